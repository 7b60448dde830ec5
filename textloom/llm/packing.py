"""Packing token sequences by Karmarkar-Karp multiway differencing.

One pass over the documents, no shuffle. A document's ids are cut into whole windows of
`window` ids; the rest is cut into items of at most `item` ids. Items of a block are
divided into m windows by the multiway differencing method: partial partitions, each m
sums, are kept by spread; the two of largest spread merge with opposing imbalances (the
largest sums of one meet the smallest of the other). m starts a little above the least that
could hold the items and rises whenever a sum exceeds the window.

A window's number is the task's partition number and a counter, so it is unique over the
table; a task that is run anew writes all its rows anew.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, table, trim

WINDOW, ITEM, BLOCK, END_ID = 2048, 384, 2048, 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def differencing(sizes: list[int], m: int) -> list[list[int]]:
    """Indices of sizes in m groups of near-equal sums."""
    heap: list = []
    for k, s in enumerate(sizes):
        heap.append((-s, k, [s], [[k]]))  # a partial partition lists its groups that hold anything, by falling sum
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        sums, groups = _merge(a[2], a[3], b[2], b[3], m)
        spread = sums[0] - (sums[-1] if len(sums) == m else 0)
        heapq.heappush(heap, (-spread, tick, sums, groups))
        tick += 1
    return heap[0][3] if heap else []


def _merge(s: list[int], g: list[list[int]], t: list[int], h: list[list[int]], m: int) -> tuple[list[int], list[list[int]]]:
    """The largest sums of one side meet the smallest (empty ones first) of the other."""
    over = max(0, len(s) + len(t) - m)  # so many pairs have both sides filled
    n = len(s)
    pairs = [(s[i], g[i]) for i in range(n - over)] + [(t[j], h[j]) for j in range(len(t) - over)]
    # s[n - over:] are the smallest of s; they meet the smallest of t in opposite order
    for i in range(over):
        pairs.append((s[n - over + i] + t[len(t) - 1 - i], g[n - over + i] + h[len(t) - 1 - i]))
    pairs.sort(key=lambda x: -x[0])
    return [x[0] for x in pairs], [x[1] for x in pairs]


def windows_of(sizes: list[int], window: int) -> list[list[int]]:
    """Groups of sizes, none above window, as few as differencing finds from the lower bound upwards."""
    if not sizes:
        return []
    m = max(1, -(-sum(sizes) * 201 // (200 * window)))  # half a percent above the bound, which hardly ever fits
    while True:
        groups = differencing(sizes, m)
        if max(sum(sizes[k] for k in g) for g in groups) <= window:
            return groups
        m += max(1, m // 100)


# one run of Latin letters, whose case and composition no neighbour changes, and a full stop or comma
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")
_MARKS = (".", ",")
CACHED = 150_000  # words of each of two generations


def _one_byte(t: str) -> bool:
    try:
        t.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Ids:
    """Packed ids of words parted by blanks or line ends; texts are taken many at a time so that their new words are encoded together."""

    def __init__(self, path: str, most: int = CACHED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # each task has one core; the library's threads would only wait for each other
        from tokenizers import Tokenizer, pre_tokenizers

        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # what was young before; words still in use move back
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        # the same model for words of letters that are in their normal form already
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, dtype=bool)
        for name, k in names.items():
            self.ends[k] = name.endswith("</w>")
        self.marks = {"": b"", ".": self.packed(["."])[0], ",": self.packed([","])[0]}

    def of(self, texts: list[str]) -> list[bytes]:
        out: list = []
        open_texts: list[tuple] = []
        latin, other = set(), set()
        for t in texts:
            if "<|" in t:  # names of special tokens may hold or touch blanks
                out.append(self.packed([t])[0])
                continue
            new = other
            if _one_byte(t):
                t, new = t.lower(), latin  # as the tokenizer does, each character by itself
            words = t.replace("\n", " ").split(" ")
            ids = list(map(self.young.get, words))
            if None in ids:
                gaps = [k for k, i in enumerate(ids) if i is None]
                open_texts.append((len(out), words, ids, gaps))
                new.update([words[k] for k in gaps])
                out.append(None)
            else:
                out.append(b"".join(ids))
        fresh = self.learned(latin, other)
        for at, words, ids, gaps in open_texts:
            for k in gaps:
                ids[k] = fresh[words[k]]
            out[at] = b"".join(ids)
        return out

    def learned(self, latin: set[str], other: set[str]) -> dict[str, bytes]:
        """Ids of words that are not young; latin: words of one-byte lower-case texts."""
        young, old, fresh, odd = self.young, self.old, {}, []
        marked: list[tuple[str, str, str]] = []  # word, its letters in lower case, its mark
        stems = set()
        for w in latin:
            ids = old.get(w)
            if ids is not None:
                fresh[w] = ids
            elif w.isalpha():
                stems.add(w)
            elif w[-1:] in _MARKS and w[:-1].isalpha():
                marked.append((w, w[:-1], w[-1]))
            else:
                odd.append(w)
        for w in other - latin:
            m = _PLAIN.fullmatch(w)
            if m:
                marked.append((w, m[1].lower(), m[2]))
            else:
                odd.append(w)
        stems.update(stem for _, stem, _ in marked if stem not in fresh and stem not in young)
        names = list(stems)
        fresh.update(zip(names, self.letters(names), strict=True))
        for w, stem, mark in marked:
            fresh[w] = (fresh.get(stem) or young[stem]) + self.marks[mark]
        fresh.update(zip(odd, self.packed(odd), strict=True))
        young.update(fresh)
        if len(young) > self.most:
            self.old, self.young = young, {}
        return fresh

    def letters(self, words: list[str], together: int = 2000) -> list[bytes]:
        """Words of letters alone, encoded as texts of many: each word ends with an id that says so."""
        out: list[bytes] = []
        groups = [words[k : k + together] for k in range(0, len(words), together)]
        for group, e in zip(groups, self.bare.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            z = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(z) != len(group):
                out += self.packed(group)
                continue
            whole, a = ids.tobytes(), 0
            for end in z.tolist():
                out.append(whole[a:end])
                a = end
        return out

    def packed(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def encoded(batches: Iterator[pa.RecordBatch], words: _Ids, together: int = 2_000_000) -> Iterator[tuple]:
    """Ids and packed tokens of every text, taken by about `together` characters at a time."""
    docs: list = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            docs.append(doc)
            texts.append(text)
            size += len(text)
            if size >= together:
                yield from zip(docs, words.of(texts), strict=True)
                docs, texts, size = [], [], 0
    yield from zip(docs, words.of(texts), strict=True)


def pack(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW, item: int = ITEM, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows are packed each on its own.
    An empty table gives no rows. Other columns of docs are not read.
    """
    path = tokenizer_path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, count = kept(("ids", path), lambda: _Ids(path)), TaskContext.get().partitionId(), 0
        end = np.array([END_ID], dtype="<u4").tobytes()
        rows: list[tuple] = []
        items: list[tuple] = []  # doc, start, length, checksum, doc's ids

        def flush() -> None:
            nonlocal count, items
            for group in windows_of([x[2] for x in items], window):
                at = 0
                for k in group:
                    rows.append((*items[k], (part << 40) + count, at))
                    at += items[k][2]
                count += 1
            items = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])
            rows.clear()
            return batch

        for doc, ids in encoded(batches, words):
            ids += end
            n, at = len(ids) // 4, 0
            while n - at >= window:
                rows.append((doc, at, window, zlib.crc32(ids[4 * at : 4 * (at + window)]), n, (part << 40) + count, 0))
                count, at = count + 1, at + window
            while at < n:
                size = min(item, n - at)
                items.append((doc, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), n))
                at += size
            if len(items) >= block:
                flush()
            if len(rows) >= 10_000:
                yield out()
        flush()
        yield out()
        trim()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, SCHEMA)


def op7_differencing_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op7_differencing_packing": op7_differencing_packing}
SQL: dict[str, str] = {}
