"""Language identification by cross-parsing against suffix automata.

For each language the automaton of a bounded sample of its labelled text recognises
exactly the sample's substrings. A text is parsed greedily: each phrase is the longest
match from where the last one ended, plus the letter that broke it. The language whose
sample needs the fewest phrases wins; counts are normalised by the parsed letters.

Texts are folded to letters (with their marks) and single blanks. Whole texts are parsed;
so that numpy steps through many places at once, they are laid out in blocks of BLOCK
letters which all start at the root. Then each block is parsed again from the state that
the block before it ended in, until both parses break at the same letter, from which on
they agree; blocks whose end changes hand it on. The phrases are those of the unblocked
parse.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fold, kept, table

SAMPLE_DOCS, SAMPLE_CHARS = 64, 60_000  # bounds of a language's sample
BLOCK, BATCH_CHARS = 128, 500_000
DENSE = 16_000_000  # cells of a language's table of transitions; larger ones are kept as sorted keys
UNKNOWN = "und"
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def folded(text: str) -> str:
    """Letters and marks in lower case and single blanks; empty without a letter (Unicode category L)."""
    plain = _OTHER.sub(" ", text.lower()).strip()
    return plain if _LETTER.search(plain) else ""


class Automaton:
    """Suffix automaton of a text of small symbol numbers from 1; 0 is no state and no symbol, 1 the root."""

    def __init__(self, symbols: list[int], width: int, dense: int = DENSE):
        follow: list[dict[int, int]] = [{}, {}]
        link, size = [0, 0], [0, 0]
        last = 1
        for c in symbols:
            new = len(follow)
            follow.append({})
            size.append(size[last] + 1)
            link.append(0)
            p = last
            while p and c not in follow[p]:
                follow[p][c] = new
                p = link[p]
            if not p:
                link[new] = 1
            else:
                q = follow[p][c]
                if size[q] == size[p] + 1:
                    link[new] = q
                else:
                    twin = len(follow)
                    follow.append(dict(follow[q]))
                    size.append(size[p] + 1)
                    link.append(link[q])
                    while p and follow[p].get(c) == q:
                        follow[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        self.width = width
        at = np.array([s * width + c for s, f in enumerate(follow) for c in f], dtype=np.int64)
        to = np.array([t for f in follow for t in f.values()], dtype=np.int32)
        self.table = self.keys = None
        if len(follow) * width <= dense:
            self.table = np.zeros(len(follow) * width, dtype=np.int32)
            self.table[at] = to
        else:  # at most three transitions a letter of the sample
            order = np.argsort(at)
            self.keys, self.to = at[order], to[order]

    def step(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The states after the symbols; 0 where there is none."""
        at = state.astype(np.int64) * self.width + symbols
        if self.table is not None:
            return self.table[at]
        if not len(self.keys):
            return np.zeros(len(state), dtype=np.int32)
        k = np.minimum(np.searchsorted(self.keys, at), len(self.keys) - 1)
        return np.where(self.keys[k] == at, self.to[k], 0)


class Languages:
    """Automata of all languages, each over its own letters. In the common code 0 pads and 1 is a letter of no sample."""

    def __init__(self, samples: dict[str, str], dense: int = DENSE):
        self.names = sorted(samples)
        letters = sorted(set("".join(samples.values())))
        self.code = np.ones(0x110000, dtype=np.uint8 if len(letters) < 250 else np.uint16 if len(letters) < 65_000 else np.uint32)
        for i, c in enumerate(letters):
            self.code[ord(c)] = i + 2
        self.own, self.automata = [], []
        for name in self.names:
            text = self.code[np.frombuffer(samples[name].encode("utf-32-le"), dtype=np.uint32)]
            used, symbols = np.unique(text, return_inverse=True)
            own = np.zeros(len(letters) + 2, dtype=np.int32)  # letters of other languages are no symbol
            own[used] = np.arange(1, len(used) + 1)
            self.own.append(own)
            self.automata.append(Automaton((symbols + 1).tolist(), len(used) + 1, dense))

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each folded text: phrases needed by each language, and letters parsed."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        rows = -(-sizes // BLOCK)
        grid = np.zeros((int(rows.sum()), BLOCK), dtype=self.code.dtype)
        owner = np.repeat(np.arange(len(texts)), rows)
        codes = self.code[np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)]
        at = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat((np.cumsum(rows) - rows) * BLOCK, sizes)
        grid.ravel()[at] = codes
        columns = np.ascontiguousarray(grid.T)
        first = np.append(True, owner[1:] != owner[:-1]) if len(owner) else np.zeros(0, bool)
        out = np.zeros((len(texts), len(self.names)), dtype=np.int64)
        for k, (own, automaton) in enumerate(zip(self.own, self.automata, strict=True)):
            np.add.at(out[:, k], owner, _parsed(automaton, own, columns, first))
        return out, sizes


def _parsed(automaton: Automaton, own: np.ndarray, columns: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Phrases that end in each block (a column of `columns`), of the parse that runs on from block to block of a text."""
    n = columns.shape[1]

    def step(state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        after = automaton.step(state, own[c])
        broken = after == 0
        return np.where(broken, 1, after), broken, broken & ((c > 0) | (state > 1))  # a letter, or the text's end inside a phrase

    state = np.ones(n, dtype=np.int32)
    breaks, so_far = np.zeros(columns.shape, dtype=bool), np.zeros(columns.shape, dtype=np.int16)
    count = np.zeros(n, dtype=np.int64)
    for i, c in enumerate(columns):
        state, breaks[i], ended = step(state, c)
        count += ended
        so_far[i] = count
    alone, alone_end, end = count.copy(), state.copy(), state.copy()
    todo = np.flatnonzero(~first)
    todo = todo[end[todo - 1] > 1]
    while len(todo):
        at, state, done = todo, end[todo - 1], np.zeros(len(todo), dtype=np.int64)
        new = end.copy()
        new[todo] = alone_end[todo]
        for i in range(len(columns)):
            state, broken, ended = step(state, columns[i, at])
            done += ended
            met = broken & breaks[i, at]
            if met.any():
                count[at[met]] = done[met] + alone[at[met]] - so_far[i, at[met]]
                at, state, done = at[~met], state[~met], done[~met]
                if not len(at):
                    break
        count[at], new[at] = done, state
        changed = todo[new[todo] != end[todo]]
        end = new
        todo = changed[changed + 1 < n] + 1
        todo = todo[~first[todo]]
    last = np.append(first[1:], True) if n else first
    return count + (last & (end > 1))


def samples_of(labelled: DataFrame, docs_most: int = SAMPLE_DOCS, chars_most: int = SAMPLE_CHARS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, str]:
    """Per language the folded whole texts first in an order by hash of id and text, until either bound is met; the last text is cut at chars_most.

    Rows per language are counted first, so that only a share by hash, of about
    4 * docs_most rows a language, leaves the scan; rows that repeat id and text count once.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = rows.groupBy(F.col("lang").alias("c_lang")).count()
    share = F.broadcast(counts.select("c_lang", (F.lit(4.0 * docs_most * 2**40) / F.col("count")).alias("limit")))  # a row a language
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text")).join(share, F.col("lang") == F.col("c_lang"))
    few = rows.where(F.col("h").bitwiseAND(F.lit(2**40 - 1)) < F.col("limit")).groupBy("lang", "h").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("h")
    picked = few.withColumn("r", F.row_number().over(order)).where(F.col("r") <= docs_most)
    out: dict[str, str] = {}
    for r in cut(picked).orderBy("lang", "r").toLocalIterator():  # docs_most texts a language
        have = out.setdefault(r["lang"], "")
        if len(have) < chars_most:
            out[r["lang"]] = (have + " " + folded(r["text"])).strip()[:chars_most]
    return {k: v for k, v in out.items() if v}


def identify(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, text_hash, lang_pred, score, phrases_per_letter, n_letters (with single blanks), for every row of docs, learned from `labelled`.

    score is how far the best language's phrases lie below the second's, as a share: 0 for
    a tie (the name first in order wins), and null texts and texts without
    a letter are UNKNOWN with score 0, as is every text if nothing could be learned. With a
    single language the score is 1. Repeated rows are each identified. An empty table gives
    no rows. Other columns are not read.
    """
    samples = samples_of(labelled, id_col=id_col, text_col=text_col, lang_col=lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(samples)  # SAMPLE_CHARS a language
    key = hash(tuple(sorted(samples.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = kept(("languages", key), lambda: Languages(shared.value))

        def answer(ids: list, hashes: list[int], texts: list[str]) -> pa.RecordBatch:
            plain = [folded(t) for t in texts]
            names, scores, rates, sizes = [UNKNOWN] * len(ids), np.zeros(len(ids)), np.zeros(len(ids)), np.array([len(t) for t in plain], dtype=np.int64)
            if languages.names:
                counts, sizes = languages.phrases(plain)
                best = counts.argmin(1)
                ranked = np.sort(counts, axis=1)
                gap = 1 - ranked[:, 0] / np.maximum(ranked[:, 1], 1) if ranked.shape[1] > 1 else np.ones(len(ids))
                has = sizes > 0
                scores = np.where(has, gap, 0.0)
                rates = np.where(has, ranked[:, 0] / np.maximum(sizes, 1), 0.0)
                names = [languages.names[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(names, pa.string()), pa.array(scores), pa.array(rates), pa.array(sizes, pa.int64())], names=["doc_id", "text_hash", "lang_pred", "score", "phrases_per_letter", "n_letters"])

        ids: list = []
        hashes: list[int] = []
        texts: list[str] = []
        held = 0
        for batch in batches:
            for i, h, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                ids.append(i)
                hashes.append(h)
                texts.append(t)
                held += len(t)
                if held >= BATCH_CHARS:
                    yield answer(ids, hashes, texts)
                    ids, hashes, texts, held = [], [], [], 0
        if ids:
            yield answer(ids, hashes, texts)

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(run, "doc_id long, text_hash long, lang_pred string, score double, phrases_per_letter double, n_letters long")


def op8_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, docs.where(fold(F.col("doc_id"), 4) != 2))
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_cross_parsing": op8_cross_parsing}
SQL: dict[str, str] = {}
