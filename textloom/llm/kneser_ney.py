"""Interpolated modified Kneser-Ney bigram model, counted in Spark, kept as sorted hash arrays.

Words are known by 64-bit hashes. Passes:

1. Each task counts its words, packs (hash, count) by range of hash; one reducer a range
   writes a sorted hash array and its counts into the shared folder. A word's id is its
   place in the whole order.
2. Each task counts its word pairs as v * (V + 2) + w and packs them by the range of v.
   Contexts that hold more than a range's fair share of the tokens are dealt over all
   ranges by w. A reducer writes sorted keys, counts and, for each v, how many followers
   were seen once, twice and more often; it passes on how many contexts each w has.
3. These continuation counts are summed by the range of w.

There are as many ranges as the session has shuffle partitions, or more, so that one holds
what PART_BYTES of text give. Scoring workers memory-map the arrays, so a machine's page
cache holds one copy of what is used; the files go once the scores are written. Two words would share a hash with probability (distinct words)^2 / 2^65.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, cut, fold, kept, mixed, shared_dir, table

END = 0x9E3779B97F4A7C15  # the end token's hash: no word's
FLUSH = 3_000_000  # tokens that a task holds before it sums them up
CHUNK = 2_000_000  # bytes of text scored at once
PART_BYTES = 128 << 20  # about the most text whose words or pairs meet in one range
PACKED = "kind int, part int, n long, keys binary, counts binary"


def local_path(folder: str) -> str:
    """The shared folder as a path; other stores are reached through their mount."""
    if folder.startswith("file:"):
        return "/" + folder[5:].lstrip("/")
    if "://" in folder:
        raise ValueError(f"the model's arrays are memory-mapped: mount {folder} and give spark.textloom.model.dir")
    return folder


def model_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.textloom.model.dir", None) or shared_dir(spark)
    path = f"{local_path(base)}/kn-{uuid.uuid4().hex}"
    os.makedirs(path, exist_ok=True)
    return path


def save(folder: str, name: str, x: np.ndarray) -> None:
    """A repeated task replaces the file at once, with the same content."""
    own = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        np.save(f, x)
    os.replace(own, f"{folder}/{name}.npy")


def load(folder: str, name: str) -> np.ndarray:
    x = np.load(f"{folder}/{name}.npy", mmap_mode="r")
    return x if len(x) else np.array(x)


def squeeze(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys as differences, byte planes apart; counts likewise."""
    z = zstandard.ZstdCompressor(level=1)
    planes = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return z.compress(np.ascontiguousarray(planes).tobytes()), z.compress(np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def spread(keys: bytes, counts: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    z = zstandard.ZstdDecompressor()
    k = np.frombuffer(z.decompress(keys), np.uint8).reshape(8, n).T
    c = np.frombuffer(z.decompress(counts), np.uint8).reshape(4, n).T
    return np.cumsum(np.ascontiguousarray(k).view("<u8").ravel(), dtype=np.uint64), np.ascontiguousarray(c).view("<u4").ravel()


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys.astype(np.uint64), counts.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[at], np.add.reduceat(counts.astype(np.int64), at)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    at = np.flatnonzero(np.append(len(keys) > 0, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(np.append(at, len(keys)))


class Tally:
    """Counts of 64-bit keys, summed up whenever FLUSH of them wait."""

    def __init__(self):
        self.waiting, self.n, self.keys, self.counts = [], 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        self.waiting.append(keys)
        self.n += len(keys)
        if self.n >= FLUSH:
            self.settle()

    def settle(self) -> None:
        if self.waiting:
            k, c = counted(np.concatenate(self.waiting))
            self.keys, self.counts = summed(np.concatenate([self.keys, k]), np.concatenate([self.counts, c])) if len(self.keys) else (k, c)
            self.waiting, self.n = [], 0


def packed(kind: int, part: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
    """A row for each part; keys sorted within it."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    part, keys, counts = part[order], keys[order], counts[order]
    at = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    for a, z in zip(at, [*at[1:], len(part)], strict=True):
        yield (kind, int(part[a]), int(z - a), *squeeze(keys[a:z], counts[a:z]))


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["kind", "part", "n", "keys", "counts"])


def hash_part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()  # on bytes: A-Z alone, and the six ASCII blanks


def gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    got = [spread(k.as_py(), c.as_py(), n.as_py()) for k, c, n in zip(table["keys"], table["counts"], table["n"], strict=True)]
    return summed(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))


def histogram(x: np.ndarray) -> list[int]:
    """How many are 1, 2, 3, 4."""
    return [int((x == k).sum()) for k in (1, 2, 3, 4)]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Of counts 1, 2 and above, from how many keys have counts 1 to 4."""
    if not n[0] or not n[1]:
        return 0.5, 0.75, 0.9
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n[1] / n[0]), (2, 2 - 3 * y * n[2] / n[1]), (3, 3 - 4 * y * n[3] / n[2] if n[2] else 2.0)))


class Vocabulary:
    """Ids of words by the sorted hash arrays."""

    def __init__(self, info: dict):
        self.info, self.words = info, WordHashes()
        self.base = np.array(info["base"], dtype=np.int64)
        self.sizes, self.open = np.diff(self.base), {}

    def hashes(self, p: int) -> np.ndarray:
        if p not in self.open:
            self.open[p] = load(self.info["dir"], f"hash-{p}")
        return self.open[p]

    def ids(self, h: np.ndarray) -> np.ndarray:
        """V + 1 for words unseen."""
        known, back = np.unique(h, return_inverse=True)
        out = np.full(len(known), self.info["V"] + 1, dtype=np.int64)
        part = hash_part(known, len(self.sizes))
        at = np.searchsorted(part, np.arange(len(self.sizes) + 1))
        for p in np.flatnonzero((at[1:] > at[:-1]) & (self.sizes > 0)):
            q, own = known[at[p] : at[p + 1]], self.hashes(p)
            k = np.minimum(np.searchsorted(own, q), len(own) - 1)
            out[at[p] : at[p + 1]] = np.where(own[k] == q, k + self.base[p], self.info["V"] + 1)
        return out[back]


def sequences(texts: list[bytes], words: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's end with them, and how many tokens each text has."""
    each = [words.of(tokens(t)) for t in texts]
    n = np.array([len(x) + 1 for x in each], dtype=np.int64)
    out = np.empty(int(n.sum()), dtype=np.uint64)
    at = 0
    for x in each:
        out[at : at + len(x)] = x
        out[at + len(x)] = END
        at += len(x) + 1
    return out, n


def contexts(ids: np.ndarray, n: np.ndarray, begin: int) -> np.ndarray:
    v = np.empty_like(ids)
    v[1:] = ids[:-1]
    v[np.cumsum(n) - n] = begin
    return v


def chunks(batch: pa.RecordBatch, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    sizes = np.array([len(x) for x in batch.column("text").to_pylist()], dtype=np.int64) if batch.num_rows else np.zeros(0, np.int64)
    a = held = 0
    for k, s in enumerate(sizes):
        held += s
        if held >= most:
            yield a, k + 1
            a, held = k + 1, 0
    if a < len(sizes):
        yield a, len(sizes)


def train(rows: DataFrame, parts: int | None = None) -> dict:
    """Count `text` (binary) of rows and write the model; what scoring needs to open it. Whoever calls removes its folder, `dir`."""
    spark = rows.sparkSession
    if not parts:
        size = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    folder = model_dir(spark)

    def words_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tally = WordHashes(), Tally()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, z in chunks(batch):
                tally.add(sequences(texts[a:z], words)[0])
        tally.settle()
        for row in packed(0, hash_part(tally.keys, parts), tally.keys, tally.counts):
            yield batch_of([row])

    def words_out(key: tuple, got: pa.Table) -> pa.Table:
        p = key[0].as_py()
        keys, counts = gathered(got)
        save(folder, f"hash-{p}", keys)
        save(folder, f"count-{p}", counts)
        end = counts[keys == np.uint64(END)]
        return pa.table({"part": pa.array([p], pa.int32()), "n": [len(keys)], "total": [int(counts.sum())], "docs": [int(end[0]) if len(end) else 0]})

    sizes = rows.select("text").mapInArrow(words_in, PACKED).groupBy("part").applyInArrow(words_out, "part int, n long, total long, docs long").collect()  # a row a part
    per = {r["part"]: r["n"] for r in sizes}
    base = [0, *np.cumsum([per.get(p, 0) for p in range(parts)]).tolist()]
    info = {"dir": folder, "parts": parts, "base": base, "V": base[-1], "N": sum(r["total"] for r in sizes), "docs": sum(r["docs"] for r in sizes)}
    if not info["N"]:
        return info | {"hot": [], "T": 0, "D": [0.5, 0.75, 0.9], "U": [0.5, 0.75, 0.9], "u": [0, 0, 0], "hot_n": {}}
    return info | _pairs(rows, info)


def _pairs(rows: DataFrame, info: dict) -> dict:
    spark, parts, V, folder = rows.sparkSession, info["parts"], info["V"], info["dir"]
    base = np.array(info["base"], dtype=np.int64)
    share = max(1, info["N"] // parts)

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                if base[p + 1] > base[p]:
                    hot = np.flatnonzero(load(folder, f"count-{p}") >= share) + base[p]
                    yield pa.RecordBatch.from_arrays([pa.array(hot, pa.int64())], names=["v"])

    # at most `parts` words hold such a share
    hot = sorted([r["v"] for r in spark.range(0, parts, 1, min(parts, 64)).mapInArrow(often, "v long").collect()] + ([V] if info["docs"] >= share else []))
    hot_ids = np.array(hot, dtype=np.int64)

    def pairs_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, tally = Vocabulary(info), Tally()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, z in chunks(batch):
                h, n = sequences(texts[a:z], vocabulary.words)
                w = vocabulary.ids(h)
                tally.add((contexts(w, n, V) * (V + 2) + w).astype(np.uint64))
        tally.settle()
        part = pair_part(tally.keys, info, hot_ids)
        for row in packed(0, part, tally.keys, tally.counts):
            yield batch_of([row])

    stats = "kind int, part int, n long, keys binary, counts binary, total long, ones array<long>"

    def pairs_out(key: tuple, got: pa.Table) -> pa.Table:
        p = key[0].as_py()
        keys, counts = gathered(got)
        save(folder, f"pair-{p}", keys)
        save(folder, f"pairn-{p}", np.minimum(counts, 255).astype(np.uint8))
        big = np.flatnonzero(counts >= 255)
        save(folder, f"pairbig-{p}", np.stack([big, counts[big]]).astype(np.int64))
        v, w = (keys // np.uint64(V + 2)).astype(np.int64), (keys % np.uint64(V + 2)).astype(np.int64)
        n = np.minimum(counts, 3) - 1
        own = ~np.isin(v, hot_ids)
        dense = np.zeros((base[p + 1] - base[p], 3), dtype=np.uint32)
        in_range = own & (v < V)
        np.add.at(dense, (v[in_range] - base[p], n[in_range]), 1)
        save(folder, f"follow-{p}", dense)
        k, c = counted(w.astype(np.uint64))
        rows = list(packed(1, np.searchsorted(base, k.astype(np.int64), side="right") - 1, k, c))
        ones = [*histogram(counts), len(counts)]
        for x in np.unique(v[~own | (v == V)]):
            some = np.bincount(n[v == x], minlength=3)
            rows.append((2, int(x % parts), int(x), None, some.astype("<i8").tobytes()))
        rows.append((3, p, 0, None, None))
        return pa.table(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))] + [pa.array([0] * len(rows), pa.int64()), pa.array([ones if r[0] == 3 else None for r in rows], pa.list_(pa.int64()))],
            names=["kind", "part", "n", "keys", "counts", "total", "ones"],
        )

    done = cut(rows.select("text").mapInArrow(pairs_in, PACKED).groupBy("part").applyInArrow(pairs_out, stats))

    def contexts_out(key: tuple, got: pa.Table) -> pa.Table:
        p = key[0].as_py()
        keys, counts = gathered(got)
        dense = np.zeros(base[p + 1] - base[p], dtype=np.int64)
        dense[keys.astype(np.int64) - base[p]] = counts
        save(folder, f"before-{p}", dense)
        return pa.table({"part": pa.array([p], pa.int32()), "ones": pa.array([[*histogram(dense), int((dense > 0).sum())]], pa.list_(pa.int64()))})

    before = done.where("kind = 1").select("part", "n", "keys", "counts").groupBy("part").applyInArrow(contexts_out, "part int, ones array<long>").collect()
    # one row a part, and one a frequent context and part
    tail = done.where("kind = 3").select("ones").collect()
    top = done.where("kind = 2").select("n", "counts").groupBy("n").agg(F.collect_list("counts").alias("c")).collect()
    D = np.sum([r["ones"] for r in tail], axis=0).tolist()
    U = np.sum([r["ones"] for r in before], axis=0).tolist()
    return {
        "hot": hot,
        "hot_n": {r["n"]: np.sum([np.frombuffer(bytes(c), "<i8") for c in r["c"]], axis=0).tolist() for r in top},
        "T": D[4],
        "D": list(discounts(D)),
        "U": list(discounts(U)),
        "u": [U[0], U[1], U[4] - U[0] - U[1]],
    }


def pair_part(keys: np.ndarray, info: dict, hot: np.ndarray) -> np.ndarray:
    """A pair lies in the range of its context; frequent contexts are dealt out by the whole key."""
    v = (keys // np.uint64(info["V"] + 2)).astype(np.int64)
    part = np.minimum(np.searchsorted(np.array(info["base"][1:], dtype=np.int64), v, side="right"), info["parts"] - 1)
    at = np.isin(v, hot)
    if at.any():
        part[at] = hash_part(mixed(keys[at]), info["parts"])
    return part


class Model:
    """The arrays of a trained model, memory-mapped."""

    def __init__(self, info: dict):
        self.info, self.vocabulary = info, Vocabulary(info)
        self.V, self.base, self.parts = info["V"], np.array(info["base"], dtype=np.int64), info["parts"]
        self.hot = np.array(info["hot"], dtype=np.int64)
        self.open: dict[str, np.ndarray] = {}

    def array(self, name: str, p: int) -> np.ndarray | None:
        key = f"{name}-{p}"
        if key not in self.open:
            self.open[key] = load(self.info["dir"], key) if os.path.exists(f"{self.info['dir']}/{key}.npy") else None
        return self.open[key]

    def dense(self, name: str, ids: np.ndarray, width: int = 0) -> np.ndarray:
        """The values at ids (0 for those past V), from arrays cut as the vocabulary is; ids sorted."""
        out = np.zeros((len(ids), width) if width else len(ids), dtype=np.int64)
        at = np.searchsorted(ids, self.base)
        for p in np.flatnonzero(at[1:] > at[:-1]):
            x = self.array(name, p)
            if x is not None and len(x):
                out[at[p] : at[p + 1]] = x[ids[at[p] : at[p + 1]] - self.base[p]]
        return out

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """keys sorted and distinct."""
        out = np.zeros(len(keys), dtype=np.int64)
        part = pair_part(keys, self.info, self.hot)
        for p in np.unique(part):
            x = self.array("pair", p)
            if x is None or not len(x):
                continue
            at = np.flatnonzero(part == p)
            q = keys[at]
            k = np.minimum(np.searchsorted(x, q), len(x) - 1)
            met = x[k] == q
            c = np.where(met, self.array("pairn", p)[k], 0).astype(np.int64)
            big = self.array("pairbig", p)
            if big.shape[1] and (c == 255).any():
                over = c == 255
                c[over] = big[1][np.searchsorted(big[0], k[over])]
            out[at] = c
        return out

    def discount(self, c: np.ndarray, d: list[float]) -> np.ndarray:
        return np.maximum(c - np.where(c == 0, 0.0, np.where(c == 1, d[0], np.where(c == 2, d[1], d[2]))), 0.0)

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text: tokens, known tokens, base score, the model's log10 probability."""
        h, n = sequences(texts, self.vocabulary.words)
        starts, N, V = np.cumsum(n) - n, self.info["N"], self.V
        if not N:
            return n, np.zeros_like(n), np.zeros(len(n)), np.zeros(len(n))
        w = self.vocabulary.ids(h)
        v = contexts(w, n, V)
        ids, back = np.unique(w, return_inverse=True)
        c = self.dense("count", ids)
        base = np.log10((c + 0.5) / (N + 0.5 * (V + 1)))[back]
        known = (c > 0)[back]
        u = self.info["u"]
        rest = float(np.dot(self.info["U"], u))
        p1 = ((self.discount(self.dense("before", ids), self.info["U"]) + rest / (V + 1)) / self.info["T"])[back]
        ctx, cback = np.unique(v, return_inverse=True)
        total, follow = self.dense("count", ctx), self.dense("follow", ctx, 3)
        total[ctx == V] = self.info["docs"]
        for k, x in enumerate(ctx):
            if int(x) in self.info["hot_n"]:
                follow[k] = self.info["hot_n"][int(x)]
        gamma = follow @ np.array(self.info["D"])
        keys, kback = np.unique((v * (V + 2) + w).astype(np.uint64), return_inverse=True)
        cc = self.discount(self.pair_counts(keys), self.info["D"])[kback]
        total, gamma = total[cback].astype(float), gamma[cback]
        p = np.where(total > 0, (cc + gamma * p1) / np.maximum(total, 1), p1)
        sums = lambda x: np.add.reduceat(x, starts)
        return n, sums(known.astype(np.int64)), sums(base), sums(np.log10(p))


def score(docs: DataFrame, trained: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of docs, learned from `trained`.

    A null text is empty: its only token is the end. Repeated rows are scored each. Without
    training rows every probability is 1. An empty table gives no rows. Other columns are
    not read. The scores are written before this returns, and the model's files removed.
    """
    as_bytes = F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    info = train(trained.select(as_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = kept(("model", info["dir"]), lambda: Model(info))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, z in chunks(batch):
                n, known, base, s = m.score(texts[a:z])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:z], pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(z - a, info["N"]), pa.int64()), pa.array(base), pa.array(s)], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes).mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    try:
        return cut(scored)
    finally:
        shutil.rmtree(info["dir"], ignore_errors=True)


def op6_kneser_ney_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 5) == 1
    out = score(docs, docs.where(~held))
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op6_kneser_ney_scores": op6_kneser_ney_scores}
SQL: dict[str, str] = {}
