"""Quality by perplexity under a Kneser-Ney model of trusted text, with sharded count joins.

An interpolated model's log-probability of a text is a sum over its words and word pairs:
each word has a weight (its own probability, and its backoff as a context), each known pair
a correction. So scoring is a join of the texts' pairs with the model's counts, and a sum:

1. The model is counted on all trusted documents but those that set the quantiles. Its
   counts stay where training wrote them, in shards by the range of the context. The
   corrections of the most frequent pairs (HEAD, or more of a large model) and a Bloom
   filter of all pairs, of which each shard writes its own stretch, go to every task; both
   have a bounded size. A filter that is full lets more pairs through, which changes no
   result.
2. A task adds up the words' weights and the head's corrections by itself (the words'
   arrays are memory-mapped) and sends only pairs that the filter knows, as word ids in
   sorted runs by shard, so no frequent pair travels.
3. A shard's task looks its pairs up in the shard's sorted array and sums by text; the
   sums meet again by the run of texts they came from. What tells the run's texts travels
   with them, so the pairs are written once, by one shuffle.

A text is kept if its perplexity is at most the QUANTILE of its language's trusted texts
that the model did not see; languages without any use the quantile over all.
"""

from __future__ import annotations

import math
import shutil
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import sweep
from . import kneser_ney as kn
from .common import cut, mixed, table

MOST_IDS = 1_000_000  # ids to broadcast to the scan; more go through a join
ACCURACY = 10_000  # of the quantiles that bracket the exact one
HEAD, BLOOM_BITS = 300_000, 1 << 26
HEAD_SHARE, HEAD_MOST = 12, 4_000_000  # of a larger model one pair in HEAD_SHARE is in the head, up to HEAD_MOST
PAIR_BITS = 16  # of the filter, for each pair, while there are no more than BLOOM_BITS
RUN_PAIRS, RUN_TEXTS = 3_000_000, 50_000  # that a task holds before it sends them
QUANTILE = 0.995
ROW = "batch long, shard int, n long, keys binary, docs binary, ids array<long>, langs array<string>, tokens array<long>, base array<double>"
KINDS = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.float64()))
NAMES = [x.split()[0] for x in ROW.split(", ")]


class Bloom:
    """A filter of pairs; each part of the model has a stretch of it, from `start` in bits on, as its pairs are many."""

    def __init__(self, sizes: list[int], most: int):
        total = sum(sizes)
        bits = min(most, PAIR_BITS * total)
        self.start = np.array([k * bits // max(total, 1) // 8 * 8 for k in [0, *np.cumsum(sizes).tolist()]], dtype=np.int64)
        self.bits = np.zeros(int(self.start[-1]) >> 3, dtype=np.uint8)

    def _at(self, keys: np.ndarray, part: np.ndarray) -> Iterator[np.ndarray]:
        start, width = self.start[part], (self.start[part + 1] - self.start[part]).astype(np.uint64)
        for k in range(3):
            yield start + ((mixed(keys + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(32)) * width >> np.uint64(32)).astype(np.int64)

    def stretch(self, p: int) -> slice:
        return slice(int(self.start[p]) >> 3, int(self.start[p + 1]) >> 3)

    def add(self, keys: np.ndarray, p: int) -> None:
        if self.start[p + 1] > self.start[p]:
            for at in self._at(keys, np.full(len(keys), p)):
                np.bitwise_or.at(self.bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))

    def has(self, keys: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Of parts without a stretch (fewer pairs than fill a byte), all."""
        out = np.ones(len(keys), dtype=bool)
        some = np.flatnonzero(self.start[part + 1] > self.start[part])
        met = np.ones(len(some), dtype=bool)
        for at in self._at(keys[some], part[some]):
            met &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        out[some] = met
        return out


def terms(m: kn.Model, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted distinct ids (V begins a text, V + 1 is any unknown word): log10 of the word's own probability and of its backoff, its count and backoff."""
    info, V = m.info, m.V
    p1 = np.log10((m.discount(m.dense("before", ids), info["U"]) + float(np.dot(info["U"], info["u"])) / (V + 1)) / info["T"])
    total, follow = m.dense("count", ids), m.dense("follow", ids, 3)
    total[ids == V] = info["docs"]
    for k, some in info["hot_n"].items():
        at = np.searchsorted(ids, k)
        if at < len(ids) and ids[at] == k:
            follow[at] = some
    gamma = follow @ np.array(info["D"]) / np.maximum(total, 1)
    return p1, np.log10(np.where(gamma > 0, gamma, 1.0)), total, gamma


def corrections(m: kn.Model, keys: np.ndarray, c: np.ndarray) -> np.ndarray:
    """What known pairs with counts c add to the weights of their words."""
    a, b = (keys // np.uint64(m.V + 2)).astype(np.int64), (keys % np.uint64(m.V + 2)).astype(np.int64)
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    p1, back, total, gamma = terms(m, ids)
    full = m.discount(c, m.info["D"]) / np.maximum(total[a], 1) + gamma[a] * 10 ** p1[b]
    return np.log10(full) - back[a] - p1[b]


def stored(m: kn.Model, p: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of part p, sorted, and their counts."""
    keys = m.array("pair", p)
    if keys is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    c = np.asarray(m.array("pairn", p)).astype(np.int64)
    big = m.array("pairbig", p)
    if big.shape[1]:
        c[big[0]] = big[1]
    return np.asarray(keys), c


def weights(info: dict, spark: SparkSession) -> dict:
    """Write the filter; what scoring tasks need."""
    parts, folder = info["parts"], info["dir"]
    if not info["N"]:
        return {"info": info, "sizes": [0] * parts, "head": (b"", b"")}
    m = kn.Model(info)
    sizes = [0 if (x := m.array("pair", p)) is None else len(x) for p in range(parts)]
    most = min(max(HEAD, sum(sizes) // HEAD_SHARE), HEAD_MOST)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, bloom = kn.Model(info), Bloom(sizes, BLOOM_BITS)
        for batch in batches:
            for p in batch.column(0).to_pylist():
                keys, c = stored(m, p)
                bloom.add(keys, p)
                kn.save(folder, f"bloom-{p}", bloom.bits[bloom.stretch(p)])
                top = np.sort(np.argsort(-c, kind="stable")[: most // parts + 1])
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (keys[top], corrections(m, keys[top], c[top]).astype("<f4"))], names=["keys", "weights"])

    got = spark.range(0, parts, 1, parts).mapInArrow(build, "keys binary, weights binary").collect()  # `most` pairs in all
    k, w = (np.concatenate([np.frombuffer(bytes(r[c]), t) for r in got]) for c, t in (("keys", "<u8"), ("weights", "<f4")))
    order = np.argsort(k)
    return {"info": info, "sizes": sizes, "head": (k[order].tobytes(), w[order].tobytes())}


def looked_up(keys: np.ndarray, known: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether keys are known, and their values (0 where not)."""
    if not len(known):
        return np.zeros(len(keys), dtype=bool), np.zeros(len(keys))
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    met = known[at] == keys
    return met, np.where(met, value[at], 0.0)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(KINDS)], names=NAMES)


def perplexities(docs: DataFrame, w: dict, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """doc_id, lang, n_tokens, log10_prob."""
    head = docs.sparkSession.sparkContext.broadcast(w["head"])
    info, sizes = w["info"], w["sizes"]
    parts, folder, N, V = info["parts"], info["dir"], info["N"], info["V"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, bloom = kn.Model(info), Bloom(sizes, BLOOM_BITS)
        if N:
            for p in range(parts):
                bloom.bits[bloom.stretch(p)] = kn.load(folder, f"bloom-{p}")
        hk, hw = np.frombuffer(head.value[0], "<u8"), np.frombuffer(head.value[1], "<f4")
        number = TaskContext.get().partitionId() << 32
        texts_held, pairs_held, held = ([], [], [], []), 0, []

        def run() -> pa.RecordBatch:
            """What is held, and the row that tells its texts, which one shard passes on."""
            rows = [(number, number % parts, -1, None, None, *texts_held)]
            if held:
                keys, owner = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                order = np.argsort(keys)
                keys, owner = keys[order], owner[order]
                part = kn.pair_part(keys, info, m.hot)
                order = np.argsort(part, kind="stable")
                keys, owner = keys[order], owner[order]
                at = np.searchsorted(part[order], np.arange(parts + 1))
                for p in np.flatnonzero(at[1:] > at[:-1]):
                    i = slice(at[p], at[p + 1])
                    rows.append((number, int(p), int(at[p + 1] - at[p]), *kn.squeeze(keys[i], owner[i]), None, None, None, None))
            return batch_of(rows)

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, z in kn.chunks(batch):
                h, n = kn.sequences(texts[a:z], m.vocabulary.words)
                base = np.zeros(z - a)
                if N:
                    ids, at = np.unique(np.append(m.vocabulary.ids(h), V), return_inverse=True)
                    p1, back, _, _ = terms(m, ids)
                    before = kn.contexts(at[:-1], n, at[-1])
                    weight, v, b = p1[at[:-1]] + back[before], ids[before], ids[at[:-1]]
                    doc = np.repeat(np.arange(z - a), n)
                    some = np.flatnonzero((b < V) & (v <= V))  # a pair of an unknown word isn't known
                    keys = (v[some] * (V + 2) + b[some]).astype(np.uint64)
                    met, value = looked_up(keys, hk, hw)
                    weight[some] += value
                    base = np.bincount(doc, weights=weight, minlength=z - a)
                    keys, some = keys[~met], some[~met]
                    at = bloom.has(keys, kn.pair_part(keys, info, m.hot))
                    keys, some = keys[at], some[at]
                    held.append((keys, (doc[some] + len(texts_held[0])).astype(np.uint32)))
                    pairs_held += len(some)
                for x, y in zip(texts_held, (batch.column("doc_id")[a:z].to_pylist(), batch.column("lang")[a:z].to_pylist(), n.tolist(), base.tolist()), strict=True):
                    x.extend(y)
                if pairs_held >= RUN_PAIRS or len(texts_held[0]) >= RUN_TEXTS:
                    yield run()
                    number += 1
                    texts_held, pairs_held = ([], [], [], []), 0
        if texts_held[0]:
            yield run()

    def join(key: tuple, got: pa.Table) -> pa.Table:
        m, p, rows = kn.Model(info), key[0].as_py(), []
        known, c = stored(m, p) if N else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        value = corrections(m, known, c) if len(known) else np.zeros(0)
        for k in range(got.num_rows):
            r = tuple(got.column(name)[k].as_py() for name in NAMES)
            if r[2] < 0:
                rows.append(r)
                continue
            keys, owner = kn.spread(r[3], r[4], r[2])
            met, x = looked_up(keys, known, value)
            some, at = np.unique(owner[met], return_inverse=True)
            if len(some):
                sums = np.bincount(at, weights=x[met], minlength=len(some)).astype("<f4")
                rows.append((r[0], p, len(some), *kn.squeeze(some.astype(np.uint64), sums.view("<u4")), None, None, None, None))
        return pa.Table.from_batches([batch_of(rows)])

    def meet(key: tuple, got: pa.Table) -> pa.Table:
        told = got.column("n").to_pylist().index(-1)
        ids, langs, tokens, base = (got.column(name)[told].as_py() for name in NAMES[5:])
        total = np.array(base)
        for k in range(got.num_rows):
            if k != told:
                doc, sums = kn.spread(got.column("keys")[k].as_py(), got.column("docs")[k].as_py(), got.column("n")[k].as_py())
                total[doc.astype(np.int64)] += sums.view("<f4")  # a shard names a text once
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "lang": pa.array(langs, pa.string()), "n_tokens": pa.array(tokens, pa.int64()), "log10_prob": pa.array(total)})

    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    sent = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), text).mapInArrow(send, ROW)
    return sent.groupBy("shard").applyInArrow(join, ROW).groupBy("batch").applyInArrow(meet, "doc_id long, lang string, n_tokens long, log10_prob double")


def quantiles(rows: DataFrame, quantile: float) -> dict:
    """The exact quantile (the value of rank ceil(quantile * n)) of x by lang, and at None that of all rows."""
    groups = rows.select("lang", "x").unionByName(rows.select(F.lit(None).cast("string").alias("lang"), "x"))
    near = F.percentile_approx("x", [max(0.0, quantile - 2 / ACCURACY), min(1.0, quantile + 2 / ACCURACY)], ACCURACY)
    bounds = groups.groupBy("lang").agg(F.ceil(F.lit(quantile) * F.count("*")).alias("rank"), near.alias("near")).withColumnRenamed("lang", "of")
    met = cut(groups.join(F.broadcast(bounds), F.col("lang").eqNullSafe(F.col("of"))).withColumn("below", F.col("x") < F.col("near")[0]).where(F.col("x") <= F.col("near")[1]).groupBy("lang", "below", F.when(~F.col("below"), F.col("x")).alias("x")).agg(F.count("*").alias("n"), F.first("rank").alias("rank")))
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy(F.col("x").asc_nulls_first()))  # a row for all below and those of a few in ACCURACY
    got = met.withColumn("upto", upto).where(~F.col("below") & (F.col("upto") >= F.greatest("rank", F.lit(1)))).groupBy("lang").agg(F.min("x").alias("q"))
    return {r["lang"]: r["q"] for r in got.collect()}  # a row a language


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """doc_id, lang, n_tokens, log10_prob, perplexity, threshold, kept for every row of docs.

    Trusted are the documents with label 1; every fourth (by a hash of the id) sets the
    quantiles, all others train. A null text is empty. A null language counts as a
    language. Without trusted documents nothing is rejected. Repeated rows are each
    classified. An empty table gives no rows. Other columns are not read.
    """
    good = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("t_id")).where(F.col("t_id").isNotNull()).distinct()
    sets = cut(good.withColumn("sets", F.pmod(F.xxhash64("t_id"), F.lit(1_000_003)) % 4 == 0))
    training = sets.where("NOT sets").select("t_id")
    few = training.limit(MOST_IDS + 1).count() <= MOST_IDS
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    rows = docs.join(F.broadcast(training) if few else training.hint("merge"), docs[id_col] == F.col("t_id"), "left_semi").select(text)
    info = kn.train(rows)
    sweep(docs.sparkSession)  # the counts' shuffles
    try:
        scored = perplexities(docs, weights(info, docs.sparkSession), id_col, text_col, lang_col)
        found = cut(scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("log10_prob") / F.col("n_tokens"))))
    finally:
        shutil.rmtree(info["dir"], ignore_errors=True)
    setting = found.join(sets.where("sets").select("t_id"), found["doc_id"] == F.col("t_id"), "left_semi")
    limits = quantiles(setting.select(F.coalesce("lang", F.lit("")).alias("lang"), F.col("perplexity").alias("x")), quantile)
    limit = F.lit(limits.pop(None, math.inf))
    for lang, q in limits.items():
        limit = F.when(F.coalesce("lang", F.lit("")) == lang, F.lit(q)).otherwise(limit)
    out = found.withColumn("threshold", limit)
    return out.select("doc_id", "lang", "n_tokens", "log10_prob", "perplexity", "threshold", (F.col("perplexity") <= F.col("threshold")).alias("kept"))


def op3_trusted_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return classify(docs, labels)


QUERIES = {"op3_trusted_perplexity": op3_trusted_perplexity}
SQL: dict[str, str] = {}
