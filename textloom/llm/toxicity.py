"""Toxicity by class-conditional Kneser-Ney models with shared backoff.

Each class has discounted counts of word pairs and of words (in how many texts, as
continuation counts). A pair backs off to its second word, a word through ever shorter
beginnings; at every step a class's backoff is its own probability of the shorter form
times the share that both classes together give the longer one. STRENGTH adds mass to
every backoff, so a rare expression differs between the classes only as far as its own
counts and those of its beginnings say.

The evidence of a text is the difference of its toxic and ordinary log-likelihoods,
normalised by length: of the whole text, and of the passages of SPANS words where it is
highest. A logistic fit on a fold of the sample that the counts never saw turns these
numbers into a probability at the labels' own rate.

The models are fitted on a bounded sample: at most PER_CLASS toxic documents, those first
in an order by hash, ORDINARY times as many ordinary ones, and of each class as many as
hold CHARS characters. It is counted by Spark; only distinct words, and pairs that at
least two texts hold, meet in the task that turns counts into ratios.
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fold, mixed, table
from .kneser_ney import discounts, histogram

PER_CLASS, ORDINARY, CHARS = 4000, 3, 30_000_000
BEGINNINGS, SPANS = (4, 6, 8, 10), (2, 8, 32)
STRENGTH, PAIR_STRENGTH = 3.0, 300.0  # a word's, as a share of the class's total; a pair's, in texts
LIMIT = 0.3
CHUNK = 2_000_000  # characters scored at once
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def name_hash(form: str, size: int = 0) -> int:
    """Of a whole word, or of a beginning cut at `size` letters."""
    return xxhash.xxh3_64_intdigest(form.encode(), size)


def pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(mixed(v + np.uint64(1)) + w)


def discounted(counts: np.ndarray, n: list[int]) -> np.ndarray:
    d = np.array([0.0, *discounts(n)])
    return np.maximum(counts - d[np.minimum(counts, 3)], 0.0)


def word_probabilities(names: list[str], n: np.ndarray, strength: float = STRENGTH) -> tuple[np.ndarray, list[tuple[list[str], np.ndarray]]]:
    """names sorted, n (texts of each class that hold them): probabilities of the words by class, and of the beginnings of each size."""
    spread = (n > 0).sum(1).astype(float)  # shared by both classes: in how many of them a word occurs
    above = np.zeros(len(names), dtype=np.int64)
    p, s = np.ones((1, 2)), np.array([spread.sum()])
    levels = []
    for size in (*BEGINNINGS, None):
        forms = names if size is None else [x[:size] for x in names]
        new = np.fromiter((a != b for a, b in zip(forms, ["", *forms[:-1]], strict=True)), bool, len(forms))
        at = np.flatnonzero(new)
        here, spread_here, parent = np.add.reduceat(n, at), np.add.reduceat(spread, at), above[at]
        share = spread_here / s[parent]
        probability = np.empty(here.shape)
        for k in range(2):
            left = discounted(here[:, k], histogram(here[:, k]))
            total = max(1, here[:, k].sum())
            rest = total - left.sum() + strength * total
            probability[:, k] = (left + rest * p[parent, k] * share) / (total + strength * total)
        levels.append(([forms[i] for i in at], probability))
        above, p, s = np.cumsum(new) - 1, probability, spread_here
    return p, levels[:-1]


def pair_ratios(n: np.ndarray, totals: np.ndarray, at: np.ndarray, p: np.ndarray, strength: float = PAIR_STRENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Log ratios (toxic to ordinary) of pairs, and those of the weights of their contexts' backoff.

    n: texts by class that hold the pair; totals: by class, of all pairs of its context;
    at: which context, pairs sorted by it; p: probabilities by class of the second word.
    """
    starts = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
    both, all_pairs = n.sum(1), totals.sum(1)
    left = discounted(both, histogram(both))
    shared = p.mean(1)
    rest = (all_pairs[starts] - np.add.reduceat(left, starts))[at] if len(at) else left
    share = (left + rest * shared) / all_pairs / shared
    out, weight = [], []
    for k in range(2):
        own = discounted(n[:, k], histogram(n[:, k]))
        mass = totals[starts, k] - np.add.reduceat(own, starts) + strength if len(at) else own
        bottom = totals[:, k] + strength
        out.append((own + mass[at] * share * p[:, k]) / bottom)
        weight.append(mass / bottom[starts])
    return np.log(out[1] / out[0]), np.log(weight[1] / weight[0])


def by_key(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    return keys[order], values[order].astype(np.float32)


def build(names: list[str], n: np.ndarray, v: np.ndarray, w: np.ndarray, pairs: np.ndarray, totals: np.ndarray) -> dict:
    """Sorted hash arrays with log ratios: of words, beginnings, pairs and contexts."""
    order = np.array(sorted(range(len(names)), key=names.__getitem__), dtype=np.int64)
    names, n = [names[i] for i in order], n[order]
    p, levels = word_probabilities(names, n)
    hashes = np.fromiter(map(name_hash, names), np.uint64, len(names))
    ratio = lambda x: np.log(x[:, 1] / x[:, 0])
    below = [by_key(np.fromiter((name_hash(f, size) for f in forms), np.uint64, len(forms)), ratio(q)) for size, (forms, q) in zip(BEGINNINGS, levels, strict=True)]
    by_hash = np.argsort(hashes)
    place = by_hash[np.minimum(np.searchsorted(hashes, w, sorter=by_hash), len(hashes) - 1)]
    order = np.argsort(v, kind="stable")
    v, w, pairs, totals, place = v[order], w[order], pairs[order], totals[order], place[order]
    contexts, at = np.unique(v, return_inverse=True)
    r, weight = pair_ratios(pairs, totals, at, p[place])
    return {"words": by_key(hashes, ratio(p)), "beginnings": below, "pairs": by_key(pair_keys(v, w), r), "contexts": by_key(contexts, weight)}


def looked_up(keys: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Whether keys are known, and their values, 0 where not."""
    if not len(known[0]) or not len(keys):
        return np.zeros(len(keys), dtype=bool), np.zeros(len(keys))
    at = np.minimum(np.searchsorted(known[0], keys), len(known[0]) - 1)
    met = known[0][at] == keys
    return met, np.where(met, known[1][at], 0.0)


class Scorer:
    """Words met are remembered with their hash, ratio and weight as a context; all are forgotten when they are MOST."""

    MOST = 400_000

    def __init__(self, model: dict):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.hashes, self.ratio, self.weight = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)

    def learn(self, new: list[str]) -> None:
        h = np.fromiter(map(name_hash, new), np.uint64, len(new))
        met, r = looked_up(h, self.model["words"])
        for size, known in zip(BEGINNINGS[::-1], self.model["beginnings"][::-1], strict=True):
            at = [i for i in np.flatnonzero(~met) if len(new[i]) >= size]
            if at:
                found, value = looked_up(np.fromiter((name_hash(new[i][:size], size) for i in at), np.uint64, len(at)), known)
                r[at], met[at] = value, found
        self.ids.update(zip(new, range(len(self.ids), len(self.ids) + len(new)), strict=True))
        self.hashes, self.ratio = np.append(self.hashes, h), np.append(self.ratio, r)
        self.weight = np.append(self.weight, looked_up(h, self.model["contexts"])[1])

    def evidence(self, texts: list[str]) -> np.ndarray:
        """A row a text: the whole text's normalised ratio, those of the strongest passages of SPANS words, log(1 + words)."""
        found = [words(t) for t in texts]
        new = {w for t in found for w in t if w not in self.ids}
        if len(self.ids) + len(new) > self.MOST:
            self.forget()
            new = {w for t in found for w in t}
        self.learn(list(new))
        n = np.array([len(t) for t in found], dtype=np.int64)
        at = np.fromiter((self.ids[w] for t in found for w in t), np.int64, int(n.sum()))
        ends = np.cumsum(n)
        x = self.ratio[at]
        if len(at) > 1:
            inside = np.ones(len(at), dtype=bool)
            inside[(ends - n)[n > 0]] = False
            second = np.flatnonzero(inside)
            keys, back = np.unique(pair_keys(self.hashes[at[second - 1]], self.hashes[at[second]]), return_inverse=True)
            met, r = looked_up(keys, self.model["pairs"])
            x[second] = np.where(met[back], r[back], x[second] + self.weight[at[second - 1]])
        sums = np.append(0.0, np.cumsum(x))
        total = sums[ends] - sums[ends - n]
        out = [total / np.maximum(n, 1)]
        for span in SPANS:
            best = total.copy()  # a shorter text is one passage
            long = np.flatnonzero(n >= span)
            if len(long):
                runs = np.full(len(x) + 1, -np.inf)
                runs[: len(x) + 1 - span] = sums[span:] - sums[:-span]
                inside = np.concatenate([np.arange(a, z - span + 1) for a, z in zip((ends - n)[long], ends[long], strict=True)])
                counts = n[long] - span + 1
                best[long] = np.maximum.reduceat(runs[inside], np.cumsum(counts) - counts)
            out.append(best / span)
        return np.stack([*out, np.log1p(n)], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, scale and weights (the last is the intercept)."""
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (y - p) - ridge * np.append(w[:-1], 0)
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag([ridge] * (len(w) - 1) + [1e-6])
        w = w + np.clip(np.linalg.solve(h, g), -2, 2)
    return centre, scale, w


def probabilities(model: dict, evidence: np.ndarray) -> np.ndarray:
    centre, scale, w = model["fit"]
    return 1 / (1 + np.exp(-np.clip((evidence - centre) / scale @ w[:-1] + w[-1], -50, 50)))


def chunks(batches: Iterator[pa.RecordBatch], most: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches whose second column is text, cut where `most` characters are met."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        a = size = 0
        for k, t in enumerate(texts):
            size += len(t)
            if size >= most or k + 1 == len(texts):
                yield batch.slice(a, k + 1 - a), texts[a : k + 1]
                a, size = k + 1, 0


def counted(sample: DataFrame) -> DataFrame:
    """word, v, w, n0, n1, t0, t1: words (v, w null) and pairs (word null) with the texts that hold them; t of pairs: of all pairs of v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = words(text)
                own = list(dict.fromkeys(found))
                hashes = dict(zip(own, map(name_hash, own), strict=True))
                h = np.fromiter((hashes[w] for w in found), np.uint64, len(found))
                first = np.unique(pair_keys(h[:-1], h[1:]), return_index=True)[1]
                gaps, blank = pa.nulls(len(own), pa.int64()), pa.nulls(len(first), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), gaps, gaps, pa.array([y] * len(own), pa.int32())], names=["word", "v", "w", "y"])
                yield pa.RecordBatch.from_arrays([blank, pa.array(h[first].view(np.int64)), pa.array(h[first + 1].view(np.int64)), pa.array([y] * len(first), pa.int32())], names=["word", "v", "w", "y"])

    rows = sample.select("y", "text").mapInArrow(run, "word string, v long, w long, y int").groupBy("word", "v", "w").agg(F.sum(1 - F.col("y")).alias("n0"), F.sum("y").cast("long").alias("n1"))
    rows = cut(rows)
    of_v = Window.partitionBy("v")
    pairs = rows.where("word IS NULL").select("*", F.sum("n0").over(of_v).alias("t0"), F.sum("n1").over(of_v).alias("t1")).where("n0 + n1 > 1")
    nothing = F.lit(0).cast("long")
    return rows.where("word IS NOT NULL").select("*", nothing.alias("t0"), nothing.alias("t1")).unionByName(pairs)


def sampled(docs: DataFrame, labels: DataFrame, per_class: int, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, y, text, fit of the bounded sample, and how many labels there are of each class."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    first = lambda k, n: known.where(F.col("y") == k).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(n)
    toxic = min(per_class, counts.get(1, 0))
    named = F.broadcast(first(0, ORDINARY * max(toxic, 1)).unionByName(first(1, toxic)).distinct())  # (1 + ORDINARY) * per_class rows at most
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).join(named, "doc_id")
    one = cut(texts.groupBy("doc_id", "y", "h").agg(F.min(F.struct(F.xxhash64("text").alias("t"), "text"))["text"].alias("text")))
    order = Window.partitionBy("y").orderBy("h", "doc_id")  # rows of the bounded sample
    before = F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("text")
    room = one.select("doc_id", "y", before.alias("before"), (F.row_number().over(order) % 4 != 0).alias("fit")).where(F.col("before") < CHARS)
    return one.join(F.broadcast(room.select("doc_id", "y", "fit")), ["doc_id", "y"]).select("doc_id", "y", "text", "fit"), counts


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """A model of docs' texts and labels (doc_id, 0 or 1); rows of other labels, without id or without text are left out.

    Of rows that repeat an id the text first in an order by hash counts. Every fourth row
    of the sample calibrates; where those are of one class, all rows do. Without labelled
    texts of both classes the model is a constant, the share of label 1.
    """
    sample, counts = sampled(docs, labels, per_class, id_col, text_col, label_col)
    odds = counts.get(1, 0) / counts[0] if counts.get(0) else math.inf if counts else 0.0
    sample = cut(sample)
    there = {(r["y"], r["fit"]) for r in sample.select("y", "fit").distinct().collect()}
    if not {(0, True), (1, True)} <= there:
        return {"constant": odds / (1 + odds) if odds != math.inf else 1.0}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [pa.Table.from_batches([b]) for b in batches]
        t = pa.concat_tables(got)
        is_word = t["word"].is_valid()
        names, pairs = t.filter(is_word), t.filter(pa.compute.invert(is_word))
        two = lambda x, a, b: np.stack([x[a].to_numpy(), x[b].to_numpy()], axis=1).astype(np.int64)
        v, w = (pairs[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("v", "w"))
        model = build(names["word"].to_pylist(), two(names, "n0", "n1"), v, w, two(pairs, "n0", "n1"), two(pairs, "t0", "t1"))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # the distinct words and repeated pairs of the bounded sample
    model = pickle.loads(bytes(counted(sample.where("fit")).coalesce(1).mapInArrow(run, "model binary").first()["model"]))
    setting = sample.where("NOT fit") if {(0, False), (1, False)} <= there else sample
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch, texts in chunks(batches):
            x = scorer.evidence(texts)
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["y", "doc_id", "x"])

    rows = setting.select("doc_id", "text", "y").mapInArrow(weighed, "y int, doc_id long, x array<double>").orderBy("doc_id", "y").collect()  # a row a document of the bounded sample
    y = np.array([r["y"] for r in rows], dtype=float)
    centre, scale, w = logistic(np.array([r["x"] for r in rows]), y)
    w[-1] += math.log(odds) - math.log(y.sum() / (len(y) - y.sum()))
    return model | {"fit": (centre, scale, w)}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score for every row of docs, repeated ones too; a null text is empty.

    An empty table gives no rows. Without labelled rows of both classes the score is the
    share of the one class. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # words and pairs of the bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = None if "constant" in m else Scorer(m)
        for batch, texts in chunks(batches):
            p = np.full(len(texts), m["constant"]) if scorer is None else probabilities(m, scorer.evidence(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, score double")


def op5_shared_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score(docs, train(docs, labels.where(fold(F.col("doc_id"), 4) != 2)))
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))


QUERIES = {"op5_shared_backoff": op5_shared_backoff}
SQL: dict[str, str] = {}
