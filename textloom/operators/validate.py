"""Validation with first-match reasons, duplicates, and reproducible splits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.shingles import PRIME, minhash_of
from ..plans import sql as Q
from ..sources.shared import cut
from ..sources.tables import table
from . import prefix

REASONS = ("empty", "too_short", "too_long", "encoding")
PERMS = 128
MOST_IDS = 2_000_000  # ids to broadcast
BLOCK, BLOCK_ITEMS = 2_000, 1_000_000  # about the most texts and shingles of a family's block


def reason(text: Column, least: int = 50, most: int = 3000) -> Column:
    """The first of REASONS that applies, null for a valid text."""
    n = X.word_count(text)
    return F.when(X.trimmed(F.coalesce(text, F.lit(""))) == "", "empty").when(n < least, "too_short").when(n > most, "too_long").when(F.size(X.encoding_issues(text)) > 0, "encoding")


def validation_counts(records: DataFrame, text_col: str = "text", least: int = 50, most: int = 3000) -> DataFrame:
    r = records.select(reason(F.col(text_col), least, most).alias("r"))
    return r.agg(F.count("*").alias("parsed_input"), *(F.count_if(F.col("r") == k).alias(k) for k in REASONS), F.count_if(F.col("r").isNull()).alias("valid"))


def validation_text(counts: DataFrame, name: str = "input_file") -> DataFrame:
    """report: one text of validation counts (name, parsed_input, REASONS, optionally parse_errors and duplicates_removed, valid), a paragraph a file, with totals."""
    extra = [c for c in ("parse_errors", "duplicates_removed") if c in counts.columns]
    removed = [*REASONS, *extra]
    number = lambda c: F.format_number(F.col(c), 0)
    lines = [F.concat(F.lit("File: "), F.col(name)), F.concat(F.lit("  records read: "), number("parsed_input"))]
    lines += [F.concat(F.lit(f"  {c.replace('_', ' ')}: "), number(c)) for c in removed] + [F.concat(F.lit("  records kept: "), number("valid"))]
    each = counts.select(F.col(name).alias("f"), F.array_join(F.array(*lines), "\n").alias("t"), sum((F.col(c) for c in removed), F.lit(0)).alias("r"), F.col("valid").alias("v"))
    total = F.concat(F.lit("\n\nRemoved in all: "), F.format_number(F.sum("r"), 0), F.lit("\nKept in all: "), F.format_number(F.sum("v"), 0))
    return each.agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "t"))), lambda x: x["t"]), "\n\n"), total).alias("report"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, content_hash, keeper (the least id of equal content). Hashes alone are grouped; AQE splits a hot hash in the join."""
    hashed = docs.select(id_col, X.content_hash(F.col(text_col)).alias("content_hash"))
    keepers = hashed.groupBy("content_hash").agg(F.min(id_col).alias("keeper"))
    return hashed.join(keepers, "content_hash")


def similar_pairs(docs: DataFrame, threshold: float, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """a < b, jaccard: pairs of different texts at or above threshold, exactly, by a prefix join.

    Equal texts count once, by their least id. Shingles stand in order of how many texts have
    them: two sets of similarity t share one among the first n - ceil(t n) + 1 of each. Those
    that no other text has come first and match nothing, so only what is left of these first
    ones is joined, the rare before the common; pairs of sizes too different, and those that meet
    where too few shingles are left, fall out before the sets are compared. Sets are made anew of the texts that are left.
    """
    lowered = _representatives(docs, id_col, text_col).select("id", F.lower("t").alias("t")).where(F.col("id").isNotNull() & F.col("t").isNotNull())
    firsts = cut(prefix.prefixes(lowered, threshold, size))
    a, b = (firsts.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("rest").alias(f"rest{x}"), "k") for x in "ab")
    near = F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9
    enough = F.least("resta", "restb") * (1 + threshold) >= (F.col("na") + F.col("nb")) * threshold - 1e-6
    pairs = cut(a.join(b, "k").where((F.col("a") < F.col("b")) & near & enough).select("a", "b").distinct())
    return _confirmed(lowered, pairs, firsts.select("id", "n").distinct(), threshold, size)


def _confirmed(lowered: DataFrame, pairs: DataFrame, sizes: DataFrame, threshold: float, size: int) -> DataFrame:
    """a, b, jaccard of the pairs at or above threshold. sizes: id, n of the sets.

    What pairs connect, directly or over others, is a family. A task compares the pairs of a
    bundle of small families, or those between two blocks of a large one, so that a set is sent
    once, or once for each block of its family, and not for each of its pairs.
    """
    family = cut(components(pairs).join(sizes, "id"))
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_ITEMS)).cast("int")
    bundles = int((family.agg(F.sum("n")).first()[0] or 0) // BLOCK_ITEMS + 1)
    one, c = F.col("blocks") == 1, F.xxhash64("c")
    sized = family.join(family.groupBy("c").agg(blocks.alias("blocks")), "c")
    placed = cut(sized.select("id", F.when(one, F.pmod(c, F.lit(bundles))).otherwise(c).alias("family"), "blocks", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block")))
    between = lambda x, y: [F.when(one, -1).otherwise(f(x, y)).alias(k) for k, f in (("i", F.least), ("j", F.greatest))]
    ends = [placed.withColumnsRenamed({"id": x, "block": f"block_{x}"}) for x in "ab"]
    asked = pairs.join(ends[0], "a").join(ends[1].drop("family", "blocks"), "b").select("family", *between("block_a", "block_b"), "a", "b")
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("id", "family", *between("block", "other"))
    held = prefix.sets(lowered.join(_sent(placed.select("id")), "id", "left_semi"), size).join(dealt, "id")

    def compare(key: tuple, two: pa.Table, held: pa.Table) -> pa.Table:
        s = held["s"].combine_chunks()
        items, at = s.flatten().to_numpy().view(np.uint64), np.append(0, np.cumsum(s.value_lengths().to_numpy()))
        place = {x: k for k, x in enumerate(held["id"].to_pylist())}
        partners: dict[int, list[int]] = {}
        for k, x in enumerate(two["a"].to_pylist()):
            partners.setdefault(place[x], []).append(k)
        right = np.array([place[x] for x in two["b"].to_pylist()], np.int64)
        n, jaccard = np.diff(at), np.empty(len(right))
        for x, ks in partners.items():
            own = items[at[x] : at[x + 1]]
            for k in range(0, len(ks), 64):
                ys = right[some := np.array(ks[k : k + 64])]
                theirs = np.concatenate([items[at[y] : at[y + 1]] for y in ys])
                met = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
                common = np.add.reduceat(met, np.append(0, np.cumsum(n[ys])[:-1]), dtype=np.int64)
                jaccard[some] = common / (n[x] + n[ys] - common)
        return two.select(["a", "b"]).append_column("jaccard", pa.array(jaccard)).filter(pa.array(jaccard >= threshold))

    by, kind = ("family", "i", "j"), prefix.id_type(placed)
    return asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(compare, f"a {kind}, b {kind}, jaccard double")


def _sent(ids: DataFrame) -> DataFrame:
    """ids, which are checkpointed, to be broadcast if they are few enough; texts joined with more are shuffled."""
    return F.broadcast(ids) if ids.count() <= MOST_IDS else ids


def _representatives(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, t of the documents (ids unique) that are the least of their content; only ids and hashes are grouped."""
    copies = cut(exact_duplicates(docs, id_col, text_col).where(F.col(id_col) != F.col("keeper")).select(id_col))
    return docs.join(_sent(copies), id_col, "left_anti").select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))


def lsh_pairs(docs: DataFrame, bands: int = 8, rows: int = 16, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """a < b: representatives of different texts that share a band of their signatures; not confirmed."""
    lowered = _representatives(docs, id_col, text_col).select("id", F.lower("t").alias("t")).where(F.col("t").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in prefix.texts_of(batches):
            at, keys = [], []
            for k, t in enumerate(texts):
                m = minhash_of(t, size, bands * rows)
                if m is not None:
                    at += [k] * bands
                    keys += [hashlib.md5(b"%d:" % b + m[b * rows : (b + 1) * rows].tobytes()).digest() for b in range(bands)]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int32())), pa.array(keys, pa.binary())], names=["id", "k"])

    keys = cut(lowered.mapInArrow(run, f"id {prefix.id_type(lowered)}, k binary"))
    a, b = keys.withColumnRenamed("id", "a"), keys.withColumnRenamed("id", "b")
    return a.join(b, "k").where("a < b").select("a", "b").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """id, c: the least id of each id's connected component; least labels with pointer jumping, each round checkpointed."""
    ends = cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = cut(ends.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("c")))
    while True:
        near = ends.join(label.select(F.col("id").alias("b"), "c"), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("m"))
        step = cut(label.join(near, "id").select("id", F.least("c", "m").alias("at"), F.col("c").alias("was")))
        new = cut(step.join(step.select(F.col("id").alias("at"), F.col("at").alias("c")), "at").select("id", "c", "was"))
        if not new.where("c <> was").count():
            return new.select("id", "c")
        label = new.select("id", "c")


def survivors(pairs: DataFrame, lengths: DataFrame) -> DataFrame:
    """id, dropped: a greedy scan in ascending id inside each connected component. The longer text of a pair
    stays, of equal lengths the earlier; a text once dropped drops nothing further."""
    pairs = cut(pairs.select("a", "b"))
    label = components(pairs)
    inside = pairs.join(label.select(F.col("id").alias("a"), "c"), "a")
    sized = inside.join(lengths.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(lengths.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[int]] = {}
        n: dict[int, int] = {}
        for a, b, x, y in zip(pdf.a, pdf.b, pdf.na, pdf.nb, strict=True):
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
            n[a], n[b] = x, y
        dropped: set[int] = set()
        for i in sorted(near):
            if i in dropped:
                continue
            for j in sorted(near[i]):
                if j in dropped:
                    continue
                if n[j] > n[i]:
                    dropped.add(i)
                    break
                dropped.add(j)
        return pd.DataFrame({"id": sorted(near), "dropped": [i in dropped for i in sorted(near)]})

    return sized.groupBy("c").applyInPandas(scan, "id long, dropped boolean")


def hash_sample(rows: DataFrame, key: Column, n_of) -> DataFrame:
    """rows with `taken`: those of the least keys, n_of(count) of them; rows of one key go together, so the last
    key may add some. Keys are counted by their first letters, so only the boundary's bucket of keys is ranked."""
    keyed = rows.withColumn("_k", key).withColumn("_b", F.substring("_k", 1, 3))
    counts = {r["_b"]: r["count"] for r in keyed.groupBy("_b").count().collect()}  # at most 4096 rows
    left, edge = n_of(sum(counts.values())), None
    for b in sorted(counts):
        if left < counts[b]:
            edge = b
            break
        left -= counts[b]
    if edge is None:
        return keyed.withColumn("taken", F.lit(True)).drop("_k", "_b")
    before = F.coalesce(F.sum("count").over(Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = keyed.where(F.col("_b") == edge).groupBy("_k").count().select("_k", before.alias("before")).where(F.col("before") < left).agg(F.max("_k").alias("k")).first()["k"]
    return keyed.withColumn("taken", F.col("_k") <= (last if last is not None else edge)).drop("_k", "_b")


def split(docs: DataFrame, ratio: float = 0.05, seed: int = 42, text_col: str = "text") -> DataFrame:
    """docs with is_eval: max(1, floor(n ratio)) rows, chosen by a seeded hash of the content, so that equal contents stay on one side."""
    key = F.sha2(F.concat_ws(":", F.lit(seed), X.content_hash(F.col(text_col))), 256)
    return hash_sample(docs, key, lambda n: max(1, int(n * ratio)) if n else 0).withColumnRenamed("taken", "is_eval")


def overlap(train: DataFrame, evaluation: DataFrame, text_col: str = "text") -> DataFrame:
    """Content hashes of the evaluation part that the training part also has."""
    e, t = (x.select(X.content_hash(F.col(text_col)).alias("content_hash")) for x in (evaluation, train))
    return e.distinct().join(t, "content_hash", "left_semi")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def validation_report(spark: SparkSession, d: str) -> DataFrame:
    return validation_counts(_docs(spark, d))


def validation_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.coalesce(reason(F.col("text")), F.lit("valid")).alias("reason"))


def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact_duplicates(_docs(spark, d)).select("doc_id", "content_hash", "keeper", (F.col("doc_id") != F.col("keeper")).alias("dropped"))


def near_dup_pairs_exact(spark: SparkSession, d: str) -> DataFrame:
    return similar_pairs(_docs(spark, d), 0.85)


def near_dup_pairs_70(spark: SparkSession, d: str) -> DataFrame:
    return similar_pairs(_docs(spark, d), 0.7)


def near_dedup_lsh(spark: SparkSession, d: str) -> DataFrame:
    return lsh_pairs(_docs(spark, d))


def dedup_survivors(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return survivors(similar_pairs(docs, 0.7), docs.select(F.col("doc_id").alias("id"), F.length("text").alias("n")))


def train_eval_split(spark: SparkSession, d: str) -> DataFrame:
    return split(_docs(spark, d)).select("doc_id", "is_eval")


def split_overlap_check(spark: SparkSession, d: str) -> DataFrame:
    """How many rows each side of a split has, and how many contents are on both: none, if the split is right."""
    parts = split(_docs(spark, d), 0.3)
    sides = parts.agg(F.count_if(~F.col("is_eval")).alias("n_train"), F.count_if("is_eval").alias("n_eval"))
    both = overlap(parts.where("NOT is_eval"), parts.where("is_eval")).agg(F.count("*").alias("n")).first()["n"]
    return sides.withColumn("n_overlap", F.lit(both).cast("long"))


_W = Q.words("text")
_REASON = f"""CASE WHEN {Q.trimmed("coalesce(text, '')")} = '' THEN 'empty' WHEN len({_W}) < 50 THEN 'too_short' WHEN len({_W}) > 3000 THEN 'too_long'
 WHEN contains(text, chr(0)) OR contains(text, chr(65533)) OR contains(text, '????') THEN 'encoding' END"""
_SETS = f"""
reps AS (SELECT min(doc_id) AS id, text AS t FROM documents GROUP BY text),
w AS (SELECT id, {Q.words("lower(t)")} AS w FROM reps),
s AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2),
j AS (SELECT a, b, CAST(c AS DOUBLE) / (na.n + nb.n - c) AS jaccard FROM p JOIN n na ON na.id = a JOIN n nb ON nb.id = b)"""
_SPLIT = "SELECT *, rank() OVER (ORDER BY sha256('42:' || sha256(text))) <= (SELECT greatest(1, CAST(floor(count(*) * {r}) AS BIGINT)) FROM documents) AS is_eval FROM documents"
QUERIES = {
    f.__name__: f
    for f in (validation_report, validation_reasons, exact_dedup, near_dup_pairs_exact, near_dup_pairs_70, near_dedup_lsh, dedup_survivors, train_eval_split, split_overlap_check)
}
SQL = {
    "validation_report": f"""
WITH x AS (SELECT {_REASON} AS r FROM documents)
SELECT count(*) AS parsed_input, count(*) FILTER (r = 'empty') AS empty, count(*) FILTER (r = 'too_short') AS too_short, count(*) FILTER (r = 'too_long') AS too_long,
       count(*) FILTER (r = 'encoding') AS encoding, count(*) FILTER (r IS NULL) AS valid FROM x""",
    "validation_reasons": f"SELECT doc_id, coalesce({_REASON}, 'valid') AS reason FROM documents",
    "exact_dedup": "WITH x AS (SELECT doc_id, sha256(text) AS content_hash, min(doc_id) OVER (PARTITION BY text) AS keeper FROM documents) SELECT *, doc_id <> keeper AS dropped FROM x",
    "near_dup_pairs_exact": f"WITH {_SETS.strip()} SELECT * FROM j WHERE jaccard >= 0.85::DOUBLE",
    "near_dup_pairs_70": f"WITH {_SETS.strip()} SELECT * FROM j WHERE jaccard >= 0.7::DOUBLE",
    "near_dedup_lsh": f"""
WITH {_SETS.strip()},
h AS (SELECT id, ('0x' || substr(md5(g), 1, 7))::BIGINT AS h FROM s),
m AS (SELECT id, k, min((h * (k * 7919 + 12345) + k * 104729) % {PRIME}) AS v FROM h, (SELECT unnest(range(1, {PERMS + 1})) AS k) GROUP BY id, k),
b AS (SELECT id, (k - 1) // 16 AS band, string_agg(v, ',' ORDER BY k) AS key FROM m GROUP BY id, (k - 1) // 16)
SELECT DISTINCT x.id AS a, y.id AS b FROM b x JOIN b y ON x.band = y.band AND x.key = y.key AND x.id < y.id""",
    "train_eval_split": f"SELECT doc_id, is_eval FROM ({_SPLIT.format(r='0.05::DOUBLE')})",
    "split_overlap_check": f"""WITH x AS ({_SPLIT.format(r="0.3::DOUBLE")})
SELECT count(*) FILTER (NOT is_eval) AS n_train, count(*) FILTER (is_eval) AS n_eval,
       (SELECT count(DISTINCT text) FROM x WHERE is_eval AND text IN (SELECT text FROM x WHERE NOT is_eval)) AS n_overlap FROM x""",
}
