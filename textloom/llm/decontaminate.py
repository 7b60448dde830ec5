"""Benchmark decontamination by a broadcast set of hashed test windows; built-in functions only.

The benchmark's windows of `n` words (an item of fewer words is one window) are hashed.
While they number at most MOST_WINDOWS, the set goes into the plan as a literal hash set
and each document is scanned once, with no shuffle of its words; beyond that, hashes of
the documents' windows are joined with those of the table of windows, which needs no bound,
and only documents with hits are read again. Every hash that hits is verified word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, scanned, table

N, MIN_ITEMS, MOST_WINDOWS = 8, 2, 50_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The normalised words; a null text has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def windows(benchmark: DataFrame, n: int = N, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, size, window (array of words), h: the distinct windows of each item."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(n))
    cut = F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))
    return items.select("item_id", size.alias("size"), F.explode(F.array_distinct(cut)).alias("window")).withColumn("h", F.xxhash64("window"))


def hits(docs: DataFrame, benchmark: DataFrame, n: int = N, most: int = MOST_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, text_hash, n_words for every row of docs, repeated for each verified window (pos from 1, size, item_id; null where none)."""
    tests = windows(benchmark, n)
    known = tests.select("size", "h").limit(most + 1).collect()  # bounded by most
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.col(text_col).alias("text"))
    if len(known) > most:
        return _joined(base, tests)
    by_size: dict[int, list[int]] = {}
    for r in set(known):
        by_size.setdefault(r["size"], []).append(r["h"])

    def found(w: Column) -> Column:
        parts = [
            F.transform(
                F.filter(F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, size)).isin(hashes) & (i <= F.size(w) - size + 1)),  # noqa: B023
                lambda i: F.struct(i.alias("pos"), F.lit(size).alias("size"), F.slice(w, i, size).alias("window")),  # noqa: B023
            )
            for size, hashes in sorted(by_size.items())
        ]
        none = F.array().cast("array<struct<pos:int,size:int,window:array<string>>>")
        return F.struct(F.size(w).alias("n_words"), (F.concat(*parts) if parts else none).alias("hits"))

    # the words stand in a one-element array so that the lambda binds them once
    scan = base.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text_hash", F.transform(F.array(words_of(F.col("text"))), found)[0].alias("x"))
    rows = scan.select("row", "doc_id", "text_hash", F.col("x.n_words").alias("n_words"), F.explode_outer("x.hits").alias("hit"))
    tests = tests.select(F.col("h").alias("test_h"), "item_id", F.col("window").alias("test"))
    # at most `most` rows, checked above
    keyed = rows.withColumn("h", F.xxhash64("hit.window"))
    met = keyed.join(F.broadcast(tests), (F.col("h") == F.col("test_h")) & (F.col("hit.window") == F.col("test")), "left")
    return met.select("row", "doc_id", "text_hash", "n_words", F.when(F.col("item_id").isNotNull(), F.col("hit.pos")).alias("pos"), F.col("hit.size").alias("size"), "item_id")


def _joined(base: DataFrame, tests: DataFrame) -> DataFrame:
    """The way for benchmarks of any size: positions and hashes of windows are joined with the table's hashes, those that hit verified."""
    sizes = sorted(r["size"] for r in tests.select("size").distinct().collect())  # at most n values

    def spots(w: Column) -> Column:
        parts = [
            F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1))), lambda i: i <= F.size(w) - size + 1), lambda i: F.struct(i.alias("pos"), F.lit(size).alias("size"), F.xxhash64(F.slice(w, i, size)).alias("h")))  # noqa: B023
            for size in sizes
        ]
        return F.concat(*parts)

    words = F.array(words_of(F.col("text")))
    hashed = base.select("doc_id", "text_hash", F.explode(F.transform(words, spots)[0]).alias("x")).select("doc_id", "text_hash", F.col("x.pos").alias("pos"), F.col("x.size").alias("size"), F.col("x.h").alias("h"))
    may = hashed.join(tests.select("size", "h").distinct(), ["size", "h"], "left_semi")
    at = cut(may.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("pos", "size")).alias("at")))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])
    texts = base.join(at, same(base, at)).select(base["doc_id"], base["text_hash"], "text", "at").dropDuplicates(["doc_id", "text_hash"])
    windows = F.transform(F.array(F.struct(words[0].alias("w"), F.col("at").alias("at"))), lambda x: F.transform(x["at"], lambda y: F.struct(y["pos"].alias("pos"), y["size"].alias("size"), F.slice(x["w"], y["pos"], y["size"]).alias("window"))))[0]
    spotted = texts.select("doc_id", "text_hash", F.explode(windows).alias("x")).select("doc_id", "text_hash", F.col("x.pos").alias("pos"), F.col("x.size").alias("size"), F.col("x.window").alias("window"))
    met = spotted.withColumn("h", F.xxhash64("window")).join(tests.select("h", "window", "item_id"), ["h", "window"]).select("doc_id", "text_hash", "pos", "size", "item_id")
    counted = base.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text_hash", F.size(words[0]).alias("n_words"))
    return counted.join(met, same(counted, met), "left").select("row", counted["doc_id"], counted["text_hash"], "n_words", "pos", "size", "item_id")


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = N, min_items: int = MIN_ITEMS, most: int = MOST_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, items_sha256, spans, contaminated.

    spans lists the hit words' runs as (first, last), counted from 1. One row for every
    row of docs, repeated ones too. Null and empty texts have no
    words and no hits. An empty benchmark marks nothing. Other columns are not read.
    """
    rows = hits(docs, benchmark, n, most, id_col, text_col)
    per = rows.groupBy("row", "doc_id", "text_hash", "n_words").agg(
        F.array_sort(F.collect_set("item_id")).alias("items"),
        F.array_sort(F.collect_set(F.when(F.col("pos").isNotNull(), F.struct("pos", "size")))).alias("at"),
    )
    last = lambda x: x["pos"] + x["size"] - 1
    runs = lambda at: F.filter(
        scanned(at, F.lit(0), lambda end, x: F.greatest(end, last(x)), lambda end, x: F.struct(x["pos"].alias("pos"), end.alias("end"))), lambda x: (x["pos"] > x["end"] + 1) | (x["end"] == 0)
    )
    # a run ends where the scan stood when the next one began, the last one at the end of all
    ended = lambda y: F.transform(y["runs"], lambda x, i: F.struct(x["pos"].alias("first"), F.coalesce(F.get(y["runs"], i + 1)["end"], y["most"]).alias("last")))
    covered = F.transform(F.array(F.struct(F.transform(F.array("at"), runs)[0].alias("runs"), F.array_max(F.transform("at", last)).alias("most"))), ended)[0]
    out = per.withColumn("spans", covered)
    return out.select(
        "doc_id",
        "text_hash",
        F.col("n_words").cast("long").alias("n_words"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "spans",
        (F.size("items") >= min_items).alias("contaminated"),
    )


def without_spans(text: Column, spans: Column) -> Column:
    """text without the words that spans (first, last: disjoint, in order) name and the characters before each of them."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    tail = F.regexp_extract(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*$", 0)

    def left(x: Column) -> Column:
        n, end = F.size(x["spans"]), lambda i: F.coalesce(F.get(x["spans"], i - 1)["last"], F.lit(0))
        start = lambda i: F.coalesce(F.get(x["spans"], i)["first"], F.size(x["pieces"]) + 1)
        return F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: F.array_join(F.slice(x["pieces"], end(i) + 1, F.greatest(start(i) - end(i) - 1, F.lit(0))), "")), "")

    return F.concat(F.transform(F.array(F.struct(pieces.alias("pieces"), spans.alias("spans"))), left)[0], tail)


def op10_broadcast_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash", "spans")


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
SQL = {
    "op10_broadcast_windows": f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(w[i:i + least(len(w), 8) - 1], ' ') AS win
       FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT DISTINCT doc_id, i, dw.n AS n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS s FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
}
QUERIES = {"op10_broadcast_windows": op10_broadcast_windows}
