"""Contiguous shards of near-equal bytes from global prefix sums.

Rows are ordered by (hash of the text, doc_id), so equal texts stand side by side.
A range exchange deals that order out, hot texts being divided by doc_id; per-partition
totals give each partition its offset, a running sum inside the partition gives each row
its own. Shards are cut at equal byte targets. A cut that falls inside a group of equal
texts moves to the group's nearer edge if that shifts it by at most `slack` of a shard.

Only (doc_id, size, checksum, hash) travel, never the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

SLACK = 0.01


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", slack: float = SLACK) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of docs.

    A null text has size 1 and the checksum of the empty text. Repeated rows each get a
    slot of their own. A null id sorts first. An empty table gives no rows. Other columns
    of docs are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    )
    n = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.repartitionByRange(n, "h", "doc_id").withColumn("part", F.spark_partition_id()))
    # one row per partition: bounded by n
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = [
        (r["part"], r["b"] or 0, r["r"] or 0, r["bytes"])
        for r in totals.select("part", "bytes", F.sum("bytes").over(before).alias("b"), F.sum("n").over(before).alias("r")).orderBy("part").collect()
    ]
    spark = docs.sparkSession
    total = offsets[-1][1] + offsets[-1][3] if offsets else 0
    starts = F.broadcast(spark.createDataFrame([x[:3] for x in offsets], "part int, byte0 long, row0 long"))
    inside = Window.partitionBy("part").orderBy("h", "doc_id", "size", "text_crc32")
    placed = (
        ranged.join(starts, "part")
        .withColumn("first", F.col("byte0") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
        .withColumn("row", F.col("row0") + F.row_number().over(inside) - 1)
        .select("doc_id", "size", "text_crc32", "h", "first", "row")
    )
    placed = cut(placed)
    targets = [total * k // shards for k in range(1, shards)]
    edges = _edges(placed, targets, total / shards * slack)
    shard = sum((F.when(F.col("first") >= e, 1).otherwise(0) for e in edges), F.lit(0)).cast("int")
    placed = placed.withColumn("shard", shard)
    heads = F.broadcast(placed.groupBy("shard").agg(F.min("row").alias("head")))  # one row a shard
    return placed.join(heads, "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("head")).alias("slot"))


def _edges(placed: DataFrame, targets: list[int], most: float) -> list[int]:
    """The byte offsets at which shards begin, moved to edges of groups of equal texts where that is near."""
    if not targets:
        return []
    hit = placed.where(sum((F.when((F.col("first") <= t) & (F.col("first") + F.col("size") > t), 1).otherwise(0) for t in targets), F.lit(0)) > 0)
    hashes = [r["h"] for r in hit.select("h").distinct().collect()]  # at most one a target
    groups = placed.where(F.col("h").isin(hashes)).groupBy("h").agg(F.min("first").alias("a"), F.max(F.col("first") + F.col("size")).alias("z")).collect()
    out = []
    for t in targets:
        near = [e for g in groups if g["a"] <= t < g["z"] for e in (g["a"], g["z"]) if abs(e - t) <= most]
        out.append(min(near, key=lambda e: abs(e - t)) if near else t)
    return sorted(out)


def op4_prefix_sum_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op4_prefix_sum_shards": op4_prefix_sum_shards}
SQL: dict[str, str] = {}
