"""The corpus pipeline from books to training and evaluation records, as one lazy plan.

Books are read, measured, cut into continuation chunks and instruction records, validated,
freed of near-duplicates and split. Only the validated records are written before the
split, because the split counts them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import analyze, records, validate
from ..sources import markup


@dataclass(frozen=True)
class Config:
    books: str
    out: str
    chunk_size: int = 2048
    overlap: int = 256
    least_words: int = 300
    most_words: int = 800
    threshold: float = 0.85
    eval_ratio: float = 0.05
    seed: int = 42
    author: str | None = None
    system_prompt: str | None = None
    valid_words: tuple[int, int] = (50, 3000)


def continuation(texts: DataFrame, cfg: Config) -> DataFrame:
    """id, kind, text of continuation chunks; texts: path, text."""
    keyed = texts.select(F.xxhash64("path").alias("doc_id"), "text")
    got = records.token_chunks(keyed, cfg.chunk_size, cfg.overlap)
    return got.select(F.xxhash64("doc_id", "chunk_idx").alias("id"), F.lit("continuation").alias("kind"), "text", F.lit(None).cast("string").alias("training"))


def instructed(texts: DataFrame, cfg: Config) -> DataFrame:
    """id, kind, text (the answer) and training string of instruction records."""
    rows = texts.select("path", "author", F.posexplode(records.passages(F.col("text"), cfg.least_words, cfg.most_words)).alias("k", "text"))
    system = records.system_prompt(F.coalesce(F.lit(cfg.author), F.col("author")), cfg.system_prompt)
    msgs = records.messages(system, records.instruction(F.col("text")), F.col("text"))
    return rows.select(F.xxhash64("path", "k", F.lit("i")).alias("id"), F.lit("instruction").alias("kind"), "text", records.training_string(msgs).alias("training"))


def run_pipeline(spark: SparkSession, cfg: Config) -> dict[str, DataFrame]:
    """books, faults, stats, totals, report, train, eval."""
    got = markup.read_fb2(spark, cfg.books)
    books = got.where(F.col("error").isNull())
    stats = analyze.document_stats(books.select("path", "text"), "path")
    everything = continuation(books, cfg).unionByName(instructed(books, cfg))
    checked = everything.withColumn("reason", validate.reason(F.col("text"), *cfg.valid_words))
    report = checked.groupBy("kind").agg(F.count("*").alias("parsed_input"), *(F.count_if(F.col("reason") == r).alias(r) for r in validate.REASONS))
    valid = checked.where("reason IS NULL").drop("reason")
    valid.write.mode("overwrite").parquet(f"{cfg.out}/valid")
    valid = spark.read.parquet(f"{cfg.out}/valid")
    unique = valid
    for kind in ("continuation", "instruction"):
        some = valid.where(F.col("kind") == kind)
        exact = validate.exact_duplicates(some, "id").where("id <> keeper").select("id")
        pairs = validate.similar_pairs(some, cfg.threshold, "id")
        dropped = validate.survivors(pairs, some.select("id", F.length("text").alias("n"))).where("dropped").select("id")
        unique = unique.join(exact.unionByName(dropped), "id", "left_anti")
    # equal contents fall on the same side: the key is the content's hash
    parts = validate.hash_sample(unique, F.sha2(F.concat_ws(":", F.lit(cfg.seed), X.content_hash(F.coalesce("training", "text"))), 256), lambda n: max(1, int(n * cfg.eval_ratio)) if n else 0)
    return {"books": books, "faults": got.where(F.col("error").isNotNull()), "stats": stats, "totals": analyze.corpus_totals(stats), "report": report, "train": parts.where("NOT taken").drop("taken"), "eval": parts.where("taken").drop("taken")}
