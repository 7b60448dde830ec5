"""Text, JSON Lines and catalogue sources, and the sinks that go with them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X


def read_texts(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """filename, text: whole files."""
    got = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern)
    return got.select(F.col("_metadata.file_name").alias("filename"), F.col("value").alias("text"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON Lines; a bad line stops the job."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_jsonl_permissive(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file_name, line_no (from 1, blank lines counted), record, is_bad. The files are read whole, so that lines have numbers."""
    parsed = T._parse_datatype_string(schema).add("_bad", T.StringType())
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.posexplode(F.split("value", "\r?\n")).alias("p", "line"))
    got = files.where(X.trimmed(F.col("line")) != "").select("file_name", (F.col("p") + 1).alias("line_no"), F.from_json("line", parsed, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    names = [f.name for f in parsed.fields if f.name != "_bad"]
    return got.select("file_name", "line_no", F.struct(*(F.col(f"r.{n}").alias(n) for n in names)).alias("record"), F.col("r._bad").isNotNull().alias("is_bad"))


def curated(files: DataFrame, name: str, n_words: Column, skip: list[str], keep: list[str] | None = None, least: int = 3000) -> DataFrame:
    """Works to keep: no numbered copy, no skip word, a keep word if any are given, and enough words. Case counts nowhere."""
    low = F.lower(F.col(name))
    out = files.where(~F.col(name).rlike("_[2-8]$") & (n_words >= least))
    for w in skip:
        out = out.where(~F.contains(low, F.lit(w.lower())))
    if keep:
        any_of = F.lit(False)
        for w in keep:
            any_of = any_of | F.contains(low, F.lit(w.lower()))
        out = out.where(any_of)
    return out


def works_of(authors: DataFrame, author: str | None = None) -> DataFrame:
    """author, label, title, url: a row a work of a catalogue (author, label, works map<title,url>), of one author if one is named."""
    some = authors if author is None else authors.where(F.col("author") == author)
    return some.select("author", "label", F.explode("works").alias("title", "url"))


def fetched(works: DataFrame, url: str, fetch: Callable[[str], bytes | None], mirrors: list[str] = ("{}",), least_words: int = 0, otherwise: str = "latin-1") -> DataFrame:
    """works with `text`: the first mirror that answers, UTF-8 or else Latin-1 (otherwise="replace": with marks for
    what is no UTF-8); null if none does. fetch is the caller's, so offline doubles fit."""
    schema = T.StructType([*works.schema.fields, T.StructField("text", T.StringType())])

    def get(u: str) -> str | None:
        for m in mirrors:
            raw = fetch(m.format(u))
            if raw is not None:
                try:
                    return raw.decode("utf-8")
                except UnicodeDecodeError:
                    return raw.decode("utf-8", "replace") if otherwise == "replace" else raw.decode("latin-1")
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(text=[get(u) for u in pdf[url]])

    out = works.mapInPandas(run, schema)
    return out.where(F.col("text").isNull() | (X.word_count(F.col("text")) >= least_words)) if least_words else out


def manifest(books: DataFrame) -> DataFrame:
    """A row a book (path, title, author, year, text): its file's safe name, ordinals where titles meet, and sizes."""
    base = X.safe_name(F.col("title"))
    k = F.row_number().over(Window.partitionBy("_base").orderBy("path"))
    n = X.word_count(F.col("text")).cast("long")
    return books.withColumn("_base", base).withColumn("_k", k).select(
        F.concat(F.when(F.col("_k") == 1, F.col("_base")).otherwise(F.concat_ws("_", "_base", "_k")), F.lit(".txt")).alias("filename"),
        F.element_at(F.split("path", "/"), -1).alias("source_file"), "title", "author", "year",
        n.alias("word_count"), F.length("text").cast("long").alias("char_count"), (n * 2).alias("token_count_estimate"), "text",
    )


def write_texts(named: DataFrame, folder: str) -> None:
    """A folder a file name, each with its text; a re-run replaces them."""
    named.select("filename", "text").write.mode("overwrite").partitionBy("filename").text(folder)


def write_json(row: DataFrame, folder: str) -> None:
    """A one-row DataFrame (nested statistics) as one JSON object."""
    row.coalesce(1).write.mode("overwrite").json(folder)


def write_jsonl(records: DataFrame, folder: str) -> None:
    """JSON Lines, characters unescaped. A new folder: what was read isn't overwritten."""
    records.write.mode("errorifexists").json(folder)
