"""Streaming queries, driven to their end over the tables as file streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir
from ..sources.tables import table
from .sessions import sessions


def session_state_stream(spark: SparkSession, d: str, files_per_trigger: int | None = None) -> DataFrame:
    """The final state of every conversation, replayed as a stream of messages; three messages are kept.

    A batch's states are written by its number, so that a batch that is run again replaces them; of a session's
    states the last batch's counts.
    """
    schema = table(spark, d, "conversations").schema
    path = f"{d}/conversations.parquet"
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    source = reader.parquet(path if _is_folder(spark, path) else f"{d}/conversations*.parquet")
    events = source.select(
        F.col("conv_id").cast("string").alias("user_id"), F.col("turn").alias("seq"), F.when(F.col("role") == "system", "clear").otherwise("message").alias("type"), "role", "text",
        F.when(F.col("role") == "system", F.col("text")).alias("system_prompt"),
    )
    run = f"{shared_dir(spark)}/sessions-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{run}/out/batch={number}")

    query = sessions(events, 3).writeStream.outputMode("update").option("checkpointLocation", f"{run}/state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.schema("user_id string, n_messages int, system_prompt string, last_text string, history string, summary string, batch long").parquet(f"{run}/out")
    last = got.groupBy("user_id").agg(F.max_by(F.struct("n_messages", "system_prompt", "last_text"), "batch").alias("s"))
    return last.select(F.col("user_id").cast("long").alias("conv_id"), F.col("s.n_messages").cast("long").alias("n_messages"), "s.system_prompt", "s.last_text")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


QUERIES = {"session_state_stream": session_state_stream}
SQL = {
    "session_state_stream": """
WITH s AS (SELECT conv_id, text FROM conversations WHERE role = 'system'), m AS (SELECT conv_id, count(*) AS n, max_by(text, turn) AS last FROM conversations WHERE role <> 'system' GROUP BY conv_id)
SELECT m.conv_id, least(n, 3) AS n_messages, s.text AS system_prompt, last AS last_text FROM m LEFT JOIN s ON s.conv_id = m.conv_id"""
}
