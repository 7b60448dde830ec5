"""The folder that the driver and all executors share, and lineage cut there."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

SIZE_BITS = 50  # an estimate of so many bytes is too large to be sent to every task; more digits say no more


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or what setCheckpointDir named; a local session alone may do without."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    named = spark.sparkContext._jsc.sc().getCheckpointDir()
    if named.isDefined():
        return named.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "textloom-checkpoints")


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write df to the checkpoint folder and go on from there, so that lost executors cost no recomputation."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return _sized(df.checkpoint(eager))


def _sized(df: DataFrame) -> DataFrame:
    """df, which is checkpointed, with Spark's default estimate of its size if its own has more than SIZE_BITS bits.

    A checkpoint keeps the estimate of the plan it was written by, and a join's is the product of its sides'.
    So the digits double with each round of an iteration, and single numbers fill the driver.
    """
    plan = df._jdf.queryExecution().logical()
    if plan.getClass().getSimpleName() != "LogicalRDD" or plan.stats().sizeInBytes().bit_length() <= SIZE_BITS:
        return df
    jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
    nothing = jvm.scala.Option.empty()
    plan = plan.copy(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), session, nothing, nothing)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, plan), df.sparkSession)


def sweep(spark: SparkSession) -> None:
    """Collect the driver's garbage, upon which Spark drops shuffles, broadcasts and checkpoints that nothing refers to; long iterations keep its heap too calm for that."""
    gc.collect()
    spark._jvm.System.gc()
