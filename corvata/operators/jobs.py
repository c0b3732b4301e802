"""The job store as tables: queue order, recovery after a crash, revisions, and import of earlier results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def queue(jobs: DataFrame) -> DataFrame:
    """Queued jobs with their place in line, oldest first; ties by id.

    Places are counted within days and added up over them, so no task sorts the whole queue.
    """
    waiting = jobs.where("status = 'queued'").withColumn("_day", F.to_date("created_at"))
    days = waiting.groupBy("_day").agg(F.count(F.lit(1)).alias("_n"))
    before = days.select("_day", F.coalesce(F.sum("_n").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a day
    place = F.row_number().over(Window.partitionBy("_day").orderBy("created_at", "job_id"))
    return waiting.withColumn("_place", place).join(before, "_day").withColumn("place", F.col("_before") + F.col("_place")).drop("_day", "_before", "_place")


def recovered(jobs: DataFrame, journals: DataFrame) -> DataFrame:
    """Jobs as they stand after a restart.

    journals (job_id, step, committed): a publication whose last step had committed is completed, one that
    had not is undone. A job still processing goes back to the queue without error and page; one being
    cancelled is gone for good.
    """
    last = journals.groupBy("job_id").agg(F.max(F.struct("step", "committed")).alias("_last")).select("job_id", F.col("_last.committed").alias("_committed"))
    x = jobs.join(last, "job_id", "left")
    status = (
        F.when(F.col("status") == "cancelling", "aborted").when(F.coalesce("_committed", F.lit(False)), "complete").when(F.col("status") == "processing", "queued").otherwise(F.col("status"))
    )
    back = (status == "queued") & (F.col("status") == "processing")
    action = F.when(F.col("status") == "cancelling", "abort").when(F.col("_committed"), "replay").when(~F.col("_committed"), "undo").when(back, "requeue").otherwise("none")
    return x.select("job_id", status.alias("status"), F.when(back, 0).otherwise(F.col("page")).alias("page"), F.when(~back, F.col("error")).alias("error"), action.alias("action"))


def compare_and_set(current: DataFrame, writes: DataFrame, order: list[str]) -> DataFrame:
    """Which writes (key, expected, value) take effect on (key, revision, value): the first in order that expects the revision found.

    A write that takes effect raises the revision by one, so a chain of writes that each expect the
    revision before them all succeed. Adds applied and revision, the one that the write met or left.
    """
    x = writes.join(current.select("key", F.col("revision").alias("_revision")), "key", "left").withColumn("_revision", F.coalesce("_revision", F.lit(0)))
    same = Window.partitionBy("key", "expected").orderBy(*order)
    first = x.withColumn("_first", F.row_number().over(same) == 1)
    # the chain: distinct expected revisions from the current one on, without a gap and in order of arrival
    arrival = F.struct(*order)
    steps = first.where("_first and expected >= _revision").withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("expected")) - 1)
    upto = Window.partitionBy("key").orderBy("expected")
    steps = steps.withColumn("_late", F.coalesce(arrival > F.lag(arrival).over(upto), F.lit(True))).withColumn("_unbroken", F.min(((F.col("expected") == F.col("_revision") + F.col("_n")) & F.col("_late")).cast("int")).over(upto))
    won = steps.where("_unbroken = 1").select("key", "expected", *order, F.lit(True).alias("applied"))
    return writes.join(won, ["key", "expected", *order], "left").withColumn("applied", F.coalesce("applied", F.lit(False)))


def imported(history: DataFrame, jobs: DataFrame, valid: Column) -> DataFrame:
    """Earlier results that may become jobs: valid, not there already, and of one id the newest."""
    newest = Window.partitionBy("job_id").orderBy(F.desc("finished_at"), F.desc("digest"))
    fresh = history.where(valid).join(jobs.select("job_id"), "job_id", "left_anti")
    return fresh.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
