"""Visits as a stream: delay sums kept up to date, by versions, for the request stream to read.

Visits come as files, in any order and some of them twice.  A watermark on the time they were seen at bounds what the stream
remembers: ids of visits, to drop those that come again, and the open sums of each day of service and slot.  A visit that comes
later than ``lateness`` behind the latest one is dropped, so choose that as long as files may lag.

Each batch writes the new sums of the groups that it has changed, as version N.  The sums of a version are those of each group's
last change up to it, so a reader that names a version gets the same sums however often it asks, while the stream goes on; a
batch that runs again after a failure replaces its own version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from headway.operators import clean
from headway.operators.baseline import SLOT, sums_of_days
from headway.sources.shared import CLEANUP, settings


def read_visits(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Raw visits with ``service_day``, ``seen_at`` and ``visit_id`` as a stream of files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def delay_sums(raw: DataFrame, lateness: str) -> DataFrame:
    """The stream of delay sums by day and slot; a visit counts once, however often it comes within the watermark."""
    rows = clean.clean_stop_visits(raw).select("visit_id", "seen_at", "service_day", *SLOT, "delay_minutes")
    visits = rows.withWatermark("seen_at", lateness).dropDuplicatesWithinWatermark(["visit_id"])
    # The end of the day's window lets the state of a day go; the day itself may be longer than the window.
    day = F.window("seen_at", "1 day")
    return visits.groupBy(day, "service_day", *SLOT).agg(F.sum("delay_minutes").alias("total"), F.count("delay_minutes").alias("n"), F.count("stop_id").alias("visits"))


def keep_sums(raw: DataFrame, path: str, checkpoint: str, lateness: str, tasks: int | None = None) -> StreamingQuery:
    """Write each batch's changed sums to ``path``/version=N.

    tasks: parts of the state, set when the stream first starts (the session's number of shuffle partitions by default).  Of the
    state's files only those stay that the last two batches need; versions of the sums are all kept.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows.select(F.col("window.start").alias("day"), "service_day", *SLOT, "total", "n", "visits").write.mode("overwrite").parquet(f"{path}/version={number}")

    held = {CLEANUP: "true", "spark.sql.streaming.minBatchesToRetain": "2"} | ({"spark.sql.shuffle.partitions": str(tasks)} if tasks else {})
    with settings(raw.sparkSession, held):  # a stream keeps the settings with which it starts
        return delay_sums(raw, lateness).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_version(spark: SparkSession, path: str) -> int:
    """The newest version that is complete."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath() for f in files.listStatus(where)]
    return max(int(p.getName().split("=")[1]) for p in found if p.getName().startswith("version=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def sums_at(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """``partial_sums`` of all visits up to a version (the newest by default)."""
    version = latest_version(spark, path) if version is None else version
    rows = spark.read.parquet(path).filter(F.col("version") <= version)
    last = rows.groupBy("day", "service_day", *SLOT).agg(F.max_by(F.struct("total", "n", "visits"), "version").alias("s"))
    return sums_of_days(last.select(*SLOT, "s.total", "s.n", "s.visits"))


def compact(spark: SparkSession, path: str, target: str, version: int | None = None) -> None:
    """Write the sums of a version as one table, so that readers needn't go through all versions before it."""
    version = latest_version(spark, path) if version is None else version
    sums_at(spark, path, version).write.mode("overwrite").parquet(target)
