"""Route requests as a stream, answered by the batch plan.

Each request is answered alone, so there is no state and no watermark; what answers need of the visits is made before the
stream starts, or read anew for each batch from what a stream of visits keeps up to date.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from headway.plans import eta


def read_requests(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def answer(requests: DataFrame, base: eta.Base | Callable[[], eta.Base], path: str, checkpoint: str) -> StreamingQuery:
    """Write each batch's timeline to ``path``/batch=N; a batch that runs again replaces its own folder.

    base: prepared tables (``eta.load_base``), or what gives them for a batch: so requests meet the newest version of the sums.
    """

    def batch(rows: DataFrame, number: int) -> None:
        eta.timeline(rows, base() if callable(base) else base).select(*eta.TIMELINE).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
