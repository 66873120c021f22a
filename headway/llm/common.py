"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule: blank and the control characters tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.  A folder of our own only in local mode, where driver and executors are one process."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: A session's shuffle files of one statement go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SCOPES: list[list[tuple[SparkSession, str]]] = []


def cut(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that later steps don't repeat its work.

    The shuffles behind it are dropped then, and the table when the ``scope`` ends (keep: the one around it).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    scopes = _SCOPES[:-1] if keep else _SCOPES
    if scopes:
        scopes[-1].append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope() -> Iterator[None]:
    """Tables that ``cut`` writes inside are deleted at the end, but those it is told to keep."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for spark, path in _SCOPES.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def sifted(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is, or seems to be, in ``keys``, by a Bloom filter: so a join on few keys shuffles few rows.

    The filter has a bit for each of at most 2^23 positions, so 1 MB of the plan, whatever the number of keys; with very
    many it only lets more pass.
    """
    from .url_filter import bloom

    level = bloom(keys.select(F.col(key).alias("key")), 0, 16, 3, 1 << 23)
    return rows.filter(level.holds(F.col(key))) if level else rows.filter("false")


def without(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` (never null) isn't in ``others``.

    Most are told by the filter of ``sifted``, so a few keys don't shuffle all rows; those that it holds are joined exactly.
    """
    from .url_filter import bloom

    level = bloom(others.select(F.col(key).alias("key")), 0, 16, 3, 1 << 23)
    if not level:
        return rows
    held = level.holds(F.col(key))
    return rows.filter(~held).unionAll(rows.filter(held).join(others, key, "left_anti").select(*rows.columns))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def spaced(text: Column) -> Column:
    """A text that isn't null with its words set apart by single blanks."""
    return F.btrim(F.regexp_replace(text, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " "))


def words_of(spaced_text: Column) -> Column:
    """The words of what ``spaced`` returns, as an array."""
    return F.when(spaced_text == "", F.array().cast("array<string>")).otherwise(F.split(spaced_text, " "))


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    text = F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(n))
