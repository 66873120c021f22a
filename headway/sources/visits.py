"""Stop visits, splits, route indexes and model metadata as files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STOP_VISITS = (
    "trip_id string, route_id string, route_short_name string, stop_id string, stop_name string, stop_lat string, stop_lon string, stop_sequence string, "
    "scheduled_arrival_time string, day_of_week int, hour_of_day int, holiday_flag int, delay_minutes double"
)
REQUIRED = [x.split()[0] for x in STOP_VISITS.split(", ")]
ROUTE_INDEX = "route_id string, stops array<string>"


def require_columns(df: DataFrame, columns: Sequence[str] = REQUIRED) -> DataFrame:
    """``df`` itself; an error that names the missing columns."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def read_stop_visits(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Raw visits.  CSV is read with the fixed schema and a header; its columns are found by name, in any order."""
    if fmt == "csv":
        header = spark.read.option("header", True).csv(path).columns
        require_columns(spark.createDataFrame([], ", ".join(f"`{c}` string" for c in header)))
        raw = spark.read.option("header", True).schema(", ".join(f"`{c}` string" for c in header)).csv(path)
        types = dict(x.split() for x in STOP_VISITS.split(", "))
        return raw.select(*[F.col(c).try_cast(types[c]).alias(c) for c in REQUIRED])
    return require_columns(spark.read.format(fmt).load(path))


def write_splits(df: DataFrame, path: str) -> None:
    """CSV with a header, one folder per value of ``split``."""
    df.write.mode("overwrite").option("header", True).partitionBy("split").csv(path)


def save_bucketed(df: DataFrame, table: str, path: str, key: str = "trip_id", buckets: int = 64) -> DataFrame:
    """Visits in buckets of a key, as a table: splits by that key, semi-joins and joins on it don't move them again.

    buckets: choose them so that one fits an executor; a task reads one.
    """
    df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def write_route_index(index: DataFrame, path: str) -> None:
    """One JSON object per route and line."""
    index.write.mode("overwrite").json(path)


def read_route_index(spark: SparkSession, path: str) -> DataFrame:
    """Fails if there is no index at the path."""
    return spark.read.schema(ROUTE_INDEX).json(path)


def write_model_metadata(spark: SparkSession, path: str, model_type: str, features: Sequence[str], codes: DataFrame, metrics: dict[str, float]) -> None:
    """One JSON object.  codes: ``route_short_name, route_encoded``; its labels become an array in order of their codes."""
    labels = codes.agg(F.sort_array(F.collect_list(F.struct("route_encoded", "route_short_name"))).alias("x")).select(F.transform("x", lambda x: x["route_short_name"]).alias("label_encoder_classes"))
    names = F.array(*[F.lit(f.replace("_", " ").title()) for f in features])
    numbers = F.struct(*[F.lit(metrics[k]).cast("double").alias(f"test_{k}") for k in ("mae", "mse", "r2")])
    out = labels.select(F.lit(model_type).alias("model_type"), F.array(*map(F.lit, features)).alias("feature_columns"), names.alias("feature_names"), "label_encoder_classes", numbers.alias("performance"))
    out.write.mode("overwrite").json(path)
