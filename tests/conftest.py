import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(value):
    """A value in a form that is the same from both engines."""
    if value is None:
        return "~"
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


@pytest.fixture(scope="session")
def duck():
    import os

    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f.split('.')[0]} as select * from '{folder}/{f}'")
    return con


@pytest.fixture(scope="session")
def same_as_sql(spark, duck):
    """Compare a query with its SQL on the smallest tables."""

    def compare(query, sql):
        df = query(spark, "/root/testdata/sf0.001")
        names = sorted(df.columns)
        cursor = duck.execute(sql)
        found = [d[0] for d in cursor.description]
        assert sorted(found) == names
        want = sorted(tuple(plain(r[found.index(c)]) for c in names) for r in cursor.fetchall())
        got = sorted(tuple(plain(v) for v in r) for r in df.select(names).collect())
        assert got == want

    return compare
