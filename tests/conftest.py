import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, os.environ.get("PYTHONPATH", "")) if p)
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(value):
    """A value as text, alike for both engines."""
    if value is None:
        return "-"
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return str(value)


@pytest.fixture(scope="session")
def same_as_sql(spark):
    import duckdb

    sf_dir = f"{DATA}/sf0.001"
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from '{path}'")

    def compare(query, sql):
        frame = query(spark, sf_dir)
        names = sorted(frame.columns)
        ours = sorted(tuple(plain(row[n]) for n in names) for row in frame.collect())
        result = connection.execute(sql)
        found = [d[0] for d in result.description]
        assert sorted(found) == names
        theirs = sorted(tuple(plain(row[found.index(n)]) for n in names) for row in result.fetchall())
        assert ours == theirs

    return compare
