import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tidemark-tests").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "3g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def as_rows(pdf):
    """Rows in one order and one spelling of values, columns by name."""

    def plain(v):
        if v is None or (isinstance(v, float) and v != v) or str(v) in ("NaT", "<NA>"):
            return None
        if isinstance(v, bool) or str(type(v).__name__) in ("bool_", "bool"):
            return bool(v)
        if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf":
            return round(float(v), 5)
        return str(v)

    columns = sorted(pdf.columns)
    return columns, sorted((tuple(plain(v) for v in row) for row in pdf[columns].itertuples(index=False)), key=str)


def check_query(spark, duck, fn, sql):
    got, want = as_rows(fn(spark, SMALL).toPandas()), as_rows(duck.execute(sql).df())
    assert got[0] == want[0]
    assert got[1] == want[1]
