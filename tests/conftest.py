"""One local session for all tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    """A DuckDB connection with the tables as views."""
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{name}')")
    return con


def rows(found) -> list:
    """Rows of a pandas frame as sorted tuples, columns by name."""
    found = found[sorted(found.columns)]

    def plain(x):
        if hasattr(x, "tolist"):
            x = x.tolist()
        if x is None or str(x) in ("<NA>", "NaT", "nan"):
            return "~"
        return str(int(x)) if isinstance(x, float) and x == int(x) else repr(round(x, 9)) if isinstance(x, float) else str(x)

    return sorted(tuple(map(plain, r)) for r in found.itertuples(index=False))
