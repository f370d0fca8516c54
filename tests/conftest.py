from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    path = "/root/testdata/sf0.001"
    if not Path(path).exists():
        pytest.skip("test tables are not here")
    return path


@pytest.fixture(scope="session")
def duck(sf):
    """A function from SQL to rows over the test tables."""
    import duckdb

    con = duckdb.connect()
    for table in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM read_parquet('{table}')")
    return lambda sql: con.execute(sql).df()


def plain(frame):
    """A frame's rows as sorted tuples of text, columns by name."""

    def text(x):
        if x is None or str(x) == "<NA>" or x != x:
            return "None"
        return repr(0.0 if x == 0 else float(x)) if isinstance(x, float) else str(x)

    return sorted(tuple(text(x) for x in row) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="session")
def same_rows():
    return lambda a, b: sorted(a.columns) == sorted(b.columns) and plain(a) == plain(b)
