import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


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
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def canonical(rows):
    """Rows as sorted text, whatever the engine's types."""

    def one(x):
        if x is None or x != x:
            return "null"
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, (int, float)) or type(x).__name__ in ("Decimal", "int64", "int32", "float64"):
            return f"{float(x):.6f}"
        return str(x)

    return sorted(repr(tuple(one(x) for x in row)) for row in rows)


@pytest.fixture(scope="session")
def same(spark, sf_dir, duck):
    """Holds a query's rows against its SQL; returns how many there are."""

    def check(query, sql):
        frame = query(spark, sf_dir)
        names = sorted(frame.columns)
        got = canonical([tuple(r) for r in frame.select(*[f"`{n}`" for n in names]).collect()])
        want = canonical(duck.execute("SELECT " + ", ".join(f'"{n}"' for n in names) + f" FROM ({sql})").fetchall())
        assert got == want
        return len(got)

    return check
