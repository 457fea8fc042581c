import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    own = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    own.sparkContext.setLogLevel("ERROR")
    yield own
    own.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(x):
    """A value as both engines give it: numbers to nine digits, NaN as null."""
    import decimal

    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (float, decimal.Decimal)):
        return None if x != x else float(f"{float(x):.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return x


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    def check(query, sql, d=DATA):
        df = query(spark, d)
        names = sorted(df.columns)
        got = [tuple(plain(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect()]
        own = duck.execute(sql)
        order = sorted(range(len(own.description)), key=lambda i: own.description[i][0])
        assert names == [own.description[i][0] for i in order]
        want = [tuple(plain(r[i]) for i in order) for r in own.fetchall()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))

    return check
