import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def value(v):
    """A value as both engines are compared by it."""
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if hasattr(v, "item"):
        return value(v.item())
    return tuple(map(value, v)) if isinstance(v, (list, tuple)) else v


def rows(df, columns):
    return sorted((tuple(map(value, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)


def sql_rows(duck, sql, columns):
    r = duck.sql(sql)
    assert sorted(r.columns) == sorted(columns)
    return sorted((tuple(map(value, x)) for x in r.select(*[f'"{c}"' for c in columns]).fetchall()), key=repr)
