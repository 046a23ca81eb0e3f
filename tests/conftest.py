import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("OMP_NUM_THREADS", "1")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def agrees(spark):
    """Whether a query and its SQL in another engine give the same rows over the smallest tables."""
    import math

    import duckdb

    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")

    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        if isinstance(v, (int, float)):
            return f"{v + 0.0:.9g}"
        return str(v)

    def check(query, sql):
        df = query(spark, sf_dir)
        found = con.sql(sql)
        names = sorted(df.columns)
        assert names == sorted(found.columns)
        place = [found.columns.index(n) for n in names]
        got = sorted([cell(r[n]) for n in names] for r in df.collect())
        want = sorted([cell(r[i]) for i in place] for r in found.fetchall())
        assert len(got) == len(want) and got == want
        return len(got)

    return check
