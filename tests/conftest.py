import datetime
import os
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

import pytest  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g"}
    s = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return c


def compare(got, want) -> None:
    """Rows equal as bags, columns by name, doubles within rounding."""
    import pandas as pd

    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    columns = sorted(got.columns)
    for d in (got, want):
        for c in columns:
            if d[c].map(lambda x: isinstance(x, datetime.date)).any():
                d[c] = pd.to_datetime(d[c])
    a, b = (d[columns].sort_values(columns).reset_index(drop=True) for d in (got, want))
    for c in columns:
        if pd.api.types.is_float_dtype(a[c]) or pd.api.types.is_float_dtype(b[c]):
            pd.testing.assert_series_equal(a[c].astype(float), b[c].astype(float), check_names=False, rtol=1e-9, atol=1e-6)
        else:
            x, y = a[c].astype(object), b[c].astype(object)
            assert ((x == y) | (x.isna() & y.isna())).all(), c
