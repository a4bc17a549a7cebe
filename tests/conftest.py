import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def same():
    """Compares a DataFrame with SQL over the same tables, in any order of rows."""
    import duckdb
    import pandas as pd

    def check(df, sql, sf="/root/testdata/sf0.001"):
        c = duckdb.connect()
        for t in TABLES:
            c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
        a, b = df.toPandas(), c.execute(sql).df()
        assert sorted(a.columns) == sorted(b.columns)
        names = sorted(a.columns)

        def rows(x):
            return sorted(tuple("" if pd.api.types.is_scalar(v) and pd.isna(v) else str(pd.Timestamp(v)) if isinstance(v, pd.Timestamp) else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in x[names].astype(object).itertuples(index=False))

        assert rows(a) == rows(b)

    return check
