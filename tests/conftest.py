import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return c


def rows_of(pdf):
    """Sorted rows with columns by name, values as text, so that engines' types don't matter."""
    import pandas as pd

    def form(v):
        if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
            return str([form(x) for x in v])
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, float) or type(v).__name__ in ("float64", "Decimal"):
            return str(int(v)) if float(v) == int(v) else f"{float(v):.9g}"
        return str(v)

    cols = sorted(pdf.columns)
    return cols, sorted(tuple(form(v) for v in r) for r in pdf[cols].itertuples(index=False))


@pytest.fixture(scope="session")
def same():
    return lambda a, b: rows_of(a) == rows_of(b)
