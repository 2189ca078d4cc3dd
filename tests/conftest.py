import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (str(ROOT), os.environ.get("PYTHONPATH")) if p)
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def medium():
    return f"{DATA}/sf0.01"


def oracle(sql: str, sf_dir: str):
    """The rows of a DuckDB query over the tables of ``sf_dir``."""
    import duckdb

    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else str(p) + '/*.parquet'}'")
    return c.sql(sql).df()


def same(df, other) -> None:
    """Equal rows in any order, columns by name."""

    import pandas as pd

    def text(v) -> str:
        if v is None or v is pd.NA or v != v:
            return ""
        try:
            return f"{float(v):.6f}"
        except (TypeError, ValueError):
            return str(v)

    def rows(pdf):
        cols = sorted(pdf.columns)
        return cols, sorted(tuple(map(text, r)) for r in pdf[cols].astype(object).itertuples(index=False, name=None))

    assert rows(df.toPandas() if hasattr(df, "toPandas") else df) == rows(other)
