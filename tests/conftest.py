import os
import sys
from pathlib import Path

import pandas as pd
import pytest

ROOT = Path(__file__).parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    return con


def rows_of(frame) -> list[tuple]:
    """Rows of a pandas frame by sorted column names, in a comparable order."""
    names = sorted(frame.columns)

    def plain(v):
        if v is None or v is pd.NA or v != v:
            return None
        return float(v) if isinstance(v, (int, float)) or getattr(getattr(v, "dtype", None), "kind", "-") in "iufb" else v

    return sorted([tuple(plain(v) for v in row) for row in frame[names].itertuples(index=False)], key=repr)


@pytest.fixture(scope="session")
def same():
    def check(ours, theirs) -> None:
        assert sorted(ours.columns) == sorted(theirs.columns)
        assert rows_of(ours) == rows_of(theirs)

    return check
