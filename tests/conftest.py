import os
import sys
from pathlib import Path

import pandas as pd
import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    made = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


def same_rows(got, wanted) -> None:
    """Equal rows in any order, columns by name."""
    names = sorted(got.columns)
    assert names == sorted(wanted.columns)

    def shown(v):
        if pd.isna(v):
            return "None"
        if isinstance(v, float):
            return f"{v:.9g}"
        return str(v)

    rows = lambda t: sorted(tuple(map(shown, r)) for r in t[names].itertuples(index=False))
    assert rows(got) == rows(wanted)


@pytest.fixture(scope="session")
def oracle():
    import duckdb

    found = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        found.sql(f"create view {p.stem} as select * from '{p}'")
    return found
