import math
import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from loomgraph.session import local_session

    shared = tmp_path_factory.mktemp("shared")
    return local_session(
        4,
        spark__sql__shuffle__partitions="4",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
        spark__checkpoint__dir=f"file://{shared}",
    )


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return str(v)[:26] if hasattr(v, "isoformat") else v


@pytest.fixture(scope="session")
def same_as_oracle(spark):
    """Compares a query with its SQL over one data folder: equal column names and equal rows in any order."""

    def compare(query, sql, folder):
        con = duckdb.connect()
        for name in os.listdir(folder):
            path = f"{folder}/{name}" + ("/*.parquet" if os.path.isdir(f"{folder}/{name}") else "")
            con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}'")
        df = query(spark, folder)
        names = sorted(df.columns)
        cur = con.execute(sql)
        found = [d[0] for d in cur.description]
        assert sorted(found) == names
        want = sorted(repr(tuple(plain(r[found.index(c)]) for c in names)) for r in cur.fetchall())
        got = sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
        assert len(got) == len(want)
        assert got == want

    return compare
