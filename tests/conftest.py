import glob
import os

import duckdb
import pytest

from sievework.session import local_session

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(cores=4, shuffle_partitions=4, memory="4g", shared="file://" + str(tmp_path_factory.mktemp("shared")))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in glob.glob(DATA + "/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def plain(df):
    """Rows as sorted tuples of strings, columns by name: what both engines can be compared on."""

    def show(v):
        if v is None or v != v:
            return ""
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(map(show, v)) + "]"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)):
            return str(int(v)) if float(v).is_integer() else repr(round(float(v), 6))
        if hasattr(v, "isoformat"):
            return v.isoformat()
        return str(v)

    df = df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None)
    return sorted(tuple(map(show, r)) for r in df.itertuples(index=False, name=None))
