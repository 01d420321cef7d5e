"""Compare queries with their SQL on a data folder."""

import os
from pathlib import Path

import duckdb

DATA = Path(os.environ.get("SIFTARA_TEST_DATA", "/root/testdata/sf0.001"))


def views():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.name[:-8]} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def plain(v):
        if v is None or v != v:
            return None
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return bool(v)
        if isinstance(v, float):
            return round(v, 6)
        return int(v) if hasattr(v, "__index__") else str(v)

    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False, name=None)), key=repr)


def same(spark, con, query, sql):
    found, wanted = query(spark, str(DATA)).toPandas(), con.execute(sql).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    for c in found.columns:  # whole numbers and null may come as floats
        if str(found[c].dtype).startswith("datetime"):
            found[c], wanted[c] = found[c].astype(str), wanted[c].astype(str)
    f, w = rows(found), rows(wanted)
    loose = lambda x: [tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in r) for r in x]
    assert sorted(loose(f), key=repr) == sorted(loose(w), key=repr)
