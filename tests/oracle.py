"""Compares a registered query with its DuckDB SQL, row by row."""

import glob
import math
import os

import duckdb


def rows_of(frame):
    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 9)
        if hasattr(v, "tolist"):
            return v.tolist()
        return v

    return sorted((repr([plain(r[c]) for c in sorted(r)]) for r in frame))


def compare(spark, sf_dir, function, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p).split(".")[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{p}')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = [dict(zip(names, r)) for r in cur.fetchall()]
    df = function(spark, sf_dir)
    got = [r.asDict() for r in df.collect()]
    assert sorted(df.columns) == sorted(names), (sorted(df.columns), sorted(names))
    a, b = rows_of(got), rows_of(want)
    assert len(a) == len(b), (len(a), len(b))
    assert a == b, [x for x in zip(a, b) if x[0] != x[1]][:3]
