"""Spark-vs-DuckDB parity check, shaped like the driver's correctness gate.

Compares row count, column names (sorted), and an order-insensitive
multiset of normalised row values.

    python tests/parity.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v if os.environ.get("PARITY_EXACT") else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v) if os.environ.get("PARITY_EXACT") else round(float(v), 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


SPARK_TO_DUCK = {
    "LongType": "BIGINT",
    "IntegerType": "INTEGER",
    "DoubleType": "DOUBLE",
    "FloatType": "FLOAT",
    "StringType": "VARCHAR",
    "DateType": "DATE",
    "BooleanType": "BOOLEAN",
    "TimestampNTZType": "TIMESTAMP",
}


def spark_types(df):
    return {f.name: SPARK_TO_DUCK.get(type(f.dataType).__name__, type(f.dataType).__name__) for f in df.schema.fields}


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, name: str, sf_dir: str, con=None, verbose=True):
    from __spark_entry__ import oracle_sql, queries

    con = con or duck(sf_dir)
    t0 = time.time()
    df = queries()[name](spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    sql = oracle_sql().get(name)
    if sql is None:
        return {"name": name, "rows": len(s_rows), "oracle": None, "spark_s": round(t1 - t0, 2)}
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_types = {d[0]: str(d[1]) for d in res.description}
    d_rows = res.fetchall()
    t2 = time.time()
    out = {
        "name": name,
        "rows": len(s_rows),
        "oracle_rows": len(d_rows),
        "cols_match": sorted(s_cols) == sorted(d_cols),
        "values_match": False,
        "spark_s": round(t1 - t0, 2),
        "duck_s": round(t2 - t1, 2),
    }
    if out["cols_match"]:
        st = spark_types(df)
        bad_types = {c: (st[c], d_types[c]) for c in st if st[c] != d_types[c]}
        out["types_match"] = not bad_types
        if bad_types:
            out["type_diffs"] = bad_types
        a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
        out["values_match"] = a == b
        if not out["values_match"] and verbose:
            sa, sb = set(a), set(b)
            out["only_spark"] = [x for x in a if x not in sb][:3]
            out["only_oracle"] = [x for x in b if x not in sa][:3]
    else:
        out["spark_cols"], out["oracle_cols"] = sorted(s_cols), sorted(d_cols)
    return out


if __name__ == "__main__":
    from pagewise.session import build_session
    from __spark_entry__ import queries

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    spark = build_session()
    con = duck(sf)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, sf, con)
        except Exception as e:  # report and continue
            r = {"name": n, "error": repr(e)[:500]}
        ok = (r.get("values_match") and r.get("types_match", True)) or (r.get("oracle") is None and "error" not in r and "oracle_rows" not in r)
        bad += 0 if ok else 1
        print(("OK  " if ok else "BAD ") + str(r), flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
