"""Runs registered queries on Spark and their SQL on DuckDB and compares all rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def spark_kind(t: str) -> str:
    t = t.lower()
    if t in ("bigint", "int", "smallint", "tinyint"):
        return t
    return {"double": "double", "string": "string", "boolean": "boolean"}.get(t, t)


def duck_kind(t: str) -> str:
    t = str(t).upper()
    return {
        "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
    }.get(t, t.lower())


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return repr(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, name, entry, sf_dir):
    t0 = time.time()
    df = entry.run(spark, sf_dir)
    got = df.collect()
    t1 = time.time()
    out = {"rows": len(got), "spark_s": round(t1 - t0, 2)}
    if entry.sql is None:
        out["status"] = "rows-only"
        return out
    cur = con.execute(entry.sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: duck_kind(d[1]) for d in cur.description}
    want = cur.fetchall()
    out["duck_s"] = round(time.time() - t1, 2)
    problems = []
    mine = {f.name: spark_kind(f.dataType.simpleString()) for f in df.schema}
    if sorted(mine) != sorted(names):
        problems.append(f"columns {sorted(mine)} vs {sorted(names)}")
    else:
        for c in mine:
            if mine[c] != kinds[c]:
                problems.append(f"type of {c}: {mine[c]} vs {kinds[c]}")
        if len(got) != len(want):
            problems.append(f"{len(got)} rows vs {len(want)}")
        a, b = rows_of(df.columns, got), rows_of(names, want)
        if a != b:
            bad = [(x, y) for x, y in zip(a, b) if x != y]
            problems.append(f"{len(bad)} rows differ; columns {sorted(names)}; first {bad[:2]}")
    out["status"] = "ok" if not problems else "; ".join(problems)
    return out


if __name__ == "__main__":
    from iotlens.plans import catalog
    from iotlens.session import local_session

    sf_dir = f"/root/testdata/sf{os.environ.get('SF', '0.01')}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    wanted = sys.argv[1:]
    entries = catalog.entries()
    names = [n for n in entries if not wanted or any(n == w or (w.endswith("*") and n.startswith(w[:-1])) for w in wanted)]
    bad = 0
    for n in names:
        try:
            r = compare(spark, con, n, entries[n], sf_dir)
        except Exception as e:  # noqa: BLE001
            r = {"status": f"ERROR {type(e).__name__} {str(e)[:1200]}"}
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
        print(f"== {n}: {r}", flush=True)
    print(f"== {len(names)} queries, {bad} bad")
