"""Run registered queries beside their SQL and compare rows: ``python -m tests.check [key…]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from biascomp.plans import oracle_sql, queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _kind(type_name: str) -> str:
    t = type_name.lower()
    for kind, names in {
        "bigint": ("bigint",),
        "int": ("int", "integer"),
        "double": ("double",),
        "string": ("string", "varchar"),
        "boolean": ("boolean",),
        "date": ("date",),
    }.items():
        if t in names:
            return kind
    return t


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, dict):
        return tuple(sorted(v.items()))
    return v


def _key(row):
    return tuple((v is None, f"{v:.4f}" if isinstance(v, float) else str(v)) for v in row)


def compare(key: str, spark, con, sf_dir: str, tol: float = 0.0) -> tuple[bool, str]:
    started = time.time()
    df = queries()[key](spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(_norm(v) for v in row) for row in df.select(*[f"`{c}`" for c in cols]).collect()]
    spark_s = time.time() - started
    if key not in oracle_sql():
        return True, f"rows={len(got)} no SQL {spark_s:.1f}s"
    cur = con.execute(oracle_sql()[key])
    names = [d[0] for d in cur.description]
    types = {d[0]: _kind(str(d[1])) for d in cur.description}
    if sorted(names) != cols:
        return False, f"columns {cols} != {sorted(names)}"
    mine = {f.name: _kind(f.dataType.simpleString()) for f in df.schema.fields}
    bad_types = {c: (mine[c], types[c]) for c in cols if mine[c] != types[c] and "map" not in mine[c]}
    order = [names.index(c) for c in cols]
    want = [tuple(_norm(row[i]) for i in order) for row in cur.fetchall()]
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}"
    exact = sorted(map(repr, got)) == sorted(map(repr, want))
    note = f"rows={len(got)} {spark_s:.1f}s" + (f" TYPES {bad_types}" if bad_types else "")
    if exact:
        return not bad_types, note
    got.sort(key=_key), want.sort(key=_key)
    worst, example = 0.0, None
    for g, w in zip(got, want):
        for a, b in zip(g, w):
            if a == b:
                continue
            gap = abs(a - b) if isinstance(a, float) and isinstance(b, float) else math.inf
            if gap >= worst:
                worst, example = gap, (g, w)
    return worst <= tol and not bad_types, f"{note} MISMATCH worst={worst:g} {cols} {example}"


def main(argv: list[str]) -> int:
    from biascomp.session import local_session

    sf = "/root/testdata/sf0.01"
    keys = [k for k in argv if k in queries()] or list(queries())
    spark, con = local_session(), connect(sf)
    spark.sparkContext.setLogLevel("ERROR")
    failed = []
    for k in keys:
        try:
            ok, note = compare(k, spark, con, sf)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        print("ok  " if ok else "FAIL", k, note, flush=True)
        if not ok:
            failed.append(k)
    print(f"{len(keys) - len(failed)}/{len(keys)} ok; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
