"""Run registered queries next to their oracle SQL and compare whole results."""
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}" if v else "0"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canonical(x) for x in v) + "]"
    return str(v)


def rows_of(table):
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return names, sorted(tuple(canonical(v) for v in row) for row in zip(*columns))


def kinds(schema):
    return {f.name: str(f.type).replace("large_", "") for f in schema}


def compare(spark, con, name, function, sql, sf_dir):
    start = time.time()
    ours = function(spark, sf_dir).toArrow()
    seconds = time.time() - start
    if sql is None:
        return ours.num_rows > 0, f"rows only: {ours.num_rows}", seconds
    theirs = con.sql(sql).to_arrow_table()
    (a, x), (b, y) = rows_of(ours), rows_of(theirs)
    if a != b:
        return False, f"columns {a} vs {b}", seconds
    ka, kb = kinds(ours.schema), kinds(theirs.schema)
    odd = {n: (ka[n], kb[n]) for n in ka if ka[n] != kb[n] and "list" not in ka[n]}
    if len(x) != len(y):
        return False, f"rows {len(x)} vs {len(y)}", seconds
    diff = [(p, r) for p, r in zip(x, y) if p != r]
    if diff:
        return False, f"{len(diff)} of {len(x)} differ: {diff[:2]}", seconds
    return not odd and len(x) > 0, f"rows {len(x)}" + (f" types {odd}" if odd else ""), seconds


if __name__ == "__main__":
    import os
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from tests.conftest import make_session
    spark = make_session()
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    con = connect(sf_dir)
    wanted = sys.argv[1:]
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in queries:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, note, seconds = compare(spark, con, name, queries[name], oracles.get(name), sf_dir)
        except Exception as e:
            ok, note, seconds = False, f"{type(e).__name__}: {str(e)[:700]}", 0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:38s} {seconds:6.2f}s {note[:900]}", flush=True)
    print("failed:", bad)
