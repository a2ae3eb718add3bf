"""Run registered queries against their SQL on DuckDB and compare whole row sets and column types."""

from __future__ import annotations

import sys
import time
import traceback

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE",
         "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "smallint": "SMALLINT", "date": "DATE"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def key(row):
    return tuple("\0" if v is None else repr(v) for v in row)


def compare(spark, con, sf_dir, fn, sql):
    """Return a list of differences, empty when equal."""
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    if sql is None:
        return len(got), []
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want_rows = cur.fetchall()
    types = dict(con.execute(f"DESCRIBE {sql}").fetchall() and [(r[0], r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()])
    problems = []
    if sorted(names) != cols:
        return len(got), [f"columns {cols} vs {sorted(names)}"]
    spark_types = dict(df.dtypes)
    for c in cols:
        if TYPES.get(spark_types[c], spark_types[c]) != types[c]:
            problems.append(f"type of {c}: {spark_types[c]} vs {types[c]}")
    idx = [names.index(c) for c in cols]
    want = sorted((tuple(r[i] for i in idx) for r in want_rows), key=key)
    got = sorted(got, key=key)
    if len(got) != len(want):
        problems.append(f"rows {len(got)} vs {len(want)}")
    a, b = set(map(key, got)), set(map(key, want))
    if a != b or [key(r) for r in got] != [key(r) for r in want]:
        problems.append(f"values differ: only spark {len(a - b)} only sql {len(b - a)} cols={cols}")
        problems += [f"  spark {r}" for r in list(a - b)[:3]] + [f"  sql   {r}" for r in list(b - a)[:3]]
    return len(got), problems


def main(argv):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as e
    from pageledger.session import build_session

    sf_dir = argv[0]
    wanted = argv[1:]
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "10g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    q, o = e.queries(), e.oracle_sql()
    bad = 0
    for name in q:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            n, problems = compare(spark, con, sf_dir, q[name], o.get(name))
        except Exception as exc:
            n, problems = -1, [traceback.format_exc()[-1500:] if "-v" in wanted else str(exc)[:900]]
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} rows={n} {'(no sql) ' if name not in o else ''}{time.time() - t:.1f}s", flush=True)
        for p in problems:
            print("     ", p, flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
