"""Runs queries beside their SQL on the same tables: python tests/compare.py SF_DIR [NAME...]."""

import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def kind(t):
    t = str(t).lower()
    return {"bigint": "long", "long": "long", "integer": "int", "int": "int", "varchar": "string", "string": "string", "boolean": "bool", "double": "double"}.get(t, t)


def cell(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    return str(v) if v is not None and not isinstance(v, (int, str, bool)) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


def differences(df, con, sql):
    """What differs between a DataFrame and a SQL result; empty if nothing does."""
    got = con.execute(sql)
    names, types, theirs = [c[0] for c in got.description], [kind(c[1]) for c in got.description], got.fetchall()
    ours = [tuple(r) for r in df.collect()]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    mine = {f.name: kind(f.dataType.simpleString()) for f in df.schema}
    bad = {n: (mine[n], t) for n, t in zip(names, types, strict=True) if mine[n] != {"bigint": "long", "integer": "int"}.get(t, t)}
    a, b = rows(df.columns, ours), rows(names, theirs)
    if a != b:
        in_a, in_b = set(a), set(b)
        x, y = [r for r in a if r not in in_b][:2], [r for r in b if r not in in_a][:2]
        return f"{len(a)} and {len(b)} rows; ours {str(x)[:500]}; theirs {str(y)[:500]}"
    return f"types {bad}" if bad else ""


def main(sf_dir, names):
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql = connect(sf_dir), e.queries(), e.oracle_sql()
    for name in names or [n for n in queries if not n.startswith(("op", "pipeline"))]:
        t = time.time()
        try:
            said = differences(queries[name](spark, sf_dir), con, sql[name]) if name in sql else f"no SQL, {queries[name](spark, sf_dir).count()} rows"
        except Exception:
            said = "error " + traceback.format_exc()[-700:]
        print(f"{name}: {said or 'same'} ({time.time() - t:.1f} s)", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
