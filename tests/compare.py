"""Compare query results with the SQL counterparts, value by value."""

from __future__ import annotations

import math
import sys

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def canonical(value):
    if value is None:
        return ("",)
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, float):
        return ("n", "nan" if math.isnan(value) else value)
    if isinstance(value, int):
        return ("n", value)
    return ("s", str(value))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(canonical(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql: str) -> list[str]:
    got_names = df.columns
    got = rows_of(got_names, df.collect())
    relation = con.sql(sql)
    want = rows_of(relation.columns, relation.fetchall())
    if sorted(got_names) != sorted(relation.columns):
        return [f"columns {sorted(got_names)} <> {sorted(relation.columns)}"]
    if len(got) != len(want):
        return [f"rows {len(got)} <> {len(want)}"]
    return [f"{g}\n      <> {w}" for g, w in zip(got, want) if g != w]


if __name__ == "__main__":
    import time

    sys.path.insert(0, ".")
    from __spark_entry__ import oracle_sql, queries
    from tidemark.session import build_session

    sf = sys.argv[1]
    spark, con = build_session(cores=8), connect(sf)
    chosen = sys.argv[2:] or list(queries())
    bad = 0
    for name in chosen:
        begun = time.time()
        try:
            df = queries()[name](spark, sf)
            found = differences(df, con, oracle_sql()[name])
            kinds = dict(df.dtypes)
            other = dict(zip(*(lambda r: (r.columns, r.types))(con.sql(oracle_sql()[name]))))
            note = f"{len(found)} differ: " + "\n    ".join(found[:2]) if found else "ok"
            bad += bool(found)
        except Exception as e:  # report and go on
            note, kinds, other = f"FAILED {str(e)[:500]}", {}, {}
            bad += 1
        print(f"{name:32s} {time.time() - begun:6.2f}s {note}", flush=True)
        plain = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double",
                 "BOOLEAN": "boolean", "DATE": "date"}
        for c, k in kinds.items():
            if plain.get(str(other.get(c))) != k:
                print(f"    type of {c}: {k} <> {other.get(c)}")
    print(f"{len(chosen) - bad} of {len(chosen)} agree")
