"""Runs a query on Spark and its SQL on DuckDB and compares names, types, and rows as multisets."""

import datetime
import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads = 4")
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, query, sql, sf_dir):
    """What differs, as text; empty if nothing does."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]).lower() for d in result.description}
    want = rows_of(names, result.fetchall())
    out = []
    if sorted(names) != sorted(df.columns):
        out.append(f"columns {sorted(df.columns)} and {sorted(names)}")
    same = {"bigint": "bigint", "int": "integer", "double": "double", "string": "varchar", "boolean": "boolean", "timestamp": "timestamp"}
    for name, kind in df.dtypes:
        if name in kinds and same.get(kind, kind) not in kinds[name] and not (kind == "bigint" and kinds[name] in ("int64", "number")):
            out.append(f"type of {name}: {kind} and {kinds[name]}")
    if len(got) != len(want):
        out.append(f"{len(got)} and {len(want)} rows")
    bad = [(a, b) for a, b in zip(got, want, strict=False) if not all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12) for x, y in zip(a, b, strict=False))]
    if bad:
        out.append(f"{len(bad)} rows differ, first {bad[0]}")
    return "; ".join(out)[:700]
