"""Comparing a DataFrame with SQL over the same Parquet tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, int | str):
        return v
    if hasattr(v, "is_integer") or type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(((tuple(plain(r[i]) for i in order)) for r in data), key=repr)


def check(df, con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    numeric = {c: float for c in names}
    assert numeric
    got, want = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, cur.fetchall())
    as_float = lambda x: [tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in r) for r in x]
    assert as_float(got) == as_float(want)
