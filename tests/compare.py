"""Run a named query and its SQL side by side and list what differs."""

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _family(kind):
    kind = str(kind).lower()
    if kind.startswith(("bigint", "int", "hugeint", "smallint", "tinyint", "long")):
        return "bigint" if kind.startswith(("bigint", "long")) else kind.replace("integer", "int")
    if kind.startswith(("varchar", "string")):
        return "string"
    if kind.startswith("timestamp"):
        return "timestamp"
    if kind.startswith("bool"):
        return "boolean"
    return kind


def differences(df, con, sql):
    """Empty when columns, types and the bag of rows agree."""
    result = con.execute(sql)
    theirs = {d[0]: _family(d[1]) for d in result.description}
    names = [d[0] for d in result.description]
    rows = result.fetchall()
    ours = {n: _family(t) for n, t in df.dtypes}
    if sorted(ours) != sorted(theirs):
        return [f"columns: only ours {sorted(set(ours) - set(theirs))}, only theirs {sorted(set(theirs) - set(ours))}"]
    found = [f"type of {c}: {ours[c]} / {theirs[c]}" for c in ours if ours[c] != theirs[c]]
    order = sorted(ours)
    at_theirs = [names.index(c) for c in order]
    at_ours = [df.columns.index(c) for c in order]
    mine = sorted((tuple(r[i] for i in at_ours) for r in df.collect()), key=repr)
    other = sorted((tuple(r[i] for i in at_theirs) for r in rows), key=repr)
    if len(mine) != len(other):
        found.append(f"rows: {len(mine)} / {len(other)}")
    wrong = [(a, b) for a, b in zip(mine, other) if repr(a) != repr(b)]
    if wrong:
        pairs = [(c, x, y) for c, x, y in zip(order, *wrong[0]) if repr(x) != repr(y)][:5]
        found.append(f"{len(wrong)} rows differ, first: {pairs}")
    return found
