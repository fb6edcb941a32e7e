"""Run a registered query and its SQL on the same tables and compare the rows."""

import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def rows(frame):
    """Rows of an Arrow table with columns by name, in a fixed order."""
    names = sorted(frame.column_names)
    columns = [frame.column(n).to_pylist() for n in names]
    return names, sorted(zip(*columns), key=repr)


def kinds(frame):
    return {f.name: str(f.type).replace("large_", "").replace("timestamp[us, tz=UTC]", "timestamp[us]") for f in frame.schema}


def compare(spark_table, duck_table):
    """None when equal, else what differs."""
    if kinds(spark_table) != kinds(duck_table):
        mine, theirs = kinds(spark_table), kinds(duck_table)
        return "types: " + str({k: (mine.get(k), theirs.get(k)) for k in mine | theirs if mine.get(k) != theirs.get(k)})
    names, a = rows(spark_table)
    _, b = rows(duck_table)
    if len(a) != len(b):
        return f"rows: {len(a)} against {len(b)}"
    for x, y in zip(a, b):
        if x != y and repr(x) != repr(y):
            return f"first difference in {names}: {x} against {y}"
    return None
