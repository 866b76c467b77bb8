"""Spark results against DuckDB on the same Parquet tables.

``python tests/compare.py SF_DIR [NAME...]`` prints what differs and the time of each query.
"""

from __future__ import annotations

import datetime
import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """A connection with every table of the directory as a view."""
    found = duckdb.connect()
    found.execute("set timezone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        files = f"{path}/*.parquet" if path.is_dir() else str(path)
        found.execute(f"create view {path.stem} as select * from read_parquet('{files}')")
    return found


def plain(value):
    """A value as both engines give it: nested rows as tuples, NaN as text."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, dict):
        return tuple(plain(x) for x in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows(columns: list[str], found) -> list[tuple]:
    """Rows with columns in order of name, sorted."""
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


def kind(name: str) -> str:
    """A family of types that both engines name alike."""
    name = name.lower()
    if name.endswith("[]") or name.startswith("array"):
        return "list"
    if name.startswith("struct"):
        return "struct"
    for family, names in {"int": ("tinyint", "smallint", "int", "bigint"), "long": ("hugeint", "ubigint", "uint"), "double": ("double", "float", "real"), "string": ("string", "varchar")}.items():
        if name.startswith(names) or name in names:
            return family
    return name.split("(")[0]


def differences(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs between a Spark frame and a DuckDB query; empty if nothing does."""
    told = con.execute(sql)
    names = [d[0] for d in told.description]
    theirs = told.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} and {sorted(names)}"]
    ours_types = {n: kind(t) for n, t in spark_df.dtypes}
    their_types = {d[0]: kind(str(d[1])) for d in told.description}
    out = [f"type of {n}: {ours_types[n]} and {their_types[n]}" for n in names if ours_types[n] != their_types[n]]
    ours, theirs = rows(spark_df.columns, spark_df.collect()), rows(names, theirs)
    if len(ours) != len(theirs):
        out.append(f"{len(ours)} and {len(theirs)} rows")
    wrong = [(a, b) for a, b in zip(ours, theirs, strict=False) if a != b]
    if wrong:
        out.append(f"{len(wrong)} of {len(ours)} rows, first {wrong[0]}")
    return out


def main() -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as contract
    from framewright.session import get_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = get_session(8, 8, "compare")
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles, con = contract.queries(), contract.oracle_sql(), connect(sf_dir)
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            found = differences(df, con, oracles[name]) if name in oracles else [] if df.collect() is not None else []
        except Exception as error:  # the list goes on to the other queries
            found = [f"{type(error).__name__}: {str(error)[:400]}"]
        bad += bool(found)
        print(f"{'BAD ' if found else 'ok  '} {name} {time.time() - start:.1f}s {'' if name in oracles else '(no SQL)'} {found or ''}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(bool(main()))
