"""Compare registered queries with their SQL: python tests/check_oracles.py [sf] [query ...]"""

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def kind(series):
    return "number" if pd.api.types.is_numeric_dtype(series) else "other"


def canonical(frame):
    """Columns by name, every value as text, rows in order."""
    frame = frame[sorted(frame.columns)]

    def show(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return "NULL"
        return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(show(v) for v in row) for row in frame.itertuples(index=False))


def differences(spark_frame, sql_frame):
    """'' when equal, else a short text on the first difference."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} / {sorted(sql_frame.columns)}"
    if len(spark_frame) != len(sql_frame):
        return f"rows {len(spark_frame)} / {len(sql_frame)}"
    for ours, theirs in zip(canonical(spark_frame), canonical(sql_frame)):
        if ours != theirs:
            return f"row\n   {str(ours)[:700]}\n   {str(theirs)[:700]}"
    return ""


def main():
    import __spark_entry__ as entry
    from gradeweave.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    con = connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    print("without SQL:", sorted(set(queries) - set(sql)), "without query:", sorted(set(sql) - set(queries)))
    bad = 0
    for name, query in queries.items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            ours = query(spark, sf_dir).toPandas()
            took = time.time() - start
            theirs = con.execute(sql[name]).df() if name in sql else ours
            problem = differences(ours, theirs)
            if not problem and name in sql:
                types = {c: (str(ours[c].dtype), str(theirs[c].dtype)) for c in ours if str(ours[c].dtype) != str(theirs[c].dtype)}
                types = {c: t for c, t in types.items() if "object" not in t or "str" not in t}
                problem = "" if not types else f"ok but dtypes {types}"
        except Exception as error:  # report and go on with the next query
            took, problem, ours = time.time() - start, f"{type(error).__name__} {str(error)[:1500]}", []
        bad += bool(problem)
        print(f"{'BAD' if problem else 'ok '} {name} rows={len(ours)} {took:.2f}s {problem}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
