"""Run registered queries against their DuckDB oracle: python tests/check_queries.py [sf] [name part ...]"""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        x = float(v)
        return round(x, 6) + 0.0 if not math.isnan(x) else None
    return str(v)


def canon(pdf):
    cols = sorted(pdf.columns)
    rows = [tuple(cell(v) for v in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return cols, sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(got, want):
    gc, gr = canon(got)
    wc, wr = canon(want)
    if gc != wc:
        return f"columns {sorted(set(gc) ^ set(wc))}"
    if len(gr) != len(wr):
        return f"rows {len(gr)} <> {len(wr)}"
    bad = [(a, b) for a, b in zip(gr, wr) if a != b]
    return f"{len(bad)} rows differ: {gc} {bad[:2]}" if bad else None


def oracle_connection(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def main():
    import __spark_entry__ as entry
    from tablefit.session import local_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].replace(".", "").isdigit() else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = oracle_connection(sf_dir), entry.oracle_sql()
    bad = []
    for name, fn in entry.queries().items():
        if args and not any(a in name for a in args):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            got = df.toPandas()
        except Exception as e:  # report and go on
            bad.append(name)
            print(f"FAIL {name}: {type(e).__name__} {str(e)[:1500]}", flush=True)
            continue
        took = time.time() - t
        if name not in sqls:
            print(f"rows {name}: {len(got)} in {took:.1f}s", flush=True)
            continue
        try:
            want = con.execute(sqls[name]).fetchdf()
        except Exception as e:
            bad.append(name)
            print(f"FAIL {name} oracle: {str(e)[:800]}", flush=True)
            continue
        diff = compare(got, want)
        if diff:
            bad.append(name)
        print(f"{'DIFF' if diff else 'ok  '} {name}: {len(got)} rows in {took:.1f}s {diff or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
