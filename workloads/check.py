"""Compare registered queries with their DuckDB equivalents.

    python -m workloads.check [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

from workloads import oracle, registry
from workloads.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _key(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 10)
    return v


def compare(spark, con, name: str, sf_dir: str) -> str:
    """'ok', 'rows <n>' without an oracle, or a description of the difference."""
    t0 = time.time()
    df = registry.registry()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(_key(r[c]) for c in cols) for r in df.select(*cols).collect()]
    took = f"{time.time() - t0:.1f}s"
    sql = oracle.oracle_sql().get(name)
    if sql is None:
        return f"rows {len(got)} ({took})"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"DIFF columns {cols} vs {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = [tuple(_key(r[i]) for i in order) for r in cur.fetchall()]
    if Counter(got) == Counter(want):
        return f"ok {len(got)} ({took})"
    extra, missing = Counter(got) - Counter(want), Counter(want) - Counter(got)
    return (f"DIFF {len(got)} vs {len(want)}; only Spark {sum(extra.values())} {str(list(extra)[:2])[:700]}; "
            f"only DuckDB {sum(missing.values())} {str(list(missing)[:2])[:700]}")


def main(argv) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(registry.registry())
    spark, con = local_session(), connect(sf_dir)
    bad = 0
    for name in names:
        try:
            result = compare(spark, con, name, sf_dir)
        except Exception as exc:  # report and go on with the next query
            result = f"ERROR {type(exc).__name__}: {str(exc)[:900]}"
        bad += result.startswith(("DIFF", "ERROR"))
        print(f"{name:28s} {result}", flush=True)
    print(f"{len(names) - bad} of {len(names)} fine")
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
