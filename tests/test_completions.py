"""Every prefix of every logged word has its completions."""

from pathlib import Path

import duckdb

import __spark_entry__ as entry
from conftest import SF
from quern.operators import suggest as su
from quern.plans.queries import log_words


def test_suggest_prefix_has_all_prefixes(spark):
    counts = {r["query"]: r["n"] for r in su.query_counts(log_words(spark, SF)).collect()}
    got = {(r["prefix"], r["rank"]): (r["query"], r["n"]) for r in entry.queries()["suggest_prefix"](spark, SF).collect()}
    under = {}
    for q, n in counts.items():
        for k in range(len(q) + 1):
            under.setdefault(q[:k], []).append((-n, q))
    assert got == {(p, r): (q, -n) for p, found in under.items() for r, (n, q) in enumerate(sorted(found)[:5], 1)}
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    whole = {(p, r): (q, n) for p, r, q, n in con.execute(entry.oracle_sql()["suggest_prefix"]).fetchall()}
    assert whole == got
