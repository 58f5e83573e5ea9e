"""Queries at a scale where a filter or a cap would show, held against plain versions."""

import duckdb
import pytest

from palimpsest.plans import catalog


@pytest.fixture(scope="module")
def large(sf_dir):
    return sf_dir.replace("0.001", "0.1")


def read(at, name):
    return f"read_parquet('{at}/{name}.parquet')"


def test_a3_value_groups_holds_every_customer(spark, large):
    got = {tuple(r) for r in catalog.a3_value_groups(spark, large).collect()}
    want = set()
    for (k,) in duckdb.sql(f"select c_custkey from {read(large, 'customer')}").fetchall():
        n = str(8015550000 + k)
        head = f"{n[:3]}-{n[3:6]}-{n[6:]}"
        want |= {(x, head) for x in (head, f"({n[:3]}) {n[3:6]}-{n[6:]}", f"1.{n[:3]}.{n[3:6]}.{n[6:]}")}
    assert got == want and len(got) > 3 * 10000


def test_a4_account_groups_hold_every_customer(spark, large):
    got = {tuple(r) for r in catalog.a4_account_groups(spark, large).collect()}
    listed = {tuple(r) for r in catalog.a4_account_candidates(spark, large).collect()}
    tails, want = {}, set()
    for (k,) in duckdb.sql(f"select c_custkey from {read(large, 'customer')}").fetchall():
        d = f"{7 * k:012d}"
        tails.setdefault(d[8:], []).append(d)
        want |= {(d, d, 0), (f"{d[:4]}-{d[4:8]}-{d[8:]}", d, 0)}
    want |= {(f"XXXX{t}", d[0] if len(d) == 1 else f"XXXX{t}", 0 if len(d) == 1 else len(d)) for t, d in tails.items()}
    assert got == want and {len(d) for d in tails.values()} >= {1, 2}
    assert listed == {(f"XXXX{t}", x) for t, d in tails.items() if len(d) > 1 for x in d}


def test_a6_components_hold_every_edge(spark, sf_dir):
    got = {r.node: r.component for r in catalog.a6_components(spark, sf_dir).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in duckdb.sql(f"select distinct l_partkey, l_suppkey from {read(sf_dir, 'lineitem')} where l_partkey <> l_suppkey").fetchall():
        lo, hi = sorted((root(a), root(b)))
        parent[hi] = lo
    assert got == {x: root(x) for x in parent}
