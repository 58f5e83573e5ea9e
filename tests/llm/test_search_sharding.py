import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import search, sharding
from palimpsest.llm.common import gapless_rank


def brute(ids, v, queries, k):
    out = {}
    for q in queries:
        best = {}
        for i, x in zip(ids, v, strict=True):
            if i != ids[q]:
                s = int(np.dot(x.astype(object), v[q].astype(object)))
                best[i] = max(s, best.get(i, s))
        out[ids[q]] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


@pytest.mark.parametrize("scale", [50, 10**9])
def test_top_k_is_exact(spark, monkeypatch, scale):
    monkeypatch.setattr(search, "BLOCK", 40)
    monkeypatch.setattr(search, "QUERY_BYTES", 500)
    monkeypatch.setattr(search, "STEP", 8)
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.integers(-scale, scale, (150, 6)), np.zeros((3, 6), int), np.repeat(rng.integers(-scale, scale, (1, 6)), 20, 0)])
    ids = list(range(len(v)))
    ids[-1] = ids[-2]  # a repeated id
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v, strict=True)], "vec_id long, v array<bigint>")
    queries = [q for q in range(0, len(v), 10)]
    got = {}
    for r in sorted(search.top_k(df.where("vec_id % 10 = 0"), df, 4, pivots=5, pivot_sample=30).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute(ids, v, queries, 4)


def test_bounds_exclude_candidates():
    """Far clusters: most candidates are never evaluated, and the answer is that of brute force."""
    rng = np.random.default_rng(9)
    centres = rng.integers(-3000, 3000, (8, 12))
    v = np.concatenate([c + rng.integers(-40, 40, (300, 12)) for c in centres])
    ids = np.arange(len(v))
    pivots = search.choose_pivots(v[::40].astype(float), 8)
    asked = ids[::100]
    best = search.Best(asked, v[asked], search.distances(v[asked], pivots), 5)
    best.set_floors(ids[::7], v[::7])
    seen = [0]

    class Counting(np.ndarray):
        def __matmul__(self, other):
            seen[0] += len(self)
            return np.asarray(self) @ np.asarray(other)

    order = search.distances(v, pivots).argmin(1).argsort(kind="stable")
    for a in range(0, len(v), 300):
        at = order[a : a + 300]
        best.see(ids[at], v[at].view(Counting), search.distances(v[at], pivots))
    got = {q: sorted(f.items(), key=lambda x: (-x[1], x[0])) for q, f in zip(asked.tolist(), best.found, strict=True)}
    want = brute(ids.tolist(), v, asked.tolist(), 5)
    for q in want:
        merged = sorted({**dict(got[q])}.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert merged == want[q]
    assert seen[0] < 0.5 * len(v) * len(asked)


def test_products_beyond_64_bits(spark):
    big = 2**62
    df = spark.createDataFrame([(0, [big, big]), (1, [big, 1]), (2, [-big, -big])], "vec_id long, v array<bigint>")
    got = sorted((r["rank"], r.vec_id, r.score) for r in search.top_k(df.where("vec_id = 0"), df, 5).collect())
    assert got == [(1, 1, 2**63 - 1), (2, 2, -(2**63))]


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 0.0]), (4, [float("inf"), 0.0]), (5, []), (6, [0.5, 0.5]), (None, [1.0, 1.0]), (7, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = search.quantise(df, "vec_id", "embedding", 256)
    assert sorted(r.vec_id for r in q.collect()) == [0, 6, 7]
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in search.top_k(q.where("vec_id = 0"), q, 5).collect()] == [(0, 1, 6, 128 * 256 + 128 * 512)]
    assert search.top_k(q.where("false"), q.where("false"), 5).count() == 0


def test_shards(spark, odd):
    tree = sharding.balanced_tree(40)
    got = sharding.shard_documents(odd, tree, 40).collect()
    assert len(got) == odd.count() and all(0 <= r.shard < 40 and r.grown_shard in (r.shard, 40) for r in got)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert [r.text_crc32 for r in got if r.doc_id == 2] == [0] and [r.size for r in got if r.doc_id == 2] == [16]
    assert sharding.shard_documents(odd.where("false"), tree, 40).count() == 0


def test_draws_equal_a_plain_descent(spark, odd):
    tree = sharding.balanced_tree(40)

    def descend(key, t):
        regions, racks, leaves = sharding.levels(t)

        def draw(children):
            return min((-math.log((int(hashlib.md5(f"{key}|{name}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13) / w, name, x) for name, w, x in children)[2]

        return draw(leaves[draw(racks[draw(regions)])])

    for r in sharding.shard_documents(odd, tree, 40).collect():
        key = "null" if r.doc_id is None else str(r.doc_id)
        assert (r.shard, r.grown_shard) == (descend(key, tree), descend(key, tree.grow(40)))
    texts = {(r.doc_id, zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 16) for r in odd.collect()}
    assert {(r.doc_id, r.text_crc32, r["size"]) for r in sharding.shard_documents(odd, tree, 40).collect()} == texts


def test_weights_and_growth(spark):
    ids = spark.range(20000).withColumnRenamed("id", "doc_id")
    tree = sharding.Tree(((((0, 1.0), (1, 3.0)), ((2, 4.0),)), (((3, 8.0),),)))
    counts = {r.shard: r["count"] for r in sharding.place(ids, "doc_id", tree).groupBy("shard").count().collect()}
    for s, w in ((0, 1), (1, 3), (2, 4), (3, 8)):
        assert abs(counts[s] / 20000 - w / 16) < 0.015
    heavier = sharding.Tree(((((0, 1.0), (1, 3.0)), ((2, 4.0),)), (((3, 9.0),),)))
    both = sharding.place(sharding.place(ids, "doc_id", tree, "a"), "doc_id", heavier, "b")
    assert both.where("a <> b and b <> 3").count() == 0
    with pytest.raises(ValueError):
        sharding.Tree(((((0, 0.0),),),))


def test_gapless_rank_on_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, None).otherwise("cold").alias("k"), "id")
    got = gapless_rank(df, ["k"], ["id"], "r", cell_rows=50).collect()
    for k in ("hot", "cold", None):
        ranks = sorted(r.r for r in got if r.k == k)
        assert ranks == list(range(len(ranks))) and ranks
