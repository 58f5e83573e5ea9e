import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from palimpsest.llm import decontamination, ngram_join
from palimpsest.llm.words import EDGES


def grams(text):
    w = [y for y in (x.strip(EDGES).lower() for x in (text or "").split()) if y]
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets, inverted = [grams(t) for _, t in rows], defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            inverted[g].append(i)
    links = defaultdict(set)
    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in inverted[g] if j != i).items():
            if 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                links[i].add(j)
    label = list(range(len(rows)))
    for _ in range(len(rows)):
        label = [min([label[i], *(label[j] for j in links[i])]) for i in range(len(rows))]
    return links, label


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 20, 60, 150]))]
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    return [(i, t) for i, t in enumerate(out)] + [(900, ""), (901, None), (902, "...")]


@pytest.mark.parametrize(("small", "chunk"), [(32, 1024), (1, 4)])
def test_join_equals_brute_force(spark, monkeypatch, small, chunk):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "CHUNK_LEAST", chunk)
    monkeypatch.setattr(ngram_join, "CHUNK_MOST", chunk)
    rows = corpus(7)
    got = {r.doc_id: r for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    links, label = brute(rows)
    for i, (doc, _) in enumerate(rows):
        assert (got[doc].n_links, got[doc].class_id) == (len(links[i]), rows[label[i]][0])


def test_odd_rows(spark, odd):
    got = ngram_join.join(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[4].class_id == by[5].class_id == 4 and by[5].n_links == 1
    assert by[6].class_id == 1 and by[6].n_links == 2
    assert (by[8].class_id, by[9].class_id) == (8, 8) and by[2].n_links == by[3].n_links == by[7].n_links == 0
    kept = ngram_join.deduplicate(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 7, 8]
    assert ngram_join.join(odd.where("false")).count() == 0


def test_pruning_keeps_what_may_reach():
    least = ngram_join.least_matches(Fraction("0.8"))
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 32, (20000, ngram_join.HASHES), dtype=np.uint32)
    b = np.where(rng.random(a.shape) < 0.8, a, a + 1)
    assert ngram_join.posterior_keeps(a, b, least).mean() > 0.9999
    assert ngram_join.posterior_keeps(a, np.where(rng.random(a.shape) < 0.3, a, a + 1), least).mean() < 0.01


def hits(text, items, n=13):
    import re

    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found, which = set(), set()
    for item, t in items:
        b = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        k = min(n, len(b))
        for a in range(len(b) - k + 1 if k else 0):
            for i in range(len(w) - k + 1):
                if w[i : i + k] == b[a : a + k]:
                    found |= set(range(i, i + k))
                    which.add(str(item))
    return len(w), len(found), len(which)


def test_contamination_equals_brute_force(spark):
    rng = random.Random(5)
    words = ["a", "b", "C", "é", "É", "x9", "日本"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 5, 13, 20])))) for i in range(8)] + [(99, None), (10, "!!")]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 30])))) for i in range(20)] + [(50, None), (51, items[-3][1] or ""), (51, "a, " * 40)]
    docs += [(60 + i, f"q {t} {t.upper()}!") for i, t in items if t]
    got = decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = sorted((d, *hits(t, items)) for d, t in docs)
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in got) == want


def test_decontaminate(spark, odd):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (2, "word5 word6 word7")], "item_id long, text string")
    kept = decontamination.decontaminate(odd, bench)
    assert kept.columns == odd.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2, 3, 4, 5, 7, 8, 9]
    cut = {r.doc_id: r.text for r in decontamination.decontaminate(odd, bench, mode="spans").collect()}
    assert cut[1] == "The again and again." and cut[2] is None and cut[4].startswith("word0 word1 word2 word3 word4 word8 ")
    empty = bench.where("false")
    assert decontamination.contamination(odd, empty).where("contaminated").count() == 0 and decontamination.decontaminate(odd.where("false"), bench).count() == 0


def test_removal_holds_when_the_input_splits_anew(spark, sf_dir, tmp_path):
    """The input is cut into other partitions between the call and the read of the result."""
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = str(tmp_path / "docs")
    whole.repartition(8, "source", "doc_id").write.parquet(path)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    heads = {r.class_id for r in ngram_join.join(whole).collect()}
    bad = {r.doc_id for r in decontamination.contamination(whole, bench).where("contaminated").collect()}
    ids = {r.doc_id for r in whole.collect()}
    assert bad and len(heads) < len(ids)
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.minPartitionNum", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes") if spark.conf.get(k, None)}
    docs = spark.read.parquet(path)
    results = ngram_join.deduplicate(docs), decontamination.decontaminate(docs, bench)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        again = [{r.doc_id for r in x.collect()} for x in results]
        fresh = spark.read.parquet(path)
        moved = [{r.doc_id for r in x.collect()} for x in (ngram_join.deduplicate(fresh.repartition(17, "text")), decontamination.decontaminate(fresh.repartition(5, "lang"), bench))]
    finally:
        for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.set(k, was[k]) if k in was else spark.conf.unset(k)
    assert again == moved == [heads, ids - bad]


def test_rows_alike_in_every_column(spark):
    text = "one two three four five six seven eight"
    rows = [(1, text, None, 7), (1, text, None, 7), (1, text, "x", 7), (2, text, None, 7), (3, None, None, 1), (3, None, None, 1), (4, "other words that stand here alone", None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 string, again int")
    out = ngram_join.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text is None) for r in out.collect()) == [(1, False), (3, True), (3, True), (4, False)]
    bench = spark.createDataFrame([(9, "three four five")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontamination.decontaminate(docs, bench).collect()) == [3, 3, 4]
    cut = [(r.doc_id, r.text) for r in decontamination.decontaminate(docs, bench, mode="spans").collect()]
    assert sorted(cut, key=str) == sorted([(1, "one two six seven eight")] * 3 + [(2, "one two six seven eight"), (3, None), (3, None), (4, rows[-1][1])], key=str)
