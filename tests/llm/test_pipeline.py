import os
import re
import zlib

import corpus_pipeline as pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from test_findings import plain_pii
from test_join import brute

import __spark_entry__ as entry
from palimpsest.llm import decontamination, ngram_join, pii, queries, toxicity
from palimpsest.llm.tokens import Encoder


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    whole = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in pipeline.STAGES[1:4]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        if name == "near_copies":
            heads = {r.class_id for r in ngram_join.join(docs).collect()}
            assert {r.doc_id for r in out.collect()} == heads
        elif name == "decontamination":
            bad = {r.doc_id for r in decontamination.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").collect()}
            assert {r.doc_id for r in out.collect()} == set(whole) - bad
        else:
            assert {r.doc_id: r.text for r in out.collect()} == {k: pii.redact(t) for k, t in whole.items()}


def redacted(text):
    """Spans of the contract's patterns with their labels in place, the first and longest of those that overlap."""
    found = sorted((a, -b, k) for k, spans in plain_pii(text or "").items() for a, b in spans)
    out, last = [], 0
    for a, b, k in found:
        if -b > last and a >= last:
            out += [text[last:a], f"[{k.upper()}]"]
            last = -b
        elif -b > last:
            last = -b
    return "".join([*out, text[last:]]) if found else text


def contaminated(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {tuple(w[i : i + min(13, len(w))]) for w in map(words, items) for i in range(len(w) - min(13, len(w)) + 1) if w}
    w, hit = words(text), set()
    for k in {len(x) for x in windows}:
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in windows:
                hit |= set(range(i, i + k))
    return bool(hit) and 20 * len(hit) >= len(w)


def test_run_equals_plain_versions(spark, sf_dir):
    """All five stages, each done again on the driver by other means."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    score = toxicity.scores(model, pa.array([t for _, t in rows], pa.string()))
    rows = [r for r, s in zip(rows, score, strict=True) if s < 0.5]
    label = brute(rows)[1]
    rows = [r for i, r in enumerate(rows) if label[i] == i]
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = [(d, redacted(t)) for d, t in rows if not contaminated(t, items)]
    encoder, pieces, sequences = Encoder(public_tokenizers.path("word_bpe_49k.json"), False), {}, {}
    for r in pipeline.run(spark, sf_dir).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert sorted(pieces) == [d for d, _ in rows] and len(rows) < docs.count()
    for d, t in rows:
        ids = np.append(encoder.whole(t or ""), 1).astype("<u4")
        at = 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert sorted(sequences) == list(range(len(sequences)))


def test_stages_on_odd_rows(spark, odd, sf_dir):
    """Nulls, empty and long texts, repeated rows, a clashing column and an empty table pass every stage."""
    odd = odd.withColumnRenamed("shard", "score")
    for rows in (odd, odd.where("false")):
        docs = rows
        for name, stage in pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir)
            assert docs.columns == rows.columns, name
        last = pipeline.STAGES[-1][1](spark, docs, sf_dir)
        assert last.count() >= docs.count() and (docs.count() > 0) == (rows.count() > 0)


def test_all_ten_are_registered():
    found = sorted(int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op"))
    assert found == list(range(1, 11)) and "pipeline" in entry.queries() and set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f[:-8]} as select * from read_parquet('{sf_dir}/{f}')")
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert sorted(want.columns) == cols and a.equals(b)
