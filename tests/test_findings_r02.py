"""What the findings of round 2 showed."""

import pytest

from palimpsest.operators import tables
from palimpsest.operators.scan import scan


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


@pytest.fixture(scope="module")
def cells(spark):
    """Two pages of a table whose second row lacks its note, with a cell that comes twice."""
    rows = [(0, 0, 0.0, 20.0, "Note"), (0, 1, 50.0, 80.0, "From"), (0, 2, 110.0, 130.0, "To"), (1, 0, 0.0, 30.0, "tram 5"), (1, 1, 48.0, 90.0, "Ina Berger"), (1, 2, 111.0, 160.0, "Otto Lang"), (2, 0, 49.0, 90.0, "4 Vera Holm"), (2, 1, 112.0, 160.0, "Ina Berger"), (2, 1, 112.0, 160.0, "Ina Berger")]
    return spark.createDataFrame([(d, 0, *r) for d in (1, 2) for r in rows], "doc_id long, page int, row int, cell int, x0 double, x1 double, text string")


def test_f8_tables_join_no_cells(cells):
    out = tables.tables(cells)
    assert joins(out) == 0 and out.count() == 18
    assert {r.table_id for r in out.collect()} == {0} and {r.row for r in out.collect()} == {0, 1, 2}


def test_f9_aligned_joins_no_columns(cells):
    out = tables.aligned(tables.tables(cells))
    assert joins(out) == 0
    want = {(0, 0, "Note"), (0, 1, "From"), (0, 2, "To"), (1, 0, "tram 5"), (1, 1, "Ina Berger"), (1, 2, "Otto Lang"), (2, 1, "4 Vera Holm"), (2, 2, "Ina Berger")}
    assert sorted((r.doc_id, r.row, r.col, r.text) for r in out.collect()) == sorted((d, *w) for d in (1, 2) for w in want)


def found(text, *kinds, terms=()):
    return [(c, text[a:b]) for a, b, c, _ in scan(text, frozenset(kinds), terms)]


def test_f11_an_address_is_no_citation():
    text = "write to sec.36@mail2.example.com by Sec. 36"
    assert found(text, "email") == [("email", "sec.36@mail2.example.com")]
    assert found(text, "email", terms=("example.com",)) == []


@pytest.mark.parametrize("before", ["sec", "Section", "§"])
def test_f10_an_address_of_a_host_is_no_citation(before):
    assert found(f"ask {before} 10.20.30.40 there", "ip_address") == [("ip_address", "10.20.30.40")]


def test_f12_digits_of_a_key_are_no_card():
    assert found('token = "068c002651439458202064d35406d6b34bf01abe"', "credit_card") == []
    assert found("é4111111111111111 paid", "credit_card") == [("credit_card", "4111111111111111")]


def test_f5_numbers_meet_whole(spark, monkeypatch):
    from palimpsest.operators import literals

    monkeypatch.setattr(literals, "BROADCAST_VALUES", 0)
    values = [str(300000000000 + 7 * k) for k in range(50)] + ["3000000", "Ina Berger"]
    u = spark.createDataFrame([(k, f"acct {v[:4]} {v[4:7]}-{v[7:]} of ina  berger") for k, v in enumerate(values[:50])] + [(50, "1 3000000, 300-0000 and 13000000"), (51, None)], "doc_id long, text string")
    met = []
    real = literals._with_texts
    monkeypatch.setattr(literals, "_with_texts", lambda rows, texts, keys: met.append(rows) or real(rows, texts, keys))
    got = sorted((r.doc_id, r.value, r.begin) for r in literals.find_values(u, spark.createDataFrame([(v,) for v in values], "value string")).collect())
    assert got == sorted([(k, v, 5) for k, v in enumerate(values[:50])] + [(k, "Ina Berger", 23) for k in range(50)] + [(50, "3000000", 2), (50, "3000000", 11)])
    assert met[0].count() == 50  # names only: numbers that begin alike are no pairs


@pytest.mark.parametrize("most", [0, 50_000])
def test_f7_words_of_texts_are_not_sent_to_the_driver(spark, tmp_path, monkeypatch, most):
    from palimpsest.operators import people

    monkeypatch.setattr(people, "BROADCAST_PARTIES", most)
    spark.createDataFrame([(k, "Rebecca Keller met R. Keller") for k in range(3)], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    out = people.party_forms(docs, spark.createDataFrame([("P1", "Rebecca", "Keller")], "party string, first string, last string"))
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "BuildLeft" not in plan and {tuple(r) for r in out.collect()} == {("P1", "Rebecca Keller", "same", 3), ("P1", "R. Keller", "initial", 3)}


def test_f6_column_parties_join_no_heads(cells):
    out = tables.column_parties(tables.aligned(tables.tables(cells)))
    assert joins(out) == 0
    assert sorted(map(tuple, out.collect())) == [(d, v) for d in (1, 2) for v in ("Ina Berger", "Otto Lang")]


def test_f1_child_rows_join_no_heads(spark):
    rows = [(d, 0, 0, r, c, t) for d in (1, 2) for r, c, t in ((0, 0, "Initials" if d == 1 else "Payee"), (0, 1, "Birth month"), (1, 0, "MKB"), (1, 1, "03/2019"), (2, 0, "TNB"))]
    out = tables.child_rows(spark.createDataFrame(rows, "doc_id long, page int, table_id int, row int, col int, text string"))
    assert joins(out) == 0 and [tuple(r) for r in out.collect()] == [(1, "MKB", "03/2019")]


def test_f4_files_are_rewritten_once(spark, sf_dir):
    from palimpsest.plans import table_queries

    plan = table_queries.k2_rewritten_documents(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 2  # rewritten, and read


def test_f2_f3_hints_hide_no_proposal():
    """Pieces of lines that a harvester knows, of its sources and odd characters, in random order."""
    import random

    import pyarrow as pa

    from palimpsest.operators import harvest
    from palimpsest.plans import lines, name_queries

    rng, made = random.Random(3), [[p if isinstance(p, str) else "123" for p in lines._flat(s)] for d in name_queries.HARVESTS.values() for s in d.values()]
    plain = ["".join(m) for m in made]
    odd = ["\n", "\x0b", "\u00a0", "\u0661\u0662", " ", "  ", "JUDGE", "ſ", "By the Court:\n", "NET PAY", "pay ſtub", "P.O. BOX 7", "Born: May 2016", "née Ortega", "Jane Roe", "12a Oak Lane\n", "Balance Sheet", ", UT 84088", "Sent   ", "From  To\n", "Deposit ACH Acme Co PAYROLL", "RECOMMENDED BY THE COMMISSIONER:\n"]
    texts = plain + ["\n".join(rng.sample(plain, 3)) for _ in range(300)] + ["".join(rng.choice(rng.choice(made) + odd) for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    needed = harvest.needed_by(pa.array(texts))
    assert len(harvest._HINTS) == len(harvest._compiled()) and max(map(len, needed[: len(plain)])) < 12
    for t, n in zip(texts, needed, strict=True):
        assert harvest.propose(t, n) == harvest.propose(t), t


def test_f2_f3_a_small_file_is_dealt_to_all_tasks(spark, sf_dir):
    from palimpsest.plans import catalog

    for name in ("h5_counterparties", "h8_employers"):
        assert catalog.QUERIES[name](spark, sf_dir).rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def test_f3_words_fold_alike():
    import re
    import unicodedata

    from palimpsest.functions.names import _key

    for w in ("O'Brien-2", "", "É1ſt", "abc", "ZELLE&", "straße", *map(chr, range(0x250))):
        plain = unicodedata.normalize("NFKD", w.casefold())
        assert _key(w) == re.sub("[^a-z]", "", "".join(c for c in plain if not unicodedata.combining(c)))
