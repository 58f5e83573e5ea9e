from pyspark.sql import functions as F

from palimpsest.operators import categories, context, graph, grouping, labels, literals, metrics, registry, scan, units
from palimpsest.sources.html import to_text


def test_categories(spark):
    assert categories.categories(spark).count() == len(categories.TAGS) == 64
    assert {d.category for d in scan.DETECTORS} | {r.category for r in labels.RULES} <= set(categories.TAGS)


def test_lines_of_long_and_short_texts(spark):
    long = "\n".join("x" * (i % 7) for i in range(3000))
    df = spark.createDataFrame([(1, "a\n\nbc"), (2, long), (3, None), (4, ""), (2, long)], "doc_id long, text string")
    got = units.lines(df).collect()
    assert sorted((r.line_no, r.start, r.text) for r in got if r.doc_id == 1) == [(0, 0, "a"), (1, 2, ""), (2, 3, "bc")]
    mine = [r for r in got if r.doc_id == 2]
    assert len(mine) == 6000 and all(long[r.start : r.start + len(r.text)] == r.text for r in mine)
    assert [r.text for r in got if r.doc_id == 4] == [""] and not [r for r in got if r.doc_id == 3]


def test_registry_numbers_and_rewrites(spark):
    docs = spark.createDataFrame([(1, 0, "a@example.com or B@example.com"), (2, 0, "b@example.com"), (3, 0, "none"), (4, 0, None)], "doc_id long, unit_id int, text string")
    m = scan.explode_matches(scan.scan_units(docs, ("email",)))
    e = registry.number(registry.build(m))
    assert {r.canonical: (r.n, r.occurrences, r.documents) for r in e.collect()} == {"a@example.com": (1, 1, 1), "B@example.com": (2, 2, 2)}
    out = {r.doc_id: r.redacted_text for r in registry.rewrite(docs, m, e).collect()}
    assert out == {1: "[EMAIL-1] or [EMAIL-2]", 2: "[EMAIL-2]", 3: "none", 4: None}
    assert registry.contexts(m, docs).count() == 3


def test_numbers_are_gapless_over_many_ranges(spark):
    rows = spark.range(5000).selectExpr("concat('k', id) as entity_key", "if(id % 3 = 0, 'email', 'phone') as category", "named_struct('doc_id', id * 7919 % 5003, 'unit_id', 0, 'begin', 0) as first_seen")
    got = registry.number(rows).collect()
    for tag in ("EMAIL", "PHONE"):
        mine = sorted((r.first_seen.doc_id, r.n) for r in got if r.tag == tag)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))


def test_components_of_a_long_path(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (0, 1)], "a long, b long")
    got = {r.node: r.component for r in graph.components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert graph.components(df.where("false")).count() == 0


def test_heads(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None), ("x", "x")], "key string, parent string")
    assert {r.key: r["head"] for r in graph.heads(df).collect()} == {"a": "c", "b": "c", "c": "c", "x": "x"}


def test_ambiguous_tail_keeps_candidates(spark):
    rows = [("111122223333", 2), ("999922223333", 1), ("XXXX3333", 1), ("XXXX4444", 1), ("5555666677", 1), ("****6677", 1)]
    df = spark.createDataFrame([(c, c, n) for c, n in rows], "entity_key string, canonical string, occurrences int")
    got = {r.entity_key: (r["head"], r.n_candidates) for r in grouping.account_groups(df).collect()}
    assert got["XXXX3333"] == ("XXXX3333", 2) and got["****6677"] == ("5555666677", 0) and got["XXXX4444"] == ("XXXX4444", 0)
    listed = sorted(tuple(r) for r in grouping.account_candidates(df).collect())
    assert listed == [("XXXX3333", "111122223333"), ("XXXX3333", "999922223333")]


def test_organisations_cluster(spark):
    df = spark.createDataFrame([("Acme Widgets Inc",), ("ACME WIDGETS",), ("Acme Widgetz LLC",), ("Zenith Bank",)], "value string")
    got = {r.value: r.cluster for r in grouping.organisation_clusters(df).collect()}
    assert len({got[v] for v in list(got) if v.lower().startswith("acme")}) == 1 and got["Zenith Bank"] == "zenith bank"


def test_known_values_on_both_ways(spark, monkeypatch):
    u = spark.createDataFrame([(1, "pay Acme  Corp. now, not Acme Corps"), (2, None), (3, "acct 12345678.5 or 12345678")], "doc_id long, text string")
    v = spark.createDataFrame([("Acme Corp",), ("12345678",), ("abc",), ("1999",)], "value string")
    want = {(1, "Acme Corp", 4, 14), (3, "12345678", 19, 27)}
    assert {tuple(r) for r in literals.find_values(u, v).collect()} == want
    monkeypatch.setattr(literals, "BROADCAST_VALUES", 0)
    assert {tuple(r) for r in literals.find_values(u, v).collect()} == want


def test_address_block_and_anchor(spark):
    rows = [(1, i, t, o) for i, (t, o) in enumerate([("Jane", "jane"), ("12 Elm Street", None), ("Provo, UT 84601", None), ("", None), ("acct", None)])]
    df = spark.createDataFrame(rows, "doc_id long, line_no int, text string, owner string")
    assert [r.address for r in context.address_blocks(df).collect()] == ["12 Elm Street, Provo, UT 84601"]
    assert {r.line_no: r.anchored for r in context.anchor(df).collect()} == dict.fromkeys(range(5), "jane")


def test_money_multiset(spark):
    df = spark.createDataFrame([(1, "$1,000.50 and $1000.50, $2"), (2, None)], "doc_id long, text string")
    assert {(r.doc_id, r.amount, r.n) for r in metrics.money(df).collect()} == {(1, "$1000.50", 2), (1, "$2", 1)}


def test_leaks_are_bounded(spark):
    truth = spark.createDataFrame([("s", "person", "Jane Roe"), ("s", "id", "A.1")], "set_id string, kind string, value string")
    out = spark.createDataFrame([("s", 1, "jane roe left"), ("s", 2, "jane roeburn a.12"), ("t", 3, "jane roe")], "set_id string, doc_id long, text string")
    assert {(r.kind, r.doc_id) for r in metrics.leaks(truth, out).collect()} == {("person", 1)}


def test_visual_rows_and_cells(spark):
    words = [(1, 1, x, y, x + 10.0, y + 10.0, t) for x, y, t in [(0.0, 0.0, "ab"), (12.0, 1.0, "cd"), (90.0, 0.5, "9"), (0.0, 30.0, "ef")]]
    df = spark.createDataFrame(words, "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, text string")
    cells = {(r.row, r.cell): r.text for r in units.row_cells(units.visual_rows(df)).collect()}
    assert cells == {(0, 0): "ab cd", (0, 1): "9", (1, 0): "ef"}


def test_html_text():
    assert to_text("<head><title>t</title></head><p>a&amp;b<br>c</p><script>x</script>") == "a&b\nc"
    assert to_text(None) == ""


def test_decisions(spark):
    e = spark.createDataFrame([("k", "person", "[NAME-1]"), ("l", "person", "[NAME-2]")], "entity_key string, category string, replacement string")
    d = spark.createDataFrame([("k", "enable", "false", 1), ("k", "enable", "true", 2), ("k", "replace", "X", 3)], "entity_key string, op string, arg string, seq int")
    got = {r.entity_key: (r.enabled, r.replacement) for r in registry.apply_decisions(e, d).collect()}
    assert got == {"k": (True, "X"), "l": (True, "[NAME-2]")}


def test_caption(spark):
    text = "\n".join(["IN THE COURT", *["x"] * 9, "COMES NOW the petitioner", "more"])
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(units.caption_region(F.col("t"))).first()[0].count("\n") == 9


def test_large_blocks_link_what_small_ones_do(spark):
    names = ["acme widgets", "amce widgets", "burn works", "bum works", "xavier holdings", "xaviers holdings", "xavler holdings", "yonder fields", "yonder fielbs", "yonder boats"]
    many = [f"{x}{w} company{i}" for x in "abxy" for i, w in enumerate(f"{a}{b}" for a in "bcdefghijklmnopq" for b in "bcdefghijklmnopq")]
    small = {r.value: r.cluster for r in grouping.organisation_clusters(spark.createDataFrame([(n,) for n in names], "value string")).collect()}
    rows = spark.createDataFrame([(n,) for n in names + many], "value string")
    large = {r.value: r.cluster for r in grouping.organisation_clusters(rows).collect()}
    assert small["acme widgets"] == small["amce widgets"] and small["burn works"] == small["bum works"]
    assert {n: large[n] for n in names} == small


def test_alike_pairs_equal_all_pairs(spark):
    import random

    from palimpsest.functions import text as T

    rng = random.Random(3)
    values = sorted({"a" + "".join(rng.choice("mrn0o1l ") for _ in range(rng.randint(1, 8))) for _ in range(500)})
    df = spark.createDataFrame([(v,) for v in values], "value string")
    want = df.selectExpr("value as a").crossJoin(df.selectExpr("value as b")).where("a < b").where(T.alike(F.col("a"), F.col("b")))
    assert sorted(map(tuple, grouping.alike_pairs(df, F.lit("")).collect())) == sorted(map(tuple, want.collect()))


def test_known_values_agree_on_both_ways(spark, monkeypatch):
    u = spark.createDataFrame([(1, "from New York City, york and NEW  YORK or $$$$ ſmith"), (None, "York alone"), (2, "a York, new york york"), (2, "York again"), (3, None)], "doc_id long, text string")
    v = spark.createDataFrame([("York",), ("york",), ("New York",), ("new york",), ("New  York",), ("York City",), ("Smith",), ("$$$$",), ("york york york",)], "value string")
    listed = sorted((tuple(r) for r in literals.find_values(u, v).collect()), key=str)
    monkeypatch.setattr(literals, "BROADCAST_VALUES", 0)
    assert sorted((tuple(r) for r in literals.find_values(u, v).collect()), key=str) == listed
    assert (1, "New  York", 5, 13) in listed and not any(r[1] == "York City" for r in listed) and any(r[0] is None or r[0] != r[0] for r in listed)


def test_heads_of_long_chains_and_circles(spark):
    parent = {f"n{i:02d}": f"n{i + 1:02d}" for i in range(40)} | {"n40": None}
    parent |= {"a": "b", "b": "a", "t": "a", "c": "d", "d": "e", "e": "c", "u": "v", "v": "d", "s": "s", "w": "s", "p": "q", "q": "r", "r": "z", "z": "p"}
    df = spark.createDataFrame(list(parent.items()), "key string, parent string")
    want = {}
    for k in parent:
        seen, x = [k], k
        while parent[x] not in (None, x) and parent[x] not in seen:
            x = parent[x]
            seen.append(x)
        ring = seen[seen.index(parent[x]) :] if parent[x] not in (None, x) else []
        want[k] = k if k in ring else min(ring) if ring else x
    assert {r.key: r["head"] for r in graph.heads(df).collect()} == want
    assert graph.heads(df.where("false")).count() == 0


def test_numbers_with_signs_agree_on_both_ways(spark, monkeypatch):
    texts = ["acct 3357 3537 2072 and 335735372072, 33-57353-72072 not 3,357,353.72", "x3357 35372072 or 9335735372072", "33573537 2072 33573537", None, "1234-567 12345678"]
    u = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    v = spark.createDataFrame([("335735372072",), ("33573537",), ("1234567",), ("Roe 1234567",)], "value string")
    found = lambda: sorted((r.doc_id, r.begin, r.end, r.value) for r in literals.find_values(u, v).collect())
    listed = found()
    assert [texts[d][a:b] for d, a, b, _ in listed] == ["3357 3537 2072", "335735372072", "33-57353-72072", "33573537 2072", "33573537", "1234-567"]
    monkeypatch.setattr(literals, "BROADCAST_VALUES", 0)
    assert found() == listed
