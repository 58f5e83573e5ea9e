import io
import random
import re
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import gates, render
from palimpsest.functions.names import parse
from palimpsest.operators import context, grouping, harvest, literals, parties, people, spans, surrogates, tables
from palimpsest.plans.table_queries import small_docx
from palimpsest.sources import delivery, files


@pytest.mark.parametrize(("text", "category", "likely"), [
    ("Statement", "organization", False), ("Interest Rate", "person", False), ("Zelle", "person", False), ("FDIC", "person", False), ("Add Money", "person", False), ("Taxes", "organization", False),
    ("Gustav Lindell", "person", True), ("Mark Kessler", "person", True), ("Blue Mesa Farms", "employer", True), ("", "person", False),
])
def test_likely_names(text, category, likely):
    assert gates.likely_name(text, category) is likely


def test_screening_only_sorts():
    assert gates.screen(False, "business") == "other" and gates.screen(False, None) == gates.screen(None, "business") == "person"
    assert gates.keeps("Roe Coaching LLC", "employer", "other") and gates.keeps("WILLIAM ROE", "person", "other") and gates.keeps("Mark Store", "person", None) is None
    assert not gates.keeps("Penny Barn Riverton", "person", "other") and gates.keeps("Tran Date", "person", "person") is False


def test_company_forms():
    rule = re.compile(render.company_pattern("Best Pies Co., Inc."))
    assert not rule.search("the best pies of the year") and all(rule.search(t) for t in ("BEST PIES CO", "Best Pies #123", "Paid Best Pies, Inc."))
    rule = re.compile(render.company_pattern("Roe's Food & Drug"))
    assert all(rule.search(t) for t in ("ROES FOOD AND DRUG", "Roe’s Food & Drug Centers", "ROE'S FOOD & DRUG")) and render.company_pattern("Best") == ""


@pytest.mark.parametrize(("like", "made"), [("SMITH, J. E.", "CORWIN, M. A."), ("Jane Eve Smith", "Mabel Ann Corwin"), ("the Smiths", "the Corwins"), ("Ms. Smith", "Ms. Corwin"), ("jane smith", "mabel corwin")])
def test_rendered_in_shape(like, made):
    assert render.render(parse("Mabel Ann Corwin"), like, parse("Jane Eve Smith")) == made


def test_partial_names():
    assert render.shaped("JaneSmith", "Jane Eve Smith", "Mabel Ann Corwin") == "MabelCorwin" and render.shaped("J Smith", "Jane Smith", "Mabel Corwin") == "M Corwin" and render.shaped("Xavier", "Jane Smith", "Mabel Corwin") is None


HARVESTED = [
    ("INGRID T. HALVORS, District Court Judge", [("official", "INGRID T. HALVORS")]), ("COMMISSIONER’S RECOMMENDATION:\n\n____\nPetra Weiler", [("official", "Petra Weiler")]), ("Commissioner of Insurance regulations apply.", []), ("if the judge agrees", []),
    ("01/11  Pay Friends to Selma Nyberg     Pay Friends", [("counterparty", "Selma Nyberg")]), ("TRANSFER TO SAVINGS XXXX7145", []), ("CHECK 1042 TO ATM", []), ("AMAZON MKTPL", []), ("DOORDASH*CHIPOTLE SAN", []),
    ("Dec 26 Direct Deposit from Heron Inc +$640.10", [("employer", "Heron Inc")]), ("Employer address: 915 Birchwood Avenue", []), ("DIRECT DEP CHECKING PAYROLL", []),
    ("Nils & Tove Aster\n12 Main St", [("holder", "Nils Aster"), ("holder", "Tove Aster")]), ("Lakeside Mortgage Co.\n123 Main St", []), ("", []),
]


@pytest.mark.parametrize(("text", "found"), HARVESTED)
def test_proposals(text, found):
    assert [(k, v) for k, v, _, _ in harvest.propose(text)] == found


def test_harvest_of_null_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert harvest.harvest(rows).count() == harvest.harvest(rows.where("false")).count() == 0


def test_docx_round_trip():
    data = small_docx("paid to JANE  ", "ROE", "buck, Jane Roebuck's ", "and 8812004417 ", "or 88120044170")
    out, n = delivery.rewrite_docx(data, {"Jane Roebuck": "[NAME-1]", "8812004417": "[ACCOUNT-1]"})
    assert n == 3 and files.read_any("a.docx", out) == "paid to [NAME-1], [NAME-1]'s and [ACCOUNT-1] or 88120044170"
    with zipfile.ZipFile(io.BytesIO(out)) as z:
        assert ElementTree.fromstring(z.read("word/document.xml")) is not None
    assert delivery.rewrite_docx(data, {})[1] == 0


def test_archives_are_read_inside_archives():
    def pack(**held):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, data in held.items():
                z.writestr(name.replace("__", "."), data)
        return out.getvalue()

    inner = pack(b__txt=b"inside", c__bin=b"no text")
    data = pack(a__txt=b"one", z__zip=inner, d__docx=small_docx("two"), bad__docx=b"broken")
    assert files.read_any("x.zip", data) == "a.txt\none\nbad.docx\n\nd.docx\ntwo\nz.zip\nb.txt\ninside"
    assert files.read_any("x.zip", b"broken") == ""


def test_archives_and_feedback(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b.txt", bytearray(b"2")), (1, "a.txt", bytearray(b"1")), (2, "c.txt", bytearray(b"3"))], "set_id long, name string, content binary")
    for r in delivery.archives(rows).collect():
        with zipfile.ZipFile(io.BytesIO(r.archive)) as z:
            assert z.namelist() == (["a.txt", "b.txt"] if r.set_id == 1 else ["c.txt"])
    for _ in range(2):
        delivery.log_feedback(spark.createDataFrame([("wrong", 1)], "what string, n int"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


@pytest.mark.parametrize(("rtf", "text"), [
    (r"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\info{\author Jane}}\f0 Hello \b bold\b0 , caf\'e9\par two\tab x\u8217?s}", "Hello bold, café\ntwo\tx’s"), (r"{\rtf1{\*\generator x}a\{b\}\\c\~d}", "a{b}\\c\xa0d"), ("", ""), ("{", ""), (r"\'zz", ""), ("plain", "plain"),
])
def test_rich_text(rtf, text):
    assert files.rtf_text(rtf.encode("latin-1")) == text


def test_apostrophes_of_both_kinds_are_one(spark):
    rows = spark.createDataFrame([(1, "Mr. O’Brien and Sean O’Brien, Sean O'Brien")], "doc_id long, text string")
    got = people.find_people(rows, [("p", "Sean O'Brien")]).collect()
    assert [r.value for r in got] == ["Sean O’Brien", "Sean O'Brien"]


def test_names_of_a_large_case_stay_apart():
    code = lambda i: chr(97 + i // 26) + chr(97 + i % 26)
    real = [f"First{code(i)} Last{code(i)}" for i in range(400)]
    made = surrogates.assign(real, b"salt")
    assert len(set(made.values())) == 400 and len({m.split()[-1] for m in made.values()}) == 400
    assert surrogates.assign(real, b"salt") == made


def test_accounts_of_six_digits_in_scan_lines(spark):
    rows = spark.createDataFrame([(1, 0, "pay 55011234569999000011 now"), (2, 0, "x-55011234569999000011"), (3, 0, "550112345699990000110000000000000000000000000000000000000000000")], "doc_id long, line_no int, text string")
    got = context.scan_line_accounts(rows, spark.createDataFrame([("123456",), ("12345",)], "account string")).collect()
    assert [(r.doc_id, r.account) for r in got] == [(1, "123456")]


def test_places_of_any_length(spark):
    texts = spark.createDataFrame([(1, "moved to Truth or Consequences of the Upper Valley in May"), (2, None)], "doc_id long, text string")
    known = spark.createDataFrame([("Truth or Consequences of the Upper Valley",), ("Upper Valley",)], "name string")
    assert [r.place for r in literals.longest_known(texts, known).collect()] == ["Truth or Consequences of the Upper Valley"]
    assert literals.longest_known(texts, known.where("false")).count() == 0


def test_address_places(spark):
    rows = [("a", "3118 Cedar Point Dr, Logan UT 84321", 9), ("b", "3118 CEDAR POINT DR", 1), ("c", "3118 Cedar Point Dr, Boise ID 83702", 1), ("d", "12 Oak Ln, Provo", 1), ("e", "12 0ak Lane, Provo, UT 84601", 2), ("f", "PO Box 7", 1), ("g", "P.O. Box 7, Ogden UT 84401", 2), ("h", "no address", 1), ("i", None, 1)]
    got = {r.entity_key: (r["head"], r.n_candidates) for r in grouping.address_groups(spark.createDataFrame(rows, "entity_key string, canonical string, occurrences int")).collect()}
    assert got == {"a": ("a", 0), "b": ("b", 2), "c": ("c", 0), "d": ("e", 0), "e": ("e", 0), "f": ("g", 0), "g": ("g", 0), "h": ("h", 0), "i": ("i", 0)}


def test_people_of_one_word(spark):
    rows = [(1, "Jane Roe"), (1, "Jane Q. Roe"), (1, "Jane"), (1, "Novak"), (1, "Ann Novak"), (1, "Bo Novak"), (2, "Jane"), (1, None)]
    got = {(r.set_id, r.name): (r["head"], r.candidates) for r in people.people_heads(spark.createDataFrame(rows, "set_id long, name string")).collect()}
    assert got[1, "Jane Roe"] == got[1, "Jane"] == ("Jane Q. Roe", []) and got[1, "Novak"] == ("Novak", ["Ann Novak", "Bo Novak"]) and got[2, "Jane"] == ("Jane", [])


def test_tables_of_nothing(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0, 1.0, 2.0, "alone")], "doc_id long, page int, row int, cell int, x0 double, x1 double, text string")
    assert tables.tables(cells).count() == 0 and tables.aligned(tables.tables(cells.where("false"))).count() == 0


def test_bare_digits_that_fit_several_are_none(spark):
    units = spark.createDataFrame([(1, "see 123456 and 7,123,456 and 99123456")], "doc_id long, text string")
    assert parties.bare_digits(units, spark.createDataFrame([("99123456",), ("88123456",)], "number string")).select("run").collect() == [("99123456",)]


def test_span_guards_equal_loops(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        s = [(a := rng.randint(0, 20), a + rng.randint(1, 8), rng.randint(1, 3)) for _ in range(rng.randint(0, 6))]
        rows.append((i, s))
    df = spark.createDataFrame(rows, "i int, leaks array<struct<begin:int,end:int,sure:int>>")
    for r in df.select("i", "leaks", spans.one_per_place(F.col("leaks")).alias("k")).collect():
        x = [tuple(s) for s in r.leaks]
        inner = [s for s in x if not any(o[0] <= s[0] and s[1] <= o[1] and o[1] - o[0] > s[1] - s[0] and o[2] >= s[2] for o in x)]
        best = {}
        for s in inner:
            best[s[:2]] = max(best.get(s[:2], 0), s[2])
        assert [tuple(s) for s in r.k] == sorted((*k, v) for k, v in best.items())


def test_those_that_stand_apart_keep_their_own(spark):
    rows = [(1, "person", "Daniel R Holm", False), (1, "person", "Daniel Holm", True), (1, "person", "Daniel Holm", False), (1, "person", "Dan Holm", False), (2, "person", "Daniel Holm", None), (2, "person", None, False)]
    got = {(r.set_id, r.name): r.forms for r in people.person_registry(spark.createDataFrame(rows, "set_id long, category string, name string, apart boolean")).collect()}
    assert got == {("1", "Daniel R Holm"): ["Dan Holm", "Daniel R Holm"], ("1", "Daniel Holm"): ["Daniel Holm"], ("2", "Daniel Holm"): ["Daniel Holm"]}
