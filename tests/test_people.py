from palimpsest.functions.addresses import Address, address_parts, parse_address, same_place
from palimpsest.operators import parties, people


def test_addresses(spark):
    assert parse_address("12 N. Elm Street, Apt 4, Provo, UT 84601-1234") == Address("12", "n", "elm", "st", "4", "provo", "84601", "")
    assert parse_address("12Elm St") == Address("12", "", "elm", "st")
    assert parse_address("P.O. Box 77, Provo, UT 84601").box == "77"
    assert parse_address(None) == Address()
    assert same_place(parse_address("12 Elm St"), parse_address("12 Elm Street, Provo, UT 84601")) and not same_place(parse_address("12 Elm St Apt 1"), parse_address("12 Elm St Apt 2"))
    df = spark.createDataFrame([("12 Elm St",), (None,)], "a string")
    assert [r.p.number for r in df.select(address_parts("a").alias("p")).collect()] == ["12", ""]


def test_glued_words():
    parts = frozenset(("jane", "roe", "smith", "an"))
    assert people.read_glued("trJaneRoe12", parts) == ["jane", "roe"]
    assert people.read_glued("jane", parts) is None and people.read_glued("janexroe", parts) is None


def test_heads_keep_ambiguity(spark):
    rows = [("a", n) for n in ("Jane Quinn Roe", "Jane Roe", "J. Roe", "John Roe", "Peter Novak")] + [("b", "J. Roe"), ("b", "Jane Roe")]
    got = {(r.set_id, r.name): (r["head"], r.candidates) for r in people.people_heads(spark.createDataFrame(rows, "set_id string, name string")).collect()}
    assert got[("a", "Jane Roe")] == ("Jane Quinn Roe", []) and got[("b", "J. Roe")] == ("Jane Roe", [])
    assert got[("a", "J. Roe")] == ("J. Roe", ["Jane Quinn Roe", "John Roe"])


def test_find_people(spark):
    df = spark.createDataFrame([(1, "JANE ROE met jane q. roe; Roe, Jane and Janet Roeburn; J Roe"), (2, None)], "doc_id long, text string")
    got = sorted(r.value for r in people.find_people(df, [("p1", "Jane Q. Roe")]).collect())
    assert got == ["J Roe", "JANE ROE", "Roe, Jane", "jane q. roe"]
    pairs = people.same_people(spark.createDataFrame([("s", "Jane Roe"), ("s", "J. Roe"), ("s", "John Novak"), ("t", "Jane Roe")], "set_id string, name string"))
    assert [tuple(r) for r in pairs.collect()] == [("s", "J. Roe", "Jane Roe")]
    assert people.variant_table(spark.createDataFrame([("p", "Jane Roe")], "entity_key string, name string")).where("variant = 'Jane Roe'").first()["priority"] == 76


def test_fold_needs_one_fit(spark):
    rows = spark.createDataFrame([("p1", "account", "1111222233"), ("p2", "account", "9999222233"), ("p3", "phone", "(801) 555-0100")], "key string, kind string, value string")
    found = spark.createDataFrame([(1, "account", "001111222233"), (2, "account", "XXXX2233"), (3, "phone", "801.555.0100"), (4, "phone", None)], "id long, kind string, value string")
    assert {r.id: r.key for r in parties.fold(found, rows).collect()} == {1: "p1", 2: None, 3: "p3", 4: None}
