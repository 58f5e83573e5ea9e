import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import forms, names, text, validators


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column).first()[0]


@pytest.mark.parametrize(("f", "value", "ok"), [
    (validators.luhn_valid, "4111-1111-1111-1111", True), (validators.luhn_valid, "4111111111111112", False), (validators.luhn_valid, None, False),
    (validators.valid_ssn, "123-45-6789", True), (validators.valid_ssn, "666-45-6789", False), (validators.valid_ssn, "912-71-1234", True), (validators.valid_ssn, "912-13-1234", False),
    (validators.valid_routing, "021000021", True), (validators.valid_routing, "021000022", False),
    (validators.valid_iban, "GB82 WEST 1234 5698 7654 32", True), (validators.valid_iban, "GB82 WEST 1234 5698 7654 31", False),
    (validators.valid_vin, "1HGCM82633A004352", True), (validators.valid_vin, "24460412651906981", False),
    (validators.not_words, "12CarrefourMarketParisFrCard22", False), (validators.not_words, "1BoatSLRHtKNngkdXEeobR76b53LETtpyT", True),
])
def test_validators(spark, f, value, ok):
    assert one(spark, f(F.col("v")), v=value) is ok


@pytest.mark.parametrize(("a", "b", "same"), [("Smith", "SMITH", True), ("Kirkendall", "Kirkendal", True), ("Smith", "Smyth", False), ("Morn1ng", "Mom1ng", True), ("Kirkendall", "Kirkenadll", True), ("Larsen", "Carsen", False)])
def test_alike(spark, a, b, same):
    assert one(spark, text.alike(F.col("a"), F.col("b")), a=a, b=b) is same


def test_keyed_pick(spark):
    digest = hmac.new(b"salt", b"a\x1fb", hashlib.sha256).digest()
    assert one(spark, text.pick(b"salt", 1000003, F.col("a"), F.col("b")), a="a", b="b") == int.from_bytes(digest[:8], "big") % 1000003


def test_keys_and_small_functions(spark):
    c = F.col("v")
    assert one(spark, text.phone_key(c), v="+1 (801) 555-0100 ext. 4") == "8015550100"
    assert one(spark, text.org_key(c), v="The Acme Widgets, Inc.") == "acme widgets"
    assert one(spark, text.match_case(F.lit("Doe"), c), v="SMITH") == "DOE"
    assert one(spark, text.fold(c), v="  Straße  9 ") == "strasse 9"
    assert one(spark, text.spreadsheet_safe(c), v="=1+1") == "'=1+1"
    assert one(spark, text.unglue(c), v="CafeRio12") == "Cafe Rio 12"
    assert one(spark, text.snippet(c, F.lit(6), F.lit(11)), v="hello world again") == "hello [world] again"
    assert one(spark, text.bare_digits(c), v="00-123 4567") == "1234567"


def test_forms(spark):
    c = F.col("v")
    assert len(one(spark, forms.ssn_forms(c), v="123456789")) == 9
    assert one(spark, forms.ssn_forms(c), v="12") == []
    assert len(one(spark, forms.phone_forms(c), v="8015550100")) == 14
    assert str(one(spark, forms.parse_date(c), v="March 5, 1990")) == "1990-03-05"
    assert one(spark, forms.parse_date(c), v="soon") is None
    assert one(spark, forms.normalise(F.lit("ssn"), c), v="123 45 6789") == "123-45-6789"
    assert "XXXX6789" in one(spark, forms.account_forms(c), v="0000123456789")


def test_names():
    n = names.parse("Dr. Maria de la Cruz Jr.")
    assert (n.title, n.first, n.last, n.suffix) == ("Dr.", "Maria", "de la Cruz", "Jr.")
    assert names.parse("Roe, Jane Q.") == names.Name("Jane", ("Q.",), "Roe", "")
    v = names.variants(names.parse("Jane Quinn Roe"))
    assert {"Jane Quinn Roe", "Jane Q. Roe", "J. Roe", "Roe, Jane"} <= set(v) and v == sorted(v, key=lambda x: (-len(x), x))
    same = lambda a, b: names.same_person(names.parse(a), names.parse(b))
    assert same("Robert Roe", "Bob Roe") and same("J. Roe", "Jane Q Roe") and not same("Jane Roe", "Mary Roe") and not same("Al Roe Jr", "Al Roe Sr")
    assert names.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.9611, abs=1e-4)
    assert names.score("Jane Roe", "Jane Roe") == 1.0 and names.score("Jane Roe", "Peter Larsen") < names.LOW
    assert names.plausible("Jane Q Roe".split(), frozenset()) and not names.plausible(["Account", "12"], frozenset())
