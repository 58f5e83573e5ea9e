"""Registered queries on units, forms of values and names, each on rows whose results are known."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import addresses, forms, names
from ..functions import text as X
from ..functions.gates import as_column
from ..operators import metrics, people, scan, spans, units
from ..sources import files
from . import lines
from .catalog import _SPANS, _line_spans, _pad, query, table
from .lines import Digits, found
from .table_queries import small_docx


@query("select c_custkey as doc_id, unnest([0, 0, 1, 1, 2]) as row, unnest(['a', 'b', 'c', 'd', 'e']) as text from customer")
def s6_visual_rows(spark, sf_dir):
    """Words of three rows, whose baselines waver by less than half their height."""
    words = F.array(*[F.struct(F.lit(y).alias("y0"), F.lit(y + 10.0).alias("y1"), F.lit(x).alias("x0"), F.lit(t).alias("text")) for y, x, t in ((10.0, 5.0, "a"), (13.0, 60.0, "b"), (25.0, 5.0, "c"), (24.0, 60.0, "d"), (40.0, 5.0, "e"))])
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("page"), F.explode(words).alias("w")).select("doc_id", "page", "w.*")
    return units.visual_rows(rows).select("doc_id", "row", "text")


@query("select c_custkey as doc_id, unnest([0, 1]) as cell, unnest(['two words', 'k' || c_custkey]) as text from customer")
def s7_row_cells(spark, sf_dir):
    k = F.concat(F.lit("k"), F.col("c_custkey").cast("string"))
    words = F.array(*[F.struct(F.lit(a).alias("x0"), F.lit(b).alias("x1"), t.alias("text")) for a, b, t in ((0.0, 30.0, F.lit("two")), (33.0, 83.0, F.lit("words")), (200.0, 230.0, k))])
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("page"), F.lit(0).alias("row"), F.explode(words).alias("w")).select("doc_id", "page", "row", "w.*")
    return units.row_cells(rows).select("doc_id", "cell", "text")


_FACES = [f"caption line {i}" for i in range(12)]


@query(f"select c_custkey as doc_id, array_to_string({_FACES}, chr(10)) as text from customer")
def s13_caption_regions(spark, sf_dir):
    text = F.lit("\n".join([*_FACES, "COMES NOW the petitioner", "and more"]))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), units.caption_region(text).alias("text"))


@query("select '/f' || c_custkey || '.docx' as path, 'Name: Jane ' || c_custkey || ', paid' as text from customer")
def s2_document_texts(spark, sf_dir):
    build = as_column(lambda k: bytearray(small_docx("Name: ", f"Jane {k}", ", paid")), T.BinaryType())
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("/f"), F.col("c_custkey").cast("string"), F.lit(".docx")).alias("path"), build("c_custkey").alias("content"), F.lit(True).alias("supported"))
    return files.texts(rows)


_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _docx_table(k: int) -> bytearray:
    import io
    import zipfile

    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    rows = "".join(f"<w:tr>{cell(a)}{cell(b)}</w:tr>" for a, b in (("Account", "Value"), (f"77{k}", "12.00")))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{_W}"><w:body><w:tbl>{rows}</w:tbl></w:body></w:document>')
    return bytearray(out.getvalue())


@query("select '/f' || c_custkey || '.docx' as path, 0 as table_id, unnest([0, 0, 1, 1]) as row, unnest([0, 1, 0, 1]) as col, unnest(['Account', 'Value', '77' || c_custkey, '12.00']) as text from customer")
def s3_document_tables(spark, sf_dir):
    build = as_column(_docx_table, T.BinaryType())
    return files.docx_tables(table(spark, sf_dir, "customer").select(F.concat(F.lit("/f"), F.col("c_custkey").cast("string"), F.lit(".docx")).alias("path"), build("c_custkey").alias("content")))


_SHEET = {"parties": [{"role": "petitioner", "names": ["Jane Roe {k}"], "phones": ["801-555-0100", " "], "accounts": [{"number": "77{k}", "institution": "Bank"}]}, {"role": "child", "names": ["Bo Roe"], "emails": None}]}


@query("select unnest(['petitioner', 'petitioner', 'petitioner', 'child']) as role, unnest(['name', 'phone', 'account', 'name']) as kind, unnest(['Jane Roe ' || c_custkey, '801-555-0100', '77' || c_custkey, 'Bo Roe']) as value from customer")
def s17_party_sheets(spark, sf_dir):
    sheet = F.replace(F.lit(json.dumps(_SHEET)), F.lit("{k}"), F.col("c_custkey").cast("string"))
    return files.party_sheet(table(spark, sf_dir, "customer").select(sheet.alias("json")))


@query("select c_custkey as id, c_name as name from customer")
def k5_encrypted_keys(spark, sf_dir):
    """Encrypted with a password and decrypted again."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    hidden = files.encrypt(rows, "name", "correct horse", b"salt", 1000)
    return files.decrypt(hidden.where(~F.contains("name", F.lit("Customer"))), "name", "correct horse", b"salt", 1000)


# -- forms ------------------------------------------------------------------------------------
_D10 = _pad("8015550000 + c_custkey", 10)


@query(f"""
with k as (select c_custkey as id, {_D10} as d from customer), p as (select id, d, substr(d, 1, 3) as a, substr(d, 4, 3) as b, substr(d, 7) as c from k)
select id, unnest([a || '-' || b || '-' || c, a || '.' || b || '.' || c, a || ' ' || b || ' ' || c, d, '(' || a || ') ' || b || '-' || c, '(' || a || ')' || b || '-' || c, a || '/' || b || '-' || c, '1-' || a || '-' || b || '-' || c,
'+1 ' || a || '-' || b || '-' || c, '+1 ' || a || '.' || b || '.' || c, '+1 ' || a || ' ' || b || ' ' || c, '+1 ' || d, '+1 (' || a || ') ' || b || '-' || c, '+1' || d]) as form from p
""")
def f18_phone_forms(spark, sf_dir):
    d = (F.lit(8015550000) + F.col("c_custkey")).cast("string")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.explode(forms.phone_forms(d)).alias("form"))


@query("""
with k as (select o_orderkey as id, cast(o_orderdate as date) as d from orders)
select distinct id, unnest([strftime(d, '%Y-%m-%d'), strftime(d, '%m/%d/%Y'), strftime(d, '%-m/%-d/%Y'), strftime(d, '%m-%d-%Y'), strftime(d, '%-m-%-d-%Y'), strftime(d, '%m/%d/%y'), strftime(d, '%-m/%-d/%y'),
strftime(d, '%B %-d, %Y'), strftime(d, '%b %-d, %Y'), strftime(d, '%-d %B %Y'), strftime(d, '%-d %b %Y'), strftime(d, '%m%d%Y'), strftime(d, '%Y%m%d'), strftime(d, '%m.%d.%Y')]) as form from k
""")
def f18_birth_date_forms(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("d"))
    return rows.select("id", F.explode(forms.dob_forms(F.col("d"))).alias("form")).distinct()


@query(f"""
with k as (select c_custkey as id, {_pad('c_custkey', 9)} as d from customer), g as (select id, d, substr(d, 1, 4) || ' ' || substr(d, 5, 4) || ' ' || substr(d, 9) as g, substr(d, 6) as t from k)
select distinct id, unnest([d, g, replace(g, ' ', '-'), 'XXXX' || t, 'xxxx' || t, '****' || t, '...' || t, 'XXXX-' || t, 'x' || t]) as form from g
""")
def f18_account_forms(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("d"))
    return rows.select("id", F.explode(forms.account_forms(F.col("d"))).alias("form"))


@query("select c_custkey as id, substr(d, 1, 2) || '-' || substr(d, 3) as form from (select c_custkey, lpad(cast(c_custkey as varchar), 9, '0') as d from customer) union all select c_custkey, lpad(cast(c_custkey as varchar), 9, '0') from customer union all select c_custkey, unnest(['roe' || c_custkey, '@roe' || c_custkey, '$roe' || c_custkey]) from customer")
def f18_other_forms(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    both = F.concat(forms.tin_forms(F.lpad(k, 9, "0")), forms.handle_forms(F.concat(F.lit("@roe"), k)))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.explode(both).alias("form"))


@query("""
select c_custkey as id, cast(c_custkey as varchar) as number, 'n' as direction, 'oak ridge' as street, 'ln' as suffix, '4b' as unit, 'provo' as city, '846' || lpad(cast(c_custkey % 100 as varchar), 2, '0') as zip5, '' as box from customer
""")
def f16_address_parts(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    text = F.concat(k, F.lit(" North Oak Ridge Lane Apt 4B, Provo, UT 846"), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), addresses.address_parts(text).alias("p")).select("id", "p.*")


@query("select c_custkey as id, 'Jane Roe' || c_custkey as a, 'PayPal ' || c_custkey as b from customer")
def f26_unglued(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.replace(X.unglue(F.concat(F.lit("JaneRoe"), k)), F.concat(F.lit(" "), k), k).alias("a"), F.replace(X.unglue(F.concat(F.lit("PayPal"), k)), F.lit("Pay Pal"), F.lit("PayPal")).alias("b"))


_FORMS_OF = ("Jane Eve Roe", "Jane E. Roe", "Jane E Roe", "Jane Roe", "J. Eve Roe", "J. E. Roe", "J. E Roe", "J. Roe", "J Eve Roe", "J E. Roe", "J E Roe", "J Roe")


@query("select c_custkey as id, replace(unnest(" + str([*_FORMS_OF, *(f"Roe, {f.removesuffix(' Roe')}" for f in _FORMS_OF)]) + "), 'Roe', 'Roe' || chr(cast(97 + c_custkey % 26 as integer))) as variant from customer")
def f2_name_variants(spark, sf_dir):
    name = F.concat(F.lit("Jane Eve Roe"), F.char((97 + F.col("c_custkey") % 26).cast("long")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.explode(names.name_variants(name)).alias("variant"))


_GIVEN = {"equal": ("Robert", "robert", True), "short": ("Bob", "Robert", True), "initial": ("R.", "Robert", True), "other": ("Roger", "Robert", False), "none": ("", "Robert", True), "two": ("Liz", "Beth", False)}


@query(" union all ".join(f"select c_custkey as id, '{n}' as \"case\", {str(w).lower()} as same from customer" for n, (_, _, w) in _GIVEN.items()))
def f10_given_names(spark, sf_dir):
    same = as_column(names.same_given, T.BooleanType())
    made = F.array(*[F.struct(F.lit(n).alias("case"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, (a, b, _) in _GIVEN.items()])
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.explode(made).alias("m")).select("id", "m.case", same("m.a", "m.b").alias("same"))


@query("select c_custkey as id, 'Jane Eve Roe' || repeat('x', c_custkey % 5) as richest from customer")
def f12_richest_names(spark, sf_dir):
    rich = as_column(lambda n: [float(x) for x in names.richness(names.parse(n))], T.ArrayType(T.DoubleType()))
    last = F.concat(F.lit("Roe"), F.repeat(F.lit("x"), (F.col("c_custkey") % 5).cast("int")))
    made = F.array(F.concat(F.lit("Jane "), last), F.concat(F.lit("Jane Eve "), last), F.concat(F.lit("J. Eve "), last))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.explode(made).alias("n"))
    return rows.withColumn("r", rich("n")).groupBy("id").agg(F.max_by("n", "r").alias("richest"))


_SHAPED = {"two": ("Jane Roe", True), "initial": ("Jane Q. Roe", True), "three": ("Jane Eve Roe", False), "one": ("Jane", False), "small": ("jane roe", False)}


@query(" union all ".join(f"select c_custkey as id, '{n}' as \"case\", {str(w).lower()} as shaped from customer" for n, (_, w) in _SHAPED.items()))
def p10_person_shaped(spark, sf_dir):
    made = F.array(*[F.struct(F.lit(n).alias("case"), F.lit(v).alias("v")) for n, (v, _) in _SHAPED.items()])
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.explode(made).alias("m")).select("id", "m.case", names.person_shaped(F.col("m.v")).alias("shaped"))


_GLUED = {"both": ("JaneRoebuck", "jane roebuck"), "prefix": ("TRJaneRoebuck", "jane roebuck"), "digits": ("JANEROEBUCK4417", "jane roebuck"), "one": ("Roebuck", None), "other": ("JaneXavier", None)}


@query(" union all ".join(f"select c_custkey as id, '{n}' as \"case\", {'null' if w is None else repr(w)} as parts from customer" for n, (_, w) in _GLUED.items()))
def j5_run_together(spark, sf_dir):
    made = F.array(*[F.struct(F.lit(n).alias("case"), F.lit(v).alias("word")) for n, (v, _) in _GLUED.items()])
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.explode(made).alias("m")).select("id", "m.case", "m.word")
    return people.run_together(rows, ("Jane Roebuck", "Ann Roebuck")).select("id", "case", F.array_join("parts", " ").alias("parts"))


@query(f"with s as ({_SPANS}) select l_orderkey, b as \"begin\", e as \"end\", case when exists (select 1 from s p where p.l_orderkey = a.l_orderkey and p.category = 'c1' and a.b < p.e and p.b < a.e) then 96 else p end as priority from s a where category <> 'c1'")
def i8_whole_handles(spark, sf_dir):
    rows = _line_spans(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("s.category") == "c1", F.col("s"))).alias("first"), F.collect_list(F.when(F.col("s.category") != "c1", F.col("s"))).alias("rest"))
    return rows.select("l_orderkey", F.explode(spans.lift(F.col("rest"), F.col("first"), 96)).alias("m")).select("l_orderkey", "m.begin", "m.end", "m.priority")


@query("""
with m as (select o_custkey as doc_id, 'shop ' || o_orderkey % 4 as value, o_orderkey as k from orders), b as (select doc_id, value, count(*) as n from m group by all), a as (select doc_id, value, count(*) as n from m where k % 3 <> 0 group by all)
select doc_id, value, b.n - coalesce(a.n, 0) as lost from b left join a using (doc_id, value) where b.n > coalesce(a.n, 0) and value <> 'shop 1'
""")
def u6_lost_merchants(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.concat(F.lit("shop "), (k % 4).cast("string")).alias("value"), k.alias("k"))
    count = lambda x: x.groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n"))
    household = spark.createDataFrame([("Shop 1",)], "value string")
    return metrics.lost_merchants(count(rows), count(rows.where("k % 3 <> 0")), household)


_DATES = {"line": ("from ", found("date", "0", Digits(1, 9, 1), "/1", Digits(1), "/2024"), " to ", found("date", "May 1", Digits(1), ", 2024"), " and ", found("date", "2024-01-1", Digits(1)), " not 12.50 or 1/2")}


@query(lines.expected_sql("customer", "c_custkey", _DATES))
def d8_dates_in_text(spark, sf_dir):
    docs = lines.documents(table(spark, sf_dir, "customer"), "c_custkey", _DATES)
    return scan.find_dates(docs, ("doc_id", "line")).select("doc_id", "line", F.lit("date").alias("category"), "value", "begin")


@query("select c_custkey as id, unnest([0, 1, 2]) as i, cast(unnest([0, 1, 3]) as double) * 10 as x from customer")
def f24_glyph_shares(spark, sf_dir):
    """Where the letters of a word of 40 points stand: m is twice as wide as a."""
    word = F.lit("ama")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.posexplode(units.letter_places(word, F.lit(0.0), F.lit(40.0))).alias("i", "x"))
