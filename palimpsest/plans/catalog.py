"""Registered queries of the engine, each with its SQL for DuckDB where SQL can state the result.

Texts that the tables lack (numbers behind labels, addresses, ledgers) are built from their columns
in the same way on both sides, so that the expected rows are known without a pattern.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import forms, names, text, validators
from ..operators import context, grouping, harvest, literals, metrics, registry, scan, spans, units
from ..operators.graph import components
from ..sources import html
from ..storage import save_shared

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pad(c: str, n: int) -> str:
    return f"lpad(cast({c} as varchar), {n}, '0')"


def _key(c: str, n: int):
    return F.lpad(F.col(c).cast("string"), n, "0")


#: The plain detectors whose matches RE2 finds as well: the digits around them are consumed and put back.
PHONE, IPV4, EMAIL = r"\+1 \([0-9]{3}\) 555-[0-9]{4}", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]"
#: Area codes of numbers that are free to call, which are no findings.
FREE = str(scan.FREE_CODES)


def _simple_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, unit_id, begin, end, category and value of the plain kinds, on documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("unit_id"), "text")
    found = scan.scan_units(docs, ("email", "phone", "ip_address", "credit_card"))
    return scan.explode_matches(found)


# -- units ------------------------------------------------------------------------------------
@query("""
with p as (select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents)
select doc_id, cast(line_no as integer) as line_no,
cast(coalesce(sum(length(text) + 1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) as integer) as start,
cast(length(text) as integer) as n_chars from p
""")
def s10_lines(spark, sf_dir):
    out = units.lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "line_no", "start", F.length("text").alias("n_chars"))


@query("select conv_id as doc_id, string_agg(text, chr(10) order by turn) as text from conversations group by conv_id")
def s11_document_text(spark, sf_dir):
    return units.document_texts(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("unit_id"), "text"))


@query("""
with f as (select url as path, regexp_extract(url, '([^/]+)$', 1) as name, regexp_extract(url, '([^/]+)/[^/]+$', 1) as folder from pages)
select path, case when count(*) over (partition by lower(name)) > 1 and folder <> '' then folder || '/' || name else name end as label from f
""")
def s12_document_labels(spark, sf_dir):
    return units.document_labels(table(spark, sf_dir, "pages").select(F.col("url").alias("path")))


@query("""
with c as (select cast(conv_id as bigint) as doc_id, turn, role, text from conversations)
select doc_id, 0 as table_id, cast(case role when 'user' then 0 when 'assistant' then 1 else 2 end as integer) as col, string_agg(text, chr(10) order by turn) as text
from c where trim(text) <> '' group by all having count(*) >= 2
""")
def s10_column_texts(spark, sf_dir):
    role = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    cells = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit(0).alias("table_id"), F.col("turn").alias("row"), role.alias("col"), "text")
    return units.column_texts(cells)


@query("""
with c as (select p_size as table_id, row_number() over (partition by p_size order by p_partkey) - 1 as row, p_name as a, p_brand as b from part),
cells as (select table_id, row, 0 as col, a as text from c union all select table_id, row, 1, b from c),
l as (select *, first(text) over (partition by table_id, col order by row) as head, lag(text) over (partition by table_id, col order by row) as above,
lag(text) over (partition by table_id, row order by col) as lft, first(text) over (partition by table_id, row order by col) as row_head from cells),
u as (select table_id, row, col, text, 'head' as source, head as label from l union all select table_id, row, col, text, 'above', above from l
union all select table_id, row, col, text, 'left', lft from l union all select table_id, row, col, text, 'row_head', row_head from l)
select table_id, cast(row as integer) as row, col, source, rtrim(label) || ': ' || text as text from u
where label is not null and length(label) <= 60 and trim(label) <> '' and label <> text
""")
def d11_table_contexts(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_size").alias("table_id"), (F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey")) - 1).alias("row"), "p_name", "p_brand")
    cells = rows.select(F.lit(0).alias("doc_id"), "table_id", "row", F.posexplode(F.array("p_name", "p_brand")).alias("col", "text"))
    return units.table_contexts(cells).drop("doc_id")


@query("""
with l as (select o_orderkey as doc_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as w, l_quantity as x, 'w' || l_linenumber as text from orders join lineitem on o_orderkey = l_orderkey),
g as (select doc_id, w, text, 100.0 * w + (x % 3) * 8 as x0 from l), p as (select *, x0 + 80 + 5 * (w % 2) as x1 from g),
n as (select *, x0 - lag(x1) over (partition by doc_id order by w) as gap, (x1 - x0) / length(text) as width from p)
select doc_id, 0 as page, string_agg(case when gap is null then '' when gap >= 1.4 * width then repeat(' ', cast(least(greatest(floor(gap / width), 3), 12) as integer)) else ' ' end || text, '' order by w) as text from n group by doc_id
""")
def s5_word_gaps(spark, sf_dir):
    l = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))  # noqa: E741
    l = l.withColumn("w", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")))  # noqa: E741
    x0 = 100.0 * F.col("w") + (F.col("l_quantity") % 3) * 8
    words = l.select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("page"), F.lit(0).alias("block"), F.lit(0).alias("line"), F.col("w").alias("word"), x0.alias("x0"), (x0 + 80 + 5 * (F.col("w") % 2)).alias("x1"), F.concat(F.lit("w"), "l_linenumber").alias("text"))
    return units.words_to_lines(words).select("doc_id", "page", "text")


#: What is left of a page once hidden elements, comments and tags are gone, line by line.
_SEEN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<head>.*?</head>', '', 'g'), '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g')"
_BROKEN = f"regexp_replace({_SEEN}, '(?i)</?({'|'.join(sorted(html.BLOCKS))})( [^>]*)?/?>', chr(10), 'g')"
_UNTAGGED = f"regexp_replace(regexp_replace({_BROKEN}, '(?i)<t[dh]( [^>]*)?>', chr(9), 'g'), '(?s)<[^>]*>', '', 'g')"
_PLAIN = _UNTAGGED
for _entity, _code in (("lt", 60), ("gt", 62), ("quot", 34), ("#39", 39), ("nbsp", 160), ("copy", 169), ("middot", 183), ("amp", 38)):
    _PLAIN = f"replace({_PLAIN}, '&{_entity};', chr({_code}))"


@query(rf"select page_id, array_to_string(list_filter(list_transform(string_split({_PLAIN}, chr(10)), lambda x: trim(regexp_replace(x, '[\s\x{{a0}}]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) as text from pages")
def s18_html_text(spark, sf_dir):
    return html.html_text(table(spark, sf_dir, "pages"), "page_id", "html")


# -- detectors --------------------------------------------------------------------------------
@query(rf"""
with m as (select doc_id, 'phone' as category, unnest(regexp_extract_all(text, '{PHONE}')) as value from documents)
select category, value, count(*) as n, count(distinct doc_id) as documents from m where substr(value, 5, 3) not in {FREE} group by all
""")
def d0_phones(spark, sf_dir):
    m = _simple_matches(spark, sf_dir).where("category = 'phone'")
    return m.groupBy("category", "value").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents"))


@query(rf"""
with m as (select doc_id, unnest(regexp_extract_all(text, '{EMAIL}')) as value from documents)
select 'email' as category, value, count(*) as n, count(distinct doc_id) as documents from m group by all
""")
def d0_emails(spark, sf_dir):
    m = _simple_matches(spark, sf_dir).where("category = 'email'")
    return m.groupBy("category", "value").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents"))


@query(rf"""
with m as (select doc_id, unnest(regexp_extract_all(text, '\b{IPV4}\b')) as value from documents),
k as (select * from m where list_max(list_transform(string_split(value, '.'), lambda x: cast(x as integer))) <= 255)
select 'ip_address' as category, value, count(*) as n, count(distinct doc_id) as documents from k group by all
""")
def d0_ip_addresses(spark, sf_dir):
    m = _simple_matches(spark, sf_dir).where("category = 'ip_address'")
    return m.groupBy("category", "value").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents"))


_LABELS = [
    ("bank_account", "Account Number: ", 12), ("mrn", "Medical Record No. ", 9), ("passport", "Passport No: ", 9), ("policy_number", "Policy Number: ", 10),
    ("claim_number", "Claim No. ", 8), ("parcel_number", "Parcel # ", 10), ("voter_id", "Voter ID: ", 9), ("inmate_number", "Inmate No. ", 7), ("loan_number", "Loan Number: ", 11),
]


@query(" union all ".join(f"select c_custkey as doc_id, '{c}' as category, {_pad('c_custkey', n)} as value, cast({len(label)} as integer) as begin from customer" for c, label, n in _LABELS))
def d0_labelled(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    rows = customers.select(F.col("c_custkey").alias("doc_id"), F.explode(F.array(*[F.concat(F.lit(label), _key("c_custkey", n)) for _, label, n in _LABELS])).alias("text"))
    return scan.explode_matches(scan.scan_units(rows)).select("doc_id", "category", "value", "begin")


@query(f"""
select c_custkey as doc_id, '9' || substr(k, 1, 2) || '-' || g || '-' || substr(k, 3, 4) as value
from (select c_custkey, {_pad('c_custkey % 1000000', 6)} as k, cast(50 + c_custkey % 50 as varchar) as g from customer)
where (cast(g as integer) between 50 and 65 or cast(g as integer) between 70 and 88 or cast(g as integer) between 90 and 92 or cast(g as integer) between 94 and 99) and substr(k, 3, 4) <> '0000'
""")
def v2_taxpayer_numbers(spark, sf_dir):
    k = F.lpad((F.col("c_custkey") % 1000000).cast("string"), 6, "0")
    value = F.concat(F.lit("9"), F.substring(k, 1, 2), F.lit("-"), (50 + F.col("c_custkey") % 50).cast("string"), F.lit("-"), F.substring(k, 3, 4))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), value.alias("value")).where(validators.valid_ssn(F.col("value")))


_LUHN = "list_sum(list_transform(range(1, 17), lambda i: case when (17 - i) % 2 = 0 then (2 * cast(substr(v, i, 1) as integer)) // 10 + (2 * cast(substr(v, i, 1) as integer)) % 10 else cast(substr(v, i, 1) as integer) end)) % 10"


@query(f"select doc_id, v as value from (select o_orderkey as doc_id, '4' || {_pad('o_orderkey * 7919 + o_custkey', 15)} as v from orders) where {_LUHN} = 0")
def v1_luhn(spark, sf_dir):
    v = F.concat(F.lit("4"), F.lpad((F.col("o_orderkey") * 7919 + F.col("o_custkey")).cast("string"), 15, "0"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), v.alias("value")).where(validators.luhn_valid(F.col("value")))


@query(f"""
with r as (select s_suppkey as doc_id, {_pad('s_suppkey * 1013', 9)} as v from supplier)
select doc_id, v as value, list_sum(list_transform(range(1, 10), lambda i: cast(substr(v, i, 1) as integer) * [3, 7, 1][(i - 1) % 3 + 1])) % 10 = 0 as valid from r
""")
def v3_routing(spark, sf_dir):
    v = F.lpad((F.col("s_suppkey") * 1013).cast("string"), 9, "0")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), v.alias("value"))
    return rows.withColumn("valid", validators.valid_routing(F.col("value")))


@query(f"""
with r as (select c_custkey as doc_id, {_pad('c_custkey', 18)} as b from customer), n as (select doc_id, b, 98 - cast(b || '131400' as hugeint) % 97 as c from r)
select doc_id, 'DE' || lpad(cast((c + doc_id % 3) % 97 as varchar), 2, '0') || b as value, doc_id % 3 = 0 as valid from n
""")
def v4_iban(spark, sf_dir):
    rest = F.pmod(F.concat(_key("c_custkey", 18), F.lit("131400")).cast("decimal(38,0)"), F.lit(97)).cast("int")
    check = (98 - rest + F.col("c_custkey") % 3) % 97  # right for every third key
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("DE"), F.lpad(check.cast("string"), 2, "0"), _key("c_custkey", 18)).alias("value"))
    return rows.withColumn("valid", validators.valid_iban(F.col("value")))


@query(f"""
with r as (select p_partkey as doc_id, upper(substr(replace(replace(md5(cast(p_partkey as varchar)), '0', 'O'), '1', case when p_partkey % 3 = 0 then 'I' else '7' end), 1, 17)) as v from part)
select doc_id, v as value, not contains(v, 'O') and not contains(v, 'I') and regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Z]') as valid from r
""")
def v5_vin(spark, sf_dir):
    h = F.replace(F.replace(F.md5(F.col("p_partkey").cast("string")), F.lit("0"), F.lit("O")), F.lit("1"), F.when(F.col("p_partkey") % 3 == 0, "I").otherwise("7"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.upper(F.substring(h, 1, 17)).alias("value"))
    return rows.withColumn("valid", validators.valid_vin(F.col("value")))


@query("""
select p_partkey as doc_id, '1' || v as value, not regexp_matches(v, '[a-z]{4}') or 1.0 * length(regexp_replace(lower(v), '[^aeiou]', '', 'g')) / length(regexp_replace(v, '[^A-Za-z]', '', 'g')) < 0.3 as plausible
from (select p_partkey, substr(replace(p_name || p_name || p_name, ' ', ''), 1, 30) as v from part)
""")
def v6_wallet_words(spark, sf_dir):
    v = F.substring(F.replace(F.concat("p_name", "p_name", "p_name"), F.lit(" "), F.lit("")), 1, 30)
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("1"), v).alias("value"))
    return rows.withColumn("plausible", validators.not_words(F.col("value")))


# -- spans ------------------------------------------------------------------------------------
def _line_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    begin = (F.col("l_partkey") % 60).cast("int")
    return l.select("l_orderkey", F.struct(begin.alias("begin"), (begin + 3 + F.col("l_quantity").cast("int") % 12).alias("end"), F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("category"), (50 + F.col("l_suppkey") % 5).cast("int").alias("priority"), F.lit("").alias("value")).alias("s"))


_SPANS = "select l_orderkey, cast(l_partkey % 60 as integer) as b, cast(l_partkey % 60 + 3 + cast(l_quantity as integer) % 12 as integer) as e, 'c' || l_linenumber as category, cast(50 + l_suppkey % 5 as integer) as p from lineitem"


@query(f"""
with s as ({_SPANS}), o as (select *, max(e) over (partition by l_orderkey order by b, e rows between unbounded preceding and 1 preceding) as before from s),
g as (select *, sum(case when before is null or b > before then 1 else 0 end) over (partition by l_orderkey order by b, e rows unbounded preceding) as island from o)
select l_orderkey, min(b) as "begin", max(e) as "end" from g group by l_orderkey, island
""")
def i3_merge_spans(spark, sf_dir):
    rows = _line_spans(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list("s").alias("spans"))
    return rows.select("l_orderkey", F.explode(spans.merge(F.col("spans"))).alias("m")).select("l_orderkey", "m.begin", "m.end")


@query(f"""
with recursive s as ({_SPANS}), r as (select *, row_number() over (partition by l_orderkey order by p desc, e - b desc, b, category) as n from s),
w(l_orderkey, n, kept) as (
  select distinct l_orderkey, cast(0 as bigint), cast([] as struct(b integer, e integer, c varchar)[]) from r
  union all select r.l_orderkey, r.n, case when len(list_filter(w.kept, lambda k: k.b < r.e and r.b < k.e)) = 0 then list_append(w.kept, struct_pack(b := r.b, e := r.e, c := r.category)) else w.kept end
  from w join r on r.l_orderkey = w.l_orderkey and r.n = w.n + 1),
l as (select l_orderkey, arg_max(kept, n) as kept from w group by l_orderkey), u as (select l_orderkey, unnest(kept) as k from l)
select l_orderkey, k.b as "begin", k.e as "end", k.c as category from u
""")
def i4_resolve_spans(spark, sf_dir):
    rows = _line_spans(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list("s").alias("spans"))
    return rows.select("l_orderkey", F.explode(spans.resolve(F.col("spans"))).alias("m")).select("l_orderkey", "m.begin", "m.end", "m.category")


@query(f"""
with s as ({_SPANS}) select l_orderkey, b as "begin", e as "end", category from s a
where category <> 'c1' and not exists (select 1 from s p where p.l_orderkey = a.l_orderkey and p.category = 'c1' and a.b < p.e and p.b < a.e)
""")
def i2_protected_overlap(spark, sf_dir):
    rows = _line_spans(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("s.category") == "c1", F.col("s"))).alias("protected"), F.collect_list(F.when(F.col("s.category") != "c1", F.col("s"))).alias("found"))
    return rows.select("l_orderkey", F.explode(spans.drop_touching(F.col("found"), F.col("protected"))).alias("m")).select("l_orderkey", "m.begin", "m.end", "m.category")


@query(f"""
with s as ({_SPANS}) select l_orderkey, b as "begin", e as "end", category from s a
where not exists (select 1 from s p where p.l_orderkey = a.l_orderkey and p.b <= a.b and a.e <= p.e and p.e - p.b > a.e - a.b)
""")
def i5_drop_contained(spark, sf_dir):
    rows = _line_spans(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list("s").alias("spans"))
    return rows.select("l_orderkey", F.explode(spans.drop_within(F.col("spans"), F.col("spans"), True)).alias("m")).select("l_orderkey", "m.begin", "m.end", "m.category")


# -- functions --------------------------------------------------------------------------------
@query("""
select c_custkey as id, case when c_custkey % 3 = 0 then upper(n) when c_custkey % 3 = 1 then lower(n) else n end as cased,
n || case when regexp_matches(lower(n), '(s|x|z|ch|sh)$') then 'es' else 's' end as plural,
translate(replace(replace(lower(c_name), 'rn', 'm'), 'vv', 'w'), '01i|!5$', 'olll' || 'lss') as folded
from (select c_custkey, c_name, c_mktsegment, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) as n from customer)
""")
def f4_f6_case_plural_fold(spark, sf_dir):
    n = F.initcap("c_mktsegment")
    like = F.when(F.col("c_custkey") % 3 == 0, F.upper("c_mktsegment")).when(F.col("c_custkey") % 3 == 1, F.lower("c_mktsegment")).otherwise(n)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), text.match_case(n, like).alias("cased"), text.pluralize(n).alias("plural"), text.ocr_fold(F.col("c_name")).alias("folded"))


_OCR = "translate(replace(replace(lower(%s), 'rn', 'm'), 'vv', 'w'), '01i|!5$', 'ollllss')"
_WORDS = "select distinct lower(w) as w from (select unnest(string_split(p_name, ' ')) as w from part) where regexp_matches(w, '^[A-Za-z]{4,}$')"


def _part_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w"))
    return w.where(F.col("w").rlike("^[A-Za-z]{4,}$")).select(F.lower("w").alias("w")).distinct()


@query(f"""
with n as ({_WORDS}), t as (select w, substr(w, 1, 2) || substr(w, 4) as token from n union all select w, substr(w, 1, 1) || substr(w, 3, 1) || substr(w, 2, 1) || substr(w, 4) from n union all select w, w || 'q' from n),
k as (select distinct token from t where length(token) >= 4)
select distinct token, n.w as name from k join n on token <> n.w and damerau_levenshtein(token, n.w) = 1 and (length(token) <> length(n.w) or list_sort(string_split(token, '')) = list_sort(string_split(n.w, '')))
""")
def j4_near_tokens(spark, sf_dir):
    n = _part_words(spark, sf_dir)
    w = F.col("w")
    made = F.array(F.concat(F.substring(w, 1, 2), F.substring(w, 4, 99)), F.concat(F.substring(w, 1, 1), F.substring(w, 3, 1), F.substring(w, 2, 1), F.substring(w, 4, 99)), F.concat(w, F.lit("q")))
    return literals.near_tokens(n.select(F.explode(made).alias("token")), n.select(w.alias("name")))


@query(f"""
with o as ({_WORDS}), m as (select unnest([w, w || 's', replace(w, 'l', 'i'), substr(w, 1, 3) || substr(w, 5)]) as w from o), n as (select distinct w from m where regexp_matches(w, '^[a-z]{{4,}}$'))
select a.w as a, b.w as b, a.w <> b.w and damerau_levenshtein(a.w, b.w) <= 1 as typo,
{_OCR % 'a.w'} = {_OCR % 'b.w'} or (least(length({_OCR % 'a.w'}), length({_OCR % 'b.w'})) >= 4 and levenshtein({_OCR % 'a.w'}, {_OCR % 'b.w'}) <= case when least(length({_OCR % 'a.w'}), length({_OCR % 'b.w'})) >= 9 then 2 else 1 end) as near,
a.w = b.w or {_OCR % 'a.w'} = {_OCR % 'b.w'} or (least(length(a.w), length(b.w)) >= 7 and damerau_levenshtein(a.w, b.w) <= 1) as alike from n a join n b on substr(a.w, 1, 1) = substr(b.w, 1, 1) and a.w < b.w
""")
def f8_f9_edit_distance(spark, sf_dir):
    w = F.col("w")
    made = F.array(w, F.concat(w, F.lit("s")), F.replace(w, F.lit("l"), F.lit("i")), F.concat(F.substring(w, 1, 3), F.substring(w, 5, 99)))
    n = _part_words(spark, sf_dir).select(F.explode(made).alias("w")).where(w.rlike("^[a-z]{4,}$")).distinct().withColumn("k", F.substring("w", 1, 1))
    pairs = n.withColumnRenamed("w", "a").join(n.withColumnRenamed("w", "b"), "k").where("a < b")
    a, b = F.col("a"), F.col("b")
    return pairs.select("a", "b", text.typo(a, b).alias("typo"), text.similar(a, b).alias("near"), text.alike(a, b).alias("alike"))


@query("""
with p as (select c_custkey as id, encode(c_name) as m from customer), q as (select id, ('0x' || substr(sha256(cast(unhex('%s') as blob) || unhex(sha256(cast(unhex('%s') as blob) || m))), 1, 16))::ubigint %% 997 as m2 from p) select id, cast(m2 as bigint) as n from q
""" % ("".join(f"{b ^ 0x5C:02x}" for b in b"salt".ljust(64, b"\0")), "".join(f"{b ^ 0x36:02x}" for b in b"salt".ljust(64, b"\0"))))
def f14_keyed_pick(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), text.pick(b"salt", 997, F.col("c_name")).alias("n"))


@query(f"""
with k as (select c_custkey as id, '801555' || {_pad('c_custkey % 10000', 4)} as d from customer)
select id, f, case when f = 0 then '(' || substr(d, 1, 3) || ') ' || substr(d, 4, 3) || '-' || substr(d, 7) when f = 1 then '1-' || substr(d, 1, 3) || '-' || substr(d, 4, 3) || '-' || substr(d, 7) else substr(d, 1, 3) || '.' || substr(d, 4, 3) || '.' || substr(d, 7) || ' ext. 12' end as written, d as key
from k, (select unnest([0, 1, 2]) as f)
""")
def f17_phone_keys(spark, sf_dir):
    d = F.concat(F.lit("801555"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"))
    a, b, c = F.substring(d, 1, 3), F.substring(d, 4, 3), F.substring(d, 7, 4)
    written = F.array(F.concat(F.lit("("), a, F.lit(") "), b, F.lit("-"), c), F.concat_ws("-", F.lit("1"), a, b, c), F.concat(F.concat_ws(".", a, b, c), F.lit(" ext. 12")))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.posexplode(written).alias("f", "written"))
    return rows.withColumn("key", text.phone_key(F.col("written")))


@query(f"""
with k as (select c_custkey as id, {_pad('c_custkey', 9)} as d from customer)
select id, unnest([d, substr(d, 1, 3) || '-' || substr(d, 4, 2) || '-' || substr(d, 6), substr(d, 1, 3) || ' ' || substr(d, 4, 2) || ' ' || substr(d, 6), substr(d, 1, 3) || '.' || substr(d, 4, 2) || '.' || substr(d, 6),
'XXX-XX-' || substr(d, 6), '***-**-' || substr(d, 6), 'xxx-xx-' || substr(d, 6), 'XXXXX' || substr(d, 6), '*****' || substr(d, 6)]) as form from k
""")
def f18_printed_forms(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.explode(forms.ssn_forms(_key("c_custkey", 9))).alias("form"))


@query("select o_orderkey as id, f, case f when 0 then strftime(o_orderdate, '%m/%d/%Y') when 1 then strftime(o_orderdate, '%Y-%m-%d') else strftime(o_orderdate, '%B %-d, %Y') end as written, strftime(o_orderdate, '%Y-%m-%d') as iso from orders, (select unnest([0, 1, 2]) as f)")
def f19_parse_dates(spark, sf_dir):
    d = F.col("o_orderdate")
    written = F.array(F.date_format(d, "MM/dd/yyyy"), F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "MMMM d, yyyy"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.posexplode(written).alias("f", "written"))
    return rows.withColumn("iso", F.date_format(forms.parse_date(F.col("written")), "yyyy-MM-dd"))


@query("""
select p_partkey as id, case when p_partkey % 4 = 0 then '''=' || p_name when p_partkey % 4 = 1 then '''@' || p_name else p_name end as safe,
trim(regexp_replace(replace(p_name, ' ', '__') || '-v.1', '[\\s_\\-.]+', ' ', 'g')) as tidy from part
""")
def f30_f31_safe_names(spark, sf_dir):
    raw = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("="), "p_name")).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("@"), "p_name")).otherwise(F.col("p_name"))
    stem = F.concat(F.replace("p_name", F.lit(" "), F.lit("__")), F.lit("-v.1"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.spreadsheet_safe(raw).alias("safe"), text.tidy_filename(stem).alias("tidy"))


_FIRST, _LAST = ["Maria", "John", "Peter", "Helen", "Robert", "Susan", "Thomas"], ["Keller", "Novak", "Ortega", "Whitman", "Larsen"]
_SQL_NAME = f"{_FIRST}[c_custkey % {len(_FIRST)} + 1] || ' ' || chr(cast(65 + c_custkey % 26 as integer)) || '. ' || {_LAST}[c_custkey % {len(_LAST)} + 1]"


def _names(c: str = "c_custkey"):
    first, last = F.array(*map(F.lit, _FIRST)), F.array(*map(F.lit, _LAST))
    k = F.col(c)
    return F.get(first, (k % len(_FIRST)).cast("int")), F.char((65 + k % 26).cast("long")), F.get(last, (k % len(_LAST)).cast("int"))


@query(f"select c_custkey as id, {_FIRST}[c_custkey % {len(_FIRST)} + 1] as first, chr(cast(65 + c_custkey % 26 as integer)) || '.' as middle, {_LAST}[c_custkey % {len(_LAST)} + 1] as last, true as same from customer")
def f1_f11_names(spark, sf_dir):
    f, m, l = _names()  # noqa: E741
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(l, F.lit(", "), f, F.lit(" "), m, F.lit(".")).alias("a"), F.concat(F.lit("Dr. "), f, F.lit(" "), l).alias("b"))
    rows = rows.withColumn("n", names.parse_name("a")).withColumn("same", names.is_same_person("a", "b"))
    return rows.select("id", "n.first", F.get("n.middles", F.lit(0)).alias("middle"), "n.last", "same")


_LIKE = "jaro_winkler_similarity(lower(%s), lower(%s))"


@query(f"""
with n as (select c_custkey as id, {_FIRST}[c_custkey % {len(_FIRST)} + 1] as f, {_LAST}[c_custkey % {len(_LAST)} + 1] as l, {_FIRST}[(c_custkey * 3 + 1) % {len(_FIRST)} + 1] as g, {_LAST}[(c_custkey * 3 + 1) % {len(_LAST)} + 1] as k from customer),
s as (select id, case when f = g then 1.0 else {_LIKE % ('f', 'g')} end as a, {_LIKE % ('l', 'k')} as b from n), t as (select id, a, b, 0.55 * b + 0.45 * a as t from s)
select id, cast(round(case when a < 0.85 or b < 0.85 then least(t, 0.74) else t end, 6) as double) as score from t
""")
def f13_name_scores(spark, sf_dir):
    f, m, l = _names()  # noqa: E741
    g, _, k = _names("o")
    rows = table(spark, sf_dir, "customer").withColumn("o", F.col("c_custkey") * 3 + 1)
    return rows.select(F.col("c_custkey").alias("id"), names.name_score(F.concat_ws(" ", f, l), F.concat_ws(" ", g, k)).alias("score"))


# -- registry, numbering, rewriting -----------------------------------------------------------
_FOUND = rf"""
e as (select doc_id, unnest(regexp_extract_all(text, '{EMAIL}')) as value, 'email' as category from documents),
t as (select * from (select doc_id, unnest(regexp_extract_all(text, '{PHONE}')) as value, 'phone' as category from documents) where substr(value, 5, 3) not in {FREE}),
i as (select doc_id, value, 'ip_address' as category from (select doc_id, unnest(regexp_extract_all(text, '\b{IPV4}\b')) as value from documents)
where list_max(list_transform(string_split(value, '.'), lambda x: cast(x as integer))) <= 255),
f as (select * from e union all select * from t union all select * from i)
"""


@query(f"with {_FOUND} select category || '|' || lower(value) as entity_key, category, count(*) as occurrences, count(distinct doc_id) as documents, min(doc_id) as first_doc from f group by all")
def a1_registry(spark, sf_dir):
    m = _simple_matches(spark, sf_dir).where("category <> 'credit_card'")
    return registry.build(m).select("entity_key", "category", "occurrences", "documents", F.col("first_seen.doc_id").alias("first_doc"))


_SEGMENTS = "select c_custkey as doc_id, c_mktsegment || ' ' || (c_custkey % 40) as value, case when c_nationkey % 2 = 0 then 'organization' else 'employer' end as category from customer"


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat_ws(" ", "c_mktsegment", (F.col("c_custkey") % 40).cast("string"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("unit_id"), F.lit(0).alias("begin"), value.alias("value"), F.when(F.col("c_nationkey") % 2 == 0, "organization").otherwise("employer").alias("category"))


@query(f"""
with s as ({_SEGMENTS}), g as (select category || '|' || lower(value) as entity_key, category, min(doc_id) as first_doc, count(*) as occurrences from s group by all),
t as (select *, case category when 'organization' then 'ORG' else 'EMPLOYER' end as tag from g)
select entity_key, tag, row_number() over (partition by tag order by first_doc, entity_key) as n, '[' || tag || '-' || row_number() over (partition by tag order by first_doc, entity_key) || ']' as replacement from t
""")
def w1_numbering(spark, sf_dir):
    return registry.number(registry.build(_segments(spark, sf_dir))).select("entity_key", "tag", "n", "replacement")


@query(f"""
with s as ({_SEGMENTS}), g as (select category, min(doc_id) as first_doc, count(*) as occurrences, count(distinct doc_id) as documents, lower(value) as k from s group by category, lower(value))
select category, (select min(value) from s where s.doc_id = first_doc) as canonical, occurrences, documents,
'[' || case category when 'organization' then 'ORG' else 'EMPLOYER' end || '-' || row_number() over (partition by category order by first_doc, k) || ']' as replacement from g
""")
def k4_mapping_table(spark, sf_dir):
    return registry.mapping_table(registry.number(registry.build(_segments(spark, sf_dir))))


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: What the flagship looks for, as RE2 finds it: e-mail addresses, phones, addresses of hosts, sixteen digits of a card.
_ANY_OF = rf"{EMAIL}|{PHONE}|\b(?:{_OCTET}\.){{3}}{_OCTET}\b|\b[0-9]{{16}}\b"
_CARD_OK = _LUHN.replace("substr(v, ", "substr(x, ") + " = 0"


def _rewriting(kinds: tuple[str, ...]) -> str:
    """The rewritten documents: found values in order, numbered by first appearance for each tag, put between the
    pieces of text that they part."""
    kind = f"case when contains(x, '@') then 'email' when x[1] = '+' then case when substr(x, 5, 3) not in {FREE} then 'phone' end when contains(x, '.') then 'ip_address' when {_CARD_OK} then 'credit_card' end"
    tag = "case category when 'email' then 'EMAIL' when 'phone' then 'PHONE' when 'ip_address' then 'IP' else 'CARD' end"
    listed = ", ".join(f"'{k}'" for k in kinds)
    return rf"""
with p as (select doc_id, text, regexp_extract_all(text, '{_ANY_OF}') as m, string_split_regex(text, '{_ANY_OF}') as g from documents where text is not null),
x as (select doc_id, unnest(m) as x, generate_subscripts(m, 1) as i from p), k as (select doc_id, i, x, {kind} as category from x),
f as (select * from k where category in ({listed})), e as (select category, lower(x) as v, min(struct_pack(d := doc_id, i := i)) as first from f group by all),
n as (select category, v, '[' || {tag} || '-' || row_number() over (partition by category order by first.d, first.i, v) || ']' as replacement from e),
r as (select f.doc_id, f.i, replacement from f join n on f.category = n.category and lower(f.x) = n.v), a as (select doc_id, map_from_entries(list((i, replacement))) as made, count(*) as hits from r group by doc_id)
select p.doc_id, coalesce(hits, 0) as n_hits, case when hits is null then p.text else array_to_string(list_transform(g, lambda y, j: y || case when j > len(m) then '' else coalesce(made[j], m[j]) end), '') end as redacted_text from p left join a using (doc_id)
"""


@query(_rewriting(("email", "phone", "ip_address")))
def k1_rewrite_hits(spark, sf_dir):
    return _rewritten(spark, sf_dir, ("email", "phone", "ip_address"))


def _rewritten(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...]) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.lit(0).alias("unit_id"), "text")
    matches = save_shared(scan.explode_matches(scan.scan_units(docs, kinds)).drop("text"), "matches")  # scanned once, read for the registry and for the texts
    return registry.rewrite(docs, matches, registry.number(registry.build(matches)))


@query(_rewriting(("email", "phone", "ip_address", "credit_card")))
def flagship_redaction(spark, sf_dir):
    """Documents to rewritten texts: scan, gates, registry, numbering, substitution."""
    return _rewritten(spark, sf_dir, ("email", "phone", "ip_address", "credit_card"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship_redaction(spark, sf_dir)


@query("""
with l as (select l_orderkey, list(struct_pack(p := l_linenumber, v := '<' || l_linenumber || '>') order by l_linenumber) as h from lineitem group by l_orderkey)
select l_orderkey, list_reduce(list_transform(h, lambda x: x.v || repeat('.', 3)), lambda a, b: a || b) as text from l
""")
def k1_substitute(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("n"))  # noqa: E741
    at = F.transform(F.sequence(F.lit(1), F.size("n")), lambda i: F.struct(((i - 1) * 5).alias("begin"), ((i - 1) * 5 + 2).alias("end"), F.concat(F.lit("<"), F.element_at("n", i).cast("string"), F.lit(">")).alias("replacement")))
    return l.select("l_orderkey", spans.substitute(F.repeat(F.lit("ab..."), F.size("n")), at).alias("text"))


@query("""
with d as (select o_custkey as k, o_orderkey as seq, case o_orderkey % 3 when 0 then 'enable' when 1 then 'replace' else 'retype' end as op,
case o_orderkey % 3 when 0 then case when o_orderkey % 2 = 0 then 'true' else 'false' end when 1 then 'R' || o_orderkey else 'employer' end as arg from orders),
l as (select k, op, max_by(arg, seq) as arg from d group by k, op)
select c_custkey as id, coalesce((select cast(arg as boolean) from l where k = c_custkey and op = 'enable'), true) as enabled,
coalesce((select arg from l where k = c_custkey and op = 'replace'), c_name) as replacement, coalesce((select arg from l where k = c_custkey and op = 'retype'), 'person') as category from customer
""")
def j18_decisions(spark, sf_dir):
    k = F.col("o_orderkey")
    op = F.when(k % 3 == 0, "enable").when(k % 3 == 1, "replace").otherwise("retype")
    arg = F.when(k % 3 == 0, F.when(k % 2 == 0, "true").otherwise("false")).when(k % 3 == 1, F.concat(F.lit("R"), k.cast("string"))).otherwise("employer")
    decisions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity_key"), k.alias("seq"), op.alias("op"), arg.alias("arg"))
    entities = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_key"), F.col("c_name").alias("replacement"), F.lit("person").alias("category"))
    return registry.apply_decisions(entities, decisions).select(F.col("entity_key").alias("id"), "enabled", "replacement", "category")


# -- joins ------------------------------------------------------------------------------------
@query("""
with v as (select n_name as value from nation where length(n_name) >= 4), u as (select o_orderkey as doc_id, 'Ship to ' || n_name || ', then to ' || lower(n_name) || '.' as text, n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)
select doc_id, n_name as value, cast(8 as integer) as "begin", cast(8 + length(n_name) as integer) as "end" from u
union all select doc_id, n_name, cast(18 + length(n_name) as integer), cast(18 + 2 * length(n_name) as integer) from u
""")
def j2_known_values(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    u = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    u = u.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("Ship to "), "n_name", F.lit(", then to "), F.lower("n_name"), F.lit(".")).alias("text"))
    return literals.find_values(u, n.select(F.col("n_name").alias("value")))


@query("""
with n as (select l_orderkey as doc_id, l_suppkey, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as integer) as line_no from lineitem),
o as (select doc_id, line_no, case when line_no % 4 = 1 then 'owner' || l_suppkey % 3 end as owner, line_no % 5 = 4 as blank from n),
b as (select *, sum(case when blank then 1 else 0 end) over (partition by doc_id order by line_no) as block from o),
h as (select doc_id, min(owner) as h from o where line_no < 15 and owner is not null group by doc_id having count(distinct owner) = 1)
select doc_id, line_no, coalesce(owner, last_value(owner ignore nulls) over (partition by doc_id, block order by line_no rows between 4 preceding and 1 preceding), h) as anchored from b left join h using (doc_id)
""")
def j9_anchoring(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_suppkey", n.alias("line_no"))  # noqa: E741
    rows = l.select("doc_id", "line_no", F.when(F.col("line_no") % 4 == 1, F.concat(F.lit("owner"), (F.col("l_suppkey") % 3).cast("string"))).alias("owner"), F.when(F.col("line_no") % 5 == 4, "").otherwise("x").alias("text"))
    return context.anchor(rows).select("doc_id", "line_no", "anchored")


@query("""
select c_custkey as doc_id, cast(2 as integer) as line_no, c_custkey || ' Elm Street, Provo, UT 846' || lpad(cast(c_custkey % 100 as varchar), 2, '0') as address from customer
""")
def d10_address_blocks(spark, sf_dir):
    lines = F.array(F.lit("Statement of 01/02/2024"), F.concat(F.col("c_custkey").cast("string"), F.lit(" Elm Street")), F.concat(F.lit("Provo, UT 846"), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0")), F.lit("Total $12.00"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.posexplode(lines).alias("line_no", "text"))
    return context.address_blocks(rows)


@query("select o_orderkey as doc_id, 0 as line_no, '5501' || k || '9999' as run, k as account from (select o_orderkey, cast(300000000000 + o_custkey * 7919 as varchar) as k from orders)")
def d9_scan_lines(spark, sf_dir):
    account = (F.col("o_custkey") * 7919 + F.lit(300000000000)).cast("string")
    orders = table(spark, sf_dir, "orders").withColumn("account", account)
    rows = orders.select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("line_no"), F.concat(F.lit("pay 5501"), "account", F.lit("9999 now")).alias("text"))
    return context.scan_line_accounts(rows, orders.select("account").distinct())


@query("""
select s_suppkey as doc_id, 'New ' || replace(n_name, '_', ' ') as place from supplier join nation on s_nationkey = n_nationkey
""")
def j13_longest_place(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("n_name", F.replace("n_name", F.lit("_"), F.lit(" ")))
    gazetteer = n.select(F.col("n_name").alias("name")).unionByName(n.select(F.concat(F.lit("NEW "), "n_name").alias("name")))
    t = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    t = t.select(F.col("s_suppkey").alias("doc_id"), F.concat(F.lit("resident of New "), "n_name", F.lit(" near "), "n_name").alias("text"))
    return literals.longest_known(t, gazetteer)


@query("select substr(k, 9) as tail, case when count(*) over (partition by substr(k, 9)) = 1 then k end as number from (select lpad(cast(c_custkey as varchar), 12, '0') as k from customer)")
def j7_masked_tails(spark, sf_dir):
    full = table(spark, sf_dir, "customer").select(_key("c_custkey", 12).alias("number"))
    return literals.tail_owner(full.select(F.substring("number", 9, 4).alias("tail")), full)


@query(f"""
with p as (select o_orderkey as doc_id, case o_orderkey % 4 when 0 then l else f || ' ' || l end as value, case o_orderkey % 3 when 0 then 'high' when 1 then 'medium' else 'low' end as confidence
from (select *, {_FIRST}[o_custkey % {len(_FIRST)} + 1] as f, {_LAST}[o_custkey % {len(_LAST)} + 1] || ' ' || o_custkey % 9 as l from orders)),
g as (select lower(value) as k, value, max(case confidence when 'high' then 3 when 'medium' then 2 else 1 end) as c, count(distinct doc_id) as documents, count(*) as finds from p group by all)
select 'person' as kind, value, case c when 3 then 'high' when 2 then 'medium' else 'low' end as confidence, documents, finds from g where k not in ('maria keller 1', 'peter larsen 2', 'novak 4')
""")
def j14_known_veto(spark, sf_dir):
    k = F.col("o_orderkey")
    f, _, l = _names("o_custkey")  # noqa: E741
    l = F.concat_ws(" ", l, (F.col("o_custkey") % 9).cast("string"))  # noqa: E741
    value = F.when(k % 4 == 0, l).otherwise(F.concat_ws(" ", f, l))
    rows = table(spark, sf_dir, "orders").select(k.alias("doc_id"), F.lit("person").alias("kind"), value.alias("value"), F.when(k % 3 == 0, "high").when(k % 3 == 1, "medium").otherwise("low").alias("confidence"), F.lit(0).alias("begin"))
    return harvest.best_evidence(rows, spark.createDataFrame([("Maria Keller 1",), ("Peter Larsen 2",), ("NOVAK 4",)], "value string"))


_BARE = r"lower(regexp_replace(replace(%s, chr(10), ' '), '[^\p{L}\p{N} ]', '', 'g'))"


@query(f"""
with b as (select item_id as kind, trim({_BARE % 'text'}) as value from benchmark), d as (select source as set_id, doc_id, {_BARE % 'text'} as text from documents)
select distinct kind, set_id, doc_id from b join d on value <> '' and contains(' ' || d.text || ' ', ' ' || value || ' ')
""")
def j22_leak_search(spark, sf_dir):
    clean = lambda c: F.lower(F.regexp_replace(F.replace(c, F.lit("\n"), F.lit(" ")), r"[^\p{L}\p{N} ]", ""))
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("set_id"), "doc_id", clean(F.col("text")).alias("text"))
    truth = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("kind"), F.trim(clean(F.col("text"))).alias("value"))
    return metrics.leaks(truth, docs).select("kind", "set_id", "doc_id").distinct()


# -- entity resolution ------------------------------------------------------------------------
def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = F.lpad((F.col("c_custkey") * 7).cast("string"), 12, "0")  # ends in the same four digits for some keys
    forms_ = F.array(F.struct(full.alias("canonical"), F.lit(3).alias("occurrences")), F.struct(F.concat_ws("-", F.substring(full, 1, 4), F.substring(full, 5, 4), F.substring(full, 9, 4)).alias("canonical"), F.lit(1).alias("occurrences")), F.struct(F.concat(F.lit("XXXX"), F.substring(full, 9, 4)).alias("canonical"), F.lit(1).alias("occurrences")))
    forms_ = table(spark, sf_dir, "customer").select(F.explode(forms_).alias("f")).select("f.*")
    return forms_.groupBy("canonical").agg(F.max("occurrences").alias("occurrences")).select(F.col("canonical").alias("entity_key"), "canonical", "occurrences")


_TAILS = "k as (select lpad(cast(c_custkey * 7 as varchar), 12, '0') as d from customer), t as (select substr(d, 9) as tail, count(*) as n, min(d) as one from k group by 1)"


@query(f"""
with {_TAILS} select d as entity_key, d as head, cast(0 as bigint) as n_candidates from k union all select substr(d, 1, 4) || '-' || substr(d, 5, 4) || '-' || substr(d, 9), d, 0 from k
union all select 'XXXX' || tail, case when n = 1 then one else 'XXXX' || tail end, case when n > 1 then n else 0 end from t
""")
def a4_account_groups(spark, sf_dir):
    return grouping.account_groups(_accounts(spark, sf_dir))


@query(f"with {_TAILS} select 'XXXX' || tail as entity_key, d as candidate from k join t on substr(d, 9) = tail where n > 1")
def a4_account_candidates(spark, sf_dir):
    return grouping.account_candidates(_accounts(spark, sf_dir))


_NUMBER = "cast(8015550000 + c_custkey as varchar)"


@query(f"""
with n as (select {_NUMBER} as n from customer), h as (select n, substr(n, 1, 3) || '-' || substr(n, 4, 3) || '-' || substr(n, 7, 4) as head from n)
select unnest([head, '(' || substr(n, 1, 3) || ') ' || substr(n, 4, 3) || '-' || substr(n, 7, 4), '1.' || substr(n, 1, 3) || '.' || substr(n, 4, 3) || '.' || substr(n, 7, 4)]) as entity_key, head from h
""")
def a3_value_groups(spark, sf_dir):
    number = (F.lit(8015550000) + F.col("c_custkey")).cast("string")
    a, b, c = (F.substring(number, *x) for x in ((1, 3), (4, 3), (7, 4)))
    forms_ = F.array(F.concat_ws("-", a, b, c), F.concat(F.lit("("), a, F.lit(") "), b, F.lit("-"), c), F.concat_ws(".", F.lit("1"), a, b, c))
    rows = table(spark, sf_dir, "customer").select(F.posexplode(forms_).alias("i", "canonical"))
    rows = rows.select(F.col("canonical").alias("entity_key"), "canonical", F.lit("phone").alias("category"), F.when(F.col("i") == 0, 3).otherwise(1).alias("occurrences"))
    return grouping.same_key_groups(rows).select("entity_key", "head")


@query("""
with recursive e as (select distinct l_partkey as a, l_suppkey as b from lineitem where l_partkey <> l_suppkey), u as (select a, b from e union select b, a from e),
w(node, component) using key (node) as (select distinct a, a from u
  union select u.b, min(w.component) from w join u on u.a = w.node join recurring.w as r on r.node = u.b where w.component < r.component group by u.b)
select node, component from w
""")
def a6_components(spark, sf_dir):
    return components(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")))


_HOUSES = ["Elm Street", "Oak Ridge Lane", "Cedar Avenue"]


@query(f"""
with c as (select c_custkey as k, c_custkey || ' ' || {_HOUSES}[c_custkey % 3 + 1] as s, lpad(cast(c_custkey % 100 as varchar), 2, '0') as z from customer),
f as (select k, s || ', Provo, UT 846' || z as head, s, z from c)
select head as entity_key, head, cast(0 as bigint) as n_candidates from f
union all select upper(s) || ', Provo UT 846' || z, head, 0 from f
union all select s, case when k % 2 = 0 then head else s end, case when k % 2 = 0 then 0 else 2 end from f
union all select s || ', Ogden, UT 84499', s || ', Ogden, UT 84499', 0 from f where k % 2 = 1
""")
def a6_address_groups(spark, sf_dir):
    """A form without a town joins the only house of its street, and is a candidate where two towns have one."""
    k = F.col("c_custkey")
    s = F.concat(k.cast("string"), F.lit(" "), F.get(F.array(*map(F.lit, _HOUSES)), (k % 3).cast("int")))
    z = F.lpad((k % 100).cast("string"), 2, "0")
    forms_ = F.array(F.struct(F.concat(s, F.lit(", Provo, UT 846"), z).alias("canonical"), F.lit(9).alias("occurrences")), F.struct(F.concat(F.upper(s), F.lit(", Provo UT 846"), z).alias("canonical"), F.lit(2).alias("occurrences")), F.struct(s.alias("canonical"), F.lit(1).alias("occurrences")), F.when(k % 2 == 1, F.struct(F.concat(s, F.lit(", Ogden, UT 84499")).alias("canonical"), F.lit(5).alias("occurrences"))))
    rows = table(spark, sf_dir, "customer").select(F.explode(F.array_compact(forms_)).alias("f")).select(F.col("f.canonical").alias("entity_key"), "f.*")
    return grouping.address_groups(rows)


@query("""
with n as (select c_custkey as id, ['Maria', 'John', 'Peter'][c_custkey % 3 + 1] || ' Keller' || (c_custkey % 50) as name from customer), f as (select name, count(*) as documents from n group by name)
select name, name as main from f where documents >= 3 union all
select substr(name, 1, 1) || '. ' || string_split(name, ' ')[2], name from f where documents >= 3
""")
def a17_main_names(spark, sf_dir):
    first = F.get(F.array(*map(F.lit, ("Maria", "John", "Peter"))), (F.col("c_custkey") % 3).cast("int"))
    full = table(spark, sf_dir, "customer").select(first.alias("f"), F.concat(F.lit("Keller"), (F.col("c_custkey") % 50).cast("string")).alias("l"))
    rows = full.groupBy("f", "l").agg(F.count(F.lit(1)).alias("documents")).where("documents >= 3")
    mains = rows.select(F.concat_ws(" ", "f", "l").alias("name"), "documents")
    short = rows.select(F.concat(F.substring("f", 1, 1), F.lit(". "), "l").alias("name"), F.lit(1).cast("long").alias("documents"))
    return grouping.main_names(mains.unionByName(short))


# -- measures ---------------------------------------------------------------------------------
def _ledger(spark: SparkSession, sf_dir: str, rows: str = "true") -> DataFrame:
    amount = F.format_string("$%d.%02d", (F.col("l_quantity")).cast("long"), (F.col("l_partkey") % 3).cast("long"))
    l = table(spark, sf_dir, "lineitem").where(rows).select(F.col("l_orderkey").alias("doc_id"), F.struct("l_linenumber", amount.alias("t")).alias("x"))  # noqa: E741
    return l.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]), "\n").alias("text"))


@query("select l_orderkey as doc_id, '$' || cast(l_quantity as bigint) || '.' || lpad(cast(l_partkey % 3 as varchar), 2, '0') as amount, count(*) as n from lineitem group by all")
def a10_money_multiset(spark, sf_dir):
    return metrics.money(_ledger(spark, sf_dir))


@query("""
with m as (select l_orderkey as doc_id, '$' || cast(l_quantity as bigint) || '.' || lpad(cast(l_partkey % 3 as varchar), 2, '0') as amount, l_linenumber as k from lineitem),
b as (select doc_id, amount, count(*) as n from m group by all), a as (select doc_id, amount, count(*) as n from m where k > 1 group by all)
select doc_id, amount, b.n - coalesce(a.n, 0) as lost from b left join a using (doc_id, amount) where b.n > coalesce(a.n, 0)
""")
def u1_destroyed_money(spark, sf_dir):
    before, after = _ledger(spark, sf_dir), _ledger(spark, sf_dir, "l_linenumber > 1")
    return metrics.lost(metrics.money(before), metrics.money(after), "amount")


@query("select o_custkey as doc_id, count(*) >= 12 as financial from orders group by o_custkey")
def p17_financial(spark, sf_dir):
    amount = F.concat(F.lit("$"), (F.col("o_orderkey") % 1000).cast("string"), F.lit(".05"))
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_join(F.collect_list(amount), " and ").alias("text"))
    return o.select("doc_id", metrics.is_financial(F.col("text")).alias("financial"))


@query("""
select case grouping_id(category, doc_type, status) when 3 then 'category' when 1 then 'type_category' when 6 then 'status' else 'all' end as level, category, doc_type, status,
count(*) as findings, count(distinct doc_id) as files, count(distinct value) as distinct_values
from (select l_orderkey as doc_id, l_returnflag as category, l_linestatus as status, 'T' || l_linenumber % 3 as doc_type, cast(l_partkey % 100 as varchar) as value from lineitem)
group by grouping sets ((category), (doc_type, category), (status), ())
""")
def a9_report(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return metrics.report(l.select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("status"), F.concat(F.lit("T"), (F.col("l_linenumber") % 3).cast("string")).alias("doc_type"), (F.col("l_partkey") % 100).cast("string").alias("value")))


@query("select o_custkey as thing, count(distinct o_orderpriority) as replacements from orders group by 1 having count(distinct o_orderpriority) > 1")
def a11_split_replacements(spark, sf_dir):
    return metrics.split_replacements(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("thing"), F.col("o_orderpriority").alias("replacement")))


@query("""
with e as (select props, count(distinct user_id) as documents from events group by props)
select t as threshold, count(*) filter (documents >= t) as kept, count(*) filter (documents < t and length(props) % 2 = 0) as labelled_lost from e, (select unnest([1, 2, 3]) as t) group by t
""")
def a13_recurrence(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("props").agg(F.count_distinct("user_id").alias("documents"))
    return metrics.recurrence(e, F.length("props") % 2 == 0)


@query("""
with c as (select o_custkey, count(*) as n from orders group by 1) select case when n = 1 then '1' when n = 2 then '2' when n = 3 then '3' when n < 10 then '4-9' else '10+' end as bucket, count(*) as entities from c group by 1
""")
def a16_histogram(spark, sf_dir):
    return metrics.histogram(table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")))


@query("""
with h as (select c_name as value, case when c_custkey % 2 = 0 then 'person' else 'phone' end as category from customer)
select value, category, case when c % 5 = 0 and category = 'person' then 'confirmed' when c % 5 = 0 then 'wrong_kind' when c % 5 = 1 then 'third_party' else 'unlabelled' end as verdict
from (select *, cast(regexp_extract(value, '([0-9]+)$', 1) as bigint) as c from h)
""")
def a14_verdicts(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    n = F.regexp_extract("c_name", "([0-9]+)$", 1).cast("long")
    hits = c.select(F.col("c_name").alias("value"), F.when(F.col("c_custkey") % 2 == 0, "person").otherwise("phone").alias("category"))
    return metrics.verdicts(hits, c.where(n % 5 == 0).select(F.col("c_name").alias("value"), F.lit("person").alias("kind")), c.where(n % 5 == 1).select(F.col("c_name").alias("value")))


@query("""
with p as (select (o_orderkey * 37 % 100) / 100.0 as score, o_custkey % 2 = 0 as same, case when o_orderkey % 3 = 0 then 'tune' else 'held' end as split from orders)
select split, cast(c as double) as cutoff, count(*) filter (score >= c and same) as true_positives, count(*) filter (score >= c and not same) as false_positives, count(*) filter (same) as same_pairs, count(*) filter (not same) as other_pairs
from p, (select unnest([0.25, 0.5, 0.75]) as c) group by all
""")
def a15_threshold_sweep(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return metrics.threshold_sweep(o.select((F.col("o_orderkey") * 37 % 100 / 100.0).alias("score"), (F.col("o_custkey") % 2 == 0).alias("same"), F.when(F.col("o_orderkey") % 3 == 0, "tune").otherwise("held").alias("split")), (0.25, 0.5, 0.75))
