"""Registered queries on people, parties and review tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph, grouping, literals, parties, people, registry
from ..sources import files
from .catalog import _FIRST, _LAST, _key, _names, _pad, query, table

_FORMS = f"select c_custkey as k, {_pad('c_custkey', 9)} as d from customer"


@query("select c_custkey as key, c_custkey - c_custkey % 16 as head from customer")
def a7_heads(spark, sf_dir):
    k = F.col("c_custkey")
    step = F.when(k % 16 == 0, None).when(k % 4 == 0, k - k % 16).when(k % 2 == 0, k - k % 4).otherwise(k - 1)
    return graph.heads(table(spark, sf_dir, "customer").select(k.alias("key"), step.alias("parent")))


@query(f"""
with f as (select '9' || lpad(cast(c_custkey % 100000 as varchar), 8, '0') as d from customer), u as (select distinct d from f), t as (select substr(d, 6) as tail, count(*) as n, min(d) as one from u group by 1)
select d as entity_key, d as head from u union all select '***-**-' || tail, case when n = 1 then one else '***-**-' || tail end from t
""")
def a5_ssn_groups(spark, sf_dir):
    d = F.concat(F.lit("9"), F.lpad((F.col("c_custkey") % 100000).cast("string"), 8, "0"))
    rows = table(spark, sf_dir, "customer").select(F.explode(F.array(d, F.concat(F.lit("***-**-"), F.substring(d, 6, 4)))).alias("canonical")).distinct()
    return grouping.ssn_groups(rows.select(F.col("canonical").alias("entity_key"), "canonical"))


@query("""
select s_suppkey as party, case when count(*) over (partition by s_nationkey) > 1 then 'NATION-' || s_nationkey || '-' || row_number() over (partition by s_nationkey order by s_suppkey) else 'NATION-' || s_nationkey end as owner from supplier
""")
def w6_owner_numbers(spark, sf_dir):
    return parties.owner_labels(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("party"), F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("role")))


@query("""
with v as (select o_custkey as owner, case o_orderkey % 3 when 0 then 'ssn' when 1 then 'phone' else 'account' end as kind, o_orderkey as value from orders),
n as (select *, row_number() over (partition by owner, kind order by value) as n from v)
select cast(owner as varchar) as owner, kind, cast(value as varchar) as value, case when kind = 'ssn' and n = 1 then '[' || owner || '-SSN]' else '[' || owner || '-' || upper(kind) || '-' || n || ']' end as label from n
""")
def w2_role_labels(spark, sf_dir):
    k = F.col("o_orderkey")
    kind = F.when(k % 3 == 0, "ssn").when(k % 3 == 1, "phone").otherwise("account")
    return parties.value_labels(table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("owner"), kind.alias("kind"), k.cast("string").alias("value"), k.alias("seq")))


@query(f"""
with r as (select k, 'A' || lpad(cast(k as varchar), 6, '0') as key, '77' || lpad(cast(k as varchar), 8, '0') as num from (select c_custkey as k from customer)),
t as (select substr(num, 7) as tail, count(*) as n, min(key) as one from r group by 1)
select k * 2 as id, 'account' as kind, '00' || num as value, key from r union all select k * 2 + 1, 'account', 'XXXX' || substr(num, 7), case when n = 1 then one end from r join t on substr(num, 7) = tail
""")
def j11_fold(spark, sf_dir):
    k = F.col("c_custkey")
    num = F.concat(F.lit("77"), F.lpad(k.cast("string"), 8, "0"))
    rows = table(spark, sf_dir, "customer").select(k.alias("k"), F.concat(F.lit("A"), F.lpad(k.cast("string"), 6, "0")).alias("key"), F.lit("account").alias("kind"), num.alias("value"))
    found = rows.select((F.col("k") * 2).alias("id"), "kind", F.concat(F.lit("00"), "value").alias("value")).unionByName(rows.select((F.col("k") * 2 + 1).alias("id"), "kind", F.concat(F.lit("XXXX"), F.substring("value", 7, 4)).alias("value")))
    return parties.fold(found, rows)


@query("select o_custkey as head, o_orderpriority as kind, count(*) as forms, cast(sum(o_orderkey) as bigint) as occurrences, bool_or(o_orderstatus = 'F') as ticked from orders group by all")
def a12_review_rows(spark, sf_dir):
    return parties.review_rows(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("head"), F.col("o_orderpriority").alias("kind"), F.col("o_orderkey").alias("occurrences"), (F.col("o_orderstatus") == "F").alias("enabled")))


@query("""
select cast(l_suppkey as varchar) as owner, l_returnflag as kind, 'Value ' || l_partkey % 50 as value, count(*) as times, min(l_orderkey) as first_doc, cast(min_by(l_linenumber, l_orderkey * 100 + l_linenumber) as integer) as first_page from lineitem group by all
""")
def a21_merged_rows(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return parties.merged_rows(l.select(F.col("l_suppkey").cast("string").alias("owner"), F.col("l_returnflag").alias("kind"), F.concat(F.lit("Value "), (F.col("l_partkey") % 50).cast("string")).alias("value"), F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page")))


@query("with n as (select p_brand, p_size, count(*) as n, min(p_partkey) as f from part group by all) select p_partkey as id, case when n >= 4 then f else p_partkey end as grp from part join n using (p_brand, p_size)")
def a22_fold_alike(spark, sf_dir):
    return parties.fold_alike(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("|", "p_brand", F.col("p_size").cast("string")).alias("shape")))


@query("""
with p as (select o_custkey as key, o_orderkey % 11 as r, 'v' || o_orderkey as value from orders)
select key, min_by(value, lpad(cast(r as varchar), 3, '0') || value) as value, min(r) as source_rank from p where key not in (select c_custkey from customer where c_nationkey = 3) group by key
""")
def u2_first_wins(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), (F.col("o_orderkey") % 11).alias("source_rank"), F.concat(F.lit("v"), F.col("o_orderkey").cast("string")).alias("value"))
    return parties.first_wins(p, table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("key")))


@query("select c_custkey as doc_id, cast(0 as integer) as line_no, c_custkey || ' Elm St' as text, 'Provo, UT 846' || lpad(cast(c_custkey % 100 as varchar), 2, '0') as below from customer where c_custkey % 4 <> 1")
def j12_city_lines(spark, sf_dir):
    k = F.col("c_custkey")
    zip5 = F.concat(F.lit("846"), F.lpad((k % 100).cast("string"), 2, "0"))
    lines = F.array(F.struct(F.concat(k.cast("string"), F.lit(" Elm St")).alias("text"), F.when(k % 2 == 0, zip5).when(k % 4 == 1, "99999").alias("zip5")), F.struct(F.concat(F.lit("Provo, UT "), zip5).alias("text"), F.lit(None).cast("string").alias("zip5")))
    rows = table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.posexplode(lines).alias("line_no", "l")).select("doc_id", "line_no", "l.*")
    return parties.city_lines(rows)


@query("""
with n as (select page_id, '/case' || page_id % 7 || '/' || case when page_id % 5 = 0 then 'Jane Roe ' || page_id || '.pdf' when page_id % 2 = 0 then 'stmt.pdf' else 'STMT.pdf' end as path, page_id % 5 = 0 as held from pages),
d as (select path, case when held then 'document_' || lpad(cast(row_number() over (partition by held order by path) as varchar), case when row_number() over (partition by held order by path) > 99 then 3 else 2 end, '0') || '.pdf' else regexp_extract(path, '([^/]+)$', 1) end as name, held from (select distinct path, held from n))
select path, case when r > 1 then regexp_replace(name, '\\.pdf$', '') || '_' || r || '.pdf' else name end as name
from (select path, name, row_number() over (partition by regexp_extract(path, '^(.*)/[^/]+$', 1), lower(name) order by path) as r from d)
""")
def k7_k8_file_names(spark, sf_dir):
    p = F.col("page_id")
    name = F.when(p % 5 == 0, F.concat(F.lit("Jane Roe "), p.cast("string"), F.lit(".pdf"))).when(p % 2 == 0, "stmt.pdf").otherwise("STMT.pdf")
    paths = table(spark, sf_dir, "pages").select(F.concat(F.lit("/case"), (p % 7).cast("string"), F.lit("/"), name).alias("path")).distinct()
    return files.scrub_names(paths, ["Jane Roe"])


@query(f"""
with k as (select c_custkey as k, cast(300000000000 + c_custkey * 7919 as varchar) as d from customer)
select k as doc_id, d as value, cast(5 as integer) as "begin", cast(19 as integer) as "end" from k union all select k, d, 24, 36 from k
""")
def j2_numbers_with_signs(spark, sf_dir):
    """A number is found however its digits are parted, but not inside a sum."""
    d = (F.lit(300000000000) + F.col("c_custkey") * 7919).cast("string")
    text = F.concat(F.lit("acct "), F.substring(d, 1, 4), F.lit(" "), F.substring(d, 5, 4), F.lit("-"), F.substring(d, 9, 9), F.lit(" is "), F.lit(" "), d, F.lit(" not "), d, F.lit(".50"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), text.alias("text"), d.alias("value"))
    return literals.find_values(rows.select("doc_id", "text"), rows.select("value"))


@query("""
with r as (select case c_custkey % 4 when 0 then 'Bob' when 1 then 'Liz' when 2 then 'Pat' else 'Xavier' end as name from customer)
select distinct name, case name when 'Bob' then 'Robert Roe' else 'Elizabeth Roe' end as party from r where name in ('Bob', 'Liz')
""")
def j15_diminutives(spark, sf_dir):
    n = F.get(F.array(*map(F.lit, ("Bob", "Liz", "Pat", "Xavier"))), (F.col("c_custkey") % 4).cast("int"))
    sheet = spark.createDataFrame([("Robert", "Robert Roe"), ("Elizabeth", "Elizabeth Roe"), ("Patricia", "Patricia Roe"), ("Patrick", "Patrick Roe")], "first string, party string")
    return people.diminutives(table(spark, sf_dir, "customer").select(n.alias("name")).distinct(), sheet)


@query("""
select o_orderkey as doc_id, 'p' || o_custkey % 3 as entity_key, ['Maria', 'John', 'Peter'][o_custkey % 3 + 1] || ' ' || ['Keller', 'Novak', 'Ortega'][o_custkey % 3 + 1] as value, cast(8 as integer) as "begin" from orders
""")
def j3_name_variants(spark, sf_dir):
    first, last = F.array(*map(F.lit, ("Maria", "John", "Peter"))), F.array(*map(F.lit, ("Keller", "Novak", "Ortega")))
    i = (F.col("o_custkey") % 3).cast("int")
    text = F.concat(F.lit("paid by "), F.get(first, i), F.lit(" "), F.get(last, i), F.lit(" in cash"))
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))
    return people.find_people(docs, [("p0", "Maria Keller"), ("p1", "John Novak"), ("p2", "Peter Ortega")]).select("doc_id", "entity_key", "value", "begin")


@query("""
select category || '|' || lower(value) as entity_key, cast(rank as integer) as rank, context from (select *, row_number() over (partition by category, lower(value) order by doc_id, context) as rank
from (select category, value, context, min(doc_id) as doc_id from (select c_custkey as doc_id, 'organization' as category, c_mktsegment as value, 'paid to [' || c_mktsegment || '] by ' || c_custkey % 5 as context from customer) group by all)) where rank <= 2
""")
def w5_contexts(spark, sf_dir):
    s = F.col("c_mktsegment")
    units = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("unit_id"), F.concat(F.lit("paid to "), s, F.lit(" by "), (F.col("c_custkey") % 5).cast("string")).alias("text"), s.alias("value"))
    matches = units.select("doc_id", "unit_id", F.lit(8).alias("begin"), (F.lit(8) + F.length("value")).alias("end"), F.lit("organization").alias("category"), "value")
    return registry.contexts(matches, units.drop("value"))


@query(f"""
with c as (select distinct cast(c_custkey % 20 as varchar) as set_id, {_FIRST}[c_custkey % {len(_FIRST)} + 1] as f, chr(cast(65 + c_custkey % 26 as integer)) as m, {_LAST}[c_custkey % {len(_LAST)} + 1] as l from customer),
g as (select set_id, f, l, list(f || ' ' || m || ' ' || l order by f || ' ' || m || ' ' || l) as heads from c group by all), s as (select *, unnest([f || ' ' || l, l || ', ' || f]) as name from g)
select set_id, f || ' ' || m || ' ' || l as name, f || ' ' || m || ' ' || l as head, '' as candidates from c
union all select set_id, name, case when len(heads) = 1 then heads[1] else name end, case when len(heads) > 1 then array_to_string(heads, ', ') else '' end from s
""")
def a8_people_heads(spark, sf_dir):
    f, m, l = _names()  # noqa: E741
    rows = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 20).cast("string").alias("set_id"), F.explode(F.array(F.concat_ws(" ", f, m, l), F.concat_ws(" ", f, l), F.concat(l, F.lit(", "), f))).alias("name"))
    return people.people_heads(rows).withColumn("candidates", F.array_join("candidates", ", "))


@query(f"select k as id, substr(d, 1, 3) || '-' || substr(d, 4, 2) || '-' || substr(d, 6) as ssn, '801-555-' || right(d, 4) as phone, 'k' || k || '@example.com' as email from ({_FORMS})")
def f20_normalised(spark, sf_dir):
    from ..functions.forms import normalise

    d = _key("c_custkey", 9)
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), normalise(F.lit("ssn"), F.concat_ws(" ", F.substring(d, 1, 3), F.substring(d, 4, 2), F.substring(d, 6, 4))).alias("ssn"),
        normalise(F.lit("phone"), F.concat(F.lit("+1 (801) 555."), F.substring(d, 6, 4))).alias("phone"), normalise(F.lit("email"), F.concat(F.lit(" K"), F.col("c_custkey").cast("string"), F.lit("@Example.com "))).alias("email"),
    )


@query("select distinct c_mktsegment as value, lower(c_mktsegment) as joined, lower(c_mktsegment) || ' bank' as key from customer")
def f17_organisation_keys(spark, sf_dir):
    s = F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(s.alias("value"), X.joined_org(F.concat(F.lit("The "), s, F.lit(", Inc."))).alias("joined"), X.org_key(F.concat(s, F.lit(" Bank LLC"))).alias("key")).distinct()
