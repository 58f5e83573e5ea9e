"""Registered queries on tables from positioned cells, and on what a case gets back."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.gates import as_column
from ..operators import tables
from ..sources import delivery, files, pages
from .catalog import query, table

#: A page of a payment ledger: row, x0, x1, text. The heading has four cells, the second payment lacks its note,
#: and a lone figure stands among the rows; the line of prose above is no table.
_LEDGER = (
    (0, 10.0, 200.0, "Account statement"), (1, 10.0, 30.0, "ID"), (1, 60.0, 90.0, "Note"), (1, 120.0, 150.0, "From"), (1, 180.0, 200.0, "To"), (2, 230.0, 260.0, "$31.07"),
    (3, 10.0, 40.0, "{k}"), (3, 58.0, 100.0, "tram pass"), (3, 118.0, 165.0, "Ina Berger"), (3, 181.0, 225.0, "Otto Lang"),
    (4, 10.0, 40.0, "{k}9"), (4, 119.0, 160.0, "Vera Holm"), (4, 183.0, 225.0, "Ina Berger"), (5, 10.0, 300.0, "Thank you for using the service"),
)
_STUB = ((0, 10.0, 60.0, "Employer"), (0, 80.0, 160.0, "Period"), (1, 10.0, 70.0, "Oak {k} Supply"), (1, 80.0, 130.0, "May 2024"))
_CHILDREN = ((0, 10.0, 60.0, "Initials"), (0, 80.0, 160.0, "Birth month"), (1, 10.0, 40.0, "MKB"), (1, 80.0, 130.0, "03/2019"), (2, 10.0, 40.0, "TNB"), (2, 80.0, 130.0, "09/2015"))


def _cells(spark, sf_dir, page):
    made = F.array(*[F.struct(F.lit(r).alias("row"), F.lit(i).alias("cell"), F.lit(a).alias("x0"), F.lit(b).alias("x1"), F.replace(F.lit(t), F.lit("{k}"), F.col("c_custkey").cast("string")).alias("text")) for i, (r, a, b, t) in enumerate(page)])
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("page"), F.explode(made).alias("m")).select("doc_id", "page", "m.*")


def _rows(*rows: tuple) -> str:
    """The same rows for every customer; {k} in a text is the key."""
    value = lambda x: ("replace('" + x.replace("'", "''") + "', '{k}', cast(c_custkey as varchar))") if isinstance(x, str) else f"cast({x} as integer)"
    return rows and " union all ".join("select c_custkey as doc_id, " + ", ".join(f"{value(v)} as {n}" for n, v in r) + " from customer" for r in rows)


def _named(names: str, *rows: tuple) -> str:
    return _rows(*[tuple(zip(names.split(), r, strict=True)) for r in rows])


@query(_named("page table_id row text", *[(0, 0, r - 1, t) for r, _, _, t in _LEDGER if 1 <= r <= 4]))
def s8_tables(spark, sf_dir):
    return tables.tables(_cells(spark, sf_dir, _LEDGER)).select("doc_id", "page", "table_id", "row", "text")


@query(_named("page table_id row col text", *[(0, 0, r - 1, c, t) for r, c, t in (
    (1, 0, "ID"), (1, 1, "Note"), (1, 2, "From"), (1, 3, "To"), (2, 3, "$31.07"), (3, 0, "{k}"), (3, 1, "tram pass"), (3, 2, "Ina Berger"), (3, 3, "Otto Lang"), (4, 0, "{k}9"), (4, 2, "Vera Holm"), (4, 3, "Ina Berger"))]))
def s9_aligned_columns(spark, sf_dir):
    return tables.aligned(tables.tables(_cells(spark, sf_dir, _LEDGER)))


@query(_named("value", ("Ina Berger",), ("Otto Lang",), ("Vera Holm",)))
def h6_column_parties(spark, sf_dir):
    return tables.column_parties(tables.aligned(tables.tables(_cells(spark, sf_dir, _LEDGER))))


@query(_named("value", ("Oak {k} Supply",)))
def h6_column_employers(spark, sf_dir):
    return tables.column_employers(tables.aligned(tables.tables(_cells(spark, sf_dir, _STUB))))


@query(_named("name born", ("MKB", "03/2019"), ("TNB", "09/2015")))
def j21_child_tables(spark, sf_dir):
    return tables.child_rows(tables.aligned(tables.tables(_cells(spark, sf_dir, _CHILDREN))))


@query("select page_id as file_hash, e as engine, 0 as page from pages, (select unnest(['a', 'b']) as e) where not (page_id % 3 = 0 and e = 'a')")
def s16_unread_pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_hash"), F.lit(0).alias("page"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("engine"))
    return pages.unread_pages(p, p.where("file_hash % 3 = 0 and engine = 'a'"))


@query("select c_custkey as path, 0 as page, 'person' as category, case when c_custkey % 2 = 0 then 'Jane  Roe' else 'JANE ROE' end as value, cast(case when c_custkey % 2 = 0 then 2 else 1 end as bigint) as engines from customer")
def s15_readings_together(spark, sf_dir):
    k = F.col("c_custkey")
    found = F.array_compact(F.array(F.when(k % 2 == 0, F.struct(F.lit("a").alias("engine"), F.lit("Jane  Roe").alias("value"))), F.struct(F.lit("b").alias("engine"), F.lit("JANE ROE").alias("value"))))
    rows = table(spark, sf_dir, "customer").select(k.alias("path"), F.lit(0).alias("page"), F.lit("person").alias("category"), F.explode(found).alias("f")).select("path", "page", "category", "f.*")
    return pages.together(rows)


_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def small_docx(*runs: str) -> bytes:
    """An office document of one paragraph of these runs."""
    out = io.BytesIO()
    body = "".join(f'<w:r><w:t xml:space="preserve">{r}</w:t></w:r>' for r in runs)
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{_W}"><w:body><w:p>{body}</w:p></w:body></w:document>')
    return out.getvalue()


@query("select '/case' || c_custkey || '/a.docx' as path, cast(2 as bigint) as replaced, 'by [NAME-1] and [ACCOUNT-' || c_custkey || '].' as text from customer")
def k2_rewritten_documents(spark, sf_dir):
    """A name that two runs cut, and a number that differs from case to case."""
    build = as_column(lambda k: bytearray(small_docx("by Jane ", "Roebuck and ", f"8812{k:06d}", ".")), T.BinaryType())
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("set_id"), F.concat(F.lit("/case"), k.cast("string"), F.lit("/a.docx")).alias("path"), build("c_custkey").alias("content"))
    pairs = F.array(F.struct(F.lit("Jane Roebuck").alias("canonical"), F.lit("[NAME-1]").alias("replacement")), F.struct(F.concat(F.lit("8812"), F.lpad(k.cast("string"), 6, "0")).alias("canonical"), F.concat(F.lit("[ACCOUNT-"), k.cast("string"), F.lit("]")).alias("replacement")))
    mapping = table(spark, sf_dir, "customer").select(k.alias("set_id"), F.explode(pairs).alias("p")).select("set_id", "p.*")
    out = delivery.rewrite_files(rows, mapping)
    return files.texts(out.withColumn("supported", F.lit(True)), ("replaced",)).select("path", "replaced", "text")


@query("""
select 'settings' as section, 'mode' as key, 'redact' as value union all select 'files', l_linestatus, cast(count(*) as varchar) from lineitem group by l_linestatus
union all select 'hits', l_returnflag, cast(count(*) as varchar) from lineitem group by l_returnflag union all select 'replacements', l_returnflag, cast(count(distinct l_partkey) as varchar) from lineitem group by l_returnflag
""")
def k6_run_report(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return delivery.run_report(l.select(F.col("l_orderkey").alias("path"), F.col("l_linestatus").alias("status")), l.select(F.col("l_returnflag").alias("category"), F.col("l_partkey").cast("string").alias("replacement")), {"mode": "redact"})


@query("""
select 'Role ' || c_nationkey as "Role", case when c_custkey % 3 = 0 then '''=1+1' else 'phone' end as "Field", case when c_custkey % 2 = 0 then '''+1 801' else 'x' || c_custkey end as "Value", '' as "Detail",
'f' || c_custkey as "File", cast(c_custkey % 9 as varchar) as "Page", '2' as "Times found" from customer
""")
def k10_party_list(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("Role "), F.col("c_nationkey").cast("string")).alias("role"), F.when(k % 3 == 0, "=1+1").otherwise("phone").alias("field"), F.when(k % 2 == 0, "+1 801").otherwise(F.concat(F.lit("x"), k.cast("string"))).alias("value"), F.lit(None).cast("string").alias("detail"), F.concat(F.lit("f"), k.cast("string")).alias("file"), (k % 9).alias("page"), F.lit(2).alias("times"))
    return delivery.party_list(rows)
