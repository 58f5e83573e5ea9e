"""Tables from positioned cells: runs of rows, their columns, and the people and payers that columns name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.gates import acceptable_person_col
from ..storage import partitions_for

#: Cells from which a row without digits is a heading, and rows that make a table.
HEADING_CELLS, LEAST_ROWS = 3, 2
_FIGURE = r"^\s*[-+(]?\s*\$?\s*[0-9][0-9,]*(?:\.[0-9]{2})?\s*\)?\s*$"
#: Heads of columns that name the other party of a payment, and of cells that name an employer.
PARTY_HEADS = ("payee", "from", "to", "recipient", "sender", "recipient / sender", "paid to", "received from", "name", "merchant / payee")
EMPLOYER_HEADS = ("employer", "employer name", "employer's name", "name of employer", "place of employment")


def tables(cells: DataFrame) -> DataFrame:
    """The cells of tables: doc_id, page, table_id, row, cell, x0, x1 and text.

    A table is a run of neighbouring rows with two cells or more; a row of one lone figure may stand among
    them; a heading (three cells or more, no digits) begins a new table. Cells are doc_id, page, row, cell,
    x0, x1 and text, as ``units.row_cells`` makes them."""
    # All steps are grouped within a page, so its cells are dealt once and met again by no join.
    held = cells.where("doc_id is not null and page is not null and row is not null").repartition(partitions_for(cells), "doc_id", "page")
    cell = F.struct("cell", "x0", "x1", "text")
    per_row = held.groupBy("doc_id", "page", "row").agg(F.collect_list(cell).alias("__cells"), F.count(F.lit(1)).alias("__n"), F.bool_and(F.col("text").rlike(_FIGURE)).alias("__figure"), F.bool_or(F.col("text").rlike("[0-9]")).alias("__digit"))
    page = Window.partitionBy("doc_id", "page").orderBy("row")
    inside = (F.col("__n") >= 2) | F.col("__figure")
    heading = (F.col("__n") >= HEADING_CELLS) & ~F.col("__digit")
    rows = per_row.withColumn("__in", inside).withColumn("__start", (F.col("__in") & (~F.coalesce(F.lag("__in").over(page), F.lit(False)) | heading)).cast("int"))
    rows = rows.withColumn("__run", F.sum("__start").over(page)).where("__in")
    run = Window.partitionBy("doc_id", "page", "__run")
    rows = rows.withColumn("__k", F.count_if(F.col("__n") >= 2).over(run)).where(F.col("__k") >= LEAST_ROWS)
    rows = rows.withColumn("table_id", F.dense_rank().over(Window.partitionBy("doc_id", "page").orderBy("__run")) - 1)
    rows = rows.withColumn("__row", F.row_number().over(run.orderBy("row")) - 1)
    return rows.select("doc_id", "page", "table_id", F.col("__row").alias("row"), F.explode("__cells").alias("c")).select("doc_id", "page", "table_id", "row", "c.*")


def aligned(cells: DataFrame) -> DataFrame:
    """doc_id, page, table_id, row, col and text: the columns are the cells of the widest row (the first of
    several); each cell goes to the column that it overlaps most, or else to the one whose middle is nearest.
    Cells of a row in one column are joined by a space."""
    table = ["doc_id", "page", "table_id"]
    whole = Window.partitionBy(*table)
    n = F.count(F.lit(1)).over(Window.partitionBy(*table, "row"))
    rows = cells.withColumn("__n", n).withColumn("__widest", F.max(F.struct("__n", (-F.col("row")).alias("r"))).over(whole))
    # a table's columns, some tens at most, stand beside each of its cells
    head = F.collect_list(F.when(F.col("row") == -F.col("__widest.r"), F.struct("x0", "cell", "x1"))).over(whole)
    away = lambda c: F.abs((F.col("x0") + F.col("x1") - c["x0"] - c["x1"]) / 2)
    overlap = lambda c: F.greatest(F.least("x1", c["x1"]) - F.greatest("x0", c["x0"]), F.lit(0.0))
    best = F.array_max(F.transform(F.array_sort(head), lambda c, i: F.struct(overlap(c).alias("o"), (-away(c)).alias("a"), (-i).alias("i"))))
    at = rows.withColumn("__at", best).groupBy(*table, "row", "cell", "x0", "text").agg((-F.max("__at")["i"]).alias("col"))
    parts = F.array_sort(F.collect_list(F.struct("x0", "cell", "text")))
    return at.groupBy(*table, "row", "col").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def _headed(cells: DataFrame, heads: tuple[str, ...]) -> DataFrame:
    """The cells below a head of these names, with the document."""
    named = F.max((F.col("row") == 0) & F.lower(F.trim("text")).isin(*heads)).over(Window.partitionBy("doc_id", "page", "table_id", "col"))
    return cells.withColumn("__named", named).where("__named and row > 0").drop("__named")


def column_parties(cells: DataFrame) -> DataFrame:
    """doc_id and value of the people that the party columns of aligned tables name."""
    rows = _headed(cells, PARTY_HEADS).withColumn("value", F.trim("text"))
    return rows.where(acceptable_person_col("value")).select("doc_id", "value").distinct()


def column_employers(cells: DataFrame) -> DataFrame:
    """doc_id and value of the employers that a column's head names, or a cell to their left below the head."""
    below = _headed(cells, EMPLOYER_HEADS).select("doc_id", F.trim("text").alias("value"))
    right = Window.partitionBy("doc_id", "page", "table_id", "row").orderBy("col")
    beside = cells.withColumn("__l", F.lower(F.rtrim(F.lag("text").over(right), F.lit(" :")))).where(F.col("__l").isin(*EMPLOYER_HEADS) & (F.col("row") > 0)).select("doc_id", F.trim("text").alias("value"))
    return below.unionByName(beside).where((F.col("value") != "") & ~F.col("value").rlike(r"^[0-9$]")).distinct()


def child_rows(cells: DataFrame) -> DataFrame:
    """doc_id, name and born of the rows of child rosters: tables with a column of names and one of births."""
    lower = F.lower(F.trim("text"))
    whole = Window.partitionBy("doc_id", "page", "table_id")
    first = lambda pattern: F.min(F.when((F.col("row") == 0) & lower.rlike(pattern), F.col("col"))).over(whole)
    name = first(r"^(?:child(?:ren)?(?:'s)?|name|initials|child's (?:name|initials)|name of (?:minor )?child)$")
    rows = cells.withColumns({"__name": name, "__born": first(r"birth|\bborn\b|\bdob\b")}).where("row > 0 and __name is not null and __born is not null")
    pick = lambda c: F.max(F.when(F.col("col") == F.col(c), F.trim("text")))
    out = rows.groupBy("doc_id", "page", "table_id", "row").agg(pick("__name").alias("name"), pick("__born").alias("born"))
    return out.where("name <> '' and born <> ''").select("doc_id", "name", "born")


