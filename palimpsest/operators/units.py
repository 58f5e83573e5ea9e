"""Units of text: lines with their offsets, regions, and labels of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CAPTION_LINES, CAPTION_LEAST = 70, 8
_BODY = r"^\s*(?:1\.|COMES NOW|INTRODUCTION|BACKGROUND|FACTS)\b"


def lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line_no (from 0), start (offset in the text) and text of every line. A null text has
    no lines, an empty one a single empty line."""
    parts = F.split(F.col(text_col), "\n", -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<line_no:int,start:int,text:string>>").alias("out"))
    walk = F.aggregate(
        parts, start,
        lambda acc, p: F.struct((acc["at"] + F.length(p) + 1).alias("at"), F.concat(acc["out"], F.array(F.struct(F.size(acc["out"]).alias("line_no"), acc["at"].alias("start"), p.alias("text")))).alias("out")),
        lambda acc: acc["out"],
    )
    # lines are numbered by posexplode and offsets summed inside the row's own partition of the text,
    # without a shuffle; the fold is used for short texts only, as it copies its list
    short = F.length(F.col(text_col)) < 4096
    rows = documents.select(F.monotonically_increasing_id().alias("__rid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"), F.when(short, walk).alias("__lines"))
    few = rows.where("__lines is not null").select("doc_id", F.explode("__lines").alias("l")).select("doc_id", "l.line_no", "l.start", "l.text")
    many = rows.where("__lines is null and __text is not null").select("doc_id", "__rid", F.posexplode(F.split("__text", "\n", -1)).alias("line_no", "text"))
    before = Window.partitionBy("__rid").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    many = many.select("doc_id", "line_no", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("int").alias("start"), "text")
    return few.unionByName(many)


def document_texts(units: DataFrame) -> DataFrame:
    """One text for each document: its units in order, joined by line breaks."""
    parts = F.array_sort(F.collect_list(F.struct("unit_id", "text")))
    return units.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))


def document_labels(files: DataFrame) -> DataFrame:
    """path and label: the name, or folder and name where several files bear it."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    same = F.count(F.lit(1)).over(Window.partitionBy("__name"))
    return files.withColumn("__name", F.lower(name)).select("path", F.when((same > 1) & (folder != ""), F.concat_ws("/", folder, name)).otherwise(name).alias("label"))


def caption_region(text: Column) -> Column:
    """The first lines of a pleading, cut where its body begins (after the first few lines)."""
    parts = F.slice(F.split(text, "\n", -1), 1, CAPTION_LINES)
    body = F.filter(F.sequence(F.lit(CAPTION_LEAST + 1), F.greatest(F.size(parts), F.lit(CAPTION_LEAST + 1))), lambda i: F.coalesce(F.get(parts, i - 1).rlike(_BODY), F.lit(False)))
    return F.array_join(F.slice(parts, 1, F.coalesce(F.get(body, 0) - 1, F.size(parts))), "\n")


def column_texts(cells: DataFrame) -> DataFrame:
    """Every table column with at least two cells that aren't blank, read downwards."""
    rows = F.array_sort(F.collect_list(F.struct("row", "text")))
    out = cells.where(F.trim("text") != "").groupBy("doc_id", "table_id", "col").agg(rows.alias("r"))
    return out.where(F.size("r") >= 2).select("doc_id", "table_id", "col", F.array_join(F.transform("r", lambda x: x["text"]), "\n").alias("text"))


def words_to_lines(words: DataFrame, gap: float = 1.4) -> DataFrame:
    """Positioned words of a page as lines of text. A gap of ``gap`` characters or more becomes three
    to twelve spaces; a new block or line breaks the line."""
    order = Window.partitionBy("doc_id", "page", "block", "line").orderBy("word")
    width = (F.col("x1") - F.col("x0")) / F.greatest(F.length("text"), F.lit(1))
    space = F.col("x0") - F.lag("x1").over(order)
    wide = F.least(F.greatest(F.floor(space / width), F.lit(3)), F.lit(12)).cast("int")
    lead = F.when(space.isNull(), "").when(space >= gap * width, F.repeat(F.lit(" "), wide)).otherwise(" ")
    spaced = words.withColumn("piece", F.concat(lead, "text"))
    parts = F.array_sort(F.collect_list(F.struct("word", "piece")))
    return spaced.groupBy("doc_id", "page", "block", "line").agg(F.array_join(F.transform(parts, lambda p: p["piece"]), "").alias("text"))


#: Widths of letters beside an ordinary one.
NARROW, WIDE = "ijltf.,;:'|!1 ", "mwMW@"


def letter_places(word: Column, x0: Column, x1: Column) -> Column:
    """Where each letter of a word between x0 and x1 begins: narrow letters take half a share, wide ones two."""
    letters = F.filter(F.split(word, ""), lambda c: c != "")
    share = F.transform(letters, lambda c: F.when(F.contains(F.lit(NARROW), c), 0.5).when(F.contains(F.lit(WIDE), c), 2.0).otherwise(1.0))
    add = lambda n: F.aggregate(F.slice(share, 1, n), F.lit(0.0), lambda a, s: a + s)
    total = add(F.size(share))
    return F.transform(letters, lambda c, i: x0 + (x1 - x0) * add(i) / total)


def visual_rows(words: DataFrame, tolerance: float = 0.45) -> DataFrame:
    """Words numbered by the visual row they stand in: a new row begins where the middle of a word is
    further below the one before than a share of its height."""
    page = Window.partitionBy("doc_id", "page").orderBy("__mid", "x0")
    mid = (F.col("y0") + F.col("y1")) / 2
    out = words.withColumn("__mid", mid)
    step = (F.col("__mid") - F.lag("__mid").over(page)) > tolerance * (F.col("y1") - F.col("y0"))
    out = out.withColumn("__new", F.coalesce(step, F.lit(False)).cast("int"))
    return out.withColumn("row", F.sum("__new").over(page.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__mid", "__new")


def row_cells(words: DataFrame, gap: float = 1.4) -> DataFrame:
    """Cells of visual rows: a word further right than ``gap`` characters begins a new cell."""
    row = Window.partitionBy("doc_id", "page", "row").orderBy("x0")
    width = (F.col("x1") - F.col("x0")) / F.greatest(F.length("text"), F.lit(1))
    new = F.coalesce((F.col("x0") - F.lag("x1").over(row)) >= gap * width, F.lit(False)).cast("int")
    out = words.withColumn("__new", new).withColumn("cell", F.sum("__new").over(row.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("x0", "text")))
    return out.groupBy("doc_id", "page", "row", "cell").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def table_contexts(cells: DataFrame, longest_label: int = 60) -> DataFrame:
    """Every cell with what may label it: the column's head, the cell above, the cell to the left and
    the row's head; as ``label: text`` rows, the reading in ``source``."""
    down = Window.partitionBy("doc_id", "table_id", "col").orderBy("row")
    right = Window.partitionBy("doc_id", "table_id", "row").orderBy("col")
    told = {
        "head": F.first("text").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "above": F.lag("text").over(down),
        "left": F.lag("text").over(right), "row_head": F.first("text").over(right.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    }
    both = F.array(*[F.struct(F.lit(k).alias("source"), v.alias("label")) for k, v in told.items()])
    out = cells.withColumn("__l", both).select("doc_id", "table_id", "row", "col", "text", F.explode("__l").alias("__l")).select("doc_id", "table_id", "row", "col", "text", "__l.*")
    fine = F.col("label").isNotNull() & (F.length("label") <= longest_label) & (F.trim("label") != "") & (F.trim("text") != "") & (F.col("label") != F.col("text"))
    return out.where(fine).select("doc_id", "table_id", "row", "col", "source", F.concat_ws(": ", F.rtrim("label"), "text").alias("text"))
