"""What stands near a value: lines above, owners, address blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Lines above a value among which its owner may stand, and lines of a page's header.
BLOCK_LINES, HEADER_LINES = 4, 15
_CITY_LINE = r"^\s*[A-Za-z][A-Za-z .'-]*,?\s+[A-Z]{2}\.?\s+[0-9]{5}(?:-[0-9]{4})?\s*$"
_STREET_LINE = r"^\s*(?:[0-9]+[A-Z]?\s+\S+|P\.?\s?O\.?\s+Box\s+[0-9]+|(?:Apt|Unit|Suite|Ste|#)\.?\s*\S+)"
_MONEY = r"\$|[0-9]\.[0-9]{2}\b"


def anchor(lines: DataFrame, owner_col: str = "owner") -> DataFrame:
    """Add ``anchored``: the owner named on the line; else the nearest above, within four lines and
    with no blank line between; else the owner of the document's header lines if it is the only one.

    Lines are doc_id, line_no, text and an owner or null. A blank line begins a new block, so the
    look-up is a bounded window, not a join."""
    doc = Window.partitionBy("doc_id").orderBy("line_no")
    blank = (F.trim("text") == "").cast("int")
    rows = lines.withColumn("__block", F.sum(blank).over(doc))
    near = Window.partitionBy("doc_id", "__block").orderBy("line_no").rowsBetween(-BLOCK_LINES, -1)
    above = F.last(owner_col, ignorenulls=True).over(near)
    header = lines.where(F.col("line_no") < HEADER_LINES).where(F.col(owner_col).isNotNull()).groupBy("doc_id").agg(F.count_distinct(owner_col).alias("__k"), F.min(owner_col).alias("__h")).where("__k = 1")
    rows = rows.withColumn("__above", above).join(header, "doc_id", "left")
    return rows.withColumn("anchored", F.coalesce(owner_col, "__above", "__h")).drop("__block", "__above", "__k", "__h")


def address_blocks(lines: DataFrame) -> DataFrame:
    """doc_id, line_no and address: a line of city, state and ZIP with up to three street lines right
    above it. Lines of money or over 48 characters are no street."""
    doc = Window.partitionBy("doc_id").orderBy("line_no")
    street = F.col("text").rlike(_STREET_LINE) & ~F.col("text").rlike(_MONEY) & (F.length("text") <= 48)
    rows = lines.withColumn("__s", street).withColumn("__t", F.trim("text"))
    ups = [(F.lag("__s", i).over(doc), F.lag("__t", i).over(doc)) for i in (1, 2, 3)]
    parts, run = [], F.lit(True)
    for is_street, text in ups:
        run = run & F.coalesce(is_street, F.lit(False))
        parts.insert(0, F.when(run, text))
    out = rows.withColumn("address", F.concat_ws(", ", *parts, "__t")).withColumn("__any", F.coalesce(ups[0][0], F.lit(False)))
    return out.where(F.col("text").rlike(_CITY_LINE) & F.col("__any")).select("doc_id", "line_no", "address")


def labels_of_cells(cells: DataFrame) -> DataFrame:
    """Every cell with the text of its column's head and of the cell above (null in the first row)."""
    down = Window.partitionBy("doc_id", "table_id", "col").orderBy("row")
    return cells.select("doc_id", "table_id", "row", "col", "text", F.first("text").over(down).alias("head"), F.lag("text").over(down).alias("above"))


def scan_line_accounts(lines: DataFrame, accounts: DataFrame) -> DataFrame:
    """Digit runs of 20 to 60 with the longest known account number inside: doc_id, line_no, run, account.
    No digit or hyphen touches a run, and a number has six digits at least.

    Runs and numbers meet on the whole number: every piece of a run that is as long as some number is a key,
    so numbers that begin alike are no hot key. The different lengths of numbers go to the driver."""
    runs = lines.select("doc_id", "line_no", F.explode(F.regexp_extract_all("text", F.lit("(?<![0-9-])[0-9]{20,60}(?![0-9-])"), F.lit(0))).alias("run"))
    known = accounts.where(F.length("account").between(6, 60)).select("account").distinct()
    sizes = sorted(r[0] for r in known.select(F.length("account")).distinct().collect())
    pieces = lambda n: F.when(F.length("run") >= n, F.transform(F.sequence(F.lit(1), F.length("run") - n + 1), lambda i: F.substr("run", i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    keys = F.concat(F.array().cast("array<string>"), *map(pieces, sizes))
    hit = runs.withColumn("account", F.explode(F.array_distinct(keys))).join(known, "account")
    return hit.groupBy("doc_id", "line_no", "run").agg(F.max_by("account", F.struct(F.length("account"), "account")).alias("account"))
