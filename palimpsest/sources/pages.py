"""Pages that are pictures: which are still to be read, and what several readings found together.

Reading a picture needs an engine, which is no part of this library. Its words come as a table (path, page,
engine, reading, x0, y0, x1, y1, text, block, line, word, conf), which ``units.words_to_lines`` makes text of.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What tells a reading of a page from all others.
PAGE = ("file_hash", "page", "engine")


def unread_pages(pages: DataFrame, read: DataFrame) -> DataFrame:
    """The pages (file_hash, page, engine) that the table of readings does not hold yet."""
    return pages.join(read.select(*PAGE).distinct(), list(PAGE), "left_anti")


def together(findings: DataFrame) -> DataFrame:
    """path, page, category, value and engines of what any engine's reading of a page shows: a value that several
    show, written alike but for case and spaces, is one, in the spelling of the first engine."""
    folded = F.lower(F.regexp_replace("value", r"\s+", " "))
    out = findings.groupBy("path", "page", "category", folded.alias("__v")).agg(F.min_by("value", F.struct("engine", "value")).alias("value"), F.count_distinct("engine").alias("engines"))
    return out.drop("__v")
