"""Redaction of a stream of documents: a projection per row, and a registry that grows by batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import registry, scan, spans


def redact_stream(documents: DataFrame, categories: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """The documents with a bare tag in place of every match; no state, so it runs on streams and
    tables alike."""
    found = scan.scan_units(documents, categories, text_col)
    hits = F.transform("matches", lambda m: F.struct(m["begin"].alias("begin"), m["end"].alias("end"), F.concat(F.lit("["), registry.tag_of(m["category"]), F.lit("]")).alias("replacement")))
    return found.withColumn(text_col, spans.substitute(F.col(text_col), hits)).drop("matches")


def count_findings(documents: DataFrame, categories: tuple[str, ...], time_col: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Findings by category and window of event time; later rows than ``late`` are no longer counted."""
    found = scan.explode_matches(scan.scan_units(documents, categories))
    return found.withWatermark(time_col, late).groupBy(F.window(time_col, window), "category").agg(F.count(F.lit(1)).alias("findings"))


def keep_registry(documents: DataFrame, path: str, categories: tuple[str, ...]) -> DataStreamWriter:
    """Every batch's entities are written under the batch's number, so a repeated batch replaces its
    own rows; ``read_registry`` sums the batches up."""

    def put(batch: DataFrame, n: int) -> None:
        matches = scan.explode_matches(scan.scan_units(batch.withColumn("unit_id", F.lit(0)), categories))
        registry.build(matches).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return documents.writeStream.foreachBatch(put)


def read_registry(spark, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.groupBy("entity_key", "category").agg(F.min_by("canonical", F.struct("batch", "first_seen")).alias("canonical"), F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents"))
