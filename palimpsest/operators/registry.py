"""The registry of found values: one entity for each, numbered by first appearance, and its use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..storage import partitions_for, save_shared
from . import spans
from .categories import TAGS


#: Ranges up to which their counts, a row for each and each tag, are broadcast.
BROADCAST_PARTS = 10_000


def entity_key(category: Column, value: Column) -> Column:
    return F.concat_ws("|", category, T.fold(value))


def tag_of(category: Column) -> Column:
    tags = F.create_map(*[F.lit(x) for pair in TAGS.items() for x in pair])
    return F.coalesce(tags[category], F.lit("OTHER"))


def build(matches: DataFrame) -> DataFrame:
    """entity_key, category, canonical (the first written form), occurrences, documents (sorted) and
    first_seen (document, unit, offset) of every value in matches (doc_id, unit_id, begin, category, value).

    Counts are combined before the shuffle, so a value in a third of all rows is no hot spot."""
    seen = F.struct("doc_id", "unit_id", "begin", F.col("value").alias("value"))
    rows = matches.select(entity_key(F.col("category"), F.col("value")).alias("entity_key"), "category", "doc_id", seen.alias("seen"))
    # by document first: one pass over the matches gives both counts
    docs = rows.groupBy("entity_key", "category", "doc_id").agg(F.min("seen").alias("seen"), F.count(F.lit(1)).alias("n"))
    out = docs.groupBy("entity_key", "category").agg(F.min("seen").alias("seen"), F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("documents"))
    return out.select("entity_key", "category", F.col("seen.value").alias("canonical"), "occurrences", "documents", F.struct("seen.doc_id", "seen.unit_id", "seen.begin").alias("first_seen"))


def number(entities: DataFrame) -> DataFrame:
    """Add tag, n and replacement ``[TAG-n]``: n counts the entities of a tag by first appearance.

    Entities of a tag are dealt by ranges of their first appearance and counted range by range, so
    that no single task sorts all of them."""
    rows = entities.withColumn("tag", tag_of(F.col("category")))
    parts = partitions_for(rows)
    order = ["tag", "first_seen", "entity_key"]
    # written before it is counted, so that both readers see the same ranges
    rows = save_shared(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = rows.groupBy("tag", "__part").agg(F.count(F.lit(1)).alias("__k"))
    before = Window.partitionBy("tag").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("tag").alias("__tag"), F.col("__part").alias("__p"), F.coalesce(F.sum("__k").over(before), F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy("tag", "__part").orderBy("first_seen", "entity_key"))
    rows = rows.withColumn("__n", inside).join(F.broadcast(counts) if parts <= BROADCAST_PARTS else counts, (F.col("tag") == F.col("__tag")) & (F.col("__part") == F.col("__p")))
    n = (F.col("__base") + F.col("__n")).cast("long")
    return rows.select(*entities.columns, "tag", n.alias("n"), T.placeholder(F.col("tag"), n).alias("replacement"))


def rewrite(units: DataFrame, matches: DataFrame, entities: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The units with their matches replaced: keys, n_hits and redacted_text."""
    hits = matches.select(*keys, entity_key(F.col("category"), F.col("value")).alias("entity_key"), "begin", "end")
    hits = hits.join(entities.select("entity_key", "replacement"), "entity_key")
    per_unit = hits.groupBy(*keys).agg(F.collect_list(F.struct("begin", "end", "replacement")).alias("hits"))
    out = units.join(per_unit, list(keys), "left")
    hits_or_none = F.coalesce("hits", F.array().cast("array<struct<begin:int,end:int,replacement:string>>"))
    return out.select(*keys, F.size(hits_or_none).cast("long").alias("n_hits"), spans.substitute(F.col("text"), hits_or_none).alias("redacted_text"))


def mapping_table(entities: DataFrame) -> DataFrame:
    """What is kept to undo a rewrite, by category and folded value."""
    return entities.select("category", "canonical", "replacement", "occurrences", "documents").orderBy("category", T.fold(F.col("canonical")), "canonical")


def contexts(matches: DataFrame, units: DataFrame, keep: int = 2) -> DataFrame:
    """The first ``keep`` different surroundings of every entity."""
    rows = matches.join(units.select("doc_id", "unit_id", F.col("text").alias("__t")), ["doc_id", "unit_id"])
    rows = rows.select(entity_key(F.col("category"), F.col("value")).alias("entity_key"), F.struct("doc_id", "unit_id", "begin").alias("at"), T.snippet(F.col("__t"), F.col("begin"), F.col("end")).alias("context"))
    rows = rows.groupBy("entity_key", "context").agg(F.min("at").alias("at"))
    rank = F.row_number().over(Window.partitionBy("entity_key").orderBy("at", "context"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= keep).select("entity_key", "rank", "context")


def unique_replacements(entities: DataFrame) -> DataFrame:
    """Heads that bear a replacement another head has already: those get a suffix of their rank."""
    rank = F.row_number().over(Window.partitionBy("replacement").orderBy("entity_key"))
    return entities.withColumn("__r", rank).withColumn("replacement", F.when(F.col("__r") > 1, F.concat("replacement", F.lit("-"), F.col("__r").cast("string"))).otherwise(F.col("replacement"))).drop("__r")


def apply_decisions(entities: DataFrame, decisions: DataFrame) -> DataFrame:
    """The last decision of each kind (enable, replace, retype, merge) on each entity, applied."""
    last = decisions.groupBy("entity_key", "op").agg(F.max_by("arg", "seq").alias("arg"))
    wide = last.groupBy("entity_key").pivot("op", ["enable", "replace", "retype", "merge"]).agg(F.first("arg"))
    out = entities.join(wide, "entity_key", "left")
    put = {"enabled": F.coalesce(F.col("enable").cast("boolean"), F.lit(True)), "replacement": F.coalesce("replace", "replacement"), "category": F.coalesce("retype", "category"), "parent": F.col("merge")}
    return out.withColumns(put).drop("enable", "replace", "retype", "merge")
