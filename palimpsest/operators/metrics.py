"""Measures: what survived, what was destroyed, how consistent replacements are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = r"\$\s?[0-9][0-9,]*(?:\.[0-9]{2})?"
#: The figures from which a document counts as financial.
FINANCIAL_FIGURES = 12


def money(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, amount and n: the multiset of dollar figures, without separators."""
    found = texts.select("doc_id", F.explode(F.regexp_extract_all(text_col, F.lit(MONEY), F.lit(0))).alias("m"))
    return found.groupBy("doc_id", F.regexp_replace("m", r"[\s,]", "").alias("amount")).agg(F.count(F.lit(1)).alias("n"))


def is_financial(text: Column) -> Column:
    return F.regexp_count(text, F.lit(MONEY)) >= FINANCIAL_FIGURES


def lost(before: DataFrame, after: DataFrame, value: str, n: str = "n") -> DataFrame:
    """doc_id, value and lost: the multiset difference, before less after."""
    rows = before.select("doc_id", value, F.col(n).alias("__b")).join(after.select("doc_id", value, F.col(n).alias("__a")), ["doc_id", value], "left")
    out = rows.withColumn("lost", F.col("__b") - F.coalesce("__a", F.lit(0)))
    return out.where("lost > 0").select("doc_id", value, "lost")


def leaks(truth: DataFrame, outputs: DataFrame) -> DataFrame:
    """truth (set_id, kind, value) that stands in outputs (set_id, doc_id, text): one row for each. Truth
    without a set_id is looked for in every set.

    Values meet texts on their folded first word, and are verified between bounds."""
    word = r"[\p{L}\p{N}]+"
    keyed = truth.withColumn("lead", F.lower(F.regexp_extract("value", word, 0))).where("lead <> ''")
    text = F.lower(F.col("text"))
    words = outputs.select("set_id", "doc_id", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(word), F.lit(0)))).alias("lead"))
    some = words.join(keyed, [c for c in ("set_id", "lead") if c in keyed.columns]).drop("lead").distinct()
    quoted = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), F.lower(F.col("value")), F.lit(r"\E(?![\p{L}\p{N}])"))
    return some.join(outputs.select("set_id", "doc_id", text.alias("t")), ["set_id", "doc_id"]).where(F.regexp_like("t", quoted)).select("set_id", "kind", "value", "doc_id").distinct()


def report(findings: DataFrame) -> DataFrame:
    """Counts of findings (doc_id, category, value, doc_type, status) in one pass: by category, by type
    and category, by status, and in all; ``level`` tells which."""
    out = findings.groupingSets(
        [["category"], ["doc_type", "category"], ["status"], []], "category", "doc_type", "status"
    ).agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("doc_id").alias("files"), F.count_distinct("value").alias("distinct_values"), F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 3, "category").when(F.col("g") == 1, "type_category").when(F.col("g") == 6, "status").otherwise("all")
    return out.select(level.alias("level"), "category", "doc_type", "status", "findings", "files", "distinct_values")


def split_replacements(hits: DataFrame) -> DataFrame:
    """Real things (thing) that got more than one replacement."""
    out = hits.groupBy("thing").agg(F.count_distinct("replacement").alias("replacements"))
    return out.where("replacements > 1")


def recurrence(rows: DataFrame, labelled: Column, thresholds: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """For each threshold the entities seen in as many documents, and the labelled ones lost."""
    at = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    rows = rows.select("documents", labelled.alias("labelled"), at)
    kept = F.col("documents") >= F.col("threshold")
    return rows.groupBy("threshold").agg(F.count_if(kept).alias("kept"), F.count_if(~kept & F.col("labelled")).alias("labelled_lost"))


def histogram(counts: DataFrame, col: str = "n") -> DataFrame:
    """How many entities were seen once, twice, three, four to nine, ten or more times."""
    c = F.col(col)
    bucket = F.when(c == 1, "1").when(c == 2, "2").when(c == 3, "3").when(c < 10, "4-9").otherwise("10+")
    return counts.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("entities"))


def verdicts(hits: DataFrame, truth: DataFrame, third: DataFrame) -> DataFrame:
    """hits (value, category) with a verdict: confirmed, wrong_kind, third_party or unlabelled."""
    t = truth.groupBy(F.lower("value").alias("__v")).agg(F.collect_set("kind").alias("__kinds"))
    o = third.select(F.lower("value").alias("__o")).distinct()
    rows = hits.join(t, F.lower("value") == F.col("__v"), "left").join(o, F.lower("value") == F.col("__o"), "left")
    verdict = F.when(F.array_contains("__kinds", F.col("category")), "confirmed").when(F.col("__v").isNotNull(), "wrong_kind").when(F.col("__o").isNotNull(), "third_party").otherwise("unlabelled")
    return rows.select("value", "category", verdict.alias("verdict"))


def threshold_sweep(scored: DataFrame, cutoffs: tuple[float, ...]) -> DataFrame:
    """Pairs (score, same, split) at every cutoff: true and false positives by split."""
    rows = scored.select("score", "same", "split", F.explode(F.array(*map(F.lit, cutoffs))).alias("cutoff"))
    hit = F.col("score") >= F.col("cutoff")
    return rows.groupBy("split", "cutoff").agg(F.count_if(hit & F.col("same")).alias("true_positives"), F.count_if(hit & ~F.col("same")).alias("false_positives"), F.count_if(F.col("same")).alias("same_pairs"), F.count_if(~F.col("same")).alias("other_pairs"))


def case_secrets(truth: DataFrame) -> DataFrame:
    """set_id, kind and value: what any document of a case holds is secret in all of them."""
    return truth.select("set_id", "kind", F.trim("value").alias("value")).where("value <> ''").distinct()


def left_counts(left: DataFrame) -> DataFrame:
    """kind and the different values of it that were left as written."""
    return left.groupBy("kind").agg(F.count_distinct("value").alias("values"))


def first_distinct(values: Column) -> Column:
    """An array's different values in the order of their first appearance; nulls and blanks go."""
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (F.trim(v) != "")))


def outside(documents: Column, others: Column) -> Column:
    """Whether an array of documents holds one that is in none of the others."""
    return F.size(F.array_except(documents, others)) > 0


def lost_merchants(before: DataFrame, after: DataFrame, household: DataFrame) -> DataFrame:
    """doc_id, value and lost: merchants (doc_id, value, n) that stand less often after than before; names of the
    household (value) are meant to go."""
    known = household.select(F.lower("value").alias("__v")).distinct()
    return lost(before, after, "value").join(known, F.lower("value") == F.col("__v"), "left_anti")


def lost_values(before: DataFrame, after: DataFrame, pattern: str, text_col: str = "text") -> DataFrame:
    """doc_id, value and lost: what a pattern finds more often before than after, such as words or dates."""
    count = lambda t: t.select("doc_id", F.explode(F.regexp_extract_all(text_col, F.lit(pattern), F.lit(0))).alias("value")).groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n"))
    return lost(count(before), count(after), "value")
