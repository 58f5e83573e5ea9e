"""Parties first: what a sheet names gets role labels; what files hold folds into it or stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions.validators import digits

#: Kinds of which an owner has one, and their order in a review.
SINGLE = ("ssn", "dob", "dl", "passport")
KIND_ORDER = ("name", "ssn", "dob", "dl", "passport", "address", "phone", "email", "employer", "business", "account", "card", "handle", "vehicle", "other")


def owner_labels(parties: DataFrame) -> DataFrame:
    """party and owner: roles of one party bear their name, others a number in the order of the sheet."""
    w = Window.partitionBy("role")
    n = F.row_number().over(w.orderBy("party"))
    label = F.upper(F.regexp_replace("role", r"\W+", "-"))
    return parties.select("party", F.when(F.count(F.lit(1)).over(w) > 1, F.concat_ws("-", label, n.cast("string"))).otherwise(label).alias("owner"))


def value_labels(values: DataFrame) -> DataFrame:
    """owner, kind, value and label ``[OWNER-KIND]`` or ``[OWNER-KIND-n]``: kinds of which there is one
    bear no number on the first value."""
    n = F.row_number().over(Window.partitionBy("owner", "kind").orderBy("seq", "value"))
    bare = F.concat(F.lit("["), "owner", F.lit("-"), F.upper("kind"))
    return values.select("owner", "kind", "value", F.when(F.col("kind").isin(*SINGLE) & (n == 1), F.concat(bare, F.lit("]"))).otherwise(F.concat(bare, F.lit("-"), n.cast("string"), F.lit("]"))).alias("label"))


def fold(found: DataFrame, rows: DataFrame) -> DataFrame:
    """found (id, kind, value) with the only party row (key, kind, value) that it is a form of: equal
    phones, e-mails and numbers; an account's tail; a number without its leading zeros. Several fits
    are none."""
    def key(kind, value):
        return F.when(kind == "phone", X.phone_key(value)).when(kind == "email", X.email_key(value)).when(kind.isin("account", "ssn", "card"), F.regexp_replace(digits(value), "^0+", "")).otherwise(X.fold(value))

    f = found.select("id", "kind", "value", key(F.col("kind"), F.col("value")).alias("k"))
    r = rows.select("key", F.col("kind").alias("rk"), key(F.col("kind"), F.col("value")).alias("rkey"))
    whole = f.join(r, (F.col("kind") == F.col("rk")) & (F.col("k") == F.col("rkey"))).select("id", "key", F.lit(1).alias("rank"))
    tail = lambda c: F.substr(c, F.greatest(F.length(c) - 3, F.lit(1)), F.lit(4))
    masked = f.where(F.col("kind").isin("account", "ssn", "card") & F.col("value").rlike(r"[Xx*•#]{2}|\.{2}|^[0-9]{4}$")).withColumn("t", tail(digits(F.col("value"))))
    ends = r.where(F.length("rkey") >= 5).select("key", "rk", tail(F.col("rkey")).alias("rt"))
    part = masked.join(ends, (F.col("kind") == F.col("rk")) & (F.col("t") == F.col("rt"))).select("id", "key", F.lit(2).alias("rank"))
    best = whole.unionByName(part).groupBy("id", "rank").agg(F.count_distinct("key").alias("n"), F.min("key").alias("key"))
    first = best.groupBy("id").agg(F.min_by(F.struct("n", "key"), "rank").alias("b"))
    return f.join(first, "id", "left").select("id", "kind", "value", F.when(F.col("b.n") == 1, F.col("b.key")).alias("key"))


def review_rows(entities: DataFrame) -> DataFrame:
    """One row for each head and kind: forms, occurrences and whether any form is ticked."""
    return entities.groupBy("head", "kind").agg(F.count(F.lit(1)).alias("forms"), F.sum("occurrences").alias("occurrences"), F.bool_or("enabled").alias("ticked"))


def merged_rows(findings: DataFrame) -> DataFrame:
    """One row for each owner, kind and folded value: times found, and where first."""
    at = F.struct("doc_id", "page")
    out = findings.groupBy("owner", "kind", X.fold(F.col("value")).alias("folded")).agg(F.count(F.lit(1)).alias("times"), F.min(at).alias("first"), F.min_by("value", F.struct("doc_id", "page", "value")).alias("value"))
    return out.select("owner", "kind", "value", "times", F.col("first.doc_id").alias("first_doc"), F.col("first.page").alias("first_page"))


def fold_alike(items: DataFrame, least: int = 4) -> DataFrame:
    """Review items (id, shape): groups of at least ``least`` of one shape become one, others stay alone."""
    n = items.groupBy("shape").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    return items.join(n, "shape").select("id", F.when(F.col("n") >= least, F.col("first")).otherwise(F.col("id")).alias("grp"))


def first_wins(proposals: DataFrame, avoid: DataFrame) -> DataFrame:
    """The union of harvesters' proposals (key, source_rank, value): the first source wins a key, and
    keys in ``avoid`` go."""
    out = proposals.groupBy("key").agg(F.min_by("value", F.struct("source_rank", "value")).alias("value"), F.min("source_rank").alias("source_rank"))
    return out.join(avoid.select("key").distinct(), "key", "left_anti")


def city_lines(lines: DataFrame) -> DataFrame:
    """Streets (doc_id, line_no, text, zip5 or null) with the line below, if that is a town of the ZIP."""
    below = F.lead("text").over(Window.partitionBy("doc_id").orderBy("line_no"))
    rows = lines.withColumn("below", below).withColumn("z", F.regexp_extract("below", r"([0-9]{5})(?:-[0-9]{4})?\s*$", 1))
    return rows.where((F.col("z") != "") & (F.col("zip5").isNull() | (F.col("zip5") == F.col("z")))).select("doc_id", "line_no", "text", "below")


def numbered_rows(values: DataFrame) -> DataFrame:
    """owner, kind, n and value: an owner's values of a kind in the order of the sheet, and the kinds in the
    order of a review."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KIND_ORDER) for x in (k, i)])
    n = F.row_number().over(Window.partitionBy("owner", "kind").orderBy("seq", "value"))
    return values.select("owner", F.coalesce(order[F.col("kind")], F.lit(len(KIND_ORDER))).alias("kind_order"), "kind", n.alias("n"), "value")


#: Categories that a file keeps whatever the sheet says.
LEAVE = ("case_number", "case_name", "case_designator", "check_number", "order_number", "tracking_number", "routing_number", "policy_number", "claim_number", "loan_number", "diagnosis_code", "prescription", "bar_number")


def file_match(found: DataFrame) -> DataFrame:
    """id, decision and target of what a file holds, by the first rule that applies.

    Columns: id, category, bare (an unlabelled card), key (the party row that it folds into, or null),
    loan_line, city_line, above_key (the party row that the line above folds into), owner (the only party that
    context names), full_ssn, tail (four digits of one), masked and transfer_line.

    untouched: a category that is left alone. left: as written, and counted. form: a new form of a party's row.
    new: a new value of its owner, or of the parties together."""
    account = F.col("category").isin("bank_account", "masked_account", "credit_card", "investment_account")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    rule = lambda decision, target=None: F.struct(F.lit(decision).alias("decision"), (target if target is not None else F.lit(None)).cast("string").alias("target"))
    out = (
        F.when(F.col("category").isin(*LEAVE), rule("untouched"))
        .when(yes("bare"), rule("left"))
        .when(F.col("key").isNotNull(), rule("form", F.col("key")))
        .when(account & yes("loan_line"), rule("left"))
        .when(yes("city_line"), F.when(F.col("above_key").isNotNull(), rule("form", F.col("above_key"))).otherwise(rule("left")))
        .when(F.col("owner").isNotNull(), rule("new", F.col("owner")))
        .when(yes("full_ssn") | yes("tail"), rule("new", F.lit("PARTIES")))
        .when(yes("masked") & yes("transfer_line"), rule("new", F.lit("PARTIES")))
        .otherwise(rule("left"))
    )
    return found.select("id", out.alias("r")).select("id", "r.decision", "r.target")


def bare_digits(units: DataFrame, numbers: DataFrame) -> DataFrame:
    """doc_id, run and number: digit runs of at least six that are a known number, its end, or it without the
    zeros in front. Runs and numbers meet on their last six digits; a run that fits several numbers is none."""
    plain = lambda c: F.regexp_replace(c, "^0+", "")
    last = lambda c: F.substr(c, F.length(c) - 5, F.lit(6))
    runs = units.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("(?<![0-9.,])[0-9]{6,}(?![0-9]|[.,][0-9])"), F.lit(0)))).alias("run"))
    runs = runs.withColumn("r", plain("run")).where(F.length("r") >= 6).withColumn("k", last(F.col("r")))
    known = numbers.select("number", digits(F.col("number")).alias("d")).withColumn("p", plain("d")).where(F.length("p") >= 6).withColumn("k", last(F.col("p")))
    hit = runs.join(known, "k").where((F.col("r") == F.col("p")) | F.endswith("d", F.col("run")))
    one = hit.groupBy("doc_id", "run").agg(F.count_distinct("number").alias("n"), F.min("number").alias("number"))
    return one.where("n = 1").select("doc_id", "run", "number")
