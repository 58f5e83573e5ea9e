"""Printed forms of a value, and values from printed forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .validators import digits

#: Written dates that are read, in this order.
DATE_FORMATS = ("yyyy-MM-dd", "M/d/yyyy", "M-d-yyyy", "M.d.yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "MMMM d yyyy", "yyyy/MM/dd")


def _parts(value: Column, *sizes: int) -> list[Column]:
    out, at = [], 1
    for n in sizes:
        out.append(F.substring(value, at, n))
        at += n
    return out


def ssn_forms(value: Column) -> Column:
    """Nine written forms of nine digits: separators, masks and the last four."""
    d = digits(value)
    a, b, c = _parts(d, 3, 2, 4)
    j = F.concat_ws
    forms = F.array(d, j("-", a, b, c), j(" ", a, b, c), j(".", a, b, c), F.concat(F.lit("XXX-XX-"), c), F.concat(F.lit("***-**-"), c), F.concat(F.lit("xxx-xx-"), c), F.concat(F.lit("XXXXX"), c), F.concat(F.lit("*****"), c))
    return F.when(F.length(d) == 9, forms).otherwise(F.array().cast("array<string>"))


def tin_forms(value: Column) -> Column:
    d = digits(value)
    a, b = _parts(d, 2, 7)
    return F.when(F.length(d) == 9, F.array(F.concat_ws("-", a, b), d)).otherwise(F.array().cast("array<string>"))


def phone_forms(value: Column) -> Column:
    """Written forms of ten digits, with and without the country's 1."""
    d = digits(value)
    d = F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)
    a, b, c = _parts(d, 3, 3, 4)
    j = F.concat_ws
    bare = [j("-", a, b, c), j(".", a, b, c), j(" ", a, b, c), d, F.concat(F.lit("("), a, F.lit(") "), b, F.lit("-"), c), F.concat(F.lit("("), a, F.lit(")"), b, F.lit("-"), c), F.concat(a, F.lit("/"), b, F.lit("-"), c)]
    return F.when(F.length(d) == 10, F.array(*bare, *[F.concat(F.lit("1-"), x) for x in bare[:1]], *[F.concat(F.lit("+1 "), x) for x in bare[:5]], F.concat(F.lit("+1"), d))).otherwise(F.array().cast("array<string>"))


def parse_date(value: Column) -> Column:
    """A date from any of the written forms; null if none fits."""
    v = F.trim(F.regexp_replace(value, r"\s+", " "))
    return F.coalesce(*[F.try_to_date(v, f) for f in DATE_FORMATS])


def dob_forms(date: Column) -> Column:
    """Written forms of a date, distinct."""
    shapes = ("yyyy-MM-dd", "MM/dd/yyyy", "M/d/yyyy", "MM-dd-yyyy", "M-d-yyyy", "MM/dd/yy", "M/d/yy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "MMddyyyy", "yyyyMMdd", "MM.dd.yyyy")
    return F.array_distinct(F.array(*[F.date_format(date, f) for f in shapes]))


def account_forms(value: Column) -> Column:
    """The number, its groups of four, and its last four behind the usual masks."""
    d = F.regexp_replace(value, r"[\s\-]", "")
    tail = F.substr(d, F.greatest(F.length(d) - 3, F.lit(1)), F.lit(4))
    grouped = F.trim(F.regexp_replace(d, "(.{4})", "$1 "))
    masks = [F.concat(F.lit(m), tail) for m in ("XXXX", "xxxx", "****", "...", "XXXX-", "x")]
    return F.when(F.length(d) >= 5, F.array_distinct(F.array(d, grouped, F.replace(grouped, F.lit(" "), F.lit("-")), *masks))).otherwise(F.array(d))


def email_forms(value: Column) -> Column:
    v = F.lower(F.trim(value))
    return F.array_distinct(F.array(v, F.concat(F.lit("mailto:"), v)))


def handle_forms(value: Column) -> Column:
    v = F.regexp_replace(F.trim(value), r"^[@$]", "")
    return F.array(v, F.concat(F.lit("@"), v), F.concat(F.lit("$"), v))


def normalise(kind: Column, value: Column) -> Column:
    """A sheet's value in the one form of its kind; null where it can't be one."""
    d = digits(value)
    phone = F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)
    return (
        F.when(kind == "ssn", F.when(F.length(d) == 9, F.concat_ws("-", *_parts(d, 3, 2, 4))))
        .when(kind == "tin", F.when(F.length(d) == 9, F.concat_ws("-", *_parts(d, 2, 7))))
        .when(kind == "phone", F.when(F.length(phone) == 10, F.concat_ws("-", *_parts(phone, 3, 3, 4))))
        .when(kind == "email", F.when(value.rlike(r"^\s*[^@\s]+@[^@\s]+\.[^@\s]+\s*$"), F.lower(F.trim(value))))
        .when(kind == "vin", F.when(F.upper(F.trim(value)).rlike("^[A-HJ-NPR-Z0-9]{17}$"), F.upper(F.trim(value))))
        .when(kind == "dob", F.date_format(parse_date(value), "yyyy-MM-dd"))
        .otherwise(F.trim(F.regexp_replace(value, r"\s+", " ")))
    )
