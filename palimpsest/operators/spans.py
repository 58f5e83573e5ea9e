"""Interval algebra on arrays of spans: structs with at least ``begin`` and ``end`` (exclusive).

Everything is an expression on one row, so no operator here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(a: Column, b: Column) -> Column:
    return (a["begin"] < b["end"]) & (b["begin"] < a["end"])


def contains(outer: Column, inner: Column) -> Column:
    return (outer["begin"] <= inner["begin"]) & (inner["end"] <= outer["end"])


def merge(spans: Column) -> Column:
    """Spans in order; those that touch or overlap become one (begin, end)."""
    pairs = F.array_sort(F.transform(spans, lambda s: F.struct(s["begin"].cast("int").alias("begin"), s["end"].cast("int").alias("end"))))

    def step(acc, s):
        last = F.element_at(acc, -1)
        grown = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], s["end"]).alias("end"))
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))
        return F.when(F.size(acc) == 0, F.array(s)).when(s["begin"] <= last["end"], joined).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(pairs, F.array().cast("array<struct<begin:int,end:int>>"), step)


def drop_touching(spans: Column, protected: Column) -> Column:
    """The spans that overlap none of the protected ones."""
    return F.filter(spans, lambda s: ~F.exists(protected, lambda p: overlap(s, p)))


def drop_within(spans: Column, others: Column, strictly: bool = False) -> Column:
    """The spans that lie in none of the others (``strictly``: in none that is longer)."""
    longer = lambda s, o: (o["end"] - o["begin"]) > (s["end"] - s["begin"]) if strictly else F.lit(True)
    return F.filter(spans, lambda s: ~F.exists(others, lambda o: contains(o, s) & longer(s, o)))


def date_guard(hits: Column, dates: Column) -> Column:
    """The hits that are not inside a written date; a date of birth may be."""
    return F.filter(hits, lambda h: (h["category"] == "dob") | ~F.exists(dates, lambda d: contains(d, h)))


def held_back(hits: Column, unticked: Column) -> Column:
    """The hits that are not inside an unticked form of their own group. Both have ``group``; a group's own
    unticked forms hold it back, other groups' don't."""
    return F.filter(hits, lambda h: ~F.exists(unticked, lambda u: (u["group"] == h["group"]) & contains(u, h)))


def one_per_place(leaks: Column) -> Column:
    """Leaks (begin, end, sure) without those inside a surer or as sure and longer one; of those at one place
    the surest, then the first."""
    kept = F.filter(leaks, lambda s: ~F.exists(leaks, lambda o: contains(o, s) & ((o["end"] - o["begin"]) > (s["end"] - s["begin"])) & (o["sure"] >= s["sure"])))
    at = lambda a, b: (a["begin"] == b["begin"]) & (a["end"] == b["end"])
    return F.array_sort(F.filter(kept, lambda s, i: ~F.exists(F.transform(kept, lambda o, j: F.struct(o.alias("o"), j.alias("j"))), lambda x: at(x["o"], s) & ((x["o"]["sure"] > s["sure"]) | ((x["o"]["sure"] == s["sure"]) & (x["j"] < i))))))


def resolve(spans: Column) -> Column:
    """By priority, then length, then place (then category): a span stays if none before it overlaps
    it. The result is in order of place. Structs are (begin, end, category, priority, value)."""
    ranked = F.array_sort(F.transform(spans, lambda s: F.struct((-s["priority"]).alias("p"), (s["begin"] - s["end"]).alias("l"), s["begin"].alias("begin"), s["category"].alias("category"), s["end"].alias("end"), s["priority"].alias("priority"), s["value"].alias("value"))))
    kind = "array<struct<begin:int,end:int,category:string,priority:int,value:string>>"

    def step(acc, s):
        here = F.struct(s["begin"].alias("begin"), s["end"].alias("end"), s["category"].alias("category"), s["priority"].alias("priority"), s["value"].alias("value"))
        return F.when(F.exists(acc, lambda k: overlap(k, s)), acc).otherwise(F.concat(acc, F.array(here)))

    return F.array_sort(F.aggregate(ranked, F.array().cast(kind), step))


def lift(spans: Column, covered: Column, priority: int) -> Column:
    """Spans that overlap one of ``covered`` get a priority."""
    return F.transform(spans, lambda s: s.withField("priority", F.when(F.exists(covered, lambda c: overlap(s, c)), F.lit(priority)).otherwise(s["priority"])))


def substitute(text: Column, hits: Column) -> Column:
    """The text with the replacement of every hit in its place. ``hits``: (begin, end, replacement),
    apart from each other."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc, h):
        out = F.concat(acc["out"], F.substr(text, acc["at"] + 1, h["begin"] - acc["at"]), h["replacement"])
        return F.struct(out.alias("out"), h["end"].alias("at"))

    def finish(acc):
        return F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text)))

    ordered = F.array_sort(F.transform(hits, lambda h: F.struct(h["begin"].cast("int").alias("begin"), h["end"].cast("int").alias("end"), h["replacement"].alias("replacement"))))
    return F.when(F.size(hits) > 0, F.aggregate(ordered, start, step, finish)).otherwise(text)
