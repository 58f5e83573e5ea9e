"""Known values in texts: literal dictionaries, near misses, place names, masked tails."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.validators import digits

#: Shortest value that is searched for, and the most values that are sent to every task (some 100 bytes each).
LEAST, BROADCAST_VALUES = 4, 50_000
#: Digits enough to be told whatever stands between them, and digits with single signs between them in a text.
_NUMBER, _RUN = re.compile(r"[0-9]{7,}"), re.compile(r"[0-9](?:[ -]?[0-9]){6,}")
#: Letters that a pattern takes for i, s and k when it ignores case.
_FOLD = {0x130: "i", 0x131: "i", 0x17F: "s", 0x212A: "k"}


def is_number(value: str) -> bool:
    return bool(_NUMBER.fullmatch(value))


def bounded(value: str) -> str:
    """A pattern for a value between bounds: no letter, digit or sign of an address or a longer number
    may touch it; its white space is flexible. Seven digits and more may have a space or a hyphen between any
    two of them."""
    body = "[ -]?".join(value) if is_number(value) else r"\s+".join(re.escape(w) for w in value.split())
    left = r"(?<![^\W_])(?<![@.\-])" + (r"(?<![0-9][.,])" if value[:1].isdigit() else "")
    right = r"(?![^\W_])(?![@\-])" + (r"(?![.,][0-9])" if value[-1:].isdigit() else "")
    return left + body + right


def find_values(units: DataFrame, values: DataFrame, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """keys, value, begin, end: every place where a known value stands in a text. Places don't overlap:
    from left to right, the longest value that begins there is taken, and of values that differ in
    case or white space only the longest, then the first in order.

    A dictionary within the bound goes to every task as one pattern; a larger one is joined on the
    first word of the values, and each text is searched for those that stand in it. Values shorter than four characters and bare years are
    not searched. Matching ignores case."""
    fine = (F.length("value") >= LEAST) & ~F.col("value").rlike(r"^(19[5-9][0-9]|20[0-4][0-9])$")
    known = values.select(F.trim("value").alias("value")).where(fine).distinct()
    n = known.count()
    if n <= BROADCAST_VALUES:
        listed = sorted((r[0] for r in known.collect()), key=lambda v: (-len(v), v))
        return _find_listed(units, listed, keys, text_col)
    return _find_joined(units, known, keys, text_col)


def _folded(value: str) -> str:
    if is_number(bare := re.sub(r"[ -]", "", value)):
        return bare
    return " ".join((value if value.isascii() else value.translate(_FOLD)).lower().split())


def _finder(values: Iterable[str]) -> Callable[[str], list[tuple[str, int, int]]]:
    """What finds (value, begin, end) in a text, the longest value first."""
    listed = sorted(values, key=lambda v: (-len(v), v))
    pattern = re.compile("|".join(bounded(v) for v in listed), re.IGNORECASE) if listed else None
    canonical = {_folded(v): v for v in reversed(listed)}

    def owner(found: str) -> str:
        """The value of a match; letters that only the pattern takes for one are told by the pattern."""
        return canonical.get(_folded(found)) or next(v for v in listed if re.fullmatch(bounded(v), found, re.IGNORECASE))

    return lambda text: [(owner(m[0]), m.start(), m.end()) for m in pattern.finditer(text)] if pattern else []


def _schema(rows: DataFrame, keys: tuple[str, ...], more: str) -> str:
    return ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keys), more])


def _find_listed(units: DataFrame, listed: list[str], keys: tuple[str, ...], text_col: str) -> DataFrame:
    words = [((v if v.isascii() else v.translate(_FOLD)).lower().split()[0], v) for v in listed if not is_number(v)]
    numbers = frozenset(v for v in listed if is_number(v))
    lengths = sorted({len(v) for v in numbers})

    def there(text: str) -> list[str]:
        """The values that may stand in a text: names by their first word, numbers by the digits in a row."""
        low = (text if text.isascii() else text.translate(_FOLD)).lower()
        runs = [re.sub(r"[ -]", "", r) for r in _RUN.findall(text)] if numbers else ()
        return [v for f, v in words if f in low] + list({x for r in runs for n in lengths for i in range(len(r) - n + 1) if (x := r[i : i + n]) in numbers})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                text = getattr(row, text_col)
                if not text:
                    continue
                if some := there(text):
                    out += [(*(getattr(row, k) for k in keys), *m) for m in _finder(some)(text)]
            yield pd.DataFrame(out, columns=[*keys, "value", "begin", "end"])

    return units.select(*keys, text_col).mapInPandas(run, _schema(units, keys, "value string, begin int, end int"))


def _find_joined(units: DataFrame, known: DataFrame, keys: tuple[str, ...], text_col: str) -> DataFrame:
    word, texts = r"[\p{L}\p{N}]+", units.select(*keys, text_col)
    fold = lambda c: F.lower(F.translate(c, "".join(map(chr, _FOLD)), "".join(_FOLD.values())))
    number = F.col("value").rlike("^[0-9]{7,}$")
    table = known.where(~number).withColumn("lead", fold(F.regexp_extract("value", word, 0)))
    # A value without a word has an empty lead, which every text holds.
    leads = F.concat(F.regexp_extract_all(fold(F.col(text_col)), F.lit(word), F.lit(0)), F.array(F.lit("")))
    pairs = units.select(*keys, F.explode(F.array_distinct(leads)).alias("lead")).join(table, "lead").select(*keys, "value").distinct()
    there = _standing(_with_texts(pairs, texts, keys), keys, text_col)
    # A number is joined whole with what is as long in the digits of a text, which may be parted by single signs;
    # the numbers of digits that values have are a short list.
    numbers = known.where(number)
    lengths = F.array(*[F.lit(r[0]) for r in sorted(numbers.select(F.length("value")).distinct().collect())]).cast("array<int>")
    runs = F.transform(F.regexp_extract_all(F.col(text_col), F.lit(_RUN.pattern), F.lit(0)), lambda r: F.regexp_replace(r, "[ -]", ""))
    cut = lambda r, n: F.transform(F.sequence(F.lit(1), F.length(r) - n + 1), lambda i: F.substr(r, i, n))
    pieces = F.flatten(F.transform(runs, lambda r: F.flatten(F.transform(F.filter(lengths, lambda n: n <= F.length(r)), lambda n: cut(r, n)))))
    whole = units.select(*keys, F.explode(F.array_distinct(pieces)).alias("value")).join(numbers, "value").select(*keys, "value")
    listed = there.unionByName(whole).distinct().groupBy(*keys).agg(F.collect_list("value").alias("value"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(*(getattr(row, k) for k in keys), *m) for row in pdf.itertuples(index=False) for m in _finder(row.value)(getattr(row, text_col) or "")]
            yield pd.DataFrame(out, columns=[*keys, "value", "begin", "end"])

    return _with_texts(listed, texts, keys).mapInPandas(run, _schema(units, keys, "value string, begin int, end int"))


def _with_texts(rows: DataFrame, texts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows joined with the texts of their keys; null keys are equal to each other."""
    named = rows.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return texts.join(named, reduce(lambda a, b: a & b, same)).drop(*[f"__{k}" for k in keys])


def _standing(rows: DataFrame, keys: tuple[str, ...], text_col: str) -> DataFrame:
    """keys and value of the rows whose text holds their own value."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(*(getattr(row, k) for k in keys), row.value) for row in pdf.itertuples(index=False) if re.search(bounded(row.value), getattr(row, text_col) or "", re.IGNORECASE)]
            yield pd.DataFrame(out, columns=[*keys, "value"])

    return rows.mapInPandas(run, _schema(rows, keys, "value string"))


def near_tokens(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """token, name: words that are one inserted or left-out letter, or a swap of neighbours, from a name.

    Both sides are joined on what is left when one letter goes (and, for swaps, on sorted letters): an
    equi join on keys of one word, never all pairs."""

    def cut(c: str) -> Column:
        w = F.col(c)
        return F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1, F.length(w))))

    fine = lambda c: F.col(c).rlike(r"^\p{L}{4,}$")
    t = tokens.select(F.lower("token").alias("token")).where(fine("token")).distinct()
    n = names.select(F.lower("name").alias("name")).where(fine("name")).distinct()
    longer = t.select("token", F.explode(F.array_distinct(cut("token"))).alias("k")).join(n.where(F.length("name") >= 4).withColumn("k", F.col("name")), "k").select("token", "name")
    shorter = n.select("name", F.explode(F.array_distinct(cut("name"))).alias("k")).join(t.withColumn("k", F.col("token")), "k").select("token", "name")
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    swaps = t.withColumn("k", letters("token")).join(n.withColumn("k", letters("name")), "k").where(T.one_edit(F.col("token"), F.col("name"))).select("token", "name")
    return longer.unionByName(shorter).unionByName(swaps).where("token <> name").distinct()


def longest_known(texts: DataFrame, gazetteer: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """For each text the longest run of words that the gazetteer knows, however long its names are; of equal
    ones the last. Runs are joined on their folded form; the numbers of words that names have go to the driver."""
    words = F.filter(F.split(F.regexp_replace("text", r"[^\p{L}\p{N}' ]", " "), r"\s+"), lambda w: w != "")
    runs = texts.select(F.col(id_col).alias(id_col), words.alias("w"))
    known = gazetteer.select(F.lower("name").alias("known")).distinct()
    sizes = sorted(r[0] for r in known.select(F.size(F.split(F.trim("known"), r"\s+"))).distinct().collect())
    if not sizes:
        return runs.where("false").select(id_col, F.lit("").alias("place"))
    rows = None
    for n in sizes:
        part = runs.where(F.size("w") >= n).select(id_col, F.lit(n).alias("n"), F.posexplode(_grams(n)).alias("pos", "place"))
        rows = part if rows is None else rows.unionByName(part)
    hit = rows.join(known, F.lower(F.col("place")) == F.col("known"))
    return hit.groupBy(id_col).agg(F.max_by("place", F.struct("n", "pos")).alias("place"))


def _gram(i: Column, n: int) -> Column:
    return F.array_join(F.slice("w", i, n), " ")


def _grams(n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: _gram(i, n))


def tail_owner(tails: DataFrame, full: DataFrame) -> DataFrame:
    """Masked tails with the only full number that ends in them: tail, number (null if none or several)."""
    ends = full.select(F.col("number"), F.substr(digits(F.col("number")), F.greatest(F.length(digits(F.col("number"))) - 3, F.lit(1)), F.lit(4)).alias("tail"))
    one = ends.groupBy("tail").agg(F.count_distinct("number").alias("k"), F.min("number").alias("number")).where("k = 1")
    return tails.join(one, "tail", "left").select("tail", "number")
