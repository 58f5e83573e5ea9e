"""Benchmark decontamination with DataFrame functions only.

A window is n consecutive words of a benchmark item. Every position of a document first meets a
small Bloom filter over the first words of the windows; positions that pass yield their window's
words, which an equi join compares with the benchmark's windows (a broadcast hash set while their
number is within a checked bound). What is joined is equal word by word: the join is the check.
"""

from __future__ import annotations

import sys
from array import array

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import content_key, fresh, save_shared

#: What stands between words, after A-Z are made lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before that, and what stands between words.
RAW_WORD, RAW_GAP = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW_WORDS = 13
#: Words that the Bloom filter looks at.
LEAD_WORDS = 3
#: The filter's size: bits for each window, and the most bits (2 MB), whatever the benchmark's size.
BITS_PER_WINDOW, MOST_BITS = 64, 1 << 24
#: Bytes of windows up to which their table is broadcast.
BROADCAST_BYTES = 64 << 20
#: Rows whose removal may be broadcast as two 8-byte numbers.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """The words of a text; null for null. A split takes a sixth of the time that extracting them does."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), BETWEEN, -1), "")


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW_WORDS, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, k (words of the window) and window (its words, joined by spaces), distinct."""
    w = benchmark.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("k", F.least(F.size("w"), F.lit(n)))
    w = w.select("item_id", "k", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1), lambda i: F.array_join(F.slice("w", i, F.col("k")), " "))).alias("window"))
    return w.distinct()


def _place(h: Column, i: Column, lead: int, bits: int) -> Column:
    """Where the filter looks for the words that begin at i, from the words' hashes."""
    out = F.get(h, i)
    for j in range(1, lead):
        out = out.bitwiseXOR(F.shiftright(F.get(h, i + j), j))
    return out.bitwiseAND(F.lit(bits - 1))


def _bloom(windows: DataFrame, lead: int, bits: int) -> Column:
    """The filter as an array of 64-bit words, one literal of the plan; at most MOST_BITS / 64 rows reach
    the driver."""
    h = F.transform(F.split("window", " "), lambda x: F.xxhash64(x))
    rows = windows.select(_place(h, F.lit(0), lead, bits).alias("place"))
    rows = rows.select(F.shiftright("place", 6).alias("word"), F.col("place").bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    rows = rows.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")).collect()
    table = array("q", bytes(bits // 8))
    for word, mask in rows:
        table[word] = mask
    if sys.byteorder == "little":
        table.byteswap()
    spark = windows.sparkSession
    longs = spark.sparkContext._gateway.new_array(spark._jvm.long, bits // 64)
    spark._jvm.java.nio.ByteBuffer.wrap(bytearray(table.tobytes())).asLongBuffer().get(longs)
    return Column(spark._jvm.org.apache.spark.sql.functions.lit(longs))


def _positions(windows: DataFrame, lead: int, sizes: dict[int, int]) -> Column:
    """Of columns w and h (the words' hashes): pos, k and window where the filter lets windows of these sizes begin, which share the
    number of words that the filter looks at: one pass over the positions for all of them."""
    bits = 1 << 16
    while bits < min(MOST_BITS, BITS_PER_WINDOW * sum(sizes.values())):
        bits *= 2
    w, h, bloom = F.col("w"), F.col("h"), _bloom(windows.where(F.col("k").isin(*sizes)), lead, bits)

    def passes(i):
        place = _place(h, i, lead, bits)
        return F.getbit(F.get(bloom, F.shiftright(place, 6).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")) == 1

    def begins(i):
        some = [F.when(i + k <= F.size(w), F.struct(i.alias("pos"), F.lit(k).alias("k"), F.array_join(F.slice(w, i + 1, F.lit(k)), " ").alias("window"))) for k in sorted(sizes)]
        return F.array_compact(F.array(*some))

    at = F.when(F.size(w) >= min(sizes), F.sequence(F.lit(0), F.size(w) - min(sizes))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(F.filter(at, passes), begins))


def find_hits(documents: DataFrame, benchmark: DataFrame, n: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text", by_content: bool = False) -> DataFrame:
    """For each row: rid (its number in this scan), doc_id, n_words, hits (sorted, distinct structs of
    the 0-based word position and k) and items (sorted as strings). ``by_content``: for each different
    row, and its content key (k1, k2) in place of rid.

    Rows with null or empty texts have no words; an item of fewer than ``n`` words, but not none,
    is one window; repeated rows stay apart through rid.
    """
    windows = save_shared(benchmark_windows(benchmark, n), "windows")
    sizes = {r.k: (r.n, r.bytes) for r in windows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("window") + 64).alias("bytes")).collect()}  # at most n rows
    found = None
    for lead in sorted({min(k, LEAD_WORDS) for k in sizes}):
        hits = _positions(windows, lead, {k: c for k, (c, _) in sizes.items() if min(k, LEAD_WORDS) == lead})
        found = hits if found is None else F.concat(found, hits)
    k1, k2 = content_key(documents)
    row = [k1.alias("k1"), k2.alias("k2")] if by_content else [F.monotonically_increasing_id().alias("rid")]
    own = ["k1", "k2"] if by_content else ["rid"]
    rows = documents.select(*row, F.col(id_col).alias("doc_id"), F.coalesce(words(F.col(text_col)), F.array().cast("array<string>")).alias("w"))
    rows = rows.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    if found is None:
        empty = F.array().cast("array<struct<pos:int,k:int>>")
        return rows.select(*own, "doc_id", F.size("w").cast("long").alias("n_words"), empty.alias("hits"), F.array().cast("array<string>").alias("items"))
    explode = F.explode if by_content else F.explode_outer  # by content only rows with hits are asked for
    rows = rows.select(*own, "doc_id", F.size("w").cast("long").alias("n_words"), explode(found).alias("h"))
    rows = rows.select(*own, "doc_id", "n_words", "h.pos", "h.k", "h.window")
    table = windows.select(F.col("item_id").cast("string").alias("item"), F.col("k").alias("wk"), F.col("window").alias("ww"))
    if sum(b for _, b in sizes.values()) <= BROADCAST_BYTES:
        table = F.broadcast(table)
    rows = rows.join(table, (F.col("window") == F.col("ww")) & (F.col("k") == F.col("wk")), "inner" if by_content else "left")
    hit = F.when(F.col("ww").isNotNull(), F.struct("pos", "k"))
    return rows.groupBy(*own, "doc_id", "n_words").agg(F.sort_array(F.collect_set(hit)).alias("hits"), F.sort_array(F.collect_set("item")).alias("items"))


def covered(hits: Column) -> Column:
    """Words inside any of the hits, which are sorted."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(acc, h):
        end = F.greatest(acc["end"], h["pos"] + h["k"])
        return F.struct(end.alias("end"), (acc["n"] + end - F.greatest(acc["end"], h["pos"])).alias("n"))

    return F.aggregate(hits, start, step, lambda acc: acc["n"].cast("long"))


def contamination(documents: DataFrame, benchmark: DataFrame, n: int = WINDOW_WORDS, share: int = 20) -> DataFrame:
    """One row for each document: counts, the items found and the verdict, which is true if at
    least one word in ``share`` is inside a benchmark window."""
    out = find_hits(documents, benchmark, n).withColumn("n_hit", covered(F.col("hits")))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, mode: str = "documents", n: int = WINDOW_WORDS, share: int = 20) -> DataFrame:
    """The documents without their contamination; the columns stay as they are. Rows are told apart by
    their content, so the verdict meets its row however the input is split when it is read again.

    ``documents``: contaminated rows go. ``spans``: the words of all hits go, with the gap before
    each, and rows whose texts hold none stay untouched.
    """
    if mode not in ("documents", "spans"):
        raise ValueError("mode is documents or spans")
    found = find_hits(documents, benchmark, n, by_content=True).withColumn("n_hit", covered(F.col("hits"))).where("n_hit > 0")
    k1, k2, b1, b2, gone = fresh(documents, "k1", "k2", "b1", "b2", "gone")
    h1, h2 = content_key(documents)
    rows = documents.withColumns({k1: h1, k2: h2})
    same = (F.col(k1) == F.col(b1)) & (F.col(k2) == F.col(b2))
    if mode == "documents":
        bad = found.where(F.lit(share) * F.col("n_hit") >= F.col("n_words")).select(F.col("k1").alias(b1), F.col("k2").alias(b2))
        bad = save_shared(bad, "contaminated")
        if bad.count() <= BROADCAST_ROWS:
            bad = F.broadcast(bad)
        return rows.join(bad, same, "left_anti").drop(k1, k2)
    at = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["pos"], h["pos"] + h["k"] - 1))))
    bad = found.select(F.col("k1").alias(b1), F.col("k2").alias(b2), at.alias(gone))
    pieces = F.regexp_extract_all(F.col("text"), F.lit(f"{RAW_GAP}*{RAW_WORD}"), F.lit(0))
    kept = F.array_join(F.filter(pieces, lambda p, i: ~F.array_contains(F.col(gone), i)), "")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.concat(kept, F.regexp_extract("text", f"{RAW_GAP}*$", 0)))
    out = rows.join(bad, same, "left")
    return out.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in documents.columns])


ORACLE = """
with d as (select doc_id, text, row_number() over () as rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
bw as (select distinct item_id, least(len(w), 13) as k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') as win from (select item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) as i from b where len(w) > 0)),
ks as (select distinct k from bw),
dw as (select rid, k, i, array_to_string(w[i:i + k - 1], ' ') as win from (select rid, w, k, unnest(range(1, len(w) - k + 2)) as i from d, ks where len(w) >= k)),
hits as (select rid, dw.i, dw.k, bw.item_id from dw join bw on dw.win = bw.win and dw.k = bw.k),
cov as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + k)) as p from hits) group by rid),
its as (select rid, count(*) as n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) as s from (select distinct rid, item_id from hits) group by rid)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join cov using (rid) left join its using (rid)
"""
