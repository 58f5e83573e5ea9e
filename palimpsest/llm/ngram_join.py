"""Jaccard join on word n-grams with Bayesian candidate pruning.

Documents with equal n-gram sets are copies; the join runs between one document of each kind.
MinHash bands find candidate pairs: with 32 bands of 4 values a pair at similarity 0.8 is missed
with a probability of 5e-8. The two signatures are compared a few values at a time, and a pair is
dropped once the posterior probability that it reaches the threshold falls below a tolerance. The
rest are verified on their whole n-gram sets.

Candidates take two ways. Small bands give pairs. Documents that meet in a large band form
neighbourhoods (components of such meetings), which are cut into chunks; chunk meets chunk, and
what leaves are counts and a spanning forest of the links, never the pairs of a large group.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..storage import drop_shared
from .common import content_key, fresh, giving_back, save_shared, text_slices
from .words import Words, split

WORDS, THRESHOLD = 5, "0.8"
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Values of the signatures that are compared before each look at the posterior.
STEP = 16
#: A pair is dropped when it reaches the threshold with a lower probability than this.
TOLERANCE = 1e-6
#: Documents of a band that are paired one by one, at most.
SMALL = 32
#: Documents of a chunk, and bytes of its n-grams.
CHUNK_LEAST, CHUNK_MOST, CHUNK_BYTES = 1024, 8192, 16 << 20
#: Documents of a block that meet another block at once.
BLOCK = 256
#: Rows whose removal may be broadcast as two 8-byte numbers.
BROADCAST_ROWS = 500_000
#: Bytes of text whose n-grams are hashed at once.
SLICE = 1 << 20

_rng = np.random.default_rng(20)
_A = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_C = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(texts: pa.Array, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, at): text i has the n-grams ``hashes[at[i]:at[i + 1]]``, repeats included. A text of
    fewer words is one n-gram of all of them; words are lower-cased and rid of outer punctuation,
    and what holds nothing else is no word."""
    w: Words = split(texts)
    word = _mix((w.hasher()(w.begin, w.end, 3, 62)).astype(np.uint64))
    real = (w.end > w.begin)[w.codes]
    count = np.add.reduceat(real.astype(np.int64), w.at[:-1])
    seq = word[w.codes[real]]
    at = np.concatenate([[0], np.cumsum(count)])
    size = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(size)])
    start = np.repeat(at[:-1] - out_at[:-1], size) + np.arange(out_at[-1])
    left = np.repeat(at[1:], size) - start
    out = np.zeros(len(start), np.uint64)
    for j in range(n):
        inside = left > j
        out += np.where(inside, seq[np.minimum(start + j, max(0, len(seq) - 1))] * _C[j], np.uint64(0)) if len(seq) else np.uint64(0)
    return _mix(out + np.minimum(left, n).astype(np.uint64)), out_at


def distinct(hashes: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    return [np.unique(hashes[a:b]) for a, b in zip(at, at[1:], strict=False)]


def signatures(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, HASHES) least values; texts without n-grams get the largest value everywhere."""
    out = np.full((len(at) - 1, HASHES), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        for i in range(HASHES):
            out[some, i] = np.minimum.reduceat((hashes * _A[i] + _B[i]) >> np.uint64(32), at[some])
    return out


def least_matches(threshold: Fraction, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each number of compared values the fewest equal ones with which a pair goes on. With a
    uniform prior the posterior probability of s >= t after m of n equal values is that of at most m
    successes in n + 1 draws of chance t."""
    t, out = float(threshold), {}
    for n in range(STEP, HASHES + 1, STEP):
        p, m = 0.0, 0
        while m <= n:
            p += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if p >= tolerance:
                break
            m += 1
        out[n] = m
    return out


def posterior_keeps(a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which of the pairs of signatures (rows of a and b) survive, compared step by step."""
    alive, equal = np.arange(len(a)), np.zeros(len(a), np.int64)
    for n, m in least.items():
        equal[alive] += (a[alive, n - STEP : n] == b[alive, n - STEP : n]).sum(1)
        alive = alive[equal[alive] >= m]
    keep = np.zeros(len(a), bool)
    keep[alive] = True
    return keep


def reaches(common, na, nb, threshold: Fraction):
    """common / (na + nb - common) >= threshold, in whole numbers."""
    return common * threshold.denominator >= threshold.numerator * (na + nb - common)


# -- the join ---------------------------------------------------------------------------------


def _profiles(documents: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """rid, doc_id, thash, k1 and k2 (the row's content key), node (a digest of the n-gram set; null
    without words), size, sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", SLICE):
            hashes, at = shingles(batch.column("text"), n)
            sets = distinct(hashes, at)
            sig = signatures(hashes, at)
            node = [digest(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(node, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([x.tobytes() for x in sig], pa.binary())],
                [*kept, "node", "size", "sig"],
            )

    kept = ["rid", "doc_id", "thash", "k1", "k2"]
    k1, k2 = content_key(documents)
    rows = documents.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("thash"), k1.alias("k1"), k2.alias("k2"), F.col(text_col).alias("text"))
    return rows.mapInArrow(giving_back(run), "rid long, doc_id long, thash long, k1 long, k2 long, node binary, size long, sig binary")


def digest(s: np.ndarray) -> bytes:
    """16 bytes that tell sets apart: two sums of differently mixed members."""
    return np.array([s.sum(), _mix(s * _C[60] + _C[61]).sum()], np.uint64).tobytes()


def _gram_sets(documents: DataFrame, wanted: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """nid, copies, sig and grams (sorted 64-bit hashes) of the wanted kinds, from the text of one document each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", SLICE):
            sets = distinct(*shingles(batch.column("text"), n))
            same = pa.array([digest(s) == d for s, d in zip(sets, batch.column("node").to_pylist(), strict=True)])
            grams = pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("nid"), batch.column("copies"), batch.column("sig"), grams], ["nid", "copies", "sig", "grams"]).filter(same)

    rows = documents.select(F.col(id_col).cast("long").alias("__id"), F.xxhash64(text_col).alias("__hash"), F.col(text_col).alias("text"))
    rows = rows.join(wanted, F.col("__id").eqNullSafe(F.col("rep_doc")) & (F.col("__hash") == F.col("thash")))
    rows = rows.select("nid", "copies", "sig", "node", "text")
    return rows.mapInArrow(giving_back(run), "nid long, copies long, sig binary, grams binary").dropDuplicates(["nid"])


def _pruned(pairs: DataFrame, kinds: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs a, b whose signatures leave the threshold possible."""
    least = least_matches(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = [np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, HASHES) for c in ("sa", "sb")]
            yield batch.select(["a", "b"]).filter(pa.array(posterior_keeps(*sig, least)))

    side = lambda x: kinds.select(F.col("nid").alias(x), F.col("sig").alias(f"s{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(giving_back(run), "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """a, b, ca, cb of the pairs whose n-gram sets reach the threshold; ca and cb count copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ga"), batch.column("gb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                keep.append(bool(reaches(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), threshold)))
            yield batch.select(["a", "b", "ca", "cb"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: sets.select(F.col("nid").alias(x), F.col("copies").alias(f"c{x}"), F.col("grams").alias(f"g{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ca", "cb", "ga", "gb").mapInArrow(giving_back(run), "a long, b long, ca long, cb long")


def block_links(a: list[np.ndarray], b: list[np.ndarray], sa: np.ndarray, sb: np.ndarray, least: dict[int, int], threshold: Fraction) -> np.ndarray:
    """Which documents of two blocks are linked: signatures first, then the common n-grams of the
    pairs that are left, counted by a product of incidence matrices over the n-grams of both."""
    alive = np.ones((len(a), len(b)), bool)
    equal = np.zeros((len(a), len(b)), np.int16)
    for n, m in least.items():
        for k in range(n - STEP, n):
            equal += sa[:, k][:, None] == sb[:, k][None, :]
        alive &= equal >= m
        if not alive.any():
            return alive
    both = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)
    common = np.zeros((len(a), len(b)))
    for lo in range(0, len(both), 8192):
        some = both[lo : lo + 8192]
        common += _incidence(a, some) @ _incidence(b, some).T
    na, nb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    return alive & reaches(np.rint(common).astype(np.int64), na[:, None], nb[None, :], threshold)


def _incidence(sets: list[np.ndarray], grams: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(grams)), np.float32)
    for i, s in enumerate(sets):
        at = np.searchsorted(grams, s)
        at[at == len(grams)] = 0
        out[i, at[grams[at] == s]] = 1
    return out


class _Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def _forest_of(links: np.ndarray, rows: np.ndarray, cols: np.ndarray, forest: _Forest) -> None:
    """Join what the matrix links: least labels spread between rows and columns until they rest."""
    far = len(cols)
    label, last = np.arange(far), None
    while last is None or (label != last).any():
        last = label
        of_row = np.where(links, label[None, :], far).min(1)
        label = np.minimum(label, np.where(links, of_row[:, None], far).min(0))
    for i in np.flatnonzero(of_row < far):
        forest.join(int(rows[i]), int(cols[of_row[i]]))
    for j in np.flatnonzero(links.any(0)):
        forest.join(int(cols[j]), int(cols[label[j]]))


def _chunk_pair(pdf: pd.DataFrame, threshold: Fraction, least: dict[int, int]) -> pd.DataFrame:
    """Counts and a spanning forest of the links between two chunks, or inside one."""
    i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
    pdf = pdf.sort_values("nid", ignore_index=True)
    sides = []
    for c in dict.fromkeys((i, j)):
        part = pdf[pdf["chunk"] == c]
        sides.append((part["nid"].to_numpy(), part["copies"].to_numpy(), [np.frombuffer(x, np.uint64) for x in part["grams"]], np.frombuffer(b"".join(part["sig"]), "<u4").reshape(-1, HASHES)))
    x, y = sides[0], sides[-1]
    forest, total = _Forest(), {}
    for p in range(0, len(x[0]), BLOCK):
        for q in range(p if i == j else 0, len(y[0]), BLOCK):
            r, s = slice(p, p + BLOCK), slice(q, q + BLOCK)
            links = block_links(x[2][r], y[2][s], x[3][r], y[3][s], least, threshold)
            if i == j and p == q:
                np.fill_diagonal(links, False)
            gain = [(x[0][r], links @ y[1][s])] + ([] if i == j and p == q else [(y[0][s], x[1][r] @ links)])
            for nids, n in gain:
                for nid, k in zip(nids[n > 0].tolist(), n[n > 0].tolist(), strict=True):
                    total[nid] = total.get(nid, 0) + int(k)
            _forest_of(links, x[0][r], y[0][s], forest)
    edges = [(k, forest.find(k), 0) for k in list(forest.up)]
    return pd.DataFrame([*edges, *((k, k, n) for k, n in total.items())], columns=["a", "b", "links"]).astype("int64")


def join(documents: DataFrame, threshold: str = THRESHOLD, n: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's class and links: rid (its number in this scan), doc_id, its content key, class_id, copy_id, n_links.

    ``copy_id`` is the least id of the rows with the same n-gram set, ``class_id`` the least id that
    links lead to, ``n_links`` the number of other rows at or over the threshold, copies included.
    Rows without words are linked to nothing and are classes of their own. Null ids take part, but
    are not the least id while there are others.
    """
    t = Fraction(threshold)
    rows = save_shared(_profiles(documents, id_col, text_col, n), "profiles")
    worded = rows.where(F.col("node").isNotNull())
    kinds = worded.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "thash")).alias("rep"), F.any_value("size").alias("size"), F.any_value("sig").alias("sig"))
    kinds = save_shared(kinds.select(F.monotonically_increasing_id().alias("nid"), "node", "copies", F.col("rep.doc_id").alias("rep_doc"), F.col("rep.thash").alias("thash"), "size", "sig"), "kinds")

    width = 4 * ROWS
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("sig", b * width + 1, width)) for b in range(BANDS)])
    bands = kinds.select("nid", F.explode(keys).alias("key"))
    buckets = bands.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("nid").alias("hub")).where("m > 1")
    members = save_shared(bands.join(buckets, "key"), "members")

    near = components(members.where(F.col("m") > SMALL).select(F.col("nid").alias("a"), F.col("hub").alias("b")))
    near = save_shared(near, "neighbourhoods")
    small = members.where(F.col("m") <= SMALL).select("key", "nid")
    pairs = small.withColumnRenamed("nid", "a").join(small.withColumnRenamed("nid", "b"), "key").where("a < b").select("a", "b").distinct()
    of = lambda x: near.select(F.col("node").alias(x), F.col("component").alias(f"n{x}"))
    pairs = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where("na is null or nb is null or na <> nb").select("a", "b")
    met = kinds.join(members.select("nid").distinct(), "nid", "left_semi")
    met = save_shared(met.select("nid", "sig"), "met")
    pairs = save_shared(_pruned(pairs, met, t), "pairs")

    wanted = pairs.select(F.col("a").alias("nid")).unionByName(pairs.select(F.col("b").alias("nid"))).unionByName(near.select(F.col("node").alias("nid"))).distinct()
    sets = save_shared(_gram_sets(documents, kinds.join(wanted, "nid", "left_semi"), id_col, text_col, n), "grams")
    links = save_shared(_verified(pairs, sets, t), "links")
    inner = save_shared(_neighbourhood_links(sets, near, t), "inner-links")
    drop_shared(members, near, met, pairs, sets)  # what follows reads rows, kinds and the links alone

    edges = links.select("a", "b").unionByName(inner.where("a <> b").select("a", "b"))
    comps = components(edges)
    weights = links.select(F.col("a").alias("nid"), F.col("cb").alias("links")).unionByName(links.select(F.col("b").alias("nid"), F.col("ca").alias("links"))).unionByName(inner.select(F.col("a").alias("nid"), "links"))
    weights = weights.groupBy("nid").agg(F.sum("links").alias("links"))
    info = kinds.select("nid", "node", "copies", "rep_doc").join(comps.withColumnRenamed("node", "nid"), "nid", "left").join(weights, "nid", "left")
    heads = info.where("component is not null").groupBy("component").agg(F.min("rep_doc").alias("head"))
    info = info.join(heads, "component", "left").select(
        F.col("node").alias("__node"), F.col("rep_doc").alias("copy_id"), F.coalesce("component", "nid").alias("class"), F.when(F.col("component").isNull(), F.col("rep_doc")).otherwise(F.col("head")).alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    own = ["rid", "doc_id", "k1", "k2"]
    out = worded.select(*own, "node").join(info, F.col("node") == F.col("__node")).select(*own, "class_id", "copy_id", F.col("n_links").cast("long").alias("n_links"), "class")
    # rows without words have no key to be joined by and are classes of their own
    none = rows.where(F.col("node").isNull()).select(*own, F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"), (-1 - F.col("rid")).alias("class"))
    return out.unionByName(none)


def _neighbourhood_links(sets: DataFrame, near: DataFrame, threshold: Fraction) -> DataFrame:
    """Rows (a, b, 0) of a spanning forest and (a, a, links) of counts, chunk by chunk."""
    least = least_matches(threshold)
    rows = sets.join(near.withColumnRenamed("node", "nid"), "nid").withColumn("bytes", F.length("grams").cast("long"))
    sizes = rows.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.sum("bytes").alias("total"))
    chunk = F.greatest(F.lit(CHUNK_LEAST), F.least(F.lit(CHUNK_MOST), F.ceil(F.col("m") / 16)))
    sizes = sizes.select("component", F.greatest(F.ceil(F.col("m") / chunk), F.ceil(F.col("total") / F.lit(CHUNK_BYTES)), F.lit(1)).cast("int").alias("chunks"))
    rows = rows.join(sizes, "component").withColumn("chunk", F.pmod(F.xxhash64("nid"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("component", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "nid", "copies", "sig", "grams")
    # dealt anew, or else all chunks of a component would meet in the task that the join on it chose
    rows = rows.repartition("component", "i", "j")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _chunk_pair(pdf, threshold, least)

    return rows.groupBy("component", "i", "j").applyInPandas(run, "a long, b long, links long")


def deduplicate(documents: DataFrame, threshold: str = THRESHOLD, n: int = WORDS) -> DataFrame:
    """One row of each class, the one with the least id, in the columns of the input. Rows without words stay.

    Rows are told apart by their content, which holds however the input is split or read again; of
    rows that are alike in every column one stays."""
    found = save_shared(join(documents, threshold, n).select("class", "doc_id", "k1", "k2"), "classes")
    alike = found.groupBy("class", "doc_id", "k1", "k2").agg(F.count(F.lit(1)).alias("same"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("h")
    heads = found.groupBy("class").agg(first, F.count(F.lit(1)).alias("rows")).where("rows > 1").select("class", F.col("h.k1").alias("h1"), F.col("h.k2").alias("h2"))
    k1, k2, b1, b2, again = fresh(documents, "k1", "k2", "b1", "b2", "again")
    head = (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2"))
    few = heads.count() <= BROADCAST_ROWS
    marks = alike.join(F.broadcast(heads) if few else heads, "class").where(~head | (F.col("same") > 1)).select(F.col("k1").alias(b1), F.col("k2").alias(b2), head.alias(again))
    marks = save_shared(marks, "duplicates")
    n_again = marks.where(again).count()
    side = lambda m: F.broadcast(m) if m.count() <= BROADCAST_ROWS else m
    h1, h2 = content_key(documents)
    rows = documents.withColumns({k1: h1, k2: h2})
    same = (F.col(k1) == F.col(b1)) & (F.col(k2) == F.col(b2))
    kept = rows.join(side(marks), same, "left_anti").drop(k1, k2)
    if not n_again:
        return kept
    return kept.unionByName(rows.join(side(marks.where(again)), same, "left_semi").dropDuplicates([k1, k2]).drop(k1, k2))
