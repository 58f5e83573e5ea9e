"""Packing by non-negative least squares over the histogram of piece lengths.

Documents are cut into windows of 2048 ids; the rests (1 to 2047 ids) form a histogram, which is
all that the driver sees and is as small for any corpus. Shallow combinations of lengths that
fill a window exactly are columns of a matrix; non-negative least squares finds how often to
repeat each so that the histogram is used up; counts are rounded, and what remains is packed
greedily, still as counts. Pieces then find their sequence by their rank among those of their
length, without meeting in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import gapless_rank, giving_back, save_shared, text_slices
from .tokens import SLICE, encoder

WINDOW = 2048
#: Bits of a rank among the pieces of one length.
RANK_BITS = 50
#: Steps of the projected-gradient solver.
SOLVER_STEPS = 400


#: Lengths with the most pieces, for which all fillings with two further lengths are enumerated.
HOT_LENGTHS, HOT_REPEATS = 24, 4


def combinations(hist: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Shallow fillings of the window: pairs of a length and its complement, triples of a length,
    itself (or its neighbour, half or double) and what is missing; halves and quarters; and for the
    most frequent lengths one to four of them with one or any two others."""
    have = set(np.flatnonzero(hist).tolist())
    found = {tuple(sorted((a, window - a))) for a in have if window - a in have}
    for a in have:
        for b in (a, a + 1, a // 2, 2 * a):
            if b in have and window - a - b in have:
                found.add(tuple(sorted((a, b, window - a - b))))
    for k in (4, 8):
        if window // k in have:
            found.add((window // k,) * k)
    for a in np.argsort(-hist, kind="stable")[:HOT_LENGTHS].tolist():
        for k in range(1, HOT_REPEATS + 1) if hist[a] else ():
            rest = window - k * a
            if rest <= 0:
                found |= {(a,) * k} if rest == 0 else set()
                break
            if rest in have:
                found.add(tuple(sorted((*(a,) * k, rest))))
            found |= {tuple(sorted((*(a,) * k, b, rest - b))) for b in have if b <= rest - b and rest - b in have}
    return sorted(found)


def solve(combos: list[tuple[int, ...]], hist: np.ndarray, steps: int = SOLVER_STEPS) -> np.ndarray:
    """x >= 0 that makes ``A x`` close to the histogram, by accelerated projected gradients; A has
    few entries a column and is kept as lists of places."""
    if not combos:
        return np.empty(0)
    col = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
    row = np.array([a for c in combos for a in c])
    use = lambda x: np.bincount(row, x[col], len(hist))
    back = lambda r: np.bincount(col, r[row], len(combos))
    v = np.ones(len(combos))
    for _ in range(30):
        v = back(use(v))
        v /= max(np.linalg.norm(v), 1e-12)
    rate = 1 / max(np.linalg.norm(back(use(v))), 1e-12)
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - rate * back(use(y) - hist))
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        x, y = new, new + (last - 1) / t * (new - x)
    return x


def plan(hist: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences); together they use every piece once."""
    left, out = hist.astype(np.int64).copy(), []

    def take(combo: tuple[int, ...], most: int) -> None:
        lengths, times = np.unique(combo, return_counts=True)
        n = min(most, int((left[lengths] // times).min()))
        if n > 0:
            left[lengths] -= n * times
            out.append((tuple(combo), n))

    combos, carry = combinations(left, window), 0.0
    x = solve(combos, left.astype(float))
    for i in np.argsort(-x, kind="stable"):  # rounded down, and what is cut off goes to the next
        carry += x[i]
        take(combos[i], n := int(carry + 1e-9))
        carry -= n
    while len(big := np.flatnonzero(left)):  # the residuals: the longest piece first, then what fits best
        combo, room = [int(big[-1])], window - int(big[-1])
        left[combo[0]] -= 1
        while room and len(fit := np.flatnonzero(left[1 : room + 1])):
            combo.append(int(fit[-1]) + 1)
            left[combo[-1]] -= 1
            room -= combo[-1]
        np.add.at(left, combo, 1)
        take(tuple(combo), int(left[np.array(combo)].min()))
    return out


def places(planned: list[tuple[tuple[int, ...], int]], first: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, from rank, number, first sequence, offset): pieces of that length with these
    ranks lie one in each of as many sequences."""
    used: dict[int, int] = {}
    rows = []
    for combo, n in planned:
        offset = 0
        for length in combo:
            rows.append((length, used.get(length, 0), n, first, offset))
            used[length] = used.get(length, 0) + n
            offset += length
        first += n
    return rows


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_documents(df: DataFrame, vocabulary: str, end_id: int = 1, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``window`` ids of every document; ``with_ids`` keeps the ids too."""
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, attached=False)
        for batch in text_slices(batches, "text", SLICE):
            ids, lengths = encode(batch.column("text"))
            octets = np.insert(ids, np.cumsum(lengths), end_id).astype("<u4").tobytes()
            lengths = lengths + 1
            ends = np.cumsum(lengths)
            count = -(-lengths // window)
            doc = np.repeat(np.arange(len(lengths)), count)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * window
            length = np.minimum(window, lengths[doc] - start)
            at = (ends - lengths)[doc] + start
            sums = [zlib.crc32(octets[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            cols = [batch.column("doc_id").cast(pa.int64()).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(lengths[doc])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                flat = np.frombuffer(octets, "<u4").astype(np.int32)
                cols.append(pa.array([flat[a : a + n] for a, n in zip(at, length, strict=True)], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(giving_back(cut), schema)


def pack_documents(df: DataFrame, vocabulary: str, end_id: int = 1, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence and its offset in it.

    ``sequence_id`` and the offsets in each sequence run without gaps from 0. Null and empty texts
    are a piece of the end id alone; repeated rows are pieces of their own; an empty table gives
    none; other columns are dropped.
    """
    spark = df.sparkSession
    pieces = save_shared(cut_documents(df, vocabulary, end_id, window, id_col, text_col, with_ids), "pieces")
    hist = np.zeros(window + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most `window` rows
        hist[length] = n
    full, hist[window] = int(hist[window]), 0
    rows = sorted(places(plan(hist, window), full) + [(window, 0, full, 0, 0)])
    spots = spark.sparkContext.broadcast(np.array(rows, np.int64).reshape(-1, 5))  # a few rows for each length, whatever the corpus
    ranked = gapless_rank(pieces, ["length"], ["doc_id", "start", "ids_crc32", "doc_tokens"], "__rank")
    fields = [*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, lo, _, first, offset = spots.value.T
        begins = (length << RANK_BITS) + lo
        for batch in batches:
            rank = batch.column("__rank").to_numpy()
            at = np.searchsorted(begins, (batch.column("length").to_numpy() << RANK_BITS) + rank, side="right") - 1
            kept = [c for c in batch.schema.names if c != "__rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(first[at] + rank - lo[at]), pa.array(offset[at])], [*kept, "sequence_id", "offset"])

    return ranked.select(*pieces.columns, "__rank").mapInArrow(giving_back(put), T.StructType(fields))
