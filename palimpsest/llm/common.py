"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..storage import drop_shared, save_shared, shared_dir  # noqa: F401  used by the other modules

#: Characters of a text that a model is fitted on, at most; scoring reads whole texts.
FIT_CHARS = 20_000
#: Bytes of text that one vectorised step in a Python worker takes at once.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data; files are found by Spark's own readers only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release_memory() -> None:
    """Give back what this process needed for a while: a model is small, its training is not, and a
    worker that waits for its next task holds what the last one freed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow, after which the worker gives its memory back to the system. Workers are
    kept from one stage to the next, beside the executor's heap."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


def text_slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows whose texts hold about ``limit`` bytes.

    A single text over the limit is a slice of its own; no text is cut.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to be no column of ``df``."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        out.append(name)
    return out


def fit_text(col: str) -> Column:
    """A text to fit a model on: whole, or of a longer one a window that a hash of the text places."""
    spare = F.greatest(F.length(col) - FIT_CHARS, F.lit(0))
    return F.substr(F.col(col), (F.pmod(F.xxhash64(col), spare + 1) + 1).cast("int"), F.lit(FIT_CHARS))


#: Numbers are added up as whole multiples of 1 / UNIT, so that the order in which they come changes no sum.
UNIT = 1 << 24
#: Pieces that a vector is added up in, each by a task of its own.
SLOTS = 32
PARTS = "slot int, part binary"


def in_parts(vector: np.ndarray) -> pa.RecordBatch:
    """Whole numbers as rows of PARTS."""
    pieces = np.array_split(vector.astype("<i8"), SLOTS)
    return pa.RecordBatch.from_arrays([pa.array(range(SLOTS), pa.int32()), pa.array([x.tobytes() for x in pieces], pa.binary())], ["slot", "part"])


def added_up(parts: DataFrame) -> np.ndarray:
    """The sum of the vectors that rows of PARTS hold; empty if there is none. Vectors are added where they
    are, the driver reads one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, part in zip(batch.column("slot").to_pylist(), batch.column("part"), strict=True):
                x = np.frombuffer(part.as_buffer(), "<i8")
                sums[slot] = sums[slot] + x if slot in sums else x.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slot", "part"])

    rows = parts.select("slot", "part").repartition(SLOTS, "slot").mapInArrow(run, PARTS).collect()
    return np.concatenate([np.frombuffer(r.part, "<i8") for r in sorted(rows, key=lambda r: r.slot)]) if rows else np.empty(0, np.int64)


def content_key(df: DataFrame) -> tuple[Column, Column]:
    """Two 64-bit hashes of a row's whole content, nulls included. A row has the same key in every
    scan, however the input is split; a number given in one scan need not be a row's in the next."""

    def hashable(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        return c.cast("string") if "map<" in field.dataType.simpleString() or "variant" in field.dataType.simpleString() else c

    parts = [x for f in df.schema for x in (F.col(f"`{f.name}`").isNull(), hashable(f))]
    return F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts)


def gapless_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, cell_rows: int = 1024) -> DataFrame:
    """Add ``name``: a rank from 0 without gaps among the rows of equal ``keys``.

    A plain ``row_number`` would sort each key's rows in one task. Here each key is split by a
    hash of ``order`` into cells of about ``cell_rows`` rows; cells are counted first, their
    counts summed up, and rows are numbered inside their cells only. ``keys`` may be few or
    skewed. Rows alike in ``keys`` and ``order`` share a cell, so ``order`` should tell rows apart.
    """
    n, cell, base = f"__{name}_n", f"__{name}_cell", f"__{name}_base"
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)).withColumn(n, F.ceil(F.col(n) / F.lit(cell_rows)))
    dealt = _same_keys(df, per_key, keys).withColumn(cell, F.pmod(F.xxhash64(*order), F.col(n))).drop(n)
    counts = dealt.groupBy(*keys, cell).agg(F.count(F.lit(1)).alias(base))
    before = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(base, F.coalesce(F.sum(base).over(before), F.lit(0)))
    inside = Window.partitionBy(*keys, cell).orderBy(*order)
    out = _same_keys(dealt, counts, [*keys, cell])
    return out.withColumn(name, (F.col(base) + F.row_number().over(inside) - 1).cast("long")).drop(cell, base)


def _same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An inner join in which null keys are equal to each other."""
    right = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = None
    for k in keys:
        here = left[k].eqNullSafe(right[f"__r_{k}"])
        on = here if on is None else on & here
    return left.join(right, on).drop(*[f"__r_{k}" for k in keys])
