"""Token ids in a binary format of bit or byte planes.

A segment is a run of whole documents' ids: a header, then blocks of ``BLOCK_IDS`` ids. A block
is transposed into planes (all ids' lowest bytes, then the next bytes, or single bits), each
compressed with zstandard by itself, as a plane holds like values. The segment ends with its
chunk index: for each block the id count and the planes' places and lengths, so that a reader
can fetch one block alone. Segments are rows of a Parquet table that Spark's writers commit,
which works on any store; ``export_segments`` writes the same bytes as plain files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import partitions_for
from .common import giving_back, save_shared, text_slices
from .tokens import SLICE, encoder

#: Ids that are transposed at once.
BLOCK_IDS = 65536
#: Ids after which a segment is closed, at the next document's end.
SEGMENT_IDS = 1 << 20
#: Segments up to which their index may be broadcast: a row of it is about 40 bytes.
BROADCAST_SEGMENTS = 100_000
MAGIC = b"PLNS"
_HEAD = struct.Struct("<4sBBHIQ")
_PLANE = struct.Struct("<QI")


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of a block, least significant first; all-zero high planes are left out."""
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        high = 4
        while high and not octets[:, high - 1].any():
            high -= 1
        return [octets[:, k].tobytes() for k in range(high)]
    planes = np.unpackbits(octets, axis=1, bitorder="little")
    high = int(ids.max()).bit_length() if len(ids) else 0
    return [np.packbits(planes[:, k], bitorder="little").tobytes() for k in range(high)]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    octets = np.zeros((n, 4), np.uint8)
    if not bits:
        for k, p in enumerate(planes):
            octets[:, k] = np.frombuffer(p, np.uint8)
    else:
        flat = np.zeros((n, 32), np.uint8)
        for k, p in enumerate(planes):
            flat[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
        octets = np.packbits(flat, axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view("<u4").reshape(-1).astype(np.uint32)


def write_segment(ids: np.ndarray, bits: bool = False, level: int = 3, block: int = BLOCK_IDS) -> bytes:
    """Header, compressed planes of every block, chunk index, the index's place."""
    squeeze = zstandard.ZstdCompressor(level=level).compress
    blocks = [ids[a : a + block] for a in range(0, len(ids), block)]
    out = bytearray(_HEAD.pack(MAGIC, 1, bits, 0, len(blocks), len(ids)))
    index = bytearray()
    for b in blocks:
        planes = to_planes(b, bits)
        index += struct.pack("<IB", len(b), len(planes))
        for p in map(squeeze, planes):
            index += _PLANE.pack(len(out), len(p))
            out += p
    return bytes(out + index + struct.pack("<Q", len(out)))


def read_index(data: bytes) -> tuple[bool, list[tuple[int, list[tuple[int, int]]]]]:
    """(planes are bits, for each block its id count and its planes' places and lengths)."""
    magic, version, bits, _, blocks, _ = _HEAD.unpack_from(data)
    if magic != MAGIC or version != 1:
        raise ValueError("not a segment of planes")
    at = struct.unpack_from("<Q", data, len(data) - 8)[0]
    index = []
    for _ in range(blocks):
        n, k = struct.unpack_from("<IB", data, at)
        index.append((n, [_PLANE.unpack_from(data, at + 5 + j * _PLANE.size) for j in range(k)]))
        at += 5 + k * _PLANE.size
    return bool(bits), index


def read_segment(data: bytes, only: int | None = None) -> np.ndarray:
    """All ids, or those of block ``only``."""
    bits, index = read_index(data)
    expand = zstandard.ZstdDecompressor().decompress
    blocks = index if only is None else index[only : only + 1]
    parts = [from_planes([expand(data[a : a + m]) for a, m in planes], n, bits) for n, planes in blocks]
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)


SEGMENTS = "part int, seq int, n_ids long, doc_ids array<bigint>, doc_tokens array<bigint>, content binary"
_SEGMENTS = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("content", pa.binary())])


def encode_documents(df: DataFrame, vocabulary: str, end_id: int = 0, bits: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments of all documents in ascending id order, read back from the shared folder.

    Rows are dealt by ranges of the id and sorted inside them, so part and seq give the order.
    Null texts are empty and hold ``end_id`` alone, null ids come first, rows of one id stand in
    the order of their texts. An empty table gives no segment.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        encode = encoder(vocabulary, attached=True)
        held, docs, tokens, n = [], [], [], 0

        def close():
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "n_ids": n, "doc_ids": docs, "doc_tokens": tokens, "content": write_segment(np.concatenate(held), bits)}], schema=_SEGMENTS)

        for batch in text_slices(batches, "text", SLICE):
            ids, lengths = encode(batch.column("text"))
            ids = np.insert(ids, np.cumsum(lengths), end_id)
            cut = np.concatenate([[0], np.cumsum(lengths + 1)])
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                held.append(ids[cut[i] : cut[i + 1]])
                docs.append(doc)
                tokens.append(int(lengths[i]) + 1)
                n += tokens[-1]
                if n >= SEGMENT_IDS:
                    yield close()
                    held, docs, tokens, n, seq = [], [], [], 0, seq + 1
        if docs:
            yield close()

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(partitions_for(rows), "doc_id").sortWithinPartitions("doc_id", "text")
    return save_shared(rows.mapInArrow(giving_back(pack), SEGMENTS), "segments")


def segment_starts(segments: DataFrame) -> DataFrame:
    """part, seq and ``first``: the ids of all segments before it. Parts are summed up first, so
    that no task gets more rows than there are parts, or segments of one part."""
    index = segments.select("part", "seq", "n_ids")
    parts = index.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    index = index.join(parts.select("part", before.alias("base")), "part")
    return index.select("part", "seq", (F.col("base") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("first"))


def read_documents(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the segments' bytes."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, seq, docs, tokens, data = (batch.column(c)[row].as_py() for c in ("part", "seq", "doc_ids", "doc_tokens", "content"))
                octets = read_segment(data).astype("<u4").tobytes()
                cut = np.concatenate([[0], np.cumsum(tokens)])
                sums = [zlib.crc32(octets[4 * a : 4 * b]) for a, b in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(docs), pa.int32()), pa.array([seq] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(cut[:-1]), pa.array(tokens, pa.int64()), pa.array(sums, pa.int64())], ["part", "seq", "doc_id", "inner", "n_tokens", "ids_crc32"])

    docs = segments.mapInArrow(giving_back(unpack), "part int, seq int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    starts = save_shared(segment_starts(segments), "segment-index")
    if starts.count() <= BROADCAST_SEGMENTS:
        starts = F.broadcast(starts)
    out = docs.join(starts, ["part", "seq"])
    return out.select("doc_id", (F.col("first") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def export_segments(segments: DataFrame, folder: str) -> int:
    """Write every segment as a file of its own in a folder that all executors can write to; the
    number of files. A repeated task writes the same bytes again."""
    import os

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for row in batch.select(["part", "seq", "content"]).to_pylist():
                path = os.path.join(folder, f"{row['part']:05d}-{row['seq']:05d}.planes")
                with open(f"{path}.{os.getpid()}", "wb") as f:
                    f.write(row["content"])
                os.replace(f.name, path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return segments.mapInArrow(giving_back(write), "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
