"""Words of Arrow batches as codes of a dictionary, and hashes of parts of the different words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Stripped from both ends of a word.
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\xa1\xbf\xab\xbb“”‘’…–—"
_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


#: Bytes of different words that are hashed at once; it bounds the tables of powers.
BLOCK_BYTES = 1 << 20


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 256)
        _powers = tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, p, np.uint64))]) for p in (_P, _INVERSE))
    return _powers


class Hasher:
    """Hashes of byte spans, equal for equal bytes wherever they stand."""

    def __init__(self, data: np.ndarray):
        forth, self.back = _power_tables(len(data) + 1)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * forth[: len(data)])])

    def __call__(self, a: np.ndarray, b: np.ndarray, seed: int, bits: int) -> np.ndarray:
        x = (self.sums[b] - self.sums[a]) * self.back[a] + np.uint64(seed * 0x632BE59BD9B4E019 % (1 << 64))
        x = (x ^ (x >> np.uint64(31))) * _MIX
        x = (x ^ (x >> np.uint64(29))) * _MIX
        return (x >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Words:
    """``codes[at[i]:at[i + 1]]`` are the words of text i; word j of the dictionary has the bytes
    ``data[begin[j]:end[j]]``, in lower case and without punctuation at its ends."""

    codes: np.ndarray
    at: np.ndarray
    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    letters: np.ndarray

    def hasher(self) -> Hasher:
        return Hasher(self.data)

    def blocks(self) -> Iterator[tuple[slice, Words]]:
        """Runs of different words of some BLOCK_BYTES bytes, with their bytes alone and no texts."""
        a = 0
        while a < len(self.begin):
            b = max(a + 1, int(np.searchsorted(self.end, self.begin[a] + BLOCK_BYTES, side="right")))
            lo, hi = int(self.begin[a]), int(self.end[b - 1])
            none = np.empty(0, np.int64)
            yield slice(a, b), Words(none, none, self.data[lo:hi], self.begin[a:b] - lo, self.end[a:b] - lo, self.letters[a:b])
            a = b


def split(texts: pa.Array) -> Words:
    """Words between white space; a null or empty text has one empty word."""
    lists = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    at = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
    uniq = pc.utf8_lower(pc.utf8_trim(coded.dictionary, characters=EDGES)).cast(pa.large_string())
    if isinstance(uniq, pa.ChunkedArray):
        uniq = uniq.combine_chunks()
    ends = np.frombuffer(uniq.buffers()[1], np.int64)[uniq.offset : uniq.offset + len(uniq) + 1]
    raw = uniq.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[: ends[-1]] if raw is not None else np.empty(0, np.uint8)
    letters = pc.match_substring_regex(uniq, r"\pL").to_numpy(zero_copy_only=False)
    return Words(coded.indices.to_numpy(), at - at[0], data, ends[:-1], ends[1:], letters)
