"""Whole texts to token ids with the tokenizers library, a piece at a time.

A byte-level BPE cuts a text where a run of white space begins, whatever stands around it, and
a word BPE drops white space. The ids of a text are then those of its pieces, one after the
other. Texts repeat words, so each worker encodes a piece once and looks it up afterwards.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: White space of the Unicode property, as the tokenizers' own patterns take it.
_WS = r"\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_PAIR = f"[{_WS}][{_WS}]"
_PY_WS = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Marks a cut; a text that holds it is cut at white space only.
_CUT = chr(0xE000)
#: Full stops and commas that stand after neither a letter nor a digit.
_STOP_INSIDE = r"[^\pL\pN][.,]"
_PIECES = regex.compile(f"[{_PY_WS}]*[^{_PY_WS}]+|[{_PY_WS}]+")
#: Bytes of pieces that a worker remembers; beyond it those that were looked up least go, to half of that.
CACHE_BYTES = 24 << 20
#: New pieces that are held apart before they are merged with the others.
RECENT = 1 << 16
#: Longer pieces, in bytes, are encoded whenever they are met.
LONGEST = 64
#: Bytes of text that are encoded at once.
SLICE = 1 << 20

_ODD = np.random.default_rng(41).integers(1, 1 << 63, (2, LONGEST // 8 + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def piece_keys(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of byte spans of up to LONGEST bytes: sums of their 8-byte lanes and their length,
    each times an odd number of its own."""
    lanes = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    out = [size.astype(np.uint64) * x for x in _ODD[:, -1]]
    for k in range(LONGEST // 8):
        some = np.flatnonzero(size > 8 * k)
        if not len(some):
            break
        lane = lanes[begin[some] + 8 * k].view("<u8").ravel()
        short = 8 * np.minimum(size[some] - 8 * k, 8).astype(np.uint64)
        lane &= np.where(short < 64, (np.uint64(1) << (short % np.uint64(64))) - np.uint64(1), ~np.uint64(0))
        for h, x in zip(out, _ODD[:, k], strict=True):
            h[some] += lane * x
    return out[0] ^ (out[0] >> np.uint64(29)), out[1] ^ (out[1] >> np.uint64(31))


class Pieces:
    """What is known of pieces, in order of their first key: the second key, where their ids begin in a pool,
    how many they are, and how often they were looked up. A piece takes some 40 bytes."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, begin: np.ndarray, count: np.ndarray, uses: np.ndarray, ids: np.ndarray):
        order = np.argsort(h1, kind="stable")
        self.h1, self.h2, self.begin, self.count, self.uses, self.ids = h1[order], h2[order], begin[order], count[order], uses[order], ids

    @classmethod
    def of(cls, h1: np.ndarray, h2: np.ndarray, count: np.ndarray, ids: np.ndarray, uses: np.ndarray | None = None) -> Pieces:
        """Pieces whose ids stand in the pool in their own order."""
        begin = (np.cumsum(count) - count).astype(np.int32)
        return cls(h1, h2, begin, count.astype(np.int32), np.zeros(len(h1), np.int32) if uses is None else uses, ids.astype(np.uint32))

    @classmethod
    def none(cls) -> Pieces:
        return cls.of(np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.uint32))

    def __len__(self) -> int:
        return len(self.h1)

    @property
    def bytes(self) -> int:
        return sum(x.nbytes for x in (self.h1, self.h2, self.begin, self.count, self.uses, self.ids))

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The place of each piece; -1 for unknown ones."""
        if not len(self):
            return np.full(len(h1), -1)
        at = np.minimum(np.searchsorted(self.h1, h1), len(self) - 1)
        return np.where((self.h1[at] == h1) & (self.h2[at] == h2), at, -1)

    def with_(self, other: Pieces) -> Pieces:
        both = lambda x: np.concatenate([getattr(self, x), getattr(other, x)])
        begin = np.concatenate([self.begin, other.begin + np.int32(len(self.ids))])
        return Pieces(both("h1"), both("h2"), begin, both("count"), both("uses"), both("ids"))

    def most_used(self, most: int) -> Pieces:
        """The pieces that were looked up most, as many as ``most`` bytes hold; uses count half from now on."""
        keep = np.sort(np.argsort(-self.uses, kind="stable")[: int(len(self) * most / max(1, self.bytes))])
        return Pieces.of(self.h1[keep], self.h2[keep], self.count[keep], gather(self.ids, self.begin[keep], self.count[keep]), self.uses[keep] // 2)


def gather(ids: np.ndarray, begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of ids that begin at these places, one after the other."""
    return ids[gather_places(begin, counts)]


class Encoder:
    """Encode lists of texts. ``attached``: white space belongs to the piece that follows."""

    def __init__(self, path: str, attached: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.attached = Tokenizer.from_file(path), attached
        self.special = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.forget()

    def forget(self) -> None:
        self.known, self.recent = Pieces.none(), Pieces.none()

    def whole(self, text: str) -> np.ndarray:
        """The ids by the library alone, which the pieces' ids must equal."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def look_up(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of the given, different pieces; new ones are encoded."""
        data, begin, end = spans(pieces)
        size = end - begin
        brief = np.flatnonzero(size <= LONGEST)
        h1, h2 = piece_keys(data, begin[brief], size[brief])
        count = np.zeros(len(pieces), np.int64)
        held, rest = [], np.ones(len(pieces), bool)
        for table in (self.known, self.recent):
            at = table.find(h1, h2)
            hit = np.flatnonzero(at >= 0)
            table.uses[at[hit]] += 1
            held.append((table, brief[hit], at[hit]))
            count[brief[hit]] = table.count[at[hit]]
            rest[brief[hit]] = False
        miss = np.flatnonzero(rest)
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(pieces.take(pa.array(miss)).to_pylist(), add_special_tokens=False)] if len(miss) else []
        fresh_count = np.array(list(map(len, lists)), np.int64)
        fresh_ids = np.fromiter(chain.from_iterable(lists), np.uint32, int(fresh_count.sum()))
        count[miss] = fresh_count
        ends = np.cumsum(count)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        for table, rows, at in held:
            out[gather_places(ends[rows] - count[rows], count[rows])] = gather(table.ids, table.begin[at], table.count[at])
        out[gather_places(ends[miss] - fresh_count, fresh_count)] = fresh_ids
        new = rest[brief]
        if new.any():
            some = size[miss] <= LONGEST
            ids = gather(fresh_ids, (np.cumsum(fresh_count) - fresh_count)[some], fresh_count[some])
            self.recent = self.recent.with_(Pieces.of(h1[new], h2[new], fresh_count[some], ids))
            if len(self.recent) >= RECENT:
                self.known, self.recent = self.known.with_(self.recent), Pieces.none()
                if self.known.bytes > CACHE_BYTES:
                    self.known = self.known.most_used(CACHE_BYTES // 2)
        return out, count

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each). Null texts are empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        marked = np.zeros(len(texts), bool)
        for mark in self.special:
            marked |= pc.match_substring(texts, mark, ignore_case=True).to_numpy(zero_copy_only=False)
        odd = marked | pc.match_substring_regex(texts, f"{_STOP_INSIDE}|{_CUT}").to_numpy(zero_copy_only=False)
        if self.attached:
            odd |= pc.match_substring_regex(texts, _PAIR).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        for mark in " \n,.":
            keep = f"{_CUT}{mark}" if self.attached or mark in ",." else _CUT
            plain = pc.replace_substring(plain, mark, keep + _CUT if keep[-1] == "\n" else keep)
        lists = pc.split_pattern(plain, _CUT)
        at = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        at -= at[0]
        own, count = self.look_up(coded.dictionary)
        rows = coded.indices.to_numpy()
        counts = count[rows]
        ids, lengths = gather(own, (np.cumsum(count) - count)[rows], counts), np.add.reduceat(counts, at[:-1])
        if not odd.any():
            return ids, lengths
        cut = np.concatenate([[0], np.cumsum(lengths)])
        out = [ids[cut[i] : cut[i + 1]] for i in range(len(texts))]
        for i in np.flatnonzero(odd):
            text = texts[int(i)].as_py()
            out[i] = self.whole(text) if marked[i] else self.by_pieces(_PIECES.findall(text))
        return np.concatenate(out), np.fromiter(map(len, out), np.int64, len(out))

    def by_pieces(self, pieces: list[str]) -> np.ndarray:
        uniq = {p: i for i, p in enumerate(dict.fromkeys(pieces))}
        if not uniq:
            return np.empty(0, np.uint32)
        ids, count = self.look_up(pa.array(uniq, pa.large_string()))
        rows = np.fromiter((uniq[p] for p in pieces), np.int64, len(pieces))
        return gather(ids, (np.cumsum(count) - count)[rows], count[rows])


def spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, begins, ends) of an array of large strings without nulls."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    return np.frombuffer(raw, np.uint8)[: ends[-1]] if raw is not None else np.empty(0, np.uint8), ends[:-1], ends[1:]


def gather_places(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of runs that begin here and are so long."""
    ends = np.cumsum(counts)
    return np.repeat(begin - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, attached: bool) -> Encoder:
    """This process's encoder of a vocabulary file."""
    if (path, attached) not in _ENCODERS:
        _ENCODERS[path, attached] = Encoder(path, attached)
    return _ENCODERS[path, attached]
