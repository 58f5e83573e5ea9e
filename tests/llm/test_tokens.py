import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from palimpsest.llm import packing, token_output
from palimpsest.llm.tokens import Encoder

ODD = ["", "  a  b", "a\n\nb \n c", " lead", "trail ", "<|endoftext|> hi", "don't  stop", "a,b.c, d.", "x..y ,z", "3.14, 5,000.\nÉt", None, "é x", "é, İx", ".a", "\n", "a\tb\r\nc", chr(0xE000) + "a b", "it's 'll x's, y."]
FILES = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]


@pytest.mark.parametrize(("file", "attached"), FILES)
def test_pieces_equal_the_library(file, attached):
    e = Encoder(public_tokenizers.path(file), attached)
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(["a", " ", "\n", ",", ".", "é", "7", "'s", " ", "Q", "-"]) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    ids, lengths = e(pa.array(texts, pa.string()))
    cut = np.concatenate([[0], np.cumsum(lengths)])
    for i, t in enumerate(texts):
        assert ids[cut[i] : cut[i + 1]].tolist() == e.whole(t or "").tolist(), repr(t)


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [0, 1, 7, 1000, 70000])
def test_segment_round_trip(bits, n):
    ids = np.random.default_rng(n).integers(0, 50257, n).astype(np.uint32)
    data = token_output.write_segment(ids, bits, block=4096)
    assert (token_output.read_segment(data) == ids).all()
    if n > 4096:
        assert (token_output.read_segment(data, 1) == ids[4096:8192]).all()
    assert (token_output.read_segment(token_output.write_segment(np.array([2**32 - 1, 0], np.uint32), bits)) == [2**32 - 1, 0]).all()


def test_output_holds_every_document_in_order(spark, odd, monkeypatch, tmp_path):
    monkeypatch.setattr(token_output, "SEGMENT_IDS", 50)
    path = public_tokenizers.path("byte_bpe_50k.json")
    segments = token_output.encode_documents(odd, path)
    got = sorted(token_output.read_documents(segments).collect(), key=lambda r: r.start)
    e, start = Encoder(path, True), 0
    want = sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for r, (doc, text) in zip(got, want, strict=True):
        ids = np.append(e.whole(text or ""), 0).astype("<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_output.export_segments(segments, str(tmp_path / "out")) == segments.count()
    assert token_output.read_documents(token_output.encode_documents(odd.where("false"), path)).count() == 0


def test_packing_places_every_id_once(spark, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack_documents(odd, path, window=64, with_ids=True).collect()
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at and r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            at += r.length
        assert at <= 64
    e = Encoder(path, False)
    assert sum(r.length for r in got) == sum(len(e.whole(r.text or "")) + 1 for r in odd.collect())
    assert packing.pack_documents(odd.where("false"), path).count() == 0


def test_plan_uses_the_histogram_and_wastes_little():
    rng = np.random.default_rng(1)
    hist = np.bincount(np.minimum(2047, rng.exponential(500, 20000).astype(int) + 1), minlength=2049)
    hist[700] += 9000  # one length with a third of all pieces
    planned = packing.plan(hist)
    used = np.zeros_like(hist)
    for combo, n in planned:
        np.add.at(used, list(combo), n)
        assert sum(combo) <= 2048
    assert (used == hist).all()
    total = sum(n for _, n in planned)
    assert (hist * np.arange(len(hist))).sum() / (total * 2048) > 0.97


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_plan_needs_no_more_than_a_plain_packer(seed):
    """Best fit, the longest first: the plan has at most as many sequences, and no fewer than its ids fill."""
    rng = np.random.default_rng(seed)
    hist = np.bincount(np.clip(rng.lognormal(6, 0.8, 4000).astype(int), 1, 2047), minlength=2049)
    rooms = []
    for n in np.repeat(np.arange(2049), hist)[::-1].tolist():
        at = min((i for i, r in enumerate(rooms) if r >= n), key=lambda i: rooms[i], default=None)
        if at is None:
            rooms.append(2048 - n)
        else:
            rooms[at] -= n
    mine = sum(n for _, n in packing.plan(hist))
    assert -(-int((hist * np.arange(2049)).sum()) // 2048) <= mine <= len(rooms)


def test_forgotten_pieces_are_encoded_again(monkeypatch):
    """A small memory gives the same ids."""
    from palimpsest.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_BYTES", 20_000)
    monkeypatch.setattr(tokens, "RECENT", 64)
    for file, attached in FILES:
        e = Encoder(public_tokenizers.path(file), attached)
        rng = random.Random(8)
        for _ in range(30):
            texts = [" ".join(f"w{rng.randint(0, 3000)}" + "x" * rng.choice([0, 70]) for _ in range(40)) for _ in range(20)]
            ids, lengths = e(pa.array(texts))
            assert ids.tolist() == [i for t in texts for i in e.whole(t).tolist()] and len(lengths) == 20
        assert e.known.bytes <= 20_000


def test_piece_keys_tell_spans_apart():
    from palimpsest.llm.tokens import piece_keys

    words = sorted({bytes(random.Random(i).choices(b"ab\x00\xff", k=random.Random(i).randint(0, 64))) for i in range(20000)})
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    size = np.diff(end, prepend=0)
    h1, h2 = piece_keys(data, end - size, size)
    assert len(set(zip(h1.tolist(), h2.tolist(), strict=True))) == len(words)
    again = piece_keys(np.frombuffer(b"zz" + words[-1] + b"q", np.uint8), np.array([2]), np.array([len(words[-1])]))
    assert (again[0][0], again[1][0]) == (h1[-1], h2[-1])
