"""Secrets: patterns, and a character-level convolutional network over every candidate.

A candidate is any run of key characters that holds a letter, with digits or without. The network
reads it with what stands around it: characters are embedded, filters of two widths slide over them, the
maxima go through a logistic layer; of a long candidate all overlapping windows are read, in training
as in scoring, and the largest logit counts. It is trained on labelled findings: what the patterns find
in the corpus, invented keys of known shapes, and candidates that are neither. Its threshold is the
highest that still finds the wanted share of labelled secrets outside the training set, of those of the
corpus and of the invented ones alike, whatever the sign of its logit.

All candidates of all whole texts take part. A sample gives the network that all begin from; then each cell of
candidates learns on from it, beside the invented ones, in a task of its own, and the cells' networks are averaged.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PARTS, UNIT, added_up, drop_shared, fit_text, giving_back, in_parts, release_memory, save_shared, text_slices

KINDS = ("assign", "access", "hex")
#: The kind of what only the network finds.
LEARNED = "learned"
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A shorter run can't hold a longer match, so the length may stand in the pattern.
_HEX = re.compile(r"[0-9a-f]{16,}")
_DIGIT = re.compile(r"[0-9]")

#: Characters that the network tells apart; all others are one.
ALPHABET = string.ascii_letters + string.digits + " +/_=-.:\"'@#%$&*(),\n"
WINDOW, BEFORE, STRIDE = 56, 16, 28
EMBED, FILTERS, WIDTHS = 8, 12, (3, 5)
LEAST, SAMPLE_DOCUMENTS = 12, 4000
_KEY_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
_LETTER = re.compile(r"[A-Za-z]")
#: Candidates without a digit that the network begins with, at most; it learns on from all of them.
WORDS = 10_000
#: Windows of the candidates that one cell holds, about, and parts of one that logits are told apart by.
CELL_WINDOWS, FINE = 1 << 14, 1024
INVENTED, EPOCHS, BATCH, RATE = 1200, 6, 64, 0.05
#: The share of candidates that the threshold is taken from, and of their secrets that it keeps.
HELD, RECALL = 0.25, 0.95

Span = tuple[int, int]
_CODE = np.zeros(128, np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(1, len(ALPHABET) + 1)


def find_base(text: str) -> dict[str, list[Span]]:
    """Spans of the three kinds, from left to right."""
    found = {k: [] for k in KINDS}
    if ":" in text or "=" in text:
        found["assign"] = [m.span() for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found["access"] = [m.span() for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if _DIGIT.search(text) or len(text) >= 16:
        found["hex"] = [m.span() for m in _HEX.finditer(text)]
    return found


def candidates(text: str) -> list[Span]:
    """Runs of at least LEAST key characters with a letter."""
    return [m.span() for m in _KEY_RUN.finditer(text) if _LETTER.search(m[0])]


def windows(text: str, a: int, b: int) -> list[str]:
    """What the network reads of a candidate: all of it, a long one in overlapping windows."""
    starts = range(a - BEFORE, max(a - BEFORE + 1, b - WINDOW + BEFORE + STRIDE), STRIDE)
    out = []
    for s in starts:
        piece = text[max(0, s) : s + WINDOW]
        out.append((" " * max(0, -s) + piece).ljust(WINDOW))
    return out


@dataclass
class Model:
    embedding: np.ndarray
    kernels: list[np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray  # one number
    threshold: float
    #: The share of labelled secrets outside the training set that the threshold finds.
    recall: float = 1.0


def _codes(pieces: list[str]) -> np.ndarray:
    raw = np.frombuffer("".join(pieces).encode("utf-32-le"), "<u4").reshape(len(pieces), WINDOW)
    return np.where(raw < 128, _CODE[np.minimum(raw, 127)], 0)


def _forward(model: Model, codes: np.ndarray):
    x = model.embedding[codes]
    pooled, top = [], []
    for kernel in model.kernels:
        steps = WINDOW - len(kernel) + 1
        y = sum(x[:, j : j + steps] @ kernel[j] for j in range(len(kernel)))
        top.append(y.argmax(1))
        pooled.append(y.max(1))
    z = np.concatenate(pooled, axis=1) + model.bias
    return x, top, z, np.maximum(0, z) @ model.weights + model.offset[0]


def scores(model: Model, pieces: list[str]) -> np.ndarray:
    """The network's logits, a few thousand windows at a time."""
    out = [_forward(model, _codes(pieces[a : a + 2048]))[3] for a in range(0, len(pieces), 2048)]
    return np.concatenate(out) if out else np.empty(0)


def invent(rng: np.random.Generator) -> tuple[str, int, int, int]:
    """(text, begin, end, 1 for a secret) of known shapes, and of what looks a little like one."""
    pick = lambda chars, n: "".join(rng.choice(list(chars), n))
    word = lambda: pick(string.ascii_lowercase, int(rng.integers(3, 9)))
    alnum = string.ascii_letters + string.digits
    good = rng.random() < 0.5
    if good:
        shapes = ("gh" + pick("pousr", 1) + "_" + pick(alnum, 36), "sk_live_" + pick(alnum, 24), "eyJ" + pick(alnum + "_-", int(rng.integers(30, 90))), pick(alnum + "+/", int(rng.integers(24, 48))) + "==", "AKIA" + pick(string.ascii_uppercase + string.digits, 16), pick("0123456789abcdef", int(rng.choice([16, 32, 40, 64]))), pick(alnum, int(rng.integers(20, 44))), pick(string.ascii_letters, int(rng.integers(20, 44))), "xoxb-" + pick(string.digits, 11) + "-" + pick(alnum, 24))
    else:
        shapes = (word() + "-" + word() + "-" + str(rng.integers(1, 9999)), word() + word() + word() + str(rng.integers(1, 99)), "-".join(pick(string.digits, 4) for _ in range(4)) + word(), word().upper() + "-" + str(rng.integers(1900, 2100)) + "-" + pick(string.digits, 4), "/".join(word() for _ in range(3)) + "/" + str(rng.integers(1, 999)), "_".join((word(), word(), "v" + str(rng.integers(1, 20)))), pick(string.digits, 12) + "abcdef"[rng.integers(6)], word() + word() + word(), "-".join(word().capitalize() for _ in range(3)))
    value = shapes[rng.integers(len(shapes))]
    if not good and len(value) < LEAST:
        value = value + "-" + word() + word()
    before = " ".join(word() for _ in range(rng.integers(0, 4))) + (" " if rng.random() < 0.7 else str(rng.choice(list(":='\"(,"))))
    return f"{before}{value} {word()} {word()}", len(before), len(before) + len(value), int(good)


def gradients(model: Model, codes: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """(loss, gradients of the embedding, the kernels, the bias, the weights and the offset) of some
    windows: the weighted mean of the logistic loss."""
    x, top, z, logit = _forward(model, codes)
    loss = float((weight * (np.logaddexp(0, logit) - labels * logit)).sum() / len(codes))
    d = weight * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels) / len(codes)
    back = d[:, None] * model.weights * (z > 0)
    to_rows, by_kernel = np.zeros_like(model.embedding), []
    rows = np.arange(len(codes))[:, None]
    for k, (kernel, t) in enumerate(zip(model.kernels, top, strict=True)):
        g, grad = back[:, k * FILTERS : (k + 1) * FILTERS], np.zeros_like(kernel)
        for j in range(len(kernel)):
            grad[j] = np.einsum("nfe,nf->ef", x[rows, t + j], g)
            np.add.at(to_rows, codes[rows, t + j], g[:, :, None] * kernel[j].T[None])
        by_kernel.append(grad)
    return loss, [to_rows, *by_kernel, back.sum(0), d @ np.maximum(0, z), np.array([d.sum()])]


def begin(rng: np.random.Generator) -> Model:
    """A network that knows nothing yet."""
    total = FILTERS * len(WIDTHS)
    return Model(rng.normal(0, 0.3, (len(ALPHABET) + 1, EMBED)), [rng.normal(0, 0.2, (k, EMBED, FILTERS)) for k in WIDTHS], np.zeros(total), rng.normal(0, 0.2, total), np.zeros(1), 0.0)


def fit_texts(texts: list[str]) -> Model:
    return _begun(texts)[0]


def _begun(texts: list[str]) -> tuple[Model, list[np.ndarray]]:
    """A network from a few texts, and Adagrad's sums of squares."""
    rng = np.random.default_rng(5)
    found, plain = [], []  # (windows, label) of each candidate; those without a digit that no pattern touches
    for text in texts:
        for a, b, good in labelled(text or ""):
            if not good and not _DIGIT.search(text, a, b):
                plain.append((text, a, b))
            else:
                found.append((windows(text, a, b), good))
    found += [(windows(*plain[i]), 0) for i in np.sort(rng.permutation(len(plain))[:WORDS])]
    found += invented(rng)
    owner, codes, y = coded(found)
    held = rng.random(len(found)) < HELD
    model = begin(rng)
    square = [np.full_like(p, 1e-2) for p in _params(model)[:-1]]
    train(model, square, codes, y[owner], np.flatnonzero(~held[owner]), EPOCHS, rng)
    some = np.flatnonzero(held & (y == 1))
    if len(some):
        best = highest(model, codes, owner, len(found))
        model.threshold = keeping(best[some], RECALL)
        model.recall = float((best[some] >= model.threshold).mean())
    return model, square


def labelled(text: str) -> list[tuple[int, int, int]]:
    """(begin, end, 1 where a pattern touches it) of each candidate."""
    base = sorted(s for spans in find_base(text).values() for s in spans)
    return [(a, b, int(any(x < b and a < y for x, y in base))) for a, b in candidates(text)]


def invented(rng: np.random.Generator) -> list[tuple[list[str], int]]:
    made = [invent(rng) for _ in range(INVENTED)]
    return [(windows(text, a, b), y) for text, a, b, y in made]


def coded(found: list[tuple[list[str], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The candidate of each window, the windows' codes, and the candidates' labels."""
    return np.repeat(np.arange(len(found)), [len(w) for w, _ in found]), _codes([p for w, _ in found for p in w]), np.array([y for _, y in found])


def _params(model: Model) -> list[np.ndarray]:
    return [model.embedding, *model.kernels, model.bias, model.weights, model.offset]


def train(model: Model, square: list[np.ndarray], codes: np.ndarray, y: np.ndarray, some: np.ndarray, epochs: int, rng: np.random.Generator) -> None:
    """Learn on from some of the windows; the classes weigh the same."""
    params, mean = _params(model), y[some].mean()
    weight = np.where(y == 1, 0.5 / max(1e-9, mean), 0.5 / max(1e-9, 1 - mean))
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(some), max(1, len(some) // BATCH)):
            grads = gradients(model, codes[batch], y[batch], weight[batch])[1]
            for p, g, s in zip(params, grads, square, strict=False):
                s += g * g
                p -= RATE * g / np.sqrt(s)
            model.offset -= RATE * grads[-1]


def highest(model: Model, codes: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """The largest logit among the windows of each candidate."""
    best = np.full(count, -np.inf)
    for a in range(0, len(codes), 2048):
        np.maximum.at(best, owner[a : a + 2048], _forward(model, codes[a : a + 2048])[3])
    return best


def keeping(logit: np.ndarray, share: float) -> float:
    """The highest threshold that at least this share of the logits reaches."""
    return float(np.sort(logit)[int((1 - share) * len(logit))])


def fit(documents: DataFrame) -> Model:
    """A model from all candidates of all whole texts; rows of one id and text are learned from once. It begins
    with about SAMPLE_DOCUMENTS documents, the first by a hash of the id, and windows of long texts."""
    n = max(1, documents.select("doc_id").count())
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rows = documents.where(F.col("text").isNotNull() & (share < SAMPLE_DOCUMENTS / n)).groupBy("doc_id").agg(F.min(fit_text("text")).alias("text"))
    model, square = _begun(rows.toPandas().sort_values("doc_id")["text"].tolist())
    found = save_shared(_all_candidates(documents).dropDuplicates(["key", "at"]), "key-candidates")
    cells = (found.agg(F.sum("n")).first()[0] or 0) // CELL_WINDOWS + 1
    cell = F.pmod(F.xxhash64("key", "at"), F.lit(cells)).alias("cell")
    held = (F.pmod(F.xxhash64(F.lit("held"), "key", "at"), F.lit(round(1 / HELD))) == 0).alias("held")
    mine = found.where(~held).select("key", "at", "good", "pieces", cell).repartition(int(4 * cells), "cell")
    parts = mine.groupBy("cell").applyInArrow(_learner(documents, model, square), PARTS)
    _average(model, added_up(parts))
    _keep_share(model, _logits(found.where(held & (F.col("good") == 1)), model))
    drop_shared(found)
    release_memory()
    return model


def _all_candidates(documents: DataFrame) -> DataFrame:
    """key (a hash of the row's id and text), at, good, n (windows) and pieces (the windows, one after the other)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            rows = []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for a, b, good in labelled(text):
                    w = windows(text, a, b)
                    rows.append((key, a, good, len(w), "".join(w)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["key", "at", "good", "n", "pieces"])

    rows = documents.where("text is not null").select(F.xxhash64(F.col("doc_id").cast("string"), "text").alias("key"), "text")
    return rows.mapInArrow(giving_back(run), "key long, at long, good int, n long, pieces string")


def _cut(pieces: str) -> list[str]:
    return [pieces[i : i + WINDOW] for i in range(0, len(pieces), WINDOW)]


def _learner(documents: DataFrame, model: Model, square: list[np.ndarray]):
    """What a cell makes of its candidates: its network as whole numbers, and how many windows it saw."""
    shared = documents.sparkSession.sparkContext.broadcast((model, square))

    def learn(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("key", "ascending"), ("at", "ascending")])
        rng = np.random.default_rng(rows.num_rows)
        found = [(_cut(p), y) for p, y in zip(rows["pieces"].to_pylist(), rows["good"].to_pylist(), strict=True)]
        n = sum(len(w) for w, _ in found)
        owner, codes, y = coded(found + [x for x in invented(rng)])
        local, state = deepcopy(shared.value)
        train(local, state, codes, y[owner], np.arange(len(codes)), 1, rng)
        numbers = [*[n * np.rint(p * UNIT).astype(np.int64).ravel() for p in _params(local)], np.array([n])]
        release_memory()
        return pa.Table.from_batches([in_parts(np.concatenate(numbers))])

    return learn


def _average(model: Model, numbers: np.ndarray) -> None:
    """The mean of the cells' networks, each weighed by its windows."""
    if len(numbers):
        params = _params(model)
        for p, x in zip(params, np.split(numbers[:-1], np.cumsum([p.size for p in params])[:-1]), strict=True):
            p[...] = x.reshape(p.shape) / numbers[-1] / UNIT


def _logits(rows: DataFrame, model: Model) -> list[tuple[int, int]]:
    """(logit in parts of 1 / FINE, candidates) from the least on."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "pieces"):
            found = [(_cut(p), 1) for p in batch.column("pieces").to_pylist()]
            owner, codes, _ = coded(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.floor(highest(shared.value, codes, owner, len(found)) * FINE).astype(np.int64))], ["bin"])

    return sorted((r.bin, r["count"]) for r in rows.select("pieces").mapInArrow(giving_back(run), "bin long").groupBy("bin").count().collect())


def _keep_share(model: Model, bins: list[tuple[int, int]]) -> None:
    """The highest threshold that finds the wanted share of the secrets set apart, of those of the corpus and of
    invented ones that no cell saw."""
    owner, codes, y = coded(invented(np.random.default_rng(6)))
    made = highest(model, codes, owner, len(y))[y == 1]
    model.threshold = keeping(made, RECALL)
    real, below = sum(n for _, n in bins), 0
    for at, n in bins:
        below += n
        if below > int((1 - RECALL) * real):
            model.threshold = min(model.threshold, at / FINE)
            break
    hits = sum(n for at, n in bins if at / FINE >= model.threshold) + (made >= model.threshold).sum()
    model.recall = float(hits / (real + len(made)))


def find_learned(model: Model, texts: list[str], base: list[dict[str, list[Span]]]) -> list[list[Span]]:
    """For each text the candidates that the network takes for secrets and no pattern touches."""
    pieces, owner, spans = [], [], []
    for i, text in enumerate(texts):
        taken = [s for x in base[i].values() for s in x]
        for a, b in candidates(text):
            if not any(x < b and a < y for x, y in taken):
                w = windows(text, a, b)
                pieces += w
                owner += [len(spans)] * len(w)
                spans.append((i, a, b))
    out = [[] for _ in texts]
    if spans:
        best = np.full(len(spans), -np.inf)
        np.maximum.at(best, np.array(owner), scores(model, pieces))
        for j in np.flatnonzero(best >= model.threshold):
            i, a, b = spans[j]
            out[i].append((a, b))
    return out


def joined(spans: dict[str, list[Span]]) -> str:
    rank = {k: i for i, k in enumerate((*KINDS, LEARNED))}
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted((a, rank[k], b, k) for k, x in spans.items() for a, b in x))


RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_learned long, n_spans long"


def scan_documents(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the patterns' spans by kind, their digest, all spans as text, and counts of learned and of
    all spans, for every row.

    Offsets are code points, ends exclusive. Null and empty texts hold none; repeated rows each
    get theirs; other columns are dropped.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base = [find_base(t) for t in texts]
            rows = []
            for doc, found, more in zip(batch.column("doc_id").to_pylist(), base, find_learned(shared.value, texts, base), strict=True):
                rows.append((doc, *(len(found[k]) for k in KINDS), hashlib.sha256(joined(found).encode()).hexdigest(), joined(found | {LEARNED: more}), len(more), sum(map(len, found.values())) + len(more)))
            names = [c.split()[0] for c in RESULT.split(", ")]
            kinds = [pa.string() if c.endswith("string") else pa.int64() for c in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(giving_back(run), RESULT)
