"""Language identification by a linear-chain conditional random field over the words of a text.

A word's features are itself (the lexicon), its first and last letters and its n-grams, all hashed;
their weights and the transitions between languages are learned from word sequences in which
pieces of documents in different languages follow each other. The forward-backward algorithm gives
each word its probabilities; a text's language is the one with the largest share of its words.
Texts are cut into chunks whose transfer matrices are multiplied, so that long and short texts take
the same vectorised steps and the result is exact for whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fit_text, giving_back, release_memory, text_slices
from .words import Words, split

#: Documents of each language that the model is fitted on, about; of all together, about; and of each
#: where languages are very many.
SAMPLE_PER_LANGUAGE, SAMPLE, SAMPLE_LEAST = 300, 20_000, 10
#: Languages up to which their counts are broadcast; a row takes some 50 bytes.
BROADCAST_LANGUAGES = 100_000
BITS, NGRAMS, AFFIXES = 16, (2, 3), (1, 2, 3)
#: Training sequences, their words, and passes over them.
SEQUENCES, LENGTH, EPOCHS, BATCH, RATE, DECAY = 3000, 24, 4, 100, 0.3, 1e-4
CHUNK = 32


@dataclass
class Model:
    names: list[str]
    weights: np.ndarray  # (2 ** BITS, languages)
    transitions: np.ndarray  # (languages, languages), log


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hashed rows, places): word j has the rows ``rows[places[j]:places[j + 1]]``."""
    h, n = w.hasher(), w.end - w.begin
    words = np.arange(len(n))
    owner, rows = [words], [h(w.begin, w.end, 1, BITS)]
    for k in AFFIXES:
        owner += [words, words]
        rows += [h(w.begin, np.minimum(w.end, w.begin + k), 10 + k, BITS), h(np.maximum(w.begin, w.end - k), w.end, 20 + k, BITS)]
    for k in NGRAMS:
        count = np.maximum(0, n - k + 1)
        of = np.repeat(words, count)
        a = np.repeat(w.begin - (np.cumsum(count) - count), count) + np.arange(len(of))
        owner.append(of)
        rows.append(h(a, a + k, 30 + k, BITS))
    owner, rows = np.concatenate(owner), np.concatenate(rows)
    order = np.argsort(owner, kind="stable")
    return rows[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n)))])


def emissions(model_weights: np.ndarray, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Scores of each different word; every word has features, so no span is empty."""
    return np.add.reduceat(model_weights[rows], places[:-1], axis=0) if len(places) > 1 else np.zeros((0, model_weights.shape[1]), np.float32)


def _normal(x: np.ndarray, axes) -> np.ndarray:
    return x / np.maximum(x.max(axes, keepdims=True), 1e-30)


def posteriors(psi: np.ndarray, trans: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Forward-backward for many sequences at once. ``psi``: (positions, K) factors above 0, ``trans``:
    (K, K) factors, ``at``: where sequences begin and end. The probabilities of every position."""
    k, n = psi.shape[1], np.diff(at)
    chunks = -(-n // CHUNK)
    seq = np.repeat(np.arange(len(n)), chunks)
    part = np.arange(len(seq)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    begin = at[:-1][seq] + part * CHUNK
    size = np.minimum(CHUNK, at[1:][seq] - begin)
    order = np.argsort(-size, kind="stable")  # chunks that are still running stand in front
    begin, size = begin[order], size[order]
    live = [int((size > t).sum()) for t in range(CHUNK)]
    m = np.broadcast_to(np.eye(k, dtype=psi.dtype), (len(seq), k, k)).copy()
    for t, a in enumerate(live):
        if a:
            m[:a] = _normal((m[:a].reshape(-1, k) @ trans).reshape(a, k, k) * psi[begin[:a] + t][:, None, :], (1, 2))
    place = np.empty(len(seq), np.int64)
    place[order] = np.arange(len(seq))
    first = np.cumsum(chunks) - chunks
    enter, leave = np.ones((2, len(seq), k), psi.dtype)
    by_size = np.argsort(-chunks, kind="stable")
    counts = chunks[by_size]
    v = np.full((len(n), k), 1 / k, psi.dtype)
    for j in range(int(chunks.max(initial=0))):
        s = by_size[: np.searchsorted(-counts, -j, side="left")]
        c = place[first[s] + j]
        enter[c] = v[s]
        v[s] = _normal(np.einsum("nk,nkl->nl", v[s], m[c]), 1)
    v[:] = 1
    for j in range(int(chunks.max(initial=0)) - 1, -1, -1):
        s = by_size[: np.searchsorted(-counts, -j, side="left")]
        c = place[first[s] + j]
        leave[c] = v[s]
        v[s] = _normal(np.einsum("nkl,nl->nk", m[c], v[s]), 1)
    gamma = np.empty_like(psi)
    for t, a in enumerate(live):
        if a:
            enter[:a] = _normal((enter[:a] @ trans) * psi[begin[:a] + t], 1)
            gamma[begin[:a] + t] = enter[:a]
    for t in range(CHUNK - 1, -1, -1):
        if a := live[t]:
            at_t = begin[:a] + t
            gamma[at_t] *= leave[:a]
            leave[:a] = _normal((psi[at_t] * leave[:a]) @ trans.T, 1)
    return gamma / np.maximum(gamma.sum(1, keepdims=True), 1e-30)


def label_words(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities of all words that hold letters, where each text's words begin and end)."""
    w = split(texts)
    e = emissions(model.weights, *features(w))
    e = np.exp(e - e.max(1, keepdims=True)) + np.float32(1e-6)
    has = w.letters[w.codes]
    count = np.add.reduceat(has.astype(np.int64), w.at[:-1])
    at = np.concatenate([[0], np.cumsum(count)])
    trans = np.exp(model.transitions - model.transitions.max()).astype(np.float32)
    return posteriors(e.astype(np.float32)[w.codes[has]], trans, at), at


def predict(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, number of switches) of each text; ``und`` and 0 without letters."""
    p, at = label_words(model, texts)
    n = np.diff(at)
    total = np.zeros((len(n), len(model.names)))
    some = np.flatnonzero(n)
    total[some] = np.add.reduceat(p, at[some], axis=0) if len(some) else total[some]
    best = total.argmax(1)
    score = np.where(n > 0, total[np.arange(len(n)), best] / np.maximum(n, 1), 0.0)
    label = p.argmax(1)
    change = np.zeros(len(label) + 1, np.int64)
    change[1:-1] = label[1:] != label[:-1]
    change[at[:-1]] = 0
    switches = np.add.reduceat(np.append(change, 0), at[:-1]) * (n > 0)
    return [model.names[b] if k else "und" for b, k in zip(best, n, strict=True)], np.clip(score, 0, 1), switches


def fit_texts(texts: list, langs: list[str]) -> Model:
    """Learn weights and transitions from documents with a language each."""
    rng = np.random.default_rng(11)
    names = sorted(set(langs)) or ["und"]
    k = len(names)
    model = Model(names, np.zeros((1 << BITS, k), np.float32), np.zeros((k, k)))
    w = split(pa.array(texts, pa.large_string()))
    rows, places = features(w)
    pools = [[] for _ in names]
    for i, lang in enumerate(langs):
        codes = w.codes[w.at[i] : w.at[i + 1]]
        if len(codes := codes[w.letters[codes]]):
            pools[names.index(lang)].append(codes)
    usable = [i for i, p in enumerate(pools) if p]
    if not usable:
        return model
    x, y = np.empty((2, SEQUENCES, LENGTH), np.int64)
    for s in range(SEQUENCES):
        cuts = sorted(rng.choice(np.arange(1, LENGTH), rng.integers(0, 3), replace=False)) if len(usable) > 1 else []
        for a, b in zip([0, *cuts], [*cuts, LENGTH], strict=True):
            lang = usable[rng.integers(len(usable))]
            doc = pools[lang][rng.integers(len(pools[lang]))]
            from_ = rng.integers(len(doc))
            x[s, a:b] = np.take(doc, np.arange(from_, from_ + b - a), mode="wrap")
            y[s, a:b] = lang
    square, square_t = np.full_like(model.weights, 1e-2), np.full((k, k), 1e-2)
    at = np.arange(0, BATCH * LENGTH + 1, LENGTH)
    for _ in range(EPOCHS):
        for batch in rng.permutation(SEQUENCES).reshape(-1, BATCH):
            codes, back = np.unique(x[batch].ravel(), return_inverse=True)
            span = places[codes + 1] - places[codes]
            f = rows[np.repeat(places[codes] - (np.cumsum(span) - span), span) + np.arange(span.sum())]
            e = emissions(model.weights, f, np.concatenate([[0], np.cumsum(span)]))[back]
            psi = np.exp(e - e.max(1, keepdims=True)).astype(float) + 1e-9
            trans = np.exp(model.transitions - model.transitions.max())
            truth = np.eye(k)[y[batch].ravel()]
            per_word = np.zeros((len(codes), k))
            np.add.at(per_word, back, posteriors(psi, trans, at) - truth)
            each = np.repeat(per_word, span, axis=0)
            grad = np.stack([np.bincount(f, each[:, j], 1 << BITS) for j in range(k)], axis=1) / BATCH
            grad += DECAY * model.weights
            square += grad * grad
            model.weights -= (RATE * grad / np.sqrt(square)).astype(np.float32)
            grad_t = (_pairs(psi, trans, len(batch)) - np.einsum("sti,stj->ij", *(truth.reshape(len(batch), LENGTH, k)[:, z] for z in (slice(None, -1), slice(1, None))))) / BATCH
            square_t += grad_t * grad_t
            model.transitions -= RATE * grad_t / np.sqrt(square_t)
    return model


def _pairs(psi: np.ndarray, trans: np.ndarray, n: int) -> np.ndarray:
    """Expected transitions, summed over sequences of one length."""
    k = psi.shape[1]
    psi = psi.reshape(n, -1, k)
    steps = psi.shape[1]
    a, b = np.empty_like(psi), np.ones_like(psi)
    v = np.full((n, k), 1 / k)
    for t in range(steps):
        v = a[:, t] = _normal((v @ trans) * psi[:, t], 1)
    for t in range(steps - 2, -1, -1):
        b[:, t] = _normal((psi[:, t + 1] * b[:, t + 1]) @ trans.T, 1)
    joint = np.einsum("sti,ij,stj->stij", a[:, :-1], trans, psi[:, 1:] * b[:, 1:])
    return (joint / joint.sum((2, 3), keepdims=True)).sum((0, 1))


def fit(documents: DataFrame) -> Model:
    """A model of every language that a document whose crc32(doc_id) mod 5 is not 0 has: from the first
    SAMPLE_PER_LANGUAGE documents of each by a hash of the id, about; where languages are many, from fewer
    of each. Of texts of over FIT_CHARS characters a window of as many is learned from, which a hash of the
    text places; of rows with one id the first by text."""
    usable = documents.select("doc_id", "text", "lang").where("doc_id is not null and text is not null and lang is not null and crc32(encode(cast(doc_id as string), 'UTF-8')) % 5 != 0")
    counts = usable.groupBy(F.col("lang").alias("__lang")).agg(F.count(F.lit(1)).alias("__n"))
    n = counts.count()
    if not n:
        return fit_texts([], [])
    each = min(SAMPLE_PER_LANGUAGE, max(SAMPLE_LEAST, SAMPLE // n))
    counts = F.broadcast(counts) if n <= BROADCAST_LANGUAGES else counts
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    some = usable.join(counts, F.col("lang") == F.col("__lang")).where(share < each / F.col("__n"))
    some = some.groupBy("doc_id").agg(F.min(F.struct(fit_text("text").alias("text"), "lang")).alias("t")).select("doc_id", "t.*")
    got = some.toPandas().sort_values("doc_id", ignore_index=True)
    langs = got["lang"].tolist()
    model = fit_texts(got.pop("text").tolist(), langs)
    release_memory()
    return model


def identify(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score and n_switches (changes of language inside the text).

    Null, empty and letterless texts are ``und`` with score 0; repeated rows each get theirs.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            lang, score, switches = predict(shared.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(lang), pa.array(score), pa.array(switches)], ["doc_id", "lang_pred", "score", "n_switches"])

    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(giving_back(run), "doc_id long, lang_pred string, score double, n_switches long")
    held = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "n_switches")
