"""Toxicity by a convolutional text classifier in numpy.

A word's embedding is the sum of hashed rows for the word and its first letters. Filters one, two
and three words wide slide over the text, each keeps its maximum, and a logistic layer weighs the
maxima. All of it is learned from random beginnings by gradients that flow through the windows that
gave the maxima. Scores are calibrated by language on labelled rows outside the training set: the
language is told from the words themselves, the logit's scale is fitted by logistic regression, and
the threshold with the least weight of errors becomes one half.

Every labelled document that may be learned from takes part, whole. A sample gives the network that all begin
from; then each cell of documents learns on from it in a task of its own, the cells' networks are averaged, and
words are counted by language. Scales and thresholds come from all labelled documents that are set apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PARTS, UNIT, added_up, drop_shared, fit_text, fresh, giving_back, in_parts, release_memory, save_shared, text_slices
from .words import Words, split

#: Labelled documents of each class that the network begins with, at most, and the share of all that calibrates.
SAMPLE_PER_CLASS, HELD = 2500, 0.2
#: Bytes of the documents that one cell holds, about.
CELL_BYTES = 32 << 20
#: Parts of one that logits are told apart by in calibration.
FINE = 1024
BITS, DIM, FILTERS, WIDTHS = 15, 8, 8, (1, 2, 3)
PREFIXES = (4, 5)
EPOCHS, BATCH, RATE, SPREAD = 8, 64, 0.05, 0.03
#: Weight of a toxic document in training where they are rare, at most.
MOST_WEIGHT = 10.0
#: Held-out rows of each class from which a language has a scale and place of its own, if it has one in so many
#: of all held-out rows.
OWN, ONE_IN = 20, 100
#: Word rows that one step of the convolution holds.
ROWS = 1 << 18


@dataclass
class Model:
    embedding: np.ndarray  # (2 ** BITS, DIM)
    kernels: list[np.ndarray]  # for each width (width, DIM, FILTERS)
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray  # one number
    languages: np.ndarray  # (2 ** BITS, languages with a place of their own and all others) log probabilities
    shifts: np.ndarray  # for each of those the logit that becomes one half
    scales: np.ndarray


def buckets(w: Words) -> np.ndarray:
    """(different words, features): hashed rows of each word and of its first letters."""
    out = np.empty((len(w.begin), 1 + len(PREFIXES)), np.int32)
    for some, x in w.blocks():
        h = x.hasher()
        out[some, 0] = h(x.begin, x.end, 1, BITS)
        for k, n in enumerate(PREFIXES, 1):
            out[some, k] = h(x.begin, np.minimum(x.end, x.begin + n), 1 + n, BITS)
    return out


def conv_max(model: Model, rows: np.ndarray, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, filters) maxima. ``rows``: the embeddings of the different words."""
    out = []
    n = np.diff(at)
    for kernel in model.kernels:
        parts = [rows @ k for k in kernel]
        best = np.zeros((len(n), FILTERS), np.float32)
        for i in _runs(at):
            a, b = at[i[0]], at[i[-1] + 1]
            x = parts[0][codes[a:b]]
            for j in range(1, len(parts)):
                if b - a > j:
                    x[:-j] += parts[j][codes[a + j : b]]
                # a window that leaves its text counts the words inside it only
                over = np.concatenate([np.arange(max(at[t], at[t + 1] - j), at[t + 1]) for t in i]) if j else []
                over = np.array(over, np.int64)
                inside = over[over + j < b]
                if len(inside):
                    x[inside - a] -= parts[j][codes[inside + j]]
            best[i] = np.maximum.reduceat(x, at[i] - a, axis=0)
        out.append(best)
    return np.concatenate(out, axis=1)


def _runs(at: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of texts of some ROWS words; a longer text is a run of its own."""
    start = 0
    for i in range(1, len(at)):
        if i == len(at) - 1 or at[i + 1] - at[start] > ROWS:
            yield np.arange(start, i)
            start = i


def logits(model: Model, w: Words) -> np.ndarray:
    rows = np.zeros((len(w.begin), DIM), np.float32)
    for feature in buckets(w).T:
        rows += model.embedding[feature]
    pooled = np.maximum(0, conv_max(model, rows, w.codes, w.at) + model.bias)
    return pooled @ model.weights + model.offset[0]


def language_of(model: Model, w: Words) -> np.ndarray:
    per_word = model.languages[buckets(w)[:, 0]] * w.letters[:, None]
    out = np.empty(len(w.at) - 1, np.int64)
    for i in _runs(w.at):
        a, b = w.at[i[0]], w.at[i[-1] + 1]
        out[i] = np.add.reduceat(per_word[w.codes[a:b]], w.at[i] - a, axis=0).argmax(1)
    return out


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    """0 to 1 for each text; from 0.5 on it counts as toxic."""
    w = split(texts)
    lang = language_of(model, w)
    z = (logits(model, w) - model.shifts[lang]) * model.scales[lang]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _held(col: str = "doc_id") -> Column:
    """Whether a labelled row calibrates, by a hash of its id."""
    return F.pmod(F.xxhash64(F.lit("held"), F.col(col).cast("string")), F.lit(round(1 / HELD))) == 0


def _sample(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """At most SAMPLE_PER_CLASS labelled documents of each class, the first by a hash of the id; of rows with
    one id the first by text, and of long texts a window. Training begins with them."""
    # two bounded top-n lists, so broadcasting them is safe at any size
    ids = _labels(labels).where(~_held())
    some = [ids.where(f"toxic = {c}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_PER_CLASS) for c in (0, 1)]
    some = some[0].unionByName(some[1]).withColumnsRenamed({"doc_id": "__id"})
    rows = documents.select("doc_id", fit_text("text").alias("text")).join(F.broadcast(some), F.col("doc_id") == F.col("__id"))
    return rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


_LEARNABLE = "doc_id is not null and crc32(encode(cast(doc_id as string), 'UTF-8')) % 5 != 0"


def _labels(labels: DataFrame) -> DataFrame:
    """doc_id and toxic (the larger of several) of the rows that may be learned from."""
    return labels.where(f"toxic is not null and {_LEARNABLE}").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """A model from all labelled rows whose crc32(doc_id) mod 5 is not 0, and their whole texts. Repeated rows
    are learned from once, rows of one id with different texts all."""
    got = _sample(documents, labels).toPandas().sort_values("doc_id", ignore_index=True)
    model = begin(np.random.default_rng(7))
    if not len(got):
        return model
    rng = np.random.default_rng(8)
    square = [np.full_like(p, 1e-3) for p in _params(model)]
    toxic = got["toxic"].to_numpy(int)
    w = split(pa.array(got.pop("text").tolist(), pa.large_string()))
    every = np.arange(len(toxic))
    train(model, square, w, buckets(w), toxic, every, rare(toxic, every), EPOCHS, rng)
    del w
    marked = _labels(labels)
    count = {(r.toxic, r.held): r["count"] for r in marked.groupBy("toxic", _held().alias("held")).count().collect()}  # four rows
    docs = documents.where(_LEARNABLE).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"))
    langs = docs.join(marked.where(_held()), "doc_id").groupBy("lang").agg(F.sum("toxic").alias("n1"), F.count(F.lit(1)).alias("n"))
    few = max(OWN, sum(n for (_, held), n in count.items() if held) / ONE_IN)
    own = sorted(r.lang for r in langs.where(f"n >= {few} and n1 >= {OWN} and n - n1 >= {OWN}").collect())  # some ONE_IN rows at most
    bulk = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cell = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(bulk // CELL_BYTES + 1)).alias("cell")
    tasks = 4 * (bulk // CELL_BYTES + 1)
    docs = docs.select(F.col("doc_id").cast("string").alias("id"), "text", "lang", cell).repartition(tasks, "cell")
    marked = marked.select(F.col("doc_id").cast("string").alias("id"), F.col("toxic").cast("int").alias("toxic"), _held().alias("held"), cell).repartition(tasks, "cell")
    # at a rare class's weight of the whole table, not of the sample
    learn = _learner(documents, model, square, own, min(max(1, count.get((0, False), 0)) / max(1, count.get((1, False), 0)), MOST_WEIGHT))
    parts = save_shared(docs.groupBy("cell").cogroup(marked.groupBy("cell")).applyInArrow(learn, f"{PARTS}, text string, toxic int"), "toxic-cells")
    _average(model, added_up(parts.where("slot is not null")), len(own))
    told = _told(parts.where("slot is null"), model).groupBy("k", "bin", "toxic").count().toPandas().sort_values(["k", "bin", "toxic"])
    place(model, told["k"].to_numpy(int), (told["bin"].to_numpy(float) + 0.5) / FINE, told["toxic"].to_numpy(int), told["count"].to_numpy(int))
    drop_shared(parts)
    release_memory()
    return model


def _learner(documents: DataFrame, model: Model, square: list[np.ndarray], own: list[str], dear: float):
    """What a cell makes of its documents and labels: its network and its counts as one vector of whole
    numbers, and the rows that are held out."""
    shared = documents.sparkSession.sparkContext.broadcast((model, square))

    def learn(docs: pa.Table, labels: pa.Table) -> pa.Table:
        rows = docs.filter(pc.is_in(docs["id"], value_set=labels["id"].combine_chunks())).select(["id", "text", "lang"]).to_pandas()
        rows = rows.merge(labels.select(["id", "toxic", "held"]).to_pandas(), on="id").sort_values(["id", "text", "lang"]).drop_duplicates(["id", "text"])
        held, rows = rows[rows["held"]], rows[~rows["held"]]
        out = [pa.table({"slot": pa.nulls(len(held), pa.int32()), "part": pa.nulls(len(held), pa.binary()), "text": pa.array(held["text"].tolist(), pa.string()), "toxic": pa.array(held["toxic"].tolist(), pa.int32())})]
        if n := len(rows):
            local, state = deepcopy(shared.value)
            toxic = rows["toxic"].to_numpy(int)
            w = split(pa.array(rows["text"].tolist(), pa.large_string()))
            feats = buckets(w)
            train(local, state, w, feats, toxic, np.arange(n), np.where(toxic == 1, dear, 1.0), 1, np.random.default_rng(n))
            # a row of the embedding is averaged over the cells that have its words
            seen = np.zeros(1 << BITS, np.int64)
            seen[np.unique(feats)] = n
            column = [own.index(x) if x in own else len(own) for x in rows["lang"]]
            whole = lambda p: np.rint(p.astype(float) * UNIT).astype(np.int64)
            numbers = [seen[:, None] * whole(local.embedding), seen, *[n * whole(p) for p in _params(local)[1:]], np.array([n]), count_words(w, feats, np.arange(n), column, len(own) + 1)]
            part = in_parts(np.concatenate([x.ravel() for x in numbers]))
            out.append(pa.Table.from_batches([part]).append_column("text", pa.nulls(part.num_rows, pa.string())).append_column("toxic", pa.nulls(part.num_rows, pa.int32())))
        release_memory()
        return pa.concat_tables(out)

    return learn


def _average(model: Model, numbers: np.ndarray, own: int) -> None:
    """The mean of the cells' networks, each weighed by its documents, and the words of languages."""
    if not len(numbers):
        return
    sizes = [model.embedding.size, 1 << BITS, *[p.size for p in _params(model)[1:]], 1, (1 << BITS) * (own + 1)]
    total, seen, *others, n, words = np.split(numbers, np.cumsum(sizes)[:-1])
    some = seen > 0
    model.embedding[some] = (total.reshape(model.embedding.shape)[some] / seen[some, None] / UNIT).astype(np.float32)
    for p, x in zip(_params(model)[1:], others, strict=True):
        p[...] = (x.reshape(p.shape) / n[0] / UNIT).astype(np.float32)
    know_languages(model, words.reshape(1 << BITS, own + 1))


def _told(rows: DataFrame, model: Model) -> DataFrame:
    """k (the language that the words tell), bin (of the logit) and toxic of each row."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            w = split(batch.column("text"))
            bins = np.floor(logits(shared.value, w).astype(float) * FINE).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(language_of(shared.value, w)), pa.array(bins), batch.column("toxic")], ["k", "bin", "toxic"])

    return rows.select("text", "toxic").mapInArrow(giving_back(run), "k long, bin long, toxic int")


def begin(rng: np.random.Generator) -> Model:
    """A model that knows nothing yet."""
    total = FILTERS * len(WIDTHS)
    normal = lambda spread, *shape: rng.normal(0, spread, shape).astype(np.float32)
    kernels = [normal(1 / np.sqrt(k * DIM), k, DIM, FILTERS) for k in WIDTHS]
    none = np.zeros(1, np.float32)
    return Model(normal(SPREAD, 1 << BITS, DIM), kernels, np.zeros(total, np.float32), normal(1 / np.sqrt(total), total), none.copy(), np.zeros((1 << BITS, 1), np.float32), np.zeros(1), np.ones(1))


def fit_texts(texts: list, toxic: np.ndarray, langs: list[str], stands_for: tuple[float, float] | list[float] = (1.0, 1.0)) -> Model:
    """``stands_for``: how many rows a sampled one of class 0 and of class 1 stands for in the calibration."""
    rng = np.random.default_rng(7)
    model = begin(rng)
    if not len(texts):
        return model
    w = split(pa.array(texts, pa.large_string()))
    count = len(texts)
    del texts  # the codes are all that is needed from here on
    feats = buckets(w)
    held = rng.random(count) < HELD
    some = np.flatnonzero(~held) if (~held).any() else np.arange(count)
    square = [np.full_like(p, 1e-3) for p in _params(model)]
    train(model, square, w, feats, toxic, some, rare(toxic, some), EPOCHS, rng)
    _calibrate(model, w, feats, toxic, langs, np.flatnonzero(held), some, np.asarray(stands_for, float))
    return model


def _params(model: Model) -> list[np.ndarray]:
    return [model.embedding, *model.kernels, model.bias, model.weights, model.offset]


def rare(toxic: np.ndarray, some: np.ndarray) -> np.ndarray:
    """The weight of each row, more for toxic ones where they are rare among some."""
    share = max(1, int((toxic[some] == 0).sum())) / max(1, int((toxic[some] == 1).sum()))
    return np.where(toxic == 1, min(share, MOST_WEIGHT), 1.0)


def train(model: Model, square: list[np.ndarray], w: Words, feats: np.ndarray, toxic: np.ndarray, some: np.ndarray, weight: np.ndarray, epochs: int, rng: np.random.Generator) -> None:
    """Learn on from some of the texts, with Adagrad's sums of squares."""
    params = _params(model)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(some), max(1, len(some) // BATCH)):
            rows, grads = gradients(model, w, feats, batch, toxic[batch], weight[batch])[1:]
            for p, s, g, at in zip(params, square, grads, [rows, *[slice(None)] * (len(params) - 1)], strict=True):
                s[at] += g * g
                p[at] -= RATE * g / np.sqrt(s[at])


def gradients(model: Model, w: Words, feats: np.ndarray, batch: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, list[np.ndarray]]:
    """(loss, rows of the embedding that have a gradient, gradients of those rows and of all other
    parameters) of some texts: the weighted mean of the logistic loss."""
    codes = np.concatenate([w.codes[w.at[i] : w.at[i + 1]] for i in batch])
    n = w.at[batch + 1] - w.at[batch]
    at = np.concatenate([[0], np.cumsum(n)])
    of = np.repeat(np.arange(len(batch)), n)
    left = at[1:][of] - np.arange(len(codes))
    words, code = np.unique(codes, return_inverse=True)
    x = model.embedding[feats[words]].sum(1)
    best, place = [], []
    for kernel in model.kernels:
        parts = [x @ k for k in kernel]
        y = parts[0][code]
        for j in range(1, len(kernel)):
            inside = np.flatnonzero(left > j)
            y[inside] += parts[j][code[inside + j]]
        top = np.maximum.reduceat(y, at[:-1], axis=0)
        hit, first = y == top[of], np.empty(top.shape, np.int64)
        for c in range(FILTERS):
            spots = np.flatnonzero(hit[:, c])
            first[:, c] = spots[np.unique(of[spots], return_index=True)[1]]
        best.append(top)
        place.append(first)
    z = np.concatenate(best, axis=1) + model.bias
    act = np.maximum(0, z)
    logit = act @ model.weights + model.offset[0]
    p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    loss = float((weight * (np.logaddexp(0, logit) - toxic * logit)).sum() / len(batch))
    d = (weight * (p - toxic) / len(batch)).astype(model.embedding.dtype)
    back = d[:, None] * model.weights * (z > 0)
    to_words = np.zeros_like(x)
    by_kernel = []
    for k, (kernel, first) in enumerate(zip(model.kernels, place, strict=True)):
        g = back[:, k * FILTERS : (k + 1) * FILTERS]
        grad = np.zeros_like(kernel)
        for j in range(len(kernel)):
            gj = np.where(left[first] > j, g, 0)
            of_word = code[np.minimum(first + j, len(code) - 1)]
            grad[j] = np.einsum("dfe,df->ef", x[of_word], gj)
            np.add.at(to_words, of_word.ravel(), (gj[:, :, None] * kernel[j].T[None]).reshape(-1, DIM))
        by_kernel.append(grad)
    some = np.flatnonzero(to_words.any(1))
    rows, back_to = np.unique(feats[words[some]].ravel(), return_inverse=True)
    to_rows = np.zeros((len(rows), DIM), x.dtype)
    np.add.at(to_rows, back_to, np.repeat(to_words[some], feats.shape[1], axis=0))
    return loss, rows, [to_rows, *by_kernel, back.sum(0), d @ act, np.array([d.sum()], x.dtype)]


def platt(logit: np.ndarray, toxic: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(shift, scale) with which scale * (logit - shift) is the log odds of class 1: logistic regression by
    Newton's method, with targets a little inside 0 and 1 so that parted classes have an answer."""
    n1, n0 = (weight * toxic).sum(), (weight * (1 - toxic)).sum()
    target = np.where(toxic == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    spread = max(float(logit.std()), 1e-6)
    x = np.stack([(logit - logit.mean()) / spread, np.ones(len(logit))], axis=1)
    b = np.array([1.0, np.log((n1 + 1) / (n0 + 1))])

    def loss(b):
        z = x @ b
        return float((weight * (np.logaddexp(0, z) - target * z)).sum() + 1e-3 * b[0] ** 2)

    now = loss(b)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (p - target)) + np.array([2e-3 * b[0], 0])
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([2e-3, 1e-9])
        move, size = np.linalg.solve(hess, grad), 1.0
        while (new := loss(b - size * move)) > now and size > 1e-6:
            size /= 2
        if now - new < 1e-9 * max(1.0, abs(now)):
            break
        b, now = b - size * move, new
    scale = max(b[0], 1e-3) / spread
    return float(logit.mean() - b[1] / scale), float(scale)


def fewest_errors(logit: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the thresholds with the least weight of errors."""
    order = np.argsort(logit, kind="stable")
    z, y, v = logit[order], toxic[order], weight[order]
    missed = np.concatenate([[0], np.cumsum(v * y)])
    false = (v * (1 - y)).sum() - np.concatenate([[0], np.cumsum(v * (1 - y))])
    cuts = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    real = np.concatenate([[True], z[1:] > z[:-1], [True]])  # equal logits fall on one side
    loss = np.where(real, missed + false, np.inf)
    best = np.flatnonzero(loss <= loss.min() + 1e-9)
    return float(cuts[best[len(best) // 2]])


def _calibrate(model: Model, w: Words, feats: np.ndarray, toxic: np.ndarray, langs: list[str], held: np.ndarray, train: np.ndarray, stands_for: np.ndarray) -> None:
    """Scale and place of the logits, from held-out rows only: for each language that has enough of them, and
    for all others together. The language of a row is what its words say."""
    names = np.array(langs, object)
    enough = lambda rows: len(rows) and min(toxic[rows].sum(), (1 - toxic[rows]).sum()) >= OWN
    own = sorted(x for x in set(langs) if enough(held[names[held] == x]))
    column = np.array([own.index(x) if x in own else len(own) for x in langs])
    know_languages(model, count_words(w, feats, train, column, len(own) + 1))
    if len(held):
        place(model, language_of(model, w)[held], logits(model, w)[held], toxic[held], np.ones(len(held), int), stands_for)


def count_words(w: Words, feats: np.ndarray, rows: np.ndarray, column: list[int] | np.ndarray, columns: int) -> np.ndarray:
    """(2 ** BITS, columns) texts that hold a word, by the columns of their languages."""
    words = np.zeros((1 << BITS, columns), np.int64)
    for i in rows:
        np.add.at(words[:, column[i]], feats[np.unique(w.codes[w.at[i] : w.at[i + 1]]), 0], 1)
    return words


def know_languages(model: Model, words: np.ndarray) -> None:
    words = words + 0.1
    model.languages = np.log(words / words.sum(0)).astype(np.float32)
    model.shifts, model.scales = np.zeros(words.shape[1]), np.ones(words.shape[1])


def place(model: Model, told: np.ndarray, z: np.ndarray, toxic: np.ndarray, n: np.ndarray, stands_for: np.ndarray | tuple[float, float] = (1.0, 1.0)) -> None:
    """Scale and place of the logits of each language that has enough rows, and of all others together. ``n``:
    how many held-out rows there are of a language as told, a logit and a class."""
    enough = lambda rows: min((n * toxic)[rows].sum(), (n * (1 - toxic))[rows].sum()) >= OWN
    weight = n * np.asarray(stands_for, float)[toxic]
    total = np.bincount(toxic, weight, minlength=2)
    if not total.all():  # no row, or those of one class
        return
    # an error on the rarer class weighs more, by the root of how much rarer it is
    dear = np.sqrt(total.sum() / total)[toxic]
    last = len(model.shifts) - 1
    for k in range(last + 1):
        rows = np.flatnonzero(told == k)
        rows = rows if k < last and enough(rows) else np.arange(len(told))
        model.shifts[k] = fewest_errors(z[rows], toxic[rows], (weight * dear)[rows])
        model.scales[k] = platt(z[rows], toxic[rows], weight[rows])[1]


def score_documents(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Null and empty texts get the score of a text without words; repeated rows each get theirs; other
    columns are dropped; an empty table has no rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(scores(shared.value, batch.column("text")).astype(float))], ["doc_id", "score"])

    out = rows.mapInArrow(giving_back(run), "doc_id long, score double")
    held = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def with_scores(documents: DataFrame, model: Model, name: str, text_col: str = "text") -> DataFrame:
    """The rows with their score in a further column ``name``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text_col):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores(shared.value, batch.column(text_col)).astype(float))], [*batch.schema.names, name])

    return documents.mapInArrow(giving_back(run), T.StructType([*documents.schema.fields, T.StructField(name, T.DoubleType())]))


def drop_toxic(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose score is below one half, in the columns of the input."""
    score = fresh(documents, "score")[0]
    return with_scores(documents, model, score, text_col).where(F.col(score) < 0.5).drop(score)
