import zlib

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import language_id, secrets, toxicity


def documents(sf_dir):
    import duckdb

    at = sf_dir.replace("0.001", "0.01")
    return duckdb.connect().sql(f"select d.doc_id, text, lang, toxic from read_parquet('{at}/documents.parquet') d left join read_parquet('{at}/labels.parquet') l on d.doc_id = l.doc_id order by 1").fetchall()


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_forward_backward_equals_loop():
    rng = np.random.default_rng(0)
    lengths = [1, 5, 70, 33, 200, 32, 0, 64]
    at = np.concatenate([[0], np.cumsum(lengths)])
    psi, trans = rng.random((at[-1], 3)) + 0.01, rng.random((3, 3)) + 0.1
    got = language_id.posteriors(psi, trans, at)
    for i, n in enumerate(lengths):
        p, v = psi[at[i] : at[i + 1]], np.full(3, 1 / 3)
        a, b = np.empty((n, 3)), np.ones((n, 3))
        for t in range(n):
            v = a[t] = (v @ trans) * p[t] / ((v @ trans) * p[t]).sum()
        for t in range(n - 2, -1, -1):
            b[t] = trans @ (p[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        want = a * b / (a * b).sum(1, keepdims=True) if n else a
        assert np.allclose(got[at[i] : at[i + 1]], want, atol=1e-8)


def test_languages_are_told_apart(sf_dir):
    rows = documents(sf_dir)
    train = [r for r in rows if not held(r[0])]
    model = language_id.fit_texts([r[1] for r in train], [r[2] for r in train])
    test = [r for r in rows if held(r[0])]
    lang, score, _ = language_id.predict(model, pa.array([r[1] for r in test]))
    assert np.mean([a == r[2] for a, r in zip(lang, test, strict=True)]) > 0.97 and score.min() >= 0 and score.max() <= 1
    lang, score, _ = language_id.predict(model, pa.array([None, "", "12 !!", "the"]))
    assert lang[:3] == ["und"] * 3 and score[:3].tolist() == [0, 0, 0] and lang[3] == "en"


def test_switches_are_seen(sf_dir):
    train = [r for r in documents(sf_dir) if not held(r[0])]
    model = language_id.fit_texts([r[1] for r in train], [r[2] for r in train])
    de, en = (next(r[1] for r in train if r[2] == x and len(r[1]) > 300) for x in ("de", "en"))
    p, _ = language_id.label_words(model, pa.array([f"{' '.join(de.split()[:40])} {' '.join(en.split()[:40])}"]))
    names = [model.names[i] for i in p.argmax(1)]
    assert names[:30].count("de") > 25 and names[-30:].count("en") > 25


def test_toxic_texts_are_found(sf_dir):
    rows = [r for r in documents(sf_dir) if r[3] is not None]
    train, test = [r for r in rows if not held(r[0])], [r for r in rows if held(r[0])]
    model = toxicity.fit_texts([r[1] for r in train], np.array([r[3] for r in train]), [r[2] for r in train])
    s, y = toxicity.scores(model, pa.array([r[1] for r in test])), np.array([r[3] for r in test])
    assert ((s >= 0.5) == y).mean() > 0.8 and s[y == 1].mean() > s[y == 0].mean() + 0.3
    assert len(toxicity.scores(model, pa.array([None, "", " "]))) == 3


def auc(score, y):
    return np.mean([(a > b) + 0.5 * (a == b) for a in score[y == 1] for b in score[y == 0]])


def test_training_teaches_the_network(sf_dir, monkeypatch):
    """From random embeddings: without training it knows nothing, with it most toxic texts."""
    rows = [r for r in documents(sf_dir.replace("0.001", "0.1")) if r[3] is not None and r[1]]
    train, test = [r for r in rows if not held(r[0])], [r for r in rows if held(r[0])]
    fitted = {}
    for epochs in (0, toxicity.EPOCHS):
        monkeypatch.setattr(toxicity, "EPOCHS", epochs)
        model = toxicity.fit_texts([r[1] for r in train], np.array([r[3] for r in train]), [r[2] for r in train])
        fitted[epochs] = toxicity.scores(model, pa.array([r[1] for r in test]))
    y = np.array([r[3] for r in test])
    before, after = fitted.values()
    assert auc(before, y) < 0.65 and auc(after, y) > 0.95
    assert ((after >= 0.5) == y).mean() > 0.97 and (after[y == 1] >= 0.5).mean() > 0.8


def test_gradients_equal_differences():
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abcdefgh"), rng.integers(0, 9))) for _ in range(12)]
    model = toxicity.begin(rng)
    model.embedding = rng.normal(0, 0.5, model.embedding.shape)
    model.kernels, model.bias, model.weights, model.offset = [k.astype(float) for k in model.kernels], rng.normal(0, 0.3, len(model.bias)), model.weights.astype(float), np.array([0.2])
    w = toxicity.split(pa.array(texts))
    feats, batch, y, weight = toxicity.buckets(w), np.arange(12), np.arange(12) % 2, rng.random(12) + 0.5
    loss, rows, grads = toxicity.gradients(model, w, feats, batch, y, weight)
    step = 1e-6
    for param, grad, index in ((model.embedding, grads[0], rows), *((k, g, None) for k, g in zip(model.kernels, grads[1:4], strict=True)), (model.bias, grads[4], None), (model.weights, grads[5], None), (model.offset, grads[6], None)):
        for _ in range(12):
            at = tuple(rng.integers(n) for n in grad.shape)
            where = at if index is None else (index[at[0]], at[1])
            was = param[where]
            param[where] = was + step
            more = toxicity.gradients(model, w, feats, batch, y, weight)[0]
            param[where] = was - step
            less = toxicity.gradients(model, w, feats, batch, y, weight)[0]
            param[where] = was
            assert abs((more - less) / (2 * step) - grad[at]) < 1e-4


def test_threshold_with_the_fewest_errors():
    rng = np.random.default_rng(6)
    for _ in range(50):
        z, y, v = rng.integers(0, 8, 30).astype(float), rng.integers(0, 2, 30), rng.random(30)
        cut = toxicity.fewest_errors(z, y, v)
        errors = lambda c: (v * ((z >= c) != y)).sum()
        assert errors(cut) <= min(errors(c) for c in np.arange(-0.5, 9)) + 1e-9


def test_platt_finds_the_odds():
    rng = np.random.default_rng(4)
    z = rng.normal(0, 3, 20000)
    y = (rng.random(20000) < 1 / (1 + np.exp(-0.7 * (z - 1.5)))).astype(int)
    shift, scale = toxicity.platt(z, y, np.ones(20000))
    assert abs(shift - 1.5) < 0.15 and abs(scale - 0.7) < 0.05
    shift, scale = toxicity.platt(np.array([-2.0, -1, 1, 2]), np.array([0, 0, 1, 1]), np.ones(4))
    assert -1 < shift < 1 and np.isfinite(scale)


def test_convolution_equals_loop():
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(list("abcdefg"), rng.integers(0, 9))) for _ in range(40)]
    model = toxicity.fit_texts(texts, np.arange(40) % 2, ["en"] * 40)
    w = toxicity.split(pa.array(texts))
    rows = model.embedding[toxicity.buckets(w)].sum(1)
    got = toxicity.conv_max(model, rows, w.codes, w.at)
    for i in range(40):
        x = rows[w.codes[w.at[i] : w.at[i + 1]]]
        want = []
        for k in model.kernels:
            want.append(np.max([sum(x[t + j] @ k[j] for j in range(len(k)) if t + j < len(x)) for t in range(len(x))], axis=0))
        assert np.allclose(got[i], np.concatenate(want), atol=1e-4)


def test_classifiers_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (6, None), (8, 1), (8, 0)], "doc_id long, toxic int")
    assert toxicity.score_documents(odd, toxicity.fit(odd, labels)).count() == odd.count()
    model = toxicity.fit(odd.where("false"), labels.where("false"))
    assert toxicity.drop_toxic(odd.withColumnRenamed("shard", "score"), model).columns == [*odd.columns[:-1], "score"]
    assert toxicity.score_documents(odd.where("false"), model).count() == 0
    assert language_id.identify(odd, language_id.fit(odd)).count() == odd.count()
    assert {r.lang_pred for r in language_id.identify(odd, language_id.fit(odd.where("false"))).collect()} == {"und"}
    assert secrets.scan_documents(odd, secrets.fit(odd)).count() == odd.count()
    assert secrets.scan_documents(odd.where("false"), secrets.fit(odd.where("false"))).count() == 0


def test_network_finds_keys_that_no_pattern_names():
    model = secrets.fit_texts(["token = abcdef0123456789 and more", "plain words only"])
    rng = np.random.default_rng(99)
    right = [0, 0]
    total = [0, 0]
    for _ in range(400):
        text, a, b, y = secrets.invent(rng)
        right[y] += (secrets.scores(model, secrets.windows(text, a, b)).max() >= model.threshold) == bool(y)
        total[y] += 1
    assert right[0] / total[0] > 0.75 and right[1] / total[1] > 0.8


@pytest.mark.parametrize("n", [12, 40, 41, 200, 1000])
def test_windows_cover_long_candidates(n):
    text = "x " + "a1" * (n // 2) + " y"
    seen = "".join(secrets.windows(text, 2, 2 + n // 2 * 2))
    assert seen.count("a1") >= n // 2


@pytest.mark.parametrize("epochs", [0, 1, secrets.EPOCHS])
def test_threshold_keeps_the_recall(monkeypatch, epochs):
    """A network that has learned little needs a negative logit, which the threshold must reach."""
    monkeypatch.setattr(secrets, "EPOCHS", epochs)
    model = secrets.fit_texts(["token = abcdef0123456789 and more", "plain words only"])
    rng = np.random.default_rng(5)
    keys = [x for x in (secrets.invent(rng) for _ in range(2000)) if x[3]]
    found = np.mean([secrets.scores(model, secrets.windows(*x[:3])).max() >= model.threshold for x in keys])
    assert model.recall >= secrets.RECALL and found >= secrets.RECALL - 0.03


def test_threshold_may_be_negative():
    logit = np.linspace(-9, 1, 100)
    assert secrets.keeping(logit, 0.95) < 0 and (logit >= secrets.keeping(logit, 0.95)).mean() >= 0.95


def test_keys_of_letters_alone_are_found():
    key = "QwhTzKpLmXvBnRsYdGfJ"
    text = f"the key is {key} as agreed"
    assert secrets.candidates(text) == [(11, 31)] and secrets.candidates("short words, 123456789012 and ------------") == []
    model = secrets.fit_texts(["token = abcdef0123456789 and more", "plain words only"])
    assert secrets.find_learned(model, [text], [secrets.find_base(text)]) == [[(11, 31)]]


def unseen(rng):
    """Keys of shapes that the training invents none of."""
    pick = lambda chars, n: "".join(rng.choice(list(chars), n))
    upper, lower, num = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    shapes = ("AIza" + pick(upper + lower + num + "_-", 35), "SG." + pick(upper + lower + num, 22) + "." + pick(upper + lower + num, 43), "-".join(pick("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)), "-".join(pick(upper + num, 5) for _ in range(5)), pick(upper + "234567", 32), "npm_" + pick(upper + lower + num, 36), "v1:" + pick(num + lower, 40))
    value = shapes[rng.integers(len(shapes))]
    return f"use {value} for it", 4, 4 + len(value)


def test_keys_of_unseen_shapes_are_found(sf_dir):
    texts = [r[1] for r in documents(sf_dir)]
    model = secrets.fit_texts(texts)
    assert model.recall >= secrets.RECALL
    rng = np.random.default_rng(77)
    hits = 0
    for _ in range(300):
        text, a, b = unseen(rng)
        hits += bool(secrets.find_learned(model, [text], [secrets.find_base(text)])[0] or any(secrets.find_base(text).values()))
    assert hits / 300 > 0.8


def test_clean_words_are_left_alone(sf_dir):
    texts = [r[1] for r in documents(sf_dir)]
    model = secrets.fit_texts(texts[:600])
    clean = [t for t in texts[600:] if t and not any(secrets.find_base(t).values())]
    found = sum(map(len, secrets.find_learned(model, clean, [secrets.find_base(t) for t in clean])))
    assert found < 0.02 * sum(len(secrets.candidates(t)) for t in clean) + 5


def test_secret_gradients_equal_differences():
    rng = np.random.default_rng(8)
    model = secrets.begin(rng)
    model.bias, model.offset = rng.normal(0, 0.3, len(model.bias)), np.array([0.1])
    codes, y, weight = rng.integers(0, len(secrets.ALPHABET) + 1, (6, secrets.WINDOW)), np.arange(6) % 2, rng.random(6) + 0.5
    grads = secrets.gradients(model, codes, y, weight)[1]
    for param, grad in zip([model.embedding, *model.kernels, model.bias, model.weights, model.offset], grads, strict=True):
        for _ in range(12):
            at = tuple(rng.integers(n) for n in grad.shape)
            was, side = param[at], []
            for step in (1e-6, -1e-6):
                param[at] = was + step
                side.append(secrets.gradients(model, codes, y, weight)[0])
            param[at] = was
            assert abs((side[0] - side[1]) / 2e-6 - grad[at]) < 1e-4


def test_a_long_candidate_is_learned_from_and_scored_whole():
    """Only the end of a long candidate tells that it is a key: every window of it is read."""
    text = "x " + "a" * 200 + "Zq81Kd93Lm20Xp47Vb65" + " y"
    (a, b), = secrets.candidates(text)
    assert "Zq81Kd93Lm20Xp47Vb65" in " ".join(secrets.windows(text, a, b))


def test_every_language_is_learned(spark):
    """More languages than any fixed number would hold, each told by its own words."""
    rng = np.random.default_rng(2)
    rows = []
    for k in range(70):
        words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(12)]
        rows += [(1000 * k + i, " ".join(rng.choice(words, 20)), f"l{k:02d}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert len(model.names) == 70
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, model).collect()}
    test = [r for r in rows if held(r[0])]
    assert np.mean([got[r[0]] == r[2] for r in test]) > 0.9


def test_the_sample_does_not_hang_on_the_order_of_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (4, 0), (6, 0), (8, 1)], "doc_id long, toxic int")
    twice = odd.unionByName(odd.selectExpr("doc_id", "concat(text, ' more words') as text", "lang", "source", "shard"))
    for fit in (language_id.fit, lambda d: toxicity.fit(d, labels), secrets.fit):
        a, b = fit(twice), fit(twice.repartition(7, "text").orderBy("text"))
        assert all(np.array_equal(np.asarray(getattr(a, k)), np.asarray(getattr(b, k))) for k in vars(a) if k != "kernels")


def test_f17_toxicity_learns_and_calibrates_on_every_labelled_row(spark, monkeypatch):
    """Cells of a few documents, and a small sample to begin with: each document's own word is counted, and each
    language's place is that of all its rows that are set apart."""
    monkeypatch.setattr(toxicity, "SAMPLE_PER_CLASS", 5)
    monkeypatch.setattr(toxicity, "CELL_BYTES", 4000)
    rows = [(i, f"{'awful' if i % 2 else 'lovely'} own{i} " + "text " * (i % 5), "en", i % 2) for i in range(900)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    apart = {r.doc_id for r in labels.where(toxicity._held()).collect()}
    learned = [r for r in rows if not held(r[0]) and r[0] not in apart]
    words = toxicity.split(pa.array([f"own{r[0]}" for r in learned]))
    seen = model.languages[toxicity.buckets(words)[:, 0]].max(1)
    assert len(learned) > 500 and (seen > model.languages.min(0).max() + 1).all()
    some = [r for r in rows if not held(r[0]) and r[0] in apart]
    w = toxicity.split(pa.array([r[1] for r in some]))
    z, y = toxicity.logits(model, w), np.array([r[3] for r in some])
    assert len(some) > 100 and abs(model.shifts[0] - toxicity.fewest_errors(np.floor(z * toxicity.FINE) / toxicity.FINE, y, np.full(len(y), np.sqrt(2)))) < 3 / toxicity.FINE
    again = toxicity.fit(docs.repartition(5), labels.repartition(3))
    assert np.array_equal(model.embedding, again.embedding) and np.array_equal(model.shifts, again.shifts)


def test_f16_secrets_are_learned_from_every_candidate(spark, monkeypatch):
    """Cells of a few candidates and a small sample to begin with: all windows of all whole texts are learned from,
    and the threshold keeps its share of all secrets that are set apart."""
    monkeypatch.setattr(secrets, "SAMPLE_DOCUMENTS", 5)
    monkeypatch.setattr(secrets, "CELL_WINDOWS", 500)
    rng = np.random.default_rng(4)
    key = lambda n: "".join(rng.choice(list("abcdef0123456789"), n))
    rows = [(i, f"token = {key(20)} " + "short " * (5000 if i == 7 else 3) + f"extraordinarily{i} internationalization") for i in range(400)]
    docs = spark.createDataFrame([*rows, rows[0], (None, None)], "doc_id long, text string")
    summed = []
    monkeypatch.setattr(secrets, "added_up", lambda parts, real=secrets.added_up: summed.append(real(parts)) or summed[0])
    model = secrets.fit(docs)
    found = secrets._all_candidates(docs).dropDuplicates(["key", "at"]).toPandas()
    assert len(found) == sum(len(secrets.candidates(t)) for _, t in rows) and found["n"].sum() * 0.7 < summed[0][-1] < found["n"].sum() * 0.8
    best = np.array([secrets.scores(model, secrets._cut(p)).max() for p in found[found["good"] == 1]["pieces"]])
    assert (best >= model.threshold).mean() > 0.9 and model.recall >= secrets.RECALL
    summed.clear()
    again = secrets.fit(docs.repartition(5, "text"))
    assert all(np.array_equal(a, b) for a, b in zip(secrets._params(model), secrets._params(again), strict=True)) and again.threshold == model.threshold
