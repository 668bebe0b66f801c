import math
import random
import zlib

import numpy as np

from foliant.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, score string, toxic string"


def corpus(n=900):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.choice([5, 60, 400]))]
        bad = rng.random() < 0.15
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["Zorgle", "vex" + word(), "üb" + word()])
        rows.append((i, " ".join(words), "en", "s", "t"))
        labels.append((i, int(bad), 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    extra = [(5000, None, "x", "s", "t"), (5001, "", "x", "s", "t"), (None, "zorgle", "x", "s", "t"), (3, rows[3][1], "x", "s", "t")]
    docs = spark.createDataFrame(rows + extra, SCHEMA).repartition(4)
    marks = spark.createDataFrame([*labels, (None, 1, 0), (77777, 1, 0), (5, None, 0), (6, 9, 0)], "doc_id long, toxic int, quality int")
    got = toxicity.score(docs, marks).collect()
    assert len(got) == len(rows) + 4
    truth = dict((i, y) for i, y, _ in labels)
    out = [r for r in got if r.doc_id is not None and r.doc_id < 5000 and r.held_out]
    assert out and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert next(r for r in got if r.doc_id is None).held_out
    same = [r.score for r in got if r.doc_id == 3]
    assert same[0] == same[1]


def test_score_depends_on_the_text_alone():
    rows, labels = corpus(300)
    texts = [t.encode() for _, t, *_ in rows]
    model = toxicity.fit(texts, [y for _, y, _ in labels])
    whole = model.score(texts)
    assert all(abs(model.score([t])[0] - s) < 1e-12 for t, s in zip(texts[:40], whole))
    assert len(model.score([b"", b"x", b"a" * 300_000])) == 3


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.score(docs, none).collect()] == [0]
    assert toxicity.score(docs.limit(0), none).collect() == []


def test_ratios_and_fit_match_a_plain_version():
    rows, labels = corpus(120)
    texts, y = [t.encode() for _, t, *_ in rows], [k for _, k, _ in labels]
    model = toxicity.fit(texts, y, features=60)
    # n-grams by a plain rule, through the same hashed space
    def plain(text):
        own = b" " + b" ".join(text.lower().split()) + b" "
        found = set()
        for n in toxicity.SIZES:
            for i in range(len(own) - n + 1):
                doc, feature = toxicity.grams([own[i : i + n]], (n,))
                found.add(int(feature[0]))
        return found

    sets = [plain(t) for t in texts]
    pos, neg = sum(y), len(y) - sum(y)
    p = {f: sum(f in s for s, k in zip(sets, y) if k) for f in model.features.tolist()}
    q = {f: sum(f in s for s, k in zip(sets, y) if not k) for f in model.features.tolist()}
    r = np.array([math.log((p[f] + 1) / (pos + 2)) - math.log((q[f] + 1) / (neg + 2)) for f in model.features.tolist()])
    x = np.array([[float(f in s) for f in model.features.tolist()] for s in sets]) * r
    w = np.divide(model.weights, r, out=np.zeros_like(r), where=r != 0)
    # at the minimum of the regularised loss the gradient vanishes
    gap = 1 / (1 + np.exp(-(x @ w + model.bias))) - np.array(y)
    assert np.abs(x.T @ gap / len(y) + 1e-3 * w).max() < 1e-3 and abs(gap.mean()) < 1e-3
    assert np.allclose(model.score(texts), 1 / (1 + np.exp(-(x @ w + model.bias))), atol=1e-9)


def test_slices_change_nothing(monkeypatch):
    rows, labels = corpus(200)
    texts = [t.encode() for _, t, *_ in rows]
    model = toxicity.fit(texts, [y for _, y, _ in labels])
    long_text = b" ".join(texts)
    whole = model.score([*texts, long_text])
    monkeypatch.setattr(toxicity, "AT_ONCE", 1000)
    assert np.array_equal(model.score([*texts, long_text]), whole)


def test_very_long_texts(spark):
    docs = spark.createDataFrame([(2, "fine words " * 300_000), (6, "fine words " * 300_000 + "zorgle"), (3, "zorgle")], "doc_id long, text string")
    rows, labels = corpus(400)
    known = spark.createDataFrame([(1000 + 4 * i, t) for i, (_, t, *_) in enumerate(rows)], "doc_id long, text string")
    marks = spark.createDataFrame([(1000 + 4 * i, y) for i, (_, y, _) in enumerate(labels)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(known.unionByName(docs), marks).where("doc_id < 1000").collect()}
    assert len(got) == 3 and got[6] > got[2]
