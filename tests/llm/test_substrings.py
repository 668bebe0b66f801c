import random

import numpy as np
import pytest

from foliant.llm import substrings

SCHEMA = "doc_id long, text string, row long, starts string, d int"


def brute(rows, window):
    docs = [(d if d is not None else 1 << 70, d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for order, _, words in docs:
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            first[key] = min(first.get(key, (order, i)), (order, i))
    out = []
    for order, d, words in docs:
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < (order, i):
                gone |= set(range(i, i + window))
        out.append((d, len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    return sorted(out, key=str)


def rows_of(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "É", "x,", "Zz"]) + rng.choice("pqrst") * rng.randint(0, 2)
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(60):
        words = [word() for _ in range(rng.choice([0, 5, 19, 20, 21, 90]))]
        if i % 3 == 0:
            a = rng.randint(0, 30)
            at = rng.randint(0, len(words))
            words[at:at] = passage[a : a + rng.choice([19, 20, 30])]
        rows.append((rng.randint(0, 10**6) * 100 + i, rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [(7, " ".join(passage)), (8, " ".join(passage * 3)), (9, "same " * 100), (3, None), (4, ""), (5, " \n"), rows[0], rows[33], (None, " ".join(passage))]
    return rows


@pytest.mark.parametrize(("window", "widest"), [(20, 29), (20, 3), (5, 29), (3, 29)])
def test_matches_brute_force(spark, window, widest):
    rows = rows_of(window)
    df = spark.createDataFrame([(d, t, 1, "s", 2) for d, t in rows], SCHEMA).repartition(3)
    got = substrings.drop_repeats(df, window=window, widest=widest)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()), key=str) == brute(rows, window)
    assert got.columns == ["doc_id", "text", "row", "starts", "d", "n_words", "n_removed", "kept"]


def test_empty_table_and_long_text(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.drop_repeats(empty).collect() == []
    long = spark.createDataFrame([(1, " ".join(str(i * i) for i in range(200_000)) + " 1 2 3")], "doc_id long, text string")
    assert [(r.n_words, r.n_removed) for r in substrings.drop_repeats(long).collect()] == [(200_003, 0)]


def test_sketch_never_underestimates(spark):
    rows = [(t.encode() if t else b"",) for _, t in rows_of(1)]
    sketch = substrings.build_sketch(spark.createDataFrame(rows, "text binary").repartition(4), 20, 16)
    anchors = [substrings.Windows([t], 20).anchors() for (t,) in rows]
    values, n = np.unique(np.concatenate(anchors), return_counts=True)
    assert substrings.estimated_repeated(values[n > 1], sketch, 16).all()
    assert not substrings.estimated_repeated(values[n == 1], sketch, 16).all()
