import random

import corpus_pipeline
from foliant.llm import shingles


def plain(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def roots(rows):
    sets = [plain(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if 5 * len(x & y) >= 4 * len(x | y) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def made():
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passage, big, rows = words(60), words(80), []
    for k in range(40):
        base = words(rng.choice([3, 25, 100, 150])) + (passage if k % 3 == 0 else [])
        rows.append(" ".join(base))
        for changes in (1, 2, 3, 4):
            near = list(base)
            for at in rng.sample(range(len(near)), min(changes, len(near))):
                near[at] = "changed"
            rows.append("\n".join(near))
    for _ in range(40):
        near = list(big)
        for at in rng.sample(range(80), rng.randint(0, 3)):
            near[at] = f"x{rng.randrange(9)}"
        rows.append(" ".join(near))
    rows += ["", None, " \n", rows[0].upper(), rows[0], "a b", "A  b"]
    return [(i * 2, t) for i, t in enumerate(rows)]


def test_stage_finds_all_pairs_of_brute_force(spark):
    rows = made()
    label = roots(rows)
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect())
    assert kept == sorted({rows[x][0] for x in label})


def test_rounds_with_hubs_change_nothing(spark, monkeypatch):
    rows = made()
    monkeypatch.setattr(shingles, "PAIRS_PER_ENTRY", 0)
    monkeypatch.setattr(shingles, "HUB_ROUNDS", 2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in shingles.keep_one(df).collect()) == sorted({rows[x][0] for x in roots(rows)})


def test_rows_of_one_id_and_other_texts(spark):
    one, other = (" ".join(f"{c}{i}" for i in range(50)) for c in "ab")
    df = spark.createDataFrame([(3, one), (5, one), (5, other), (None, one)], "doc_id long, text string")
    assert sorted(((r.doc_id, r.text) for r in shingles.keep_one(df).collect()), key=str) == sorted([(3, one), (5, other), (None, one)], key=str)


def test_empty_table(spark):
    assert shingles.keep_one(spark.createDataFrame([], "doc_id long, text string")).collect() == []
