import random

import pytest
import xxhash

from foliant.llm import simhash

SCHEMA = "doc_id long, text string, fp string, component_id string"


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(rows):
    fps = [plain(t) for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i, x in enumerate(fps):
            for j, y in enumerate(fps):
                if (x ^ y).bit_count() <= 4:
                    label[i] = label[j] = min(label[i], label[j])
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((d, fps[i], min(ids) if ids else None))
    return sorted(out, key=str)


def texts():
    rng = random.Random(3)
    made = []
    for k in range(12):
        words = [rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.choice([2, 40, 300]))]
        made.append(" ".join(words))
        for _ in range(k % 4):
            near = list(words)
            near[rng.randrange(len(near))] = "Zq"
            made.append("\n".join(near))
    made += ["", None, "  \t\n", "one", "One", "a b c", "a b c d", "É a b c", "x " * 30000, made[0], made[0]]
    rows = [(i * 3, t) for i, t in enumerate(made)]
    return rows + [rows[4], (None, made[2]), (None, "alone in the world with no one near")]


@pytest.mark.parametrize("pairwise", [2048, 2])
def test_groups_match_brute_force(spark, pairwise):
    rows = texts()
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA).repartition(3)
    got = simhash.near_groups(df, pairwise=pairwise).collect()
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got), key=str) == groups(rows)


def test_empty_table(spark):
    assert simhash.near_groups(spark.createDataFrame([], SCHEMA)).collect() == []


def test_masks_cover_every_pair():
    masks = simhash.covering_masks(4)
    rng = random.Random(1)
    for _ in range(2000):
        gap = sum(1 << i for i in rng.sample(range(64), rng.randint(0, 4)))
        assert any(not gap & m for m in masks)


def test_keep_one_keeps_the_first(spark):
    text = " ".join(f"w{i}" for i in range(200))
    df = spark.createDataFrame([(5, text), (3, text.upper()), (9, "other words entirely here now"), (None, text)], "doc_id long, text string")
    assert sorted((r.doc_id for r in simhash.keep_one(df).collect()), key=str) == [3, 9, None]


def test_keep_one_tells_rows_of_one_id_apart(spark):
    one, other = (" ".join(f"{c}{i}" for i in range(200)) for c in "ab")
    df = spark.createDataFrame([(3, one), (5, one), (5, other)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in simhash.keep_one(df).collect()) == [(3, one), (5, other)]
