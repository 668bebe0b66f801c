import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from foliant.llm import packing

PATH = P.path("byte_bpe_50k.json")


def fewest(items, capacity):
    """The optimum of a small case by exhaustive search."""
    items = sorted(items, reverse=True)
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] >= items[i] and bins[j] not in bins[:j]:
                go(i + 1, bins[:j] + [bins[j] - items[i]] + bins[j + 1 :])
        go(i + 1, bins + [capacity - items[i]])

    go(0, [])
    return best


def test_without_limits_the_plan_is_optimal():
    rng = random.Random(3)
    for _ in range(60):
        capacity = rng.choice([12, 30, 100])
        items = [rng.randint(1, capacity * 2 // 3) for _ in range(rng.randint(1, 11))]
        plan = packing.plan_packing(Counter(items), capacity, packing.EXACT)
        assert sum(n for _, n in plan) == fewest(items, capacity)
        assert Counter(s for pattern, times in plan for s, m in pattern for _ in range(m * times)) == Counter(items)


def test_small_cases_are_optimal():
    rng = random.Random(1)
    for _ in range(60):
        capacity = rng.choice([10, 20, 50])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 11))]
        plan = packing.plan_packing(Counter(items), capacity)
        got = Counter()
        for pattern, times in plan:
            assert sum(s * m for s, m in pattern) <= capacity
            for s, m in pattern:
                got[s] += m * times
        assert got == Counter(items)
        assert sum(n for _, n in plan) == fewest(items, capacity)
        assert packing.lower_bound(Counter(items), capacity) <= fewest(items, capacity)


def test_large_counts_stay_near_the_bound():
    rng = random.Random(2)
    counts = Counter(min(1024, int(rng.lognormvariate(5.5, 1)) + 1) for _ in range(200_000))
    plan = packing.plan_packing(counts, 1024)
    assert sum(n for _, n in plan) <= packing.lower_bound(counts, 1024) * 1.0005


def test_dominance():
    assert packing.dominates((5,), (3, 2))
    assert packing.dominates((5, 3), (4, 3))
    assert not packing.dominates((3, 2), (4,))
    assert packing.fillings(10, Counter([7, 3, 5, 5]))[0] in {(7, 3), (5, 5)}


@pytest.mark.parametrize("capacity", [16, 1024])
def test_rows(spark, capacity):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "Beta,", "gamma\n", "é"]) for _ in range(rng.choice([0, 3, 10, 60, 700]))) for _ in range(150)]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(500, None, 1, "x"), (None, "no id", 1, "x"), (7, texts[7], 1, "x"), (7, texts[7], 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int, salt string").repartition(3)
    got = packing.pack(df, PATH, capacity, 2, with_ids=True).collect()
    own = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t, _, _ in rows:
        ids = np.array(own.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        edges = [0, *range(len(ids) % capacity or min(capacity, len(ids)), len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(itertools.pairwise(edges)):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(bins) <= packing.lower_bound(Counter(r.length for r in got), capacity) + 1
    assert packing.pack(df.limit(0), PATH).collect() == []
