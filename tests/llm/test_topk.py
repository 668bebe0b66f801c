import math
import random

import numpy as np
import pytest

from foliant.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score int, rank int, v string"


def brute(rows, k=5):
    kept = []
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256.0 * float(np.float32(x))) for x in v]))
    asks = {}
    for i, v in kept:
        if i % 50 == 0:
            asks[i] = min(asks.get(i, v), v)
    out = []
    for q, a in asks.items():
        found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in kept if i != q and len(a) == len(b))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


def table(kind):
    rng = random.Random(kind)
    if kind == 1:  # many ties and one common vector
        rows = [(i, [float(rng.randint(-1, 1)) / 4 for _ in range(4)] if i % 3 else [0.5, -0.25, 0.0, 1.0]) for i in range(-100, 400)]
    else:
        rows = [(i, [rng.gauss(0, 0.3) for _ in range(16)]) for i in range(700)]
    rows += [(1000, None), (1001, []), (1002, [None, 1.0]), (1050, [float("nan")] * 4), (1003, [float("inf")] * 16), (7, rows[0][1]), (None, [1.0] * 4), rows[0], (rows[0][0], [0.1] * 4)]
    return rows


@pytest.mark.parametrize("kind", [1, 2])
def test_matches_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "CANDIDATES", 150)
    monkeypatch.setattr(topk, "FIRST", 20)
    if kind == 1:
        monkeypatch.setattr(topk, "SENT", 9)
    rows = table(kind)
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA).repartition(3)
    got = topk.top_k(df).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute(rows)


def test_few_rows_and_none(spark):
    one = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(one).collect())) == [(0, 1, 1, 256 * 512), (0, 2, 2, 256 * 512)]
    assert topk.top_k(one.limit(0)).collect() == []


def test_values_beyond_doubles_products(spark):
    rows = [(0, [3e15, 1.0]), (1, [3.0, 1.0]), (2, [3e18, -1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 2**63 - 1), (2, 2**63 - 1)]
    rows = [(0, [3e6, 1.0]), (1, [3e6, 1.0]), (2, [3e6, -1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    first = int(256 * 3e6) * int(256 * 3e6)
    assert [(r.vec_id, r.score) for r in got] == [(1, first + 65536), (2, first - 65536)]


def ask(vectors, ids, queries, k=5, block=10**9):
    held, read = [[] for _ in queries], 0
    for at in range(0, len(ids), block):
        lists = topk.Lists(vectors[at : at + block], ids[at : at + block])
        read += topk.answer(lists, vectors[queries], ids[queries], held, k, True)
    return held, read


@pytest.mark.parametrize("width", [1, 4, 24])
def test_reading_stops_early_and_is_exact(width):
    rng = np.random.default_rng(width)
    vectors, ids = np.floor(rng.normal(0, 80, (3000, width))), np.arange(3000)
    queries = np.arange(0, 3000, 300)
    for block in (10**9, 700):
        held, read = ask(vectors, ids, queries, block=block)
        for q, own in zip(queries, held):
            scores = vectors @ vectors[q]
            want = sorted((-scores[i], i) for i in range(3000) if i != q)[:5]
            assert own == [(-s, i) for s, i in want]
        assert read < 0.9 * len(queries) * vectors.size


def test_supplied_vectors_are_not_read_whole():
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet", columns=["vec_id", "embedding"])
    vectors = np.floor(256 * np.array(table.column("embedding").to_pylist(), float))
    ids = table.column("vec_id").to_numpy()
    held, read = ask(vectors, ids, np.flatnonzero(ids % 50 == 0))
    share = read / (len(held) * vectors.size)
    print("share of the entries read", share)
    assert share < 1


def test_components_beyond_doubles(spark):
    rows = [(0, [1e308, 1.0]), (1, [1e308, 1.0]), (2, [-1e308, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 2**63 - 1), (2, -(2**63))]


def test_queries_of_a_block_are_added_up_together(monkeypatch):
    """Many queries at once cost much less than one by one, read as much, and hold the same."""
    import time

    rng = np.random.default_rng(9)
    vectors, ids = np.floor(rng.normal(0, 40, (3000, 48))), np.arange(3000)
    lists, queries = topk.Lists(vectors, ids), np.arange(0, 3000, 20)

    def run(step):
        begun = time.process_time()
        held, read = [[] for _ in queries], 0
        for at in range(0, len(queries), step):
            own = held[at : at + step]
            some = queries[at : at + step]
            read += topk.answer(lists, vectors[some], ids[some], own, 5, True)
            held[at : at + step] = own
        return time.process_time() - begun, held, read

    together, one_by_one = run(len(queries)), run(1)
    assert together[1:] == one_by_one[1:]
    assert together[0] < 0.5 * one_by_one[0]
    monkeypatch.setattr(topk, "TOGETHER", 7)
    assert run(len(queries))[1:] == together[1:]
