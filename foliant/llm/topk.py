"""Exact top-k inner products by aggregation over sorted lists without random access."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import checkpoint_folder, cut, tidy

#: Vectors whose lists a task holds at once, blocks of them for a task at least, and components of the queries that are sent at once.
CANDIDATES, BLOCKS, SENT = 4096, 4, 1 << 22
#: Vectors of a task that are scored at once for a first bar, and rounds in which lists are read.
FIRST, ROUNDS = 256, 16
#: Queries whose sums over a block are held at once.
TOGETHER = 512
LARGEST = 2**63 - 1


class Lists:
    """The sorted lists of a block of vectors: for each component the rows by rising value, and the place of every row."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.vectors, self.ids = vectors, ids
        order = np.argsort(vectors, axis=0, kind="stable")
        self.values = np.ascontiguousarray(np.take_along_axis(vectors, order, axis=0).T)
        self.place = np.empty(vectors.shape, np.int32)
        np.put_along_axis(self.place, order, np.arange(len(vectors), dtype=np.int32)[:, None], axis=0)


def scan(lists: Lists, queries: np.ndarray, own: np.ndarray, k: int, bars: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """For each query the rows that may be among its ``k`` best, and how many list entries were read to know it.

    A query reads each list from the end that its sign favours, all lists at one pace. Of
    every row it adds the entries met so far; for the others the entry last read bounds what
    they can add, and the far end what they add at least. A row goes when its upper bound is
    below the bar: that of ``bars``, or the k-th best lower bound. As long as a row that was
    never met could reach the bar, nothing can be told; reading stops when what is left is
    cheaper to score than the next round is to read. Queries at one depth are added up together.
    """
    n, width = lists.vectors.shape
    step = max(1, -(-n // ROUNDS))
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    bars = bars.copy()
    found = [(np.arange(n), n * width)] * len(queries)
    going = np.arange(len(queries))
    for depth in range(step, n, step):
        # the entries last read from the upper and the lower ends
        high, low = lists.values[:, n - depth], lists.values[:, depth - 1]
        never = up[going] @ high + down[going] @ low
        at = going if depth >= n // 2 else going[never < bars[going]]
        if not len(at):
            continue
        # by row and list what was met from either end, and a bound of the rest: first at most, then at least
        above, below = lists.place >= n - depth, lists.place < depth
        most = np.where(above, lists.vectors, high) @ up[at].T
        most += np.where(below, lists.vectors, low) @ down[at].T
        if n > k:
            least = np.where(above, lists.vectors, lists.values[:, 0]) @ up[at].T
            least += np.where(below, lists.vectors, lists.values[:, -1]) @ down[at].T
            least[lists.ids[:, None] == own[at]] = -np.inf
            bars[at] = np.maximum(bars[at], np.partition(least, n - k, axis=0)[n - k])
        near = most >= bars[at]
        many = near.sum(axis=0)
        for i in np.flatnonzero(many <= max(step, 2 * k)).tolist():
            found[at[i]] = np.flatnonzero(near[:, i]), (depth + int(many[i])) * width
        going = np.setdiff1d(going, at[many <= max(step, 2 * k)])
        if not len(going):
            break
    return found


def best(found: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    """The k best of (score, id), ties to smaller ids."""
    return sorted(found, key=lambda x: (-x[0], x[1]))[:k]


def answer(lists: Lists, queries: np.ndarray, query_ids: np.ndarray, held: list[list[tuple[int, int]]], k: int, exact: bool) -> int:
    """Add a block to what each query holds: its k best (score, id); the number of entries read."""
    read, n = 0, len(lists.ids)
    for at in range(0, len(queries), TOGETHER):
        asked, ids = queries[at : at + TOGETHER], query_ids[at : at + TOGETHER]
        bars = np.array([held[q][k - 1][0] if len(held[q]) == k else -math.inf for q in range(at, at + len(ids))], float)
        if exact and n > 2 * FIRST and np.isinf(bars).any():
            read += FIRST * lists.vectors.shape[1] * int(np.isinf(bars).sum())
            first = lists.vectors[:FIRST] @ asked.T
            first[lists.ids[:FIRST, None] == ids] = -np.inf
            if FIRST > k:
                bars = np.maximum(bars, np.partition(first, FIRST - k, axis=0)[FIRST - k])
        left = scan(lists, asked, ids, k, bars) if exact else [(np.arange(n), n * asked.shape[1])] * len(ids)
        for q, (rows, more) in enumerate(left):
            read += more
            rows = rows[lists.ids[rows] != ids[q]]
            if exact:
                score = (lists.vectors if len(rows) == n else lists.vectors[rows]) @ asked[q]
                near = score >= bars[q]
                if near.sum() > 8 * k:
                    near &= score >= -np.partition(-score, k - 1)[k - 1]
                new = zip(score[near].astype(np.int64).tolist(), lists.ids[rows[near]].tolist(), strict=True)
            else:
                whole = asked[q].tolist()
                new = ((sum(a * b for a, b in zip(whole, v, strict=True)), i) for v, i in zip(lists.vectors[rows].tolist(), lists.ids[rows].tolist(), strict=True))
            held[at + q] = best([*held[at + q], *new], k)
    return read


def _arrays(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of rows of one width."""
    vectors = table.column("v")
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return table.column("vec_id").to_numpy(), vectors.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _asker(shared, k: int):
    """Answers of the queries of ``shared`` among the rows of a task, block by block."""

    @tidy
    def run(batches):
        asked = shared.value
        held = {width: [[] for _ in ids] for width, (ids, _) in asked.items()}
        waiting: dict[int, list] = {width: [] for width in asked}

        def block(width):
            ids, vectors = (np.concatenate(x) for x in zip(*waiting[width], strict=True))
            waiting[width] = []
            query_ids, queries = asked[width]
            size = float(np.abs(queries.astype(float)).max(initial=0)) * float(np.abs(vectors.astype(float)).max(initial=0)) * max(width, 1)
            exact = size < 2**53
            kind = np.float64 if exact else object
            lists = Lists(vectors.astype(kind), ids) if exact else _Plain(vectors.astype(kind), ids)
            answer(lists, queries.astype(kind), query_ids, held[width], k, exact)

        for batch in batches:
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths).tolist():
                if width not in asked:
                    continue
                own = _arrays(batch.filter(pa.array(widths == width)))
                for at in range(0, len(own[0]), CANDIDATES):
                    waiting[width].append(tuple(x[at : at + CANDIDATES] for x in own))
                    if sum(len(i) for i, _ in waiting[width]) >= CANDIDATES:
                        block(width)
        for width, rows in waiting.items():
            if rows:
                block(width)
        for width, (ids, _) in asked.items():
            found = [(q, i, max(-LARGEST - 1, min(LARGEST, s))) for q, own in zip(ids.tolist(), held[width], strict=True) for s, i in own]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["query_id", "vec_id", "score"])

    return run


class _Plain:
    """Vectors without lists, for numbers that doubles cannot add exactly."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.vectors, self.ids = vectors, ids


def top_k(
    vectors: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = 50,
    scale: float = 256.0,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other vectors of each query.

    Components become floor(scale * x), at most the nearest 64-bit number; queries are the
    ids divisible by ``every``. Rows take no part whose vector is null, empty, or holds null
    or non-finite components, nor rows with a null id. Of rows that share an id the one with
    the smallest vector asks, but all of them are candidates. Vectors of other widths than
    the query's do not meet it. A score beyond 64 bits counts as the nearest 64-bit number.
    An empty table gives an empty result.

    Candidates are dealt evenly once and stay where they are. Queries are sent to them a
    bounded number at a time, so that a task holds one block of candidates with its lists and
    one bounded set of queries; each task sends the k best of each, which are ranked again.
    """
    spark = vectors.sparkSession
    x = F.col(vector_col)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    rows = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite)
    rows = cut(rows.select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v")).withColumn("width", F.size("v")))
    # the smallest vector of an id, compared left to right
    asks = cut(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("width", F.size("v")))
    asked = asks.agg(F.count("*").alias("n"), F.max("width").alias("width")).first()
    if not asked["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    turns = max(1, math.ceil(asked["n"] * asked["width"] / SENT))
    rows = rows.repartition(max(1, math.ceil(rows.count() / (CANDIDATES * BLOCKS))))
    rows = cut(rows) if turns > 1 else rows
    folder = f"{checkpoint_folder(spark)}/topk-{uuid.uuid4().hex}"
    kinds = "query_id long, vec_id long, score long"
    for turn in range(turns):
        table = asks.where(F.pmod(F.xxhash64("vec_id"), F.lit(turns)) == turn).toArrow()
        widths = table.column("width").to_numpy()
        sent = {int(w): _arrays(table.filter(pa.array(widths == w))) for w in np.unique(widths)}
        found = rows.mapInArrow(_asker(spark.sparkContext.broadcast(sent), k), kinds)
        if turns > 1:
            found.write.mode("append").parquet(folder)
    found = spark.read.schema(kinds).parquet(folder) if turns > 1 else found
    order = "row_number() over (partition by query_id order by score desc, vec_id)"
    ranked = found.select("query_id", "vec_id", "score", F.expr(order).cast("int").alias("rank"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
