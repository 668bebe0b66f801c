"""Packing of tokenised documents into sequences by bin completion."""

from __future__ import annotations

import bisect
import math
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import cut, held, small_batches, tidy, tidy_keeping
from foliant.llm.tokens import MOST_PIECES, json_coder



class Limits(NamedTuple):
    """Bounds of the search; without them it is exact, and only few pieces are feasible.

    ``fillings`` kept around one largest piece, ``members`` of a filling found by search, ``near``
    sizes tried for the next member, ``tops`` sizes tried for the first, ``steps`` of the search
    for fillings, and ``branches`` in all. ``whole``: a filling is used as often as the pieces
    allow, instead of once a branch.
    """

    fillings: float = 12
    members: float = 4
    near: float = 3
    tops: float = 96
    steps: float = 720
    branches: float = 2000
    whole: bool = True


EXACT = Limits(*[math.inf] * 6, whole=False)
Pattern = tuple[tuple[int, int], ...]  # lengths and how often, the largest first


def _fits(parts: tuple[int, ...], bins: tuple[int, ...]) -> bool:
    """Whether the parts go into the bins."""
    if not parts:
        return True
    tried = set()
    for i, room in enumerate(bins):
        if room >= parts[0] and room not in tried:
            tried.add(room)
            if _fits(parts[1:], bins[:i] + (room - parts[0],) + bins[i + 1 :]):
                return True
    return False


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether filling a is never worse than b: the members of b fit into those of a."""
    return sum(a) >= sum(b) and _fits(tuple(sorted(b, reverse=True)), tuple(sorted(a, reverse=True)))


def _best_fit(room: int, sizes: list[int], left: dict[int, int]) -> tuple[int, ...]:
    """The largest piece that fits, again and again."""
    own, used = [], Counter()
    at = bisect.bisect_right(sizes, room)
    while at:
        at = min(at, bisect.bisect_right(sizes, room))
        while at and left[sizes[at - 1]] <= used[sizes[at - 1]]:
            at -= 1
        if at:
            own.append(sizes[at - 1])
            used[own[-1]] += 1
            room -= own[-1]
    return tuple(own)


def fillings(room: int, left: dict[int, int], limits: Limits = Limits()) -> list[tuple[int, ...]]:  # noqa: B008
    """Undominated fillings of ``room`` from the pieces left, the least waste first.

    Pieces are searched in falling size, within the limits; the best fit is always one of the
    fillings. Without limits all fillings are met, but those that a fuller one dominates.
    """
    sizes = sorted(s for s, n in left.items() if n and s <= room)
    if not sizes:
        return [()]
    found = {_best_fit(room, sizes, left)}
    steps = 0

    def search(room: int, top: int, own: tuple[int, ...]) -> None:
        nonlocal steps
        if len(found) >= 4 * limits.fillings or steps > limits.steps:
            return
        steps += 1
        at = bisect.bisect_right(sizes, min(room, top))
        while at and left[sizes[at - 1]] <= own.count(sizes[at - 1]):
            at -= 1
        if not at or len(own) == limits.members:
            if len(own) < limits.members or not at:
                found.add(own)
            return
        if room in left and left[room] > own.count(room) and room <= top:
            found.add((*own, room))  # nothing beats a full sequence from here
            return
        for s in sizes[max(0, at - min(at, limits.near)) : at][::-1]:
            if left[s] > own.count(s):
                search(room - s, s, (*own, s))

    # every largest member in turn, down to what leaves most of the room open
    for s in sizes[::-1][: min(len(sizes), limits.tops)]:
        search(room - s, s, (s,))
    ordered = sorted(found, key=lambda f: (room - sum(f), len(f), tuple(-x for x in f)))
    kept: list[tuple[int, ...]] = []
    for f in ordered:
        if len(kept) == limits.fillings:
            break
        if not any(len(k) <= 8 and len(f) <= 8 and dominates(k, f) for k in kept):
            kept.append(f)
    return kept


def _apply(left: dict[int, int], pattern: Counter, times: int) -> None:
    for s, m in pattern.items():
        left[s] -= m * times
        if not left[s]:
            del left[s]


def _greedy(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit around the largest piece, each pattern as often as the pieces allow."""
    left, plan = dict(counts), []
    while left:
        top = max(left)
        sizes = sorted(left)
        left[top] -= 1
        pattern = Counter((top, *_best_fit(capacity - top, sizes, left)))
        left[top] += 1
        times = min(left[s] // m for s, m in pattern.items())
        _apply(left, pattern, times)
        plan.append((tuple(sorted(pattern.items(), reverse=True)), times))
    return plan


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences needed at least: by the sum, with the room that large pieces waste for all pieces of a size or more."""
    total = sum(s * n for s, n in counts.items())
    best = -(-total // capacity)
    for k in sorted({s for s in counts if s <= capacity // 2} | {0}):
        big = sum(n for s, n in counts.items() if s > capacity - k)
        half = [(s, n) for s, n in counts.items() if capacity // 2 < s <= capacity - k]
        small = sum(s * n for s, n in counts.items() if k <= s <= capacity // 2)
        room = sum((capacity - s) * n for s, n in half)
        best = max(best, big + sum(n for _, n in half) + max(0, -(-(small - room) // capacity)))
    return best


def plan_packing(counts: dict[int, int], capacity: int, limits: Limits = Limits()) -> list[tuple[Pattern, int]]:  # noqa: B008
    """Patterns and how often each is used, for ``counts`` pieces of each length.

    The incumbent is best fit. The search fills the sequence of the largest piece left by
    each of its undominated fillings, as often as the pieces allow, and goes on with what is
    left; a branch ends when what it wasted leaves no room for fewer sequences than the
    incumbent's. It stops at the lower bound, or at the limits. The work depends on the
    number of lengths, not of pieces. With ``EXACT`` every branch fills one sequence by every
    undominated filling, so the plan has as few sequences as any; that is for few pieces.
    """
    counts = {s: n for s, n in counts.items() if n}
    if not counts:
        return []
    best = _greedy(counts, capacity)
    used = sum(n for _, n in best)
    least = lower_bound(counts, capacity)
    total = sum(s * n for s, n in counts.items())
    done = 0

    # depth first without recursion: what is left, the plan so far, its sequences and waste
    stack = [(counts, (), 0, 0)]
    while stack and used > least and done < limits.branches:
        left, plan, bins, waste = stack.pop()
        if not left:
            if bins < used:
                used, best = bins, []
                while plan:
                    best.append(plan[0])
                    plan = plan[1]
                best.reverse()
            continue
        if waste > (used - 1) * capacity - total:
            continue
        done += 1
        top = max(left)
        rest = dict(left)
        rest[top] -= 1
        options = fillings(capacity - top, {s: n for s, n in rest.items() if n}, limits)
        for f in options[::-1]:
            pattern = Counter((top, *f))
            times = min(left[s] // m for s, m in pattern.items()) if limits.whole else 1
            after = dict(left)
            _apply(after, pattern, times)
            lost = waste + (capacity - top - sum(f)) * times
            if lost <= (used - 1) * capacity - total:
                stack.append((after, ((tuple(sorted(pattern.items(), reverse=True)), times), plan), bins + times, lost))
    return best


class Places:
    """Where the r-th piece of a length goes, by patterns."""

    def __init__(self, plan: list[tuple[Pattern, int]]):
        found: dict[int, list[tuple[int, int, int, int]]] = {}
        seen: Counter = Counter()
        base = 0
        for pattern, times in plan:
            offset = 0
            for s, m in pattern:
                found.setdefault(s, []).append((seen[s], base, m, offset))
                seen[s] += m * times
                offset += s * m
            base += times
        self.of = {s: np.array(rows, np.int64).T for s, rows in found.items()}

    def place(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, base, m, offset = self.of[length]
        at = np.searchsorted(first, ranks, side="right") - 1
        nth = ranks - first[at]
        return base[at] + nth // m[at], offset[at] + nth % m[at] * length


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, kept: int = MOST_PIECES) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of each piece, and ``ids`` if asked for.

    A document is its ids and one ``end_id``. One longer than ``capacity`` is cut into pieces
    of that length, its first piece taking what does not fill one.
    """

    @tidy_keeping
    def run(batches):
        coder = held((tokenizer, "json", kept), lambda: json_coder(tokenizer, kept))
        end = np.array([end_id], "<u4").tobytes()
        for batch in small_batches(batches):
            rows: list[list] = [[], [], [], [], [], []]
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = coder.encode(text or "") + end
                n = len(ids) // 4
                edges = [0, *range(n % capacity or min(capacity, n), n + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    own = ids[4 * a : 4 * b]
                    for column, value in zip(rows, (i, k, a, b - a, zlib.crc32(own), own if with_ids else b""), strict=True):
                        column.append(value)
            columns = [batch.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in rows[2:5]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows[5], pa.binary())], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = chosen.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")
    return found if with_ids else found.drop("ids")


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 1024,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
    limits: Limits = Limits(),  # noqa: B008
    kept: int = MOST_PIECES,
) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: the sequence of each, and its place there.

    The driver sees how many pieces have each length, ``capacity`` numbers at most, and plans
    patterns of lengths. Pieces of a length are numbered in salted groups, so that a length
    which very many share is no single group, and a pattern's places go by these numbers.
    A null text is the empty one: one piece that holds the end id alone. Equal rows are
    packed each. Other columns are not read; an empty table gives an empty result. ``kept``
    bounds the coded pieces of texts that a worker remembers; it bears on time and memory only.
    """
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = cut(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids, kept))
    counts = rows.groupBy("length").agg(F.count("*").alias("n"))
    places = Places(plan_packing({r.length: r.n for r in counts.collect()}, capacity, limits))
    many = max(1, rows.count())
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(max(64, many // 50_000))))
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = before.select("length", "salt", F.expr("sum(n) over (partition by length order by salt) - n").alias("before"))
    order = "row_number() over (partition by length, salt order by doc_id, piece, start, ids_crc32) - 1"
    ranked = salted.withColumn("nth", F.expr(order)).join(before, ["length", "salt"])

    @tidy  # the coders have done their work
    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            where = np.zeros((2, len(length)), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(part):
                    where[:, part] = places.place(int(length[part[0]]), rank[part])
            table = table.drop_columns(["rank"]).append_column("sequence_id", pa.array(where[0])).append_column("offset", pa.array(where[1]))
            yield from table.to_batches()

    shown = [*cols, "ids"] if with_ids else cols
    sent = ranked.select(*shown, (F.col("before") + F.col("nth")).cast("long").alias("rank"))
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return sent.mapInArrow(run, f"{kinds}, sequence_id long, offset long")
