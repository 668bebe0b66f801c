"""SimHash fingerprints and their links by covering locality-sensitive hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import as_bytes, cut, small_batches
from foliant.llm.components import connected_components

BITS = 64
SEED = 42
#: Distinct fingerprints of one bucket that are compared pair by pair; larger buckets take the other exact way.
PAIRWISE = 2048


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each shingle of one UTF-8 text, repeats included; a text of fewer words is one shingle."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes) + np.arange(n)
    starts = ends - sizes
    k = min(width, n)
    of = xxhash.xxh64_intdigest
    places = zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.fromiter((of(whole[s:e], SEED) for s, e in places), np.uint64, n - k + 1)


def fingerprint_of(hashes: np.ndarray) -> int:
    """The unsigned fingerprint of shingle hashes: the bits that over half of them have."""
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, width: int = 4) -> int:
    """The unsigned fingerprint of one UTF-8 text; zero for a blank one."""
    return fingerprint_of(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """``doc_id, fp`` of each row; fp holds the 64 bits as a signed long.

    A null or blank text has the fingerprint zero, a text of fewer than ``width`` words is
    one shingle. Other columns are not read; null ids stay null.
    """

    def run(batches):
        for batch in small_batches(batches):
            found = np.fromiter((fingerprint(x, width) for x in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int) -> list[int]:
    """Masks such that any two words within ``radius`` bits agree under one of them.

    Bit i carries a nonzero vector m(i) of ``radius + 1`` bits; the mask of v keeps the bits
    whose m(i) has odd overlap with v. The vectors of at most ``radius`` differing bits span
    less than the whole space, so some v is orthogonal to all of them: its mask hides every
    difference. There is a mask for every nonzero v.
    """
    whole = (1 << (radius + 1)) - 1
    of_bit = [1 + i % whole for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (of_bit[i] & v).bit_count() % 2) for v in range(1, whole + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _stars(group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges to the first member of each component of a bucket's links."""
    near = np.bitwise_count(group[:, None] ^ group[None, :]) <= radius
    n = len(group)
    label = np.arange(n)
    while True:
        least = np.where(near, label[None, :], n).min(axis=1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    far = np.flatnonzero(label != np.arange(n))
    return group[far], group[label[far]]


def _runs(batches, keys: list[str]):
    """Arrays of whole runs of equal keys from sorted batches; True in the last place: more of this run follows."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        arrays = [batch.column(k).to_numpy(zero_copy_only=False) for k in [*keys, "fp"]]
        if held is not None:
            arrays = [np.concatenate(x) for x in zip(held, arrays, strict=True)]
        changes = np.zeros(len(arrays[0]) - 1, bool)
        for x in arrays[: len(keys)]:
            changes |= x[1:] != x[:-1]
        last = int(np.flatnonzero(changes)[-1]) + 1 if changes.any() else 0
        if last:
            yield [x[:last] for x in arrays], False
        held = [x[last:] for x in arrays]
        if len(held[0]) > PAIRWISE:
            yield held, True
            held = [x[:0] for x in held]
    if held is not None and len(held[0]):
        yield held, False


def _link(radius: int, most: int):
    """Edges within buckets that come sorted by (v, key); rows of a bucket above ``most`` pass through with v of at least 0."""

    def out(a, b, v):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(a).view(np.int64)), pa.array(np.ascontiguousarray(b).view(np.int64)), pa.array(np.full(len(a), v, np.int32))],
            ["a", "b", "v"],
        )

    def run(batches):
        passing = None  # the bucket that passes through just now
        for (v, key, fp), more in _runs(batches, ["v", "key"]):
            fp = fp.view(np.uint64)
            if not len(fp):
                continue
            edge = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (key[1:] != key[:-1]), True])
            sizes = np.diff(edge)
            if passing is not None:
                if (v[0], key[0]) == passing:
                    yield out(fp[: edge[1]], fp[: edge[1]], v[0])
                    sizes[0] = 0
                passing = (v[-1], key[-1]) if more and (v[-1], key[-1]) == passing else None
            if more and sizes[-1]:
                passing = (v[-1], key[-1])
                yield out(fp[edge[-2] :], fp[edge[-2] :], v[-1])
                sizes[-1] = 0
            two = edge[:-1][sizes == 2]
            a, b = fp[two], fp[two + 1]
            near = np.bitwise_count(a ^ b) <= radius
            found = [(a[near], b[near])]
            for k in np.flatnonzero(sizes > 2):
                group = fp[edge[k] : edge[k + 1]]
                if len(group) > most:
                    yield out(group, group, v[edge[k]])
                else:
                    found.append(_stars(group, radius))
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(a):
                yield out(a, b, -1)

    return run


def _same_key(batches):
    """Edges from each row to the first row of its key; keys come sorted."""
    first = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("key", "fp"))
        starts = np.r_[first is None or key[0] != first[0], key[1:] != key[:-1]]
        at = np.where(starts, np.arange(len(key)), 0)
        np.maximum.accumulate(at, out=at)
        root = fp[at]
        if not starts[0]:
            root[: int(np.argmax(starts)) if starts.any() else len(key)] = first[1]
        first = (key[-1], root[-1])
        keep = root != fp
        if keep.any():
            pairs = np.unique(np.stack([fp[keep], root[keep]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


def links(distinct: DataFrame, radius: int = 4, pairwise: int = PAIRWISE) -> DataFrame:
    """``a, b``: edges whose components are those of all pairs within ``radius`` bits.

    ``distinct`` has each fingerprint once, in ``fp``. Every fingerprint goes to a bucket of
    each covering mask, and buckets are read as sorted streams. A bucket of at most
    ``pairwise`` members is compared in full and gives a star for each local component. The
    members of larger buckets are joined by their neighbourhoods instead: each emits all
    words within ``radius // 2`` bits, and two that share such a word are linked, which are
    exactly those within ``radius`` for an even radius. That costs a fixed number of rows a
    member, however large the bucket, and is spread by the shared word.
    """
    if radius % 2:
        raise ValueError("the radius is even")
    most = min(pairwise, PAIRWISE)
    masks = np.array([_signed(m) for m in covering_masks(radius)], np.int64)

    def keys(batches):
        # a few fingerprints at a time: rows are many times as many
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                fp = batch.column(0).slice(at, 1024).to_numpy()
                v = np.repeat(np.arange(len(masks), dtype=np.int32), len(fp))
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array((masks[:, None] & fp[None, :]).ravel()), pa.array(np.tile(fp, len(masks)))], ["v", "key", "fp"])

    keyed = distinct.select("fp").mapInArrow(keys, "v int, key long, fp long")
    found = cut(
        keyed.repartition("v", "key").sortWithinPartitions("v", "key").mapInArrow(_link(radius, most), "a long, b long, v int")
    )
    edges = found.where("v < 0").select("a", "b")
    hot = found.where("v >= 0").select(F.col("a").alias("fp")).distinct()
    if hot.isEmpty():
        return edges
    flips = [0, *(1 << i for i in range(BITS))]
    for _ in range(radius // 2 - 1):
        flips = sorted({x ^ (1 << i) for x in flips for i in range(BITS)} | set(flips))
    around = F.transform(F.lit(np.array([_signed(x) for x in flips], np.int64)), lambda x: F.col("fp").bitwiseXOR(x))
    shared = (
        hot.select("fp", F.explode(around).alias("key"))
        .repartition("key")
        .sortWithinPartitions("key", "fp")
        .mapInArrow(_same_key, "a long, b long")
    )
    return edges.unionByName(shared.distinct())


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, pairwise: int = PAIRWISE) -> DataFrame:
    """``doc_id, fp, component_id`` of each row; component_id is the smallest id reachable by links.

    Rows with equal fingerprints are one node from the start, so groups of exact copies of
    any size cost one row. A row with a null id takes part but names no component; a
    component of such rows only has a null component_id. Repeated rows stay repeated. An
    empty table gives an empty result.
    """
    rows = cut(fingerprints(docs, id_col, text_col, width))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(nodes.select("fp"), radius, pairwise))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = cut(rooted.join(named, "root").select("fp", "component_id"))
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their group; a group without ids is kept."""
    groups = near_groups(docs, id_col, text_col, width, radius)
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone"), F.col("fp").alias("_fp")).distinct()
    keyed = docs.withColumns({"_id": F.col(id_col).cast("long"), "_key": F.xxhash64(as_bytes(text_col))})
    texts = keyed.select("_id", "_key", as_bytes(text_col).alias("text")).join(gone.select(F.col("_gone").alias("_id")).distinct(), "_id")

    def run(batches):
        for batch in small_batches(batches):
            found = np.fromiter((fingerprint(x, width) for x in batch.column(2).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["_id", "_key", "_fp"])

    found = texts.mapInArrow(run, "_id long, _key long, _fp long")
    lost = found.join(gone, (found["_id"] == gone["_gone"]) & (found["_fp"] == gone["_fp"])).select("_id", "_key").distinct()
    return keyed.join(lost, ["_id", "_key"], "left_anti").select(*docs.columns)
