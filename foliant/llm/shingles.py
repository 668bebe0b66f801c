"""Near copies by the Jaccard similarity of word shingles: fingerprints first, then prefixes, exactly."""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import simhash
from foliant.llm.common import as_bytes, cut, small_batches, tidy
from foliant.llm.components import connected_components

SEED = 42
#: Similar are sets that share four fifths of their union.
UP, DOWN = 4, 5
#: Documents whose shingles are counted for the order, and shingles that the order knows. Neither bears on the result.
SAMPLED, KNOWN = 4_000, 100_000
#: Cells of the smallest parity sketch, as a power of two, and members for which sketches grow at most.
PARITY, WIDEST = 10, 1 << 20
#: Open pairs per prefix entry above which another round with hubs comes before the pairs; rounds at most, and the share of
#: pairs that a round may leave open if another is to follow.
PAIRS_PER_ENTRY, HUB_ROUNDS, GAIN = 4, 6, 0.8
#: Keys of texts that are sent to every task at most; more are met by a join.
BROADCAST = 300_000
#: Nodes that a task remembers to have sent.
SENT = 200_000


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted hashes of a text's shingles; a text of fewer words is one shingle, a blank one has none."""
    return np.unique(simhash.shingle_hashes(text, width))


def prefix_length(n: int) -> int:
    """Entries of a set of ``n`` of which one at least is in the prefix of any similar set, in any common order."""
    return n - -(-UP * n // DOWN) + 1 if n else 0


def _all(width: int):
    """The shingles of each text of ``key, text``."""

    def run(batches):
        for batch in small_batches(batches):
            for text in batch.column(1).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, width).view(np.int64))], ["s"])

    return run


def _known(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that repeat in a sample of the documents, sorted, and how often."""
    rows = docs.count()
    sample = docs.select(F.xxhash64("text").alias("key"), "text").where(F.pmod("key", F.lit(max(1, rows // SAMPLED))) == 0)
    counts = sample.mapInArrow(_all(width), "s long").groupBy("s").count().where("count >= 3")
    found = counts.orderBy(F.desc("count"), "s").limit(KNOWN).toPandas()
    s = found["s"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(s)
    return s[order], found["count"].to_numpy(np.int64)[order]


def parity(own: np.ndarray) -> bytes:
    """A sketch of a set: the parity of its members in each of at least twice as many cells.

    Two sketches differ in no more cells than the sets have members that the other lacks.
    """
    bits = max(PARITY, min(WIDEST, 2 * len(own) - 1).bit_length())
    cell = (own * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    return np.packbits(np.bincount(cell.astype(np.int64), minlength=1 << bits) & 1).tobytes()


def _halved(sketch: np.ndarray) -> np.ndarray:
    return np.packbits(np.bitwise_xor.reduce(np.unpackbits(sketch).reshape(-1, 2), axis=1))


def apart(a: bytes, b: bytes) -> int:
    """Cells in which two sketches differ, the larger one folded to the size of the other."""
    x, y = (np.frombuffer(s, np.uint8) for s in (a, b))
    while len(x) > len(y):
        x = _halved(x)
    while len(y) > len(x):
        y = _halved(y)
    return int(np.bitwise_count(x ^ y).sum())


def _prefixes(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, text_key, node, n, fp, sketch, pre`` of each row of ``doc_id, text``; equal sets have one node.

    The order of a prefix is by the count in the sample, then by hash: rare shingles come first,
    so passages and templates seldom make two documents candidates.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_known(docs, width))
    names = ["doc_id", "text_key", "node", "n", "fp", "sketch", "pre"]

    @tidy
    def run(batches):
        known, counts = shared.value
        for batch in small_batches(batches):
            nodes, sizes, prints, sketches, prefixes = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                hashes = simhash.shingle_hashes(text, width)
                own = np.unique(hashes)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                sizes.append(len(own))
                prints.append(simhash.fingerprint_of(hashes))
                sketches.append(parity(own))
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    own = own[np.lexsort((own, np.where(known[at] == own, counts[at], 0)))]
                prefixes.append(own[: prefix_length(len(own))].view(np.int64))
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, prints)]
            columns = [signed[0], pa.array(sizes, pa.int32()), signed[1], pa.array(sketches, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)

    chosen = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return chosen.mapInArrow(run, "doc_id long, text_key long, node long, n int, fp long, sketch binary, pre array<long>")


def _entries(batches):
    """``node, n, p, s`` for each entry of the prefixes; a task sends a node once, as long as it remembers."""
    sent: set[int] = set()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            keep = []
            for i, node in enumerate(part.column(0).to_pylist()):
                if node not in sent:
                    keep.append(i)
                    sent.add(node)
            if len(sent) > SENT:
                sent.clear()
            part = part.take(pa.array(keep, pa.int64()))
            sizes = pyarrow.compute.list_value_length(part.column(2)).to_numpy()
            own = np.repeat(np.arange(len(sizes)), sizes)
            p = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            picked = pa.array(own)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(picked), part.column(1).take(picked), pa.array(p.astype(np.int32)), part.column(2).flatten()], ["node", "n", "p", "s"]
            )


def _repeated(batches):
    """Rows of ``node, n, p, s`` whose s another node has, each once; they come sorted by s and node."""
    held, again = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        s, node = table.column("s").to_numpy(), table.column("node").to_numpy()
        table = table.filter(pa.array(np.r_[True, (s[1:] != s[:-1]) | (node[1:] != node[:-1])])).combine_chunks()
        s = table.column("s").to_numpy()
        same = s[1:] == s[:-1]
        keep = np.r_[again, same] | np.r_[same, False]
        held, again = table.slice(len(s) - 1).to_batches()[0], bool(keep[-1])
        keep[-1] = False
        if keep.any():
            yield from table.filter(pa.array(keep)).to_batches()
    if again:
        yield held


def _alike(x: str, y: str):
    """Whether the sizes of two sets leave room for similarity."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (nx * UP <= ny * DOWN) & (ny * UP <= nx * DOWN)


def _possible(x: str, y: str):
    """Whether two entries of one shingle leave room for similarity, by sizes and places."""
    nx, ny, px, py = (F.col(c) for c in (f"{x}.n", f"{y}.n", f"{x}.p", f"{y}.p"))
    most = F.least(px, py) + 1 + F.least(nx - px - 1, ny - py - 1)
    return _alike(x, y) & (most * (UP + DOWN) >= (nx + ny) * UP)


def _ordered(pairs: DataFrame) -> DataFrame:
    """``a, b, c``: the pairs, and how many of the given rows each has."""
    a, b = F.col("x.node"), F.col("y.node")
    return pairs.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).groupBy("a", "b").agg(F.count("*").alias("c"))


def _near(batches):
    """Pairs that their sketches leave room for: sets of a similarity of UP / DOWN differ in few members."""
    for batch in batches:
        n = batch.column("n_a").to_numpy().astype(np.int64) + batch.column("n_b").to_numpy()
        a, b = (batch.column(k).to_pylist() for k in ("sketch_a", "sketch_b"))
        keep = np.zeros(len(n), bool)
        least = 1 << (PARITY - 3)
        small = np.flatnonzero([len(x) == len(y) == least for x, y in zip(a, b, strict=True)])
        if len(small):
            x, y = (np.frombuffer(b"".join(s[i] for i in small), np.uint64).reshape(-1, least // 8) for s in (a, b))
            keep[small] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) * (UP + DOWN) <= n[small] * (DOWN - UP)
        for i in np.setdiff1d(np.arange(len(n)), small).tolist():
            keep[i] = apart(a[i], b[i]) * (UP + DOWN) <= n[i] * (DOWN - UP)
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in ("a", "b", "key_a", "key_b")], ["a", "b", "key_a", "key_b"])


def _verified(width: int):
    @tidy
    def run(batches):
        last, held = None, None
        for batch in small_batches(batches, 128):
            a, b, text_a, text_b = (batch.column(k).to_pylist() for k in ("a", "b", "text_a", "text_b"))
            keep = []
            for x, s, t in zip(a, text_a, text_b, strict=True):
                if x != last:
                    last, held = x, shingle_set(s, width)
                other = shingle_set(t, width)
                keep.append(len(np.intersect1d(held, other, assume_unique=True)) * (UP + DOWN) >= (len(held) + len(other)) * UP)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in ("a", "b")], ["a", "b"])

    return run


def _bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs ``a, b, c`` of nodes of which c entries are in both prefixes, if that leaves room for similarity.

    An entry that both sets have, but not both prefixes, comes after the end of the prefix that ends first.
    """
    of = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), (F.col("n") - F.col("pre")).alias(f"rest_{k}"))
    joined = pairs.join(of("b"), "b").join(of("a"), "a")
    return joined.where((F.col("c") + F.greatest("rest_a", "rest_b")) * (UP + DOWN) >= (F.col("n_a") + F.col("n_b")) * UP).select("a", "b")


def _similar(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """Those of the pairs ``a, b`` of nodes whose whole sets are similar.

    Sketches rule most of the others out; the texts of the rest meet and are compared.
    """
    of = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"sketch_{k}"), F.col("text_key").alias(f"key_{k}"))
    left = cut(pairs.join(of("b"), "b").join(of("a"), "a").mapInArrow(_near, "a long, b long, key_a long, key_b long"))
    wanted = cut(left.select(F.explode(F.array("key_a", "key_b")).alias("text_key")).distinct())
    chosen = F.broadcast(wanted) if wanted.count() <= BROADCAST else wanted
    texts = docs.select(F.xxhash64("text").alias("text_key"), "text").join(chosen, "text_key", "left_semi")
    texts = cut(texts.groupBy("text_key").agg(F.first("text").alias("text")))
    text = lambda k: texts.select(F.col("text_key").alias(f"key_{k}"), F.col("text").alias(f"text_{k}"))
    met = left.join(text("b"), "key_b").join(text("a"), "key_a").select("a", "b", "text_a", "text_b")
    return cut(met.mapInArrow(_verified(width), "a long, b long"))


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """``a, b``: candidates by covering masks; nodes of near fingerprints, each with the first of its own and of its star."""
    first = cut(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    same = nodes.join(first, "fp").where("node <> first").select("node", "first")
    of = lambda k: first.select(F.col("fp").alias(k), F.col("first").alias(f"node_{k}"))
    near = simhash.links(first.select("fp")).join(of("a"), "a").join(of("b"), "b").select("node_a", "node_b")
    both = same.union(near).toDF("x", "y")
    return both.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def links(docs: DataFrame, rows: DataFrame, width: int = 5) -> DataFrame:
    """``node, root``: components of all pairs of sets with similarity 0.8 or more.

    Fingerprints within 4 bits are the first candidates: they join most members of large
    groups at one pair a member. Fingerprints miss pairs near the limit, so prefixes follow:
    similar sets share an entry of theirs. The members of each shared shingle that are not
    yet in one component are compared with one hub of it, in rounds with other hubs while
    many pairs are open. Then all pairs of a shingle that are still apart are compared, so no
    similar pair is missed. Every candidate is decided by its whole sets.
    """
    rows = rows.where("n > 0")
    nodes = cut(rows.withColumn("pre", F.size("pre")).groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "pre", "fp", "sketch", "text_key"))))
    posts = rows.select("node", "n", "pre").mapInArrow(_entries, "node long, n int, p int, s long")
    posts = cut(posts.repartition("s").sortWithinPartitions("s", "node").mapInArrow(_repeated, "node long, n int, p int, s long"))
    n = posts.count()
    tested = cut(_by_fingerprint(nodes))
    edges = _similar(tested, docs, nodes, width)
    before = None
    for k in range(HUB_ROUNDS + 1):
        roots = cut(connected_components(edges))
        entries = posts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        groups = entries.groupBy("s", "root").agg(F.count("*").alias("m"))
        open_ = groups.groupBy("s").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("q"), F.count("*").alias("g")).where("g > 1")
        open_ = cut(open_)
        pairs = float(open_.agg(F.sum((F.col("m") * F.col("m") - F.col("q")) / 2)).first()[0] or 0)
        if not pairs:
            break
        entries = entries.join(open_.select("s"), "s")
        if pairs <= PAIRS_PER_ENTRY * n or k == HUB_ROUNDS or (before is not None and pairs > GAIN * before):
            # every list that has both of an open pair is open, so the pair is counted as often as prefixes share entries
            entries = cut(entries)
            found = _ordered(entries.alias("x").join(entries.alias("y"), "s").where("x.node < y.node and x.root <> y.root").where(_alike("x", "y")))
            fresh = cut(_bounded(found, nodes).join(tested, ["a", "b"], "left_anti"))
            edges = edges.unionByName(_similar(fresh, docs, nodes, width))
            break
        hub = F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node", "n", "p", "root")
        hubs = entries.groupBy("s").agg(F.min(hub).alias("y"))
        found = _ordered(entries.alias("x").join(hubs, "s").where("x.root <> y.root").where(_possible("x", "y")))
        fresh = cut(found.select("a", "b").join(tested, ["a", "b"], "left_anti"))
        edges = edges.unionByName(_similar(fresh, docs, nodes, width))
        tested, before = tested.unionByName(fresh), pairs
        gc.collect()  # the driver lets go of the plans of this round
    return connected_components(edges)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """``doc_id, text_key, node, group`` of each row; text_key is xxhash64 of the text's bytes.

    Blank and null texts are one group. Repeated rows stay repeated.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("text"))
    rows = cut(_prefixes(chosen, width))
    roots = links(chosen, rows, width)
    return rows.join(roots, "node", "left").select("doc_id", "text_key", "node", F.coalesce("root", "node").alias("group"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their group; rows without an id are kept.

    Rows that share an id but not a text are documents of their own, and the lesser key of
    the text decides between them.
    """
    groups = cut(near_groups(docs, id_col, text_col, width))
    own = F.struct("doc_id", "text_key")
    first = groups.where("doc_id is not null").groupBy("group").agg(F.min(own).alias("first"))
    gone = groups.join(first, "group").where(own != F.col("first")).select(F.col("doc_id").alias("_gone"), F.col("text_key").alias("_text")).distinct()
    same = (docs[id_col].cast("long") == gone["_gone"]) & (F.xxhash64(as_bytes(text_col)) == gone["_text"])
    return docs.join(gone, same, "left_anti")
