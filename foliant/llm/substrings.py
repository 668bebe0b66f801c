"""Removal of repeated word windows behind a count-min sketch."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import as_bytes, row_key, small_batches, tidy

#: Cells of one shard of the sketch, as a power of two: what a merging task counts at once.
SHARD = 20
#: Largest width of a row of the sketch, as a power of two. Two rows of bits are then 128 MB,
#: the most that is ever sent to executors. More data only makes more estimates too high.
WIDEST = 29
DEPTH = 2
#: Entries a task gathers before it emits them, and bytes of the texts that it cuts into windows at once.
GATHERED, AT_ONCE = 1_000_000, 2 << 20
LAST = (1 << 63) - 1

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_BASE = 0x100000001B3


class Windows:
    """The windows of some texts: their starts, and the anchor that stands for each.

    The anchor of a window is the short gram of least hash in it, the leftmost of equals.
    Equal windows have equal anchors at equal offsets, so anchors repeat at least as often
    as windows do, while neighbouring windows share theirs.
    """

    def __init__(self, texts: list[bytes], window: int):
        words: list[bytes] = []
        sizes = []
        for text in texts:
            own = text.split()
            words += own
            sizes.append(len(own))
        self.words, self.window = words, window
        self.sizes = np.array(sizes, np.int64)
        self.firsts = np.cumsum(self.sizes) - self.sizes
        n = len(words)
        doc = np.repeat(np.arange(len(texts)), self.sizes)
        count = n - window + 1
        if count <= 0:
            self.starts = self.doc = np.zeros(0, np.int64)
            self.anchor, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            return
        gram = max(1, 2 * window // 5)
        with np.errstate(over="ignore"):
            g = self._grams(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n), gram)
            g = (g ^ (g >> np.uint64(32))) * _MIX[0]
            g ^= g >> np.uint64(29)
        least, at = self._least(g, window - gram + 1)
        inside = doc[:count] == doc[window - 1 :]
        self.starts = np.flatnonzero(inside)
        self.doc = doc[self.starts]
        self.anchor, self.at = least[:count][inside], at[:count][inside]

    @staticmethod
    def _grams(h: np.ndarray, k: int) -> np.ndarray:
        """Polynomial hashes of all runs of k words, by doubling."""
        out, have, power, width = None, 0, h, 1
        while k:
            if k & 1:
                if out is None:
                    out, have = power, width
                else:
                    m = len(h) - have - width + 1
                    out = out[:m] + power[have : have + m] * np.uint64(pow(_BASE, have, 1 << 64))
                    have += width
            k >>= 1
            if k:
                m = len(h) - 2 * width + 1
                power = power[:m] + power[width : width + m] * np.uint64(pow(_BASE, width, 1 << 64))
                width *= 2
        return out

    @staticmethod
    def _least(g: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The least of k neighbours from each place on, and where the leftmost one is."""
        at, width = np.arange(len(g)), 1
        while width < k:
            step = min(width, k - width)
            m = len(g) - step
            right = g[step:] < g[:m]
            at = np.where(right, at[step:], at[:m])
            g = np.where(right, g[step:], g[:m])
            width += step
        return g, at

    def anchors(self) -> np.ndarray:
        """Hashes of the places that are anchors, each place once."""
        if not len(self.at):
            return self.anchor
        return self.anchor[np.r_[True, self.at[1:] != self.at[:-1]]]

    def digests(self, which: np.ndarray) -> np.ndarray:
        """128-bit digests of the word sequences of some windows, as rows of two 64-bit numbers."""
        ends = np.cumsum(np.fromiter(map(len, self.words), np.int64, len(self.words))) + np.arange(len(self.words))
        whole = b" ".join(self.words)
        starts = self.starts[which]
        begin = np.where(starts > 0, ends[starts - 1] + 1, 0).tolist()
        of = xxhash.xxh128_digest
        joined = b"".join([of(whole[a:b]) for a, b in zip(begin, ends[starts + self.window - 1].tolist(), strict=True)])
        return np.frombuffer(joined, np.int64).reshape(-1, 2)


def _cells(anchors: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each anchor in each row of the sketch."""
    shift = np.uint64(64 - bits)
    with np.errstate(over="ignore"):
        return [(anchors * mix) >> shift for mix in _MIX]


def build_sketch(texts: DataFrame, window: int, bits: int) -> np.ndarray:
    """Rows of ``2**bits`` bits each: whether a cell was met at least twice.

    ``texts`` has one column of bytes. Every task sends, for each shard of each row, the
    cells it met and whether it met them again; merging adds these saturated counts.
    """
    shard_bits = min(SHARD, bits)

    @tidy
    def partial(batches):
        held: list[np.ndarray] = []
        size = 0

        def flush():
            cells, n = np.unique(np.concatenate(held), return_counts=True)
            shard = (cells >> np.uint64(shard_bits)).astype(np.int32)
            cell = (cells & np.uint64((1 << shard_bits) - 1)).astype(np.uint32) | np.where(n > 1, np.uint32(1 << 31), np.uint32(0))
            edge = np.r_[0, np.flatnonzero(np.diff(shard)) + 1, len(shard)]
            rows = [cell[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(shard[edge[:-1]]), pa.array(rows, pa.binary())], ["shard", "cells"])

        for batch in small_batches(batches, size=AT_ONCE):
            for row, cells in enumerate(_cells(Windows(batch.column(0).to_pylist(), window).anchors(), bits)):
                held.append(cells | np.uint64(row << bits))
                size += len(cells)
            if size > GATHERED:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def merge(batches):
        own, met = None, None

        def done():
            bitmap = np.packbits(met > 1, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([bitmap], pa.binary())], ["shard", "bitmap"])

        for batch in batches:
            for shard, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if shard != own:
                    if own is not None:
                        yield done()
                    own, met = shard, np.zeros(1 << shard_bits, np.uint8)
                x = np.frombuffer(cells, np.uint32)
                cell = x & np.uint32(0x7FFFFFFF)
                met[cell] = np.minimum(met[cell] + 1 + (x >> 31).astype(np.uint8), 2)
        if own is not None:
            yield done()

    parts = texts.mapInArrow(partial, "shard int, cells binary")
    merged = parts.repartition("shard").sortWithinPartitions("shard").mapInArrow(merge, "shard int, bitmap binary")
    sketch = np.zeros(DEPTH << (bits - 3), np.uint8)
    size = 1 << (shard_bits - 3)
    for row in merged.toLocalIterator():
        sketch[row.shard * size : (row.shard + 1) * size] = np.frombuffer(row.bitmap, np.uint8)
    return sketch


def estimated_repeated(anchors: np.ndarray, sketch: np.ndarray, bits: int) -> np.ndarray:
    """Where the sketch says that an anchor was met at least twice."""
    found = np.ones(len(anchors), bool)
    for row, cells in enumerate(_cells(anchors, bits)):
        at = cells | np.uint64(row << bits)
        found &= (sketch[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return found


def sketch_bits(n_bytes: int, widest: int = WIDEST) -> int:
    """Width of a row of the sketch for so many bytes of text: about four cells an anchor."""
    return max(16, min(widest, math.ceil(math.log2(max(1, n_bytes // 10)))))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, widest: int = WIDEST) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept``, the words left, joined by spaces.

    A word goes if a window over it also starts earlier: in a document of smaller id, or
    before in the same one. Null ids come last. Rows of equal id and text count as one
    document; of rows that share only their id, the earlier start comes first, then the
    smaller text hash. A null text has no words. Columns pass through, but for the three.

    First the anchors of all windows are counted in a sketch that never underestimates. Then
    windows whose anchor is estimated to repeat are grouped by a 96-bit digest of their
    words, and the first of each group is found; each task sends one row for a window that
    repeats within it, so that no group is larger than the number of tasks. Last, the
    windows estimated to repeat that are not first are removed.
    """
    spark = docs.sparkSession
    text = docs.select(as_bytes(text_col).alias("text"))
    size = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = sketch_bits(size, widest)
    shared = spark.sparkContext.broadcast(build_sketch(text, window, bits))

    @tidy
    def candidates(batches):
        held: list[np.ndarray] = []
        size = 0

        def flush():
            rows = np.concatenate(held)
            h2 = rows[:, 1] >> 32
            rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 2], h2, rows[:, 0]))]
            new = np.r_[True, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] >> 32 != rows[:-1, 1] >> 32)]
            rows = rows[new]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(4)], ["h1", "h2_start", "doc", "row"])

        for batch in small_batches(batches, size=AT_ONCE):
            found = Windows(batch.column(2).to_pylist(), window)
            which = np.flatnonzero(estimated_repeated(found.anchor, shared.value, bits))
            if not len(which):
                continue
            doc = found.doc[which]
            ids = batch.column(0).to_numpy()[doc]
            start = found.starts[which] - found.firsts[doc]
            h = found.digests(which)
            # 96 bits of the digest, the last 32 above the start: what is sent is what is sorted
            held.append(np.column_stack([h[:, 0], (h[:, 1] >> 32 << 32) | start, ids, batch.column(1).to_numpy()[doc]]))
            size += len(which)
            if size > GATHERED // 4:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def first(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2 = batch.column(0).to_numpy(), batch.column(1).to_numpy() >> 32
            new = np.r_[last is None or (h1[0], h2[0]) != last, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            last = (h1[-1], h2[-1])
            start = (batch.column(1).to_numpy() & 0xFFFFFFFF)[new]
            yield pa.RecordBatch.from_arrays([batch.column(3).filter(pa.array(new)), batch.column(2).filter(pa.array(new)), pa.array(start)], ["row", "doc", "start"])

    @tidy
    def remove(batches):
        for batch in small_batches(batches, size=AT_ONCE):
            text = batch.column(1).field(batch.column(1).type.get_field_index(text_col))
            found = Windows(text.cast(pa.binary()).fill_null(b"").to_pylist(), window)
            flagged = estimated_repeated(found.anchor, shared.value, bits)
            cover = np.zeros(len(found.words) + 1, np.int32)
            starts = found.starts[flagged]
            keep = np.zeros(len(found.words) + 1, bool)
            for at, own in zip(found.firsts.tolist(), batch.column(0).to_pylist(), strict=True):
                if own:
                    keep[np.asarray(own, np.int64) + at] = True
            starts = starts[~keep[starts]]
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + window, -1)
            gone = np.cumsum(cover)[:-1] > 0
            n_removed, kept = [], []
            for i, at in enumerate(found.firsts.tolist()):
                n = int(found.sizes[i])
                own = gone[at : at + n]
                words = found.words[at : at + n]
                n_removed.append(int(own.sum()))
                kept.append(b" ".join([w for w, x in zip(words, own.tolist(), strict=True) if not x] if n_removed[-1] else words))
            columns = [batch.column(1), pa.array(found.sizes), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["d", "n_words", "n_removed", "kept"])

    order = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    # ids tell documents apart, but where some repeat
    ids = docs.select(order.alias("doc")).groupBy("doc").agg(F.count("*").alias("n"))
    key = row_key(id_col, text_col) if ids.where("n > 1").limit(1).count() else F.lit(0).cast("long")
    sent = docs.select(order.alias("doc"), key.alias("row"), as_bytes(text_col).alias("text"))
    found = sent.mapInArrow(candidates, "h1 long, h2_start long, doc long, row long")
    found = found.repartition("h1").sortWithinPartitions("h1", F.shiftright("h2_start", 32), "doc", "h2_start", "row")
    firsts = found.mapInArrow(first, "row long, doc long, start long")
    firsts = firsts.groupBy("row", "doc").agg(F.collect_list(F.col("start").cast("int")).alias("starts"))
    rows = docs.select(F.struct("*").alias("d"), order.alias("doc"), key.alias("row"))
    joined = rows.join(firsts, ["row", "doc"], "left").select("starts", "d")
    schema = T.StructType([rows.schema["d"], *(T.StructField(x, T.LongType()) for x in ("n_words", "n_removed")), T.StructField("kept", T.BinaryType())])
    made = ["n_words", "n_removed", "kept"]
    out = joined.mapInArrow(remove, schema).withColumn("kept", F.col("kept").cast("string"))
    return out.select(*(F.col("d")[c].alias(c) for c in docs.columns if c not in made), *made)
