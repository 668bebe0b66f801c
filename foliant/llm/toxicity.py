"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import as_bytes, give_back, small_batches, tidy
from foliant.llm.descent import descend

#: Lengths of the n-grams in bytes, and the hashed feature space as a power of two.
SIZES = (3, 4, 5, 6)
SPACE_BITS = 22
#: Bounds of the labelled sample that the classifier is fitted on.
SAMPLE_ROWS, SAMPLE_CHARS = 10_000, 20_000
FEATURES = 2000
THRESHOLD = 0.3
#: Bytes whose n-grams are made at once; each takes some hundred bytes meanwhile.
AT_ONCE = 1 << 19

_BASE, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def bare(text: bytes) -> bytes:
    """A-Z lower-cased, white space as single spaces, also at both ends."""
    return b" " + b" ".join(text.lower().split()) + b" "


def grams(texts: list[bytes], sizes=SIZES) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every n-gram of bare texts."""
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.fromiter(map(len, texts), np.int64, len(texts)))
    code = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64) + np.uint64(1)
    docs, found = [], []
    with np.errstate(over="ignore"):
        h = code
        for n in range(2, max(sizes) + 1):
            if len(code) < n:
                break
            h = h[:-1] * _BASE + code[n - 1 :]
            if n in sizes:
                inside = doc[: len(h)] == doc[n - 1 :]
                docs.append(doc[: len(h)][inside])
                mixed = (h[inside] + np.uint64(n)) * _MIX
                found.append((mixed ^ mixed >> np.uint64(31)) * _MIX >> np.uint64(64 - SPACE_BITS))
    if not docs:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(docs), np.concatenate(found).astype(np.int64)


def slices(texts: list[bytes], size: int, overlap: int):
    """Lists of (text, slice) of about ``size`` bytes in all; slices of a text overlap, so that every n-gram is whole in one."""
    held, total = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text)), size):
            held.append((i, text[at : at + size + overlap]))
            total += len(held[-1][1])
            if total >= size:
                yield held
                held, total = [], 0
    if held:
        yield held


@dataclass
class Model:
    features: np.ndarray
    weights: np.ndarray
    bias: float
    sizes: tuple[int, ...] = SIZES

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of the label; every feature counts once a text."""
        if not len(self.features):
            return np.full(len(texts), 1 / (1 + np.exp(-self.bias)))
        known = np.zeros(1 << SPACE_BITS, bool)
        known[self.features] = True
        met = []
        for held in slices([bare(t) for t in texts], AT_ONCE, max(self.sizes) - 1):
            of = np.array([i for i, _ in held], np.int64)
            doc, feature = grams([x for _, x in held], self.sizes)
            hit = known[feature]
            met.append(np.unique(of[doc[hit]] << SPACE_BITS | feature[hit]))
        pairs = np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64)
        doc, feature = pairs >> SPACE_BITS, pairs & ((1 << SPACE_BITS) - 1)
        at = np.searchsorted(self.features, feature)
        logit = self.bias + np.bincount(doc, self.weights[at], len(texts))
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def fit(texts: list[bytes], labels: list[int], features: int = FEATURES, alpha: float = 1.0, l2: float = 1e-3, steps: int = 300) -> Model:
    """A logistic classifier over binary n-grams scaled by r = log of their class rates' ratio.

    The features are those whose counts by class are least likely to be chance (largest
    log-likelihood ratio). Without examples of both classes the score is the label's rate.
    """
    y = np.asarray(labels, float)
    pos, neg = int(y.sum()), int(len(y) - y.sum())
    if not pos or not neg:
        rate = (pos + 1e-6) / (len(y) + 1) if len(y) else 1e-6
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(rate / (1 - rate))))
    # documents by feature and class, a few texts at a time
    seen = np.zeros((2, 1 << SPACE_BITS), np.int32)
    for at in range(0, len(texts), 64):
        doc, feature = grams([bare(t) for t in texts[at : at + 64]])
        pairs = np.unique(doc.astype(np.int64) << SPACE_BITS | feature)
        of = y[at + (pairs >> SPACE_BITS)].astype(np.int64)
        feature = pairs & ((1 << SPACE_BITS) - 1)
        for c in (0, 1):
            np.add.at(seen[c], feature[of == c], 1)
    met = np.flatnonzero(seen[0] + seen[1] > 1)

    def gain(k, n, rate):
        own = np.clip(k / n, 1e-12, 1 - 1e-12)
        whole = np.clip(rate, 1e-12, 1 - 1e-12)
        return k * np.log(own / whole) + (n - k) * np.log((1 - own) / (1 - whole))

    strength = np.empty(len(met))
    for at in range(0, len(met), 1 << 16):  # a few features at a time: the driver's memory is small
        q, p = (seen[c][met[at : at + (1 << 16)]].astype(float) for c in (0, 1))
        rate = (p + q) / (pos + neg)
        strength[at : at + (1 << 16)] = gain(p, pos, rate) + gain(q, neg, rate)
    best = np.sort(np.argsort(-strength, kind="stable")[:features])
    q, p = (seen[c][met[best]].astype(float) for c in (0, 1))
    del seen, strength
    r = np.log((p + alpha) / (pos + 2 * alpha)) - np.log((q + alpha) / (neg + 2 * alpha))
    chosen = met[best]
    known = np.full(1 << SPACE_BITS, -1, np.int32)
    known[chosen] = np.arange(len(chosen))
    rows, cols = [], []
    for at in range(0, len(texts), 64):
        doc, feature = grams([bare(t) for t in texts[at : at + 64]])
        col = known[feature]
        hit = col >= 0
        pairs = np.unique(doc[hit].astype(np.int64) << 32 | col[hit])
        rows.append(at + (pairs >> 32))
        cols.append(pairs & 0xFFFFFFFF)
    row, col = np.concatenate(rows), np.concatenate(cols)
    value = r[col]
    n = len(y)

    def loss(w):
        z = w[-1] + np.bincount(row, value * w[col], n)
        gap = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        grad = np.r_[np.bincount(col, value * gap[row], len(chosen)) / n + l2 * w[:-1], gap.mean()]
        return float(np.mean(np.logaddexp(0, z) - y * z) + l2 / 2 * (w[:-1] @ w[:-1])), grad

    w = descend(loss, np.r_[np.zeros(len(chosen)), np.log(pos / neg)], steps)
    w, bias = w[:-1], w[-1]
    return Model(chosen, w * r, float(bias))


def sample(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS,
) -> tuple[list[bytes], list[int]]:
    """At most ``rows`` labelled texts of at most ``chars`` code points, chosen by a hash of the id."""
    allowed = labels.where(~held_out(id_col) & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y"))
    # a share by hash first, so that no task sends many more ids than are chosen
    share = min(1.0, 1.1 * rows / max(1, allowed.count()))
    allowed = allowed.where(F.pmod(F.xxhash64(F.lit(7), F.col("_id")), F.lit(1 << 30)) < int(share * (1 << 30)))
    order = [F.xxhash64(F.lit(7), F.col("_id")), F.col("_id"), F.col("_y")]
    # bounded: the ids of the sample are at most ``rows``
    chosen = F.broadcast(allowed.orderBy(*order).limit(rows))
    texts = docs.where(F.char_length(F.coalesce(text_col, F.lit(""))) <= chars).select(F.col(id_col).alias("_id"), as_bytes(text_col).alias("_t"))
    found = texts.join(chosen, "_id").orderBy(*order, F.xxhash64("_t")).limit(rows).select("_t", "_y").toArrow()
    return found.column("_t").to_pylist(), found.column("_y").to_pylist()


def held_out(id_col: str):
    """Whether a row's label is never learned from; so for rows without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD, **bounds) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``.

    The classifier is fitted on a bounded sample of labelled texts and scores whole texts,
    from nothing but their characters; a null text is scored as the empty one. Labels that
    are null or neither 0 nor 1 are not learned from. Repeated rows are scored each. Columns
    pass through, but for the three.
    """
    model = fit(*sample(docs, labels, id_col, text_col, label_col, **bounds))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    give_back()

    @tidy
    def run(batches):
        for batch in small_batches(batches):
            d = batch.column(0)
            text = d.field(d.type.get_field_index(text_col)).cast(pa.binary()).fill_null(b"")
            found = shared.value.score(text.to_pylist())
            yield pa.RecordBatch.from_arrays([d, pa.array(found, pa.float64())], ["d", "score"])

    rows = docs.select(F.struct("*").alias("d"))
    scored = rows.mapInArrow(run, T.StructType([rows.schema["d"], T.StructField("score", T.DoubleType())]))
    made = {
        "held_out": held_out(f"d.{id_col}"),
        "score": F.col("score"),
        "predicted": F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"),
    }
    return scored.select(*(F.col("d")[c].alias(c) for c in docs.columns if c not in made), *(x.alias(c) for c, x in made.items()))
