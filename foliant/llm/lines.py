"""Line deduplication over levelled sorted runs of line hashes; DataFrame and SQL functions only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import SPACES, cut, row_key

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["k1", "k2"]


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z lower-cased."""
    bare = F.btrim(line, F.lit(SPACES))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_hashes(docs: DataFrame, text_col: str = "text", key: list[str] | None = None) -> DataFrame:
    """``key..., pos, k1, k2, key_chars`` for each line of each text; null is one empty line.

    k1 and k2 are two 64-bit hashes of the line's key, key_chars its code points.
    """
    key = key or []
    split = docs.select(*key, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("pos", "line"))
    keyed = split.select(*key, "pos", line_key(F.col("line")).alias("line_key"))
    return keyed.select(
        *key,
        "pos",
        F.xxhash64("line_key").alias("k1"),
        F.xxhash64(F.lit(1), F.col("line_key")).alias("k2"),
        F.char_length("line_key").alias("key_chars"),
    )


class LineRuns:
    """Counts of documents by line hash, as sorted runs in levels.

    A run is a table bucketed and sorted by hash, so that batches and runs meet in merge
    joins without moving the run. ``add`` anti-joins a batch with what the runs already
    hold as settled (``limit`` documents or more in one run: more would change nothing)
    and stores the counts of the rest as a new run of level 0. When a level has ``fanout``
    runs they are merged, counts added, into one run of the next level; every row is thus
    rewritten once a level. Runs live in the session's warehouse, which all executors
    share, until ``drop``.

    With ``limit`` 1 every stored line is settled: ``add`` then stores only unseen lines.
    """

    def __init__(self, spark: SparkSession, limit: int, fanout: int = 4, buckets: int | None = None):
        self.spark, self.limit, self.fanout = spark, limit, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _store(self, counted: DataFrame, level: int) -> None:
        name = f"foliant_run_{uuid.uuid4().hex}"
        rows = counted.repartition(self.buckets, *KEY).sortWithinPartitions(*KEY)
        rows.write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(x) for level in self.levels for x in level]

    def totals(self) -> DataFrame | None:
        """``k1, k2, n``: documents by line over all runs; exact up to ``limit``, and at least ``limit`` beyond."""
        found = self.runs()
        if not found:
            return None
        whole = found[0]
        for x in found[1:]:
            whole = whole.unionByName(x)
        return whole.groupBy(*KEY).agg(F.sum("n").alias("n"))

    def add(self, batch: DataFrame) -> None:
        """Add ``k1, k2, doc``: the lines of new documents, with repeats inside a document or without."""
        counted = batch.select("doc", *KEY).distinct().groupBy(*KEY).agg(F.count("*").alias("n"))
        for run in self.runs():
            counted = counted.join(run.where(F.col("n") >= self.limit), KEY, "left_anti")
        self._store(counted, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            merged = self.spark.table(old[0])
            for x in old[1:]:
                merged = merged.unionByName(self.spark.table(x))
            self._store(merged.groupBy(*KEY).agg(F.sum("n").alias("n")), level + 1)
            for x in old:
                self.spark.sql(f"DROP TABLE {x}")
            level += 1

    def drop(self) -> None:
        for level in self.levels:
            for x in level:
                self.spark.sql(f"DROP TABLE IF EXISTS {x}")
        self.levels = []


def drop_common_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    at_least: int = 10,
    least_chars: int = 1,
    batches: int = 4,
    fanout: int = 4,
    keep_first: bool = False,
) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept``, the text without common lines.

    A line goes from every document if its key has ``least_chars`` code points and is in
    ``at_least`` documents; with ``keep_first`` it stays in the one of smallest id (null ids
    last), so that of many copies one keeps its text. The documents enter the runs in ``batches``. A null or empty
    text is one empty line; a text whose lines all go becomes empty. Rows of equal id and
    text count as one document and get equal results; rows that share an id only, or have
    none, are documents of their own. Other columns pass through, but for those of the three names.
    """
    spark = docs.sparkSession
    # the row travels in a struct, apart from the names used here
    keyed = docs.select(F.struct("*").alias("d"), row_key(id_col, text_col).alias("_row"), F.col(id_col).alias("_id"))
    lines = line_hashes(keyed, f"d.{text_col}", ["_row", "_id"]).where(F.col("key_chars") >= least_chars).drop("key_chars")
    lines = cut(lines)
    runs = LineRuns(spark, at_least, fanout)
    try:
        for i in range(batches):
            runs.add(lines.where(F.pmod("_row", F.lit(batches)) == i).select(F.struct("_row", "_id").alias("doc"), *KEY))
        common = cut(runs.totals().where(F.col("n") >= at_least).select(*KEY))
    finally:
        runs.drop()
    met = lines.join(common, KEY, "left_semi")
    if keep_first:
        met = cut(met)
        order = F.struct(F.coalesce(F.col("_id").cast("long"), F.lit((1 << 63) - 1)).alias("i"), F.col("_row").alias("r"))
        first = met.groupBy(*KEY).agg(F.min(order).alias("first"))
        met = met.withColumn("own", order).join(first, KEY).where(F.col("own") != F.col("first"))
    gone = met.groupBy("_row", "_id").agg(F.collect_list("pos").alias("_gone"))
    gone = gone.select(F.col("_row").alias("_row2"), F.col("_id").alias("_id2"), "_gone")
    joined = keyed.join(gone, (F.col("_row") == F.col("_row2")) & F.col("_id").eqNullSafe(F.col("_id2")), "left")
    text = F.coalesce(f"d.{text_col}", F.lit(""))
    split = F.split(text, "\n")
    # one evaluation of the split, whatever the number of lines
    parts = F.struct(split.alias("lines"), F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("_gone")).alias("at"))
    rebuilt = F.transform(F.array(parts), lambda p: F.array_join(F.transform(p["at"], lambda i: F.get(p["lines"], i)), "\n"))[0]
    made = {
        "n_lines": F.char_length(text) - F.char_length(F.translate(text, "\n", "")) + 1,
        "n_dropped": F.when(F.col("_gone").isNull(), 0).otherwise(F.size(F.array_distinct("_gone"))),
        "kept": F.when(F.col("_gone").isNull(), text).otherwise(rebuilt),
    }
    passed = [F.col("d")[c].alias(c) for c in docs.columns if c not in made]
    return joined.select(*passed, *(made[c].alias(c) for c in made))
