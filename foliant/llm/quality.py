"""Quality rules and cross-document line frequency; DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import SPACE_CLASS, SPACES, cut, row_key
from foliant.llm.lines import KEY, line_hashes

#: A document has this many words at least, and no more than this share of them in repeated windows.
LEAST_WORDS, MOST_REPEATS = 50, 50
#: A line is common on a host when so many of its documents have it, and this share of them, or so many whatever the share.
LINE_DOCS, LINE_SHARE, LINE_MOST = 10, 0.005, 100
#: A document is depleted when less than this share of its characters, or fewer of them, are on other lines.
LEAST_LEFT, LEAST_CHARS = 0.3, 200
#: Hashes of lines that are sent to every task at most.
SENT = 1 << 20


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where a lambda uses it many times."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE_CLASS}+"), lambda w: w != "")


def repeat_words(own: Column) -> Column:
    """Words of an array that lie in three-word windows found twice or more.

    Windows are sorted as one number each, the upper bits a hash and the lower ones the
    place, so equal windows become neighbours; neighbours with equal hashes are compared
    word by word. What repeats is put in order again, and the covered places are summed.
    """
    n = F.size(own)
    bits = F.length(F.bin(n.cast("long"))).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    shift = F.call_function

    def coded(p: Column) -> Column:
        w = p["w"]
        return F.transform(
            F.sequence(F.lit(0), p["n"] - 3),
            lambda i: F.coalesce(
                shift("shiftleft", F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), p["b"]).bitwiseOR(i.cast("long")),
                F.lit(0).cast("long"),
            ),
        )

    def same(p: Column, x: Column, y: Column) -> Column:
        """Whether two coded windows are of equal words."""
        i, j = x.bitwiseAND(p["m"]).cast("int"), y.bitwiseAND(p["m"]).cast("int")
        equal = shift("shiftrightunsigned", x, p["b"]) == shift("shiftrightunsigned", y, p["b"])
        for k in range(3):
            equal = equal & (F.get(p["w"], i + k) == F.get(p["w"], j + k))
        return F.coalesce(equal, F.lit(False))

    def marked(p: Column, order: Column) -> Column:
        """Places of the windows that equal a neighbour in the order."""
        flags = F.zip_with(order, F.slice(order, 2, F.size(order)), lambda x, y: same(p, x, y))

        def pick(q: Column) -> Column:
            either = lambda k: F.get(q["f"], k) | ((k > 0) & F.get(q["f"], F.greatest(k - 1, F.lit(0))))
            return F.filter(
                F.transform(q["o"], lambda x, k: F.when(either(k), x.bitwiseAND(p["m"])).otherwise(F.lit(-1).cast("long"))), lambda x: x >= 0
            )

        return _let(F.struct(order.alias("o"), flags.alias("f")), pick)

    def covered(places: Column) -> Column:
        gaps = F.zip_with(places, F.slice(places, 2, F.size(places)), lambda x, y: F.least(F.lit(3).cast("long"), y - x))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, x: total + x)

    def counted(p: Column) -> Column:
        return _let(F.sort_array(_let(F.sort_array(coded(p)), lambda order: marked(p, order))), covered)

    whole = F.struct(own.alias("w"), n.alias("n"), bits.alias("b"), mask.alias("m"))
    return F.when(n < 4, F.lit(0).cast("long")).otherwise(_let(whole, counted))


def base_statistics(text: Column) -> dict[str, Column]:
    """The base columns of a text that is not null."""
    counted = _let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r")))
    full = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return {
        "n_words": counted["n"],
        "word_chars": F.char_length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": _let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": counted["r"],
    }


def line_depletion(
    docs: DataFrame, id_col: str, text_col: str, host_col: str,
    line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, line_most: int = LINE_MOST, sent: int = SENT,
) -> DataFrame:
    """``row, id, host, common_chars``: code points on lines that are common on the host, for documents that have some.

    Lines are first counted as often as they occur, by one hash of the line and its host. Only
    those that occur ``line_docs`` times may be common, so they alone are then counted by
    documents. Their hashes are sent to the tasks if they are at most ``sent``, else joined.
    """
    keyed = docs.select(row_key(id_col, text_col).alias("row"), F.col(id_col).alias("id"), F.coalesce(host_col, F.lit("")).alias("host"), F.col(text_col).alias("text"))
    lines = line_hashes(keyed, "text", ["row", "id", "host"]).where("key_chars > 0").withColumn("line", F.xxhash64("host", *KEY))
    often = cut(lines.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= line_docs).select("line"))
    often = F.broadcast(often) if often.count() <= sent else often.hint("merge")
    lines = cut(lines.join(often, "line", "left_semi").groupBy("row", "id", "host", *KEY).agg(F.sum("key_chars").alias("chars")))
    # equal rows gave their lines several times over
    own = cut(keyed.groupBy("row", "id", "host").agg(F.count("*").alias("times")))
    hosts = own.groupBy("host").agg(F.count("*").alias("host_docs"))
    found = lines.groupBy("host", *KEY).agg(F.count("*").alias("n")).where(F.col("n") >= line_docs)
    common = found.join(hosts, "host").where(F.col("n") >= F.least(F.col("host_docs") * line_share, F.lit(line_most))).select("host", *KEY)
    lost = lines.join(common, ["host", *KEY], "left_semi").groupBy("row", "id", "host").agg(F.sum("chars").alias("chars"))
    times = own.where("times > 1").select(F.col("row").alias("row2"), F.col("id").alias("id2"), F.col("host").alias("host2"), "times")
    same = (F.col("row") == F.col("row2")) & F.col("id").eqNullSafe(F.col("id2")) & (F.col("host") == F.col("host2"))
    return lost.join(times, same, "left").select("row", "id", "host", F.expr("chars div coalesce(times, 1)").alias("common_chars"))


def quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, least_left: float = LEAST_LEFT, least_chars: int = LEAST_CHARS,
) -> DataFrame:
    """One row per row of ``docs``: the base columns, ``base_failed``, ``common_chars`` and ``kept``.

    Lines are normalised (white space off both ends, A-Z lower-cased), hashed, and counted by
    documents of a host; those above both limits are taken away, and a document that keeps
    too few of its characters is rejected. A null or blank text has no words and fails; a
    null host is the host with the empty name. Rows of equal id and text count as one
    document, and each gets the result.
    """
    text = F.coalesce(text_col, F.lit(""))
    line_chars = F.aggregate(F.split(text, "\n"), F.lit(0).cast("long"), lambda total, x: total + F.char_length(F.btrim(x, F.lit(SPACES))))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("row"), F.coalesce(host_col, F.lit("")).alias("host"),
        *(c.alias(k) for k, c in base_statistics(text).items()), line_chars.alias("line_chars"),
    )
    lost = line_depletion(docs, id_col, text_col, host_col, line_docs, line_share)
    same = (rows["row"] == lost["row"]) & rows["doc_id"].eqNullSafe(lost["id"]) & (rows["host"] == lost["host"])
    joined = rows.join(lost, same, "left").drop("row", "id", "host")
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATS)
    left = F.col("line_chars") - F.col("common_chars")
    depleted = (F.col("common_chars") > 0) & ((left < F.col("line_chars") * least_left) | (left < least_chars))
    return joined.withColumns({
        "base_failed": failed,
        "common_chars": F.coalesce("common_chars", F.lit(0)),
        "kept": ~failed & ~F.coalesce(depleted, F.lit(False)),
    }).drop("line_chars")
