"""Views of plain tables as document tables; each is deterministic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.scalars import escape_text


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_chunks(documents: DataFrame) -> DataFrame:
    """``doc_id, ord, html, text``: a paragraph for each part between blank lines.

    Lines are stripped, empty ones dropped, escaped, and joined by breaks. One pass over the
    text, without a shuffle.
    """
    parts = F.split(F.col("text"), r"\n[ \t]*\n")
    lines = F.filter(F.transform(F.split(F.col("part"), "\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: x != "")
    own = documents.select("doc_id", F.posexplode(parts).alias("at", "part")).select("doc_id", "at", lines.alias("lines")).where(F.size("lines") > 0)
    return own.select(
        "doc_id",
        F.col("at").alias("ord"),
        F.concat(F.lit("<p>"), F.array_join(F.transform("lines", escape_text), "<br>"), F.lit("</p>")).alias("html"),
        F.array_join("lines", "\n").alias("text"),
    )


def event_log(events: DataFrame) -> DataFrame:
    """``doc_id, seq, kind, action, target, payload, before``: a flat log per user.

    ``before`` is what the target held; an add, or an edit after a delete, has none.
    """
    kind = F.when(F.col("event_type") == "purchase", "checkpoint").otherwise("direct_edit")
    action = F.expr("case event_type when 'signup' then 'add' when 'error' then 'delete' when 'purchase' then null else 'modify' end")
    own = events.select(
        F.col("user_id").alias("doc_id"),
        F.expr("row_number() over (partition by user_id order by ts, event_id)").cast("long").alias("seq"),
        kind.alias("kind"),
        action.alias("action"),
        F.get_json_object("props", "$.k").alias("target"),
        F.when(action.isin("add", "modify"), F.col("value")).alias("payload"),
    )
    before = F.expr("lag(payload) over (partition by doc_id, target, kind order by seq)")
    return own.withColumn("before", F.when(F.col("kind") == "direct_edit", before))


def turns(conversations: DataFrame, damaged: bool = False) -> DataFrame:
    """``doc_id, seq, actor_type, text``; damaged: without some rows, so that gaps appear."""
    rows = conversations.where((F.col("conv_id") + F.col("turn")) % 7 != 3) if damaged else conversations
    actor = F.expr("case role when 'user' then 'human' when 'assistant' then 'agent' else 'external' end")
    return rows.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("seq"), actor.alias("actor_type"), "text")


def cards(labels: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, card_ord, target, action, decision, proposed, applied``: reviewed proposals.

    The small table of payloads is joined by its number.
    """
    own = labels.select("doc_id", "quality", "toxic").withColumn("item", F.col("doc_id") % F.lit(benchmark.count()))
    found = own.join(benchmark.select(F.col("item_id").alias("item"), F.col("text").alias("proposed")), "item")
    return found.select(
        "doc_id",
        F.col("doc_id").alias("card_ord"),
        F.col("doc_id").alias("target"),
        F.lit("modify").alias("action"),
        F.when(F.col("quality") == 1, "accepted").otherwise("rejected").alias("decision"),
        "proposed",
        F.when(F.col("toxic") == 1, F.concat("proposed", F.lit(" (edited)"))).alias("applied"),
    )


def vector_lines(embeddings: DataFrame, documents: DataFrame) -> DataFrame:
    """``chunk, model, text_hash, vec``: cached vectors, every fifth with an outdated hash."""
    hashed = documents.select(F.col("doc_id").alias("chunk"), F.sha2("text", 256).alias("own"))
    rows = embeddings.select(F.col("vec_id").alias("chunk"), F.col("label").alias("model"), F.col("embedding").alias("vec"))
    old = F.when(F.col("chunk") % 5 == 0, F.lit("0")).otherwise(F.coalesce("own", F.lit("1")))
    return rows.join(hashed, "chunk", "left").select("chunk", "model", old.alias("text_hash"), "vec")
