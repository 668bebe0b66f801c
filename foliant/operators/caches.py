"""Caches kept beside documents: contents, vectors, assets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.scalars import asset_id

HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]


def contents(constructs: DataFrame, inside: DataFrame) -> DataFrame:
    """``doc_id, ord, title, level, chunks`` from ``doc_id, ord, id, tag, text``.

    A heading begins a section; a slide is an entry of its own and ends the section, so what
    follows it begins one without title, as does what comes before any heading. A slide's
    title is its first heading, and its chunks are itself and its children with an id.
    ``inside`` has the elements within slides: ``doc_id, ord`` of the slide, ``at`` (their
    order), ``depth`` (1 for children), ``id, tag, text``.
    """
    order = Window.partitionBy("doc_id").orderBy("ord")
    slide = F.col("tag") == "aim-slide"
    heading = F.when(F.col("tag").isin(HEADINGS), F.struct("at", F.col("text").alias("title")))
    child = F.when((F.col("depth") == 1) & (F.col("id").isNotNull()), F.struct("at", "id"))
    within = inside.groupBy("doc_id", "ord").agg(F.min(heading)["title"].alias("heading"), F.array_sort(F.collect_list(child)).alias("children"))
    own = constructs.join(within, ["doc_id", "ord"], "left")
    begins = F.col("tag").isin(HEADINGS) | slide | F.coalesce(F.lag(slide).over(order), F.lit(True))
    numbered = own.withColumn("section", F.sum(begins.cast("int")).over(order))
    first = F.min_by(F.struct("tag", "text", "heading", "children"), "ord")
    found = numbered.groupBy("doc_id", "section").agg(first.alias("f"), F.array_sort(F.collect_list(F.struct("ord", "id"))).alias("own"))
    is_slide, is_heading = F.col("f.tag") == "aim-slide", F.col("f.tag").isin(HEADINGS)
    level = F.when(is_heading, F.substr("f.tag", F.lit(2), F.lit(1)).try_cast("int")).otherwise(1)
    title = F.when(is_heading, F.col("f.text")).when(is_slide, F.coalesce("f.heading", F.lit(""))).otherwise("")
    chunks = F.when(is_slide & F.col("f.children").isNotNull(), F.concat(F.col("own.id"), F.col("f.children.id"))).otherwise(F.col("own.id"))
    return found.select("doc_id", F.col("section").alias("ord"), title.alias("title"), level.alias("level"), chunks.alias("chunks"))


def stale_vectors(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """``chunk, model, reason`` of cached vectors without a chunk, or of another text; ``chunks`` has ``chunk, text``."""
    own = chunks.select("chunk", F.sha2("text", 256).alias("own"))
    reason = F.when(F.col("own").isNull(), "orphaned").when(F.col("own") != F.col("text_hash"), "outdated")
    return vectors.select("chunk", "model", "text_hash").join(own, "chunk", "left").select("chunk", "model", reason.alias("reason")).where("reason is not null")


def upsert_vectors(lines: DataFrame) -> DataFrame:
    """The last line of each (chunk, model); ``line_ord`` tells the order."""
    return lines.groupBy("chunk", "model").agg(F.max_by(F.struct("text_hash", "line_ord"), "line_ord").alias("l")).select("chunk", "model", "l.text_hash", "l.line_ord")


def pack_assets(chunks: DataFrame, markup: str = "html") -> DataFrame:
    """``id, media, size`` of each distinct picture that is held in a data URI."""
    found = chunks.select(F.explode(F.regexp_extract_all(markup, F.lit(r"(data:image/[a-z+.-]+;base64,[A-Za-z0-9+/=]+)"), F.lit(1))).alias("uri")).distinct()
    blob = F.try_to_binary(F.substring_index("uri", ",", -1), F.lit("base64"))
    rows = found.select(blob.alias("blob"), F.regexp_extract("uri", "^data:([^;]+)", 1).alias("media")).where("blob is not null")
    return rows.groupBy(asset_id(F.col("blob")).alias("id")).agg(F.min("media").alias("media"), F.max(F.octet_length("blob")).alias("size"))


def dead_assets(assets: DataFrame, *payloads: DataFrame) -> DataFrame:
    """Assets that no payload (``doc_id, markup``) refers to: bodies, events and proposals alike."""
    used = None
    for p in payloads:
        own = p.select("doc_id", F.explode(F.regexp_extract_all("markup", F.lit(r'href="#(asset-[0-9a-f]{12})"'), F.lit(1))).alias("id"))
        used = own if used is None else used.unionByName(own)
    return assets.join(used.distinct(), ["doc_id", "id"], "left_anti")


def duplicate_texts(documents: DataFrame) -> DataFrame:
    """``hash, n, first_doc, last_doc`` of each text: content addressing over a corpus."""
    own = documents.select("doc_id", F.sha2("text", 256).alias("hash"))
    return own.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
