"""Guards and repairs of edits before they become events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import vocabulary as v
from foliant.functions.scalars import minted_id, valid_chunk_id


def anchors(units: DataFrame) -> DataFrame:
    """``doc_id, id, container, shell, after``: what each unit stands behind in its container's part."""
    order = Window.partitionBy("doc_id", "container", "shell").orderBy("ord")
    return units.select("doc_id", "id", "container", "shell", F.lag("id").over(order).alias("after"))


def refusals(edits: DataFrame, units: DataFrame, cards: DataFrame) -> DataFrame:
    """``edits`` with ``refused``: why an edit cannot be made, null if it can.

    ``edits``: ``doc_id, action, target, payload, container, after``; ``units``: ``doc_id, id, serial,
    container, shell, ord, tag``; ``cards``: ``doc_id, after`` of pending cards. A target must exist,
    a modification must change something, a move must move, and nothing may wait behind what is deleted.
    """
    live = anchors(units).join(units.select("doc_id", "id", "serial"), ["doc_id", "id"])
    live = live.select("doc_id", F.col("id").alias("target"), "serial", F.col("container").alias("in_now"), F.col("after").alias("after_now"), F.lit(True).alias("there"))
    waited = cards.where("after is not null").select("doc_id", F.col("after").alias("target"), F.lit(True).alias("waited")).distinct()
    place = units.select("doc_id", F.col("id").alias("after"), F.col("container").alias("after_in")).distinct()
    own = edits.join(live, ["doc_id", "target"], "left").join(waited, ["doc_id", "target"], "left").join(place, ["doc_id", "after"], "left")
    placed = F.col("action").isin("add", "move")
    same = F.col("after").eqNullSafe(F.col("after_now")) & (F.col("container") == F.col("in_now"))
    refused = (
        F.when((F.col("action") == "add") & F.col("there").isNotNull(), "the id is taken")
        .when((F.col("action") != "add") & F.col("there").isNull(), "no such target")
        .when((F.col("action") == "modify") & (F.col("payload") == F.col("serial")), "nothing changes")
        .when((F.col("action") == "delete") & F.col("waited").isNotNull(), "a pending card stands behind it")
        .when(placed & F.col("after").isNotNull() & ~F.coalesce(F.col("after_in") == F.col("container"), F.lit(False)), "no such place")
        .when((F.col("action") == "move") & (F.col("after") == F.col("target")), "behind itself")
        .when((F.col("action") == "move") & same, "nothing moves")
    )
    return own.withColumn("refused", refused).select(*edits.columns, "refused")


def misplaced_members(units: DataFrame, containers: DataFrame) -> DataFrame:
    """Units that lists and tables do not hold: ``doc_id, id, tag, container_tag``."""
    own = units.join(containers.select("doc_id", F.col("id").alias("container"), F.col("tag").alias("container_tag")), ["doc_id", "container"])
    fits = F.lit(False)
    for tag, homes in v.ITEM_CARRIERS.items():
        fits = fits | ((F.col("tag") == tag) & F.col("container_tag").isin(homes))
    return own.where((F.col("container_tag") != "aim-slide") & ~fits).select("doc_id", "id", "tag", "container_tag")


def id_repairs(units: DataFrame, recorded: DataFrame, alive: DataFrame) -> DataFrame:
    """``doc_id, ord, old, new`` of units that need another id.

    An id is kept by the first unit that has it, if it is valid and, when the log or a card has
    used it, still expected to be alive. New ids are minted from where the unit is, so that a
    repeated run mints the same.
    """
    known = recorded.select("doc_id", "id", F.lit(True).alias("used")).distinct().join(alive.select("doc_id", "id", F.lit(True).alias("alive")).distinct(), ["doc_id", "id"], "left")
    nth = F.row_number().over(Window.partitionBy("doc_id", "id").orderBy("ord"))
    own = units.select("doc_id", "ord", "id", nth.alias("nth")).join(known, ["doc_id", "id"], "left")
    usable = F.coalesce(valid_chunk_id(F.col("id")), F.lit(False)) & (F.col("nth") == 1) & (F.col("used").isNull() | F.col("alive").isNotNull())
    made = minted_id(F.col("doc_id").cast("string"), F.col("ord").cast("string"), F.coalesce("id", F.lit("")))
    return own.where(~usable).select("doc_id", "ord", F.col("id").alias("old"), made.alias("new"))


def wrapped_history(log: DataFrame, version: str, gated: DataFrame) -> DataFrame:
    """``log`` with an event that raises the version before the first event that needs it.

    ``gated``: ``doc_id, seq`` of events that need ``version``. The extra event takes the number of the
    first one, and later ones move up by one.
    """
    first = gated.groupBy("doc_id").agg(F.min("seq").alias("_at"))
    own = log.join(first, "doc_id", "left")
    moved = own.withColumn("seq", F.when(F.col("seq") >= F.col("_at"), F.col("seq") + 1).otherwise(F.col("seq"))).drop("_at")
    made = {"kind": F.lit("direct_edit"), "action": F.lit("modify"), "target": F.lit("aim:version"), "payload": F.lit(version)}
    extra = first.join(log.select("doc_id", "seq", *[c for c in log.columns if c not in ("doc_id", "seq")]), "doc_id").where(F.col("seq") == F.col("_at"))
    extra = extra.select(*[made[c].cast(t).alias(c) if c in made else F.col(c) if c in ("doc_id", "seq", "batch", "t") else F.lit(None).cast(t).alias(c) for c, t in log.dtypes])
    return moved.select(*log.columns).unionByName(extra)
