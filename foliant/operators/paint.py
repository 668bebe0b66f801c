"""Computed paint: what declarations win, and what is inherited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.lineage import kept
from foliant.functions.scalars import rgb

SIDES = ["top", "right", "bottom", "left"]


def expand_shorthand(prop: Column, value: Column) -> Column:
    """Longhand (prop, value) pairs of a declaration."""
    own = lambda p, x: F.struct(p.alias("prop"), x.alias("value"))
    sides = F.array(*[own(F.lit(f"border-{s}-color"), value) for s in SIDES])
    return F.when(prop == "border-color", sides).when(prop == "background", F.array(own(F.lit("background-color"), value))).otherwise(F.array(own(prop, value)))


def cascade(declarations: DataFrame) -> DataFrame:
    """``doc_id, node_id, prop, value`` that wins: the highest layer, in it the last written.

    ``declarations``: ``doc_id, node_id, layer, ord, prop, value``. One partial aggregation
    by node and property. Colours are normalised.
    """
    long = declarations.select("doc_id", "node_id", "layer", "ord", F.explode(expand_shorthand(F.col("prop"), F.col("value"))).alias("d"))
    won = long.groupBy("doc_id", "node_id", "d.prop").agg(F.max_by("d.value", F.struct("layer", "ord")).alias("value"))
    return won.withColumn("value", F.coalesce(rgb(F.col("value")), F.col("value")))


def inherited(nodes: DataFrame, won: DataFrame, prop: str = "color") -> DataFrame:
    """``doc_id, node_id, value`` with a parent's value where a node has none of its own.

    Nodes that are still looking ask the node they look at for its value, or else for where
    that one looks: each round doubles the way, so the rounds grow with the logarithm of the
    depth. Every round is written to the shared folder. A cycle of parents is an error.
    """
    own = won.where(F.col("prop") == prop).select("doc_id", "node_id", "value")
    elements = nodes.where(F.col("kind") == "element").select("doc_id", "node_id", F.col("parent_id").alias("at"))
    state = kept(elements.join(own, ["doc_id", "node_id"], "left"))
    rounds = max(1, state.count()).bit_length() + 1
    for _ in range(rounds):
        looking = (F.col("value").isNull()) & (F.col("at") >= 0)
        if state.where(looking).isEmpty():
            return state.where("value is not null").select("doc_id", "node_id", "value")
        asked = state.select("doc_id", F.col("node_id").alias("at"), F.col("value").alias("there"), F.col("at").alias("next"))
        met = state.where(looking).join(asked, ["doc_id", "at"], "left")
        # a parent that is no node is the end of the way
        met = met.select("doc_id", "node_id", F.coalesce("next", F.lit(-1)).alias("at"), F.col("there").alias("value"))
        state = kept(state.where(~looking).unionByName(met))
    raise ValueError("the parents of some nodes form a cycle")
