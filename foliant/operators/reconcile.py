"""Differences between the expected and the actual units of documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unit_changes(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``doc_id, id, change``: added, deleted, modified or same; one full outer join on both keys."""
    e = expected.select("doc_id", "id", F.col("serial").alias("was"), F.lit(True).alias("in_e"))
    a = actual.select("doc_id", "id", F.col("serial").alias("now"), F.lit(True).alias("in_a"))
    change = (
        F.when(F.col("in_e").isNull(), "added").when(F.col("in_a").isNull(), "deleted").when(~F.col("was").eqNullSafe(F.col("now")), "modified").otherwise("same")
    )
    return e.join(a, ["doc_id", "id"], "full_outer").select("doc_id", "id", change.alias("change"))


def edit_script(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``doc_id, step, action, id, after, payload``: edits that turn expected units into actual ones.

    Units have ``doc_id, ord, id, serial``. Deletions come first, from the end; then
    modifications in the expected order; then one walk over the actual order that adds what
    is missing and moves what does not stand behind its neighbour. Only the walk needs order.
    """

    def script(key: tuple, e: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        e, a = e.sort_values("ord"), a.sort_values("ord")
        was, now = dict(zip(e["id"], e["serial"], strict=True)), dict(zip(a["id"], a["serial"], strict=True))
        out = [("delete", x, None, None) for x in reversed(list(was)) if x not in now]
        out += [("modify", x, None, now[x]) for x in was if x in now and was[x] != now[x]]
        behind: dict = {}
        last = None
        for x in (x for x in was if x in now):
            behind[x] = last
            last = x
        follows = {b: x for x, b in behind.items()}
        last = None
        for x in now:
            if x not in behind:
                out.append(("add", x, last, now[x]))
            elif behind[x] != last:
                out.append(("move", x, last, None))
                if x in follows:  # close the gap it leaves
                    y = follows.pop(x)
                    behind[y] = behind[x]
                    follows[behind[x]] = y
                else:
                    follows.pop(behind[x], None)
            else:
                last = x
                continue
            y = follows.get(last)
            if y is not None:
                behind[y] = x
                follows[x] = y
            behind[x], follows[last] = last, x
            last = x
        return pd.DataFrame([(key[0], k, *row) for k, row in enumerate(out)], columns=["doc_id", "step", "action", "id", "after", "payload"])

    kinds = dict(expected.dtypes)
    schema = f"doc_id {kinds['doc_id']}, step long, action string, id {kinds['id']}, after {kinds['id']}, payload {kinds['serial']}"
    cols = ["doc_id", "ord", "id", "serial"]
    return expected.select(*cols).groupBy("doc_id").cogroup(actual.select(*cols).groupBy("doc_id")).applyInPandas(script, schema)


def log_refusals(log: DataFrame) -> DataFrame:
    """``doc_id, reason`` of logs that cannot be replayed from the start."""
    own = log.groupBy("doc_id").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count("*").alias("n"), F.countDistinct("seq").alias("d"))
    reason = F.when(F.col("n") != F.col("d"), "not ascending").when(F.col("last") - F.col("first") + 1 != F.col("n"), "gaps").when(F.col("first") != 1, "pruned")
    return own.select("doc_id", reason.alias("reason")).where("reason is not null")
