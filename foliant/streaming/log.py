"""Event logs as streams: live state and gaps per document."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edits_by_window(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """``window, doc_id, edits``: edits by document and hour, with late events up to the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "doc_id").agg(F.count("*").alias("edits"))


def last_sequence(events: DataFrame) -> DataFrame:
    """``doc_id, seq, gap``: a row for each event that does not follow the last one seen.

    The state of a document is one number; events of a batch are taken in order of ``seq``.
    """

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        for seq in sorted(x for b in batches for x in b["seq"]):
            if seq != last + 1:
                yield pd.DataFrame([(key[0], seq, seq - last - 1)], columns=["doc_id", "seq", "gap"])
            last = max(last, seq)
        state.update((last,))

    from pyspark.sql.streaming.state import GroupStateTimeout

    return events.groupBy("doc_id").applyInPandasWithState(follow, "doc_id long, seq long, gap long", "seq long", "append", GroupStateTimeout.NoTimeout)
