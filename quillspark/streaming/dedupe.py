"""Exact and near duplicates of a stream: the first document of each beginning or text, by arrival."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import corpus

KEPT = "doc_id long, ts timestamp, cleaned string, text_hash string"


def first_of_each(stream: DataFrame, delay: str = "1 hour", remember: str = "7 days") -> DataFrame:
    """doc_id, ts, cleaned and text_hash of the documents of a stream (doc_id, ts, text) that are long enough and new.

    Rows are keyed by how their cleaned text begins, those of short beginnings by the whole text: texts alike begin alike,
    so that one key does both steps of the deduplication. State is kept by key: a mark that it was seen, until the
    watermark (``delay`` behind the newest ts) is ``remember`` past its last document. Of one micro-batch the least
    doc_id is the first. State and progress are in the checkpoint, so that a restart goes on where it stopped.
    """
    good = corpus.drop_malformed(stream.withWatermark("ts", delay))
    keyed = good.select("doc_id", "ts", "cleaned", F.sha2("cleaned", 256).alias("text_hash"), F.coalesce(corpus.near_prefix(F.col("cleaned")), F.sha2("cleaned", 256)).alias("key"))
    kept_ms = int(pd.Timedelta(remember).total_seconds() * 1000)

    def own(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best, last = None, 0
        for rows in parts:
            row = rows.sort_values(["doc_id", "text_hash"], na_position="last").iloc[:1]
            last = max(last, int(rows["ts"].max().timestamp() * 1000))
            best = row if best is None else pd.concat([best, row]).sort_values(["doc_id", "text_hash"], na_position="last").iloc[:1]
        new = not state.exists
        state.update((True,))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + kept_ms)
        if new and best is not None:
            yield best[["doc_id", "ts", "cleaned", "text_hash"]]

    return keyed.groupBy("key").applyInPandasWithState(own, KEPT, "seen boolean", "append", GroupStateTimeout.EventTimeTimeout)
