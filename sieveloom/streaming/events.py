"""Streams: an event log, versions with a bounded history, incremental upserts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PROGRESS = "at timestamp, kind string, step string, done long, total long"


def progress(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of progress events from a folder of JSON lines."""
    return spark.readStream.schema(PROGRESS).json(folder)


def step_counts(events: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events per step and window, with a watermark."""
    return events.withWatermark("at", late).groupBy(F.window("at", window).alias("w"), "step").agg(F.count(F.lit(1)).alias("n"), F.max("done").alias("done")).select(F.col("w.start").alias("start"), "step", "n", "done")


def bounded_history(edits: DataFrame, limit: int = 10) -> DataFrame:
    """A stream of (key, seq, text) entries: the state of a key is its last number and
    newest text, so an empty text or a repeat makes no entry."""

    def update(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, newest = state.get if state.exists else (0, "")
        rows: list[tuple[int, str]] = []
        for text in pd.concat(parts).sort_values("order")["text"]:
            text = (text or "").strip()
            if text and text != newest:
                seq, newest = seq + 1, text
                rows.append((seq, text))
        state.update((seq, newest))
        yield pd.DataFrame({"key": [key[0]] * len(rows[-limit:]), "seq": [s for s, _ in rows[-limit:]], "text": [t for _, t in rows[-limit:]]})

    return edits.groupBy("key").applyInPandasWithState(update, "key long, seq long, text string", "seq long, newest string", "append", GroupStateTimeout.NoTimeout)


def upsert(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """Hand each new batch to ``merge``; stops when the source is read through."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
