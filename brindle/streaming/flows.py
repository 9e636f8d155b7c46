"""Structured Streaming: micro-batch upserts, action pairing with keyed state, checked logs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..sources.jsonl import upsert_table


def upsert_stream(stream: DataFrame, path: str, key: str, checkpoint: str):
    """Lays each micro-batch over the table at path, then stops when the source is drained.

    A batch that is replayed after a failure gives the same table, since an upsert of the same
    rows changes nothing.
    """

    def write(batch: DataFrame, _: int) -> None:
        upsert_table(batch.sparkSession, path, batch, key)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


PAIR = "track string, action string, start long, end long, tool string"
STATE = "start long, tool string"


def pair_actions(stream: DataFrame) -> DataFrame:
    """(track, action, start, end, tool): ends joined to the start of their action.

    stream: (track, action, seq, kind, tool) with kind start or end. State is one row an open
    action and goes when the action ends; an end without a start has a null start.
    """

    def step(key, frames, state):
        open_ = state.get if state.exists else None
        out = []
        for frame in frames:
            for r in frame.sort_values("seq").itertuples():
                if r.kind == "start":
                    open_ = (int(r.seq), r.tool)
                else:
                    out.append((*key, open_[0] if open_ else None, int(r.seq), open_[1] if open_ else r.tool))
                    open_ = None
        if open_:
            state.update(open_)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["track", "action", "start", "end", "tool"]).astype({"start": "Int64", "end": "Int64"})

    return stream.groupBy("track", "action").applyInPandasWithState(step, PAIR, STATE, "append", GroupStateTimeout.NoTimeout)


def late_appends(log: DataFrame, tracks: DataFrame) -> DataFrame:
    """Log rows that came after their track was closed: none in a sound log."""
    return log.join(tracks.where("closed_seq is not null").select("track", "closed_seq"), "track").where("seq > closed_seq")


def windowed_counts(stream: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by time window and key, with late rows accepted for a while."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), by).count().select(F.col("window.start").alias("start"), by, "count")
