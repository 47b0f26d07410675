"""Re-indexing after bursts of changes: keyed state with timers, and a record of a stream's progress."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RUN = "user_id long, start timestamp, stop timestamp, n long"


def merged(bursts: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """Bursts (start, stop, n) in order, those no more than ``gap`` apart made one."""
    out: list[tuple[int, int, int]] = []
    for a, b, n in sorted(bursts):
        if out and a - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(b, out[-1][1]), out[-1][2] + n)
        else:
            out.append((a, b, n))
    return out


def reindexed(events: DataFrame, gap: int = 1800, late: str = "1 hour") -> DataFrame:
    """``RUN``: one re-index for each burst of a user's changes, once ``gap`` seconds have passed without another.

    On a stream each user's open bursts are state; a timer at the end of the earliest runs when the watermark passes it. Changes that come later than ``late`` are dropped, as
    the watermark has it. On a batch all bursts are given, also those that no later event ends.
    """
    timed = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    if not events.isStreaming:
        # a window ends before its gap does, so that bursts just a gap apart need one microsecond more
        bursts = timed.where("user_id IS NOT NULL AND ts IS NOT NULL").groupBy("user_id", F.session_window("ts", f"{gap} seconds 1 microsecond"))
        return bursts.agg(F.min("ts").alias("start"), F.max("ts").alias("stop"), F.count(F.lit(1)).alias("n")).select("user_id", "start", "stop", "n")

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for f in frames:
            held += [(int(v), int(v), 1) for v in f["at"]]
        held = merged(held, gap * 1_000_000)
        mark = state.getCurrentWatermarkMs() * 1000
        done = [x for x in held if x[1] + gap * 1_000_000 < mark]
        open_ = [x for x in held if x[1] + gap * 1_000_000 >= mark]
        if open_:
            state.update(tuple(list(c) for c in zip(*open_, strict=True)))
            state.setTimeoutTimestamp((open_[0][1] + gap * 1_000_000) // 1000 + 1)
        elif state.exists:
            state.remove()
        if done:
            yield pd.DataFrame({"user_id": [key[0]] * len(done), "start": [a for a, _, _ in done], "stop": [b for _, b, _ in done], "n": [n for *_, n in done]})

    marked = timed.where("user_id IS NOT NULL").withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    out = marked.groupBy("user_id").applyInPandasWithState(run, "user_id long, start long, stop long, n long", "a array<long>, b array<long>, n array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("user_id", F.timestamp_micros("start").alias("start"), F.timestamp_micros("stop").alias("stop"), "n")


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All that a stream gives for what has arrived, written as Parquet and read back; a second call goes on where the first stopped."""
    q = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


class Progress(StreamingQueryListener):
    """What each batch of the streams of a session did: query, batch, input rows, rows of state, milliseconds."""

    def __init__(self) -> None:
        self.batches: list[tuple[str, int, int, int, int]] = []
        self.ended: list[str] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches.append((str(p.id), p.batchId, p.numInputRows, sum(s.numRowsTotal for s in p.stateOperators), int(p.batchDuration)))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.append(str(event.id))
