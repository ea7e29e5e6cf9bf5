"""The feed of a job's events: in order, with heartbeats while nothing happens, up to the event that ends the job.

A feed shows a job's events by time and sequence.  When `beat` passes without one, it shows a heartbeat, and another
after each further `beat`; an event at the very end of a pause comes instead of the heartbeat.  After the first event
of an ending kind it shows nothing more.  `feed` says this of a table, up to an instant; `live` of a stream, where the
instant is the watermark: events wait in the job's state until the watermark has passed them, so a late one that is
still inside the watermark takes its place, and timers make the heartbeats.  A job's state is its waiting events.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ENDINGS = ("complete", "error")
HEARTBEAT = "heartbeat"
FEED = "job bigint, ms bigint, kind string, seq bigint"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def feed(events: DataFrame, beat: int, until: Column, endings: tuple[str, ...] = ENDINGS) -> DataFrame:
    """(job, ms, kind, seq) of events (job, ms, kind, seq), with heartbeats up to `until`."""
    by_time = Window.partitionBy("job").orderBy("ms", "seq")
    ends = F.col("kind").isin(*endings)
    seen = events.where(F.col("ms") <= until).withColumns(
        {
            "over": F.coalesce(F.max(ends).over(by_time.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)),
            "next": F.lead("ms").over(by_time),
        }
    )
    seen = seen.where("NOT over")
    gap = F.when(ends, F.lit(0)).when(F.col("next").isNotNull(), F.floor((F.col("next") - F.col("ms") - 1) / beat)).otherwise(F.floor((until - F.col("ms")) / beat))
    beats = seen.withColumn("n", gap.cast("int")).where("n > 0").select("job", F.explode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.col("ms") + i.cast("long") * beat)).alias("ms"))
    return seen.select("job", "ms", "kind", "seq").unionByName(beats.select("job", "ms", F.lit(HEARTBEAT).alias("kind"), F.lit(None).cast("long").alias("seq")))


class Feed(StatefulProcessor):
    """State of a job: events that wait for the watermark, the time of what was shown last, whether the job is over."""

    def __init__(self, beat: int, endings: tuple[str, ...] = ENDINGS):
        self.beat, self.endings = beat, endings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms bigint, kind string, seq bigint")
        self.shown = handle.getValueState("shown", "ms bigint, over boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not (self.shown.exists() and self.shown.get()[1]):
            new = [(int(a), k, int(s)) for f in rows for a, k, s in zip(f["ms"], f["kind"], f["seq"], strict=True)]
            for at in {a for a, _, _ in new}:
                self.handle.registerTimer(at)
            self.waiting.appendList(new)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        last, over = self.shown.get() if self.shown.exists() else (None, False)
        if over:
            return
        rows = sorted(self.waiting.get(), key=lambda r: (r[0], r[2]))
        due, left = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        out: list[tuple] = []
        for at, kind, seq in due:
            last = self._beats(out, last, at - 1)
            out.append((at, kind, seq))
            last = at
            if kind in self.endings:
                over = True
                break
        if not over:
            last = self._beats(out, last, now)
            if last is not None:
                self.handle.registerTimer(last + self.beat)
        self.waiting.clear()
        if left and not over:
            self.waiting.put([tuple(r) for r in left])
        self.shown.update((last, over))
        if out:
            at, kind, seq = zip(*out)
            yield pd.DataFrame({"job": key[0], "ms": at, "kind": kind, "seq": pd.array(seq, "Int64")})

    def _beats(self, out: list[tuple], last: int | None, until: int) -> int | None:
        while last is not None and last + self.beat <= until:
            last += self.beat
            out.append((last, HEARTBEAT, None))
        return last

    def close(self) -> None:
        pass


def live(events: DataFrame, beat: int, endings: tuple[str, ...] = ENDINGS) -> DataFrame:
    """The feed of a stream of events (job, ms, kind, seq) with a watermark; its session needs the RocksDB state store."""
    return events.groupBy("job").transformWithStateInPandas(Feed(beat, endings), outputStructType=FEED, outputMode="Append", timeMode="EventTime")
