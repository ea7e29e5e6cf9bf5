"""Streaming forms of the event operators; over the same rows they equal the batch queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronolake.operators.windows import TARGET

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def stream(spark: SparkSession, folder: str, late: str = "2 days") -> DataFrame:
    """Events from parquet files, with their time as TIMESTAMP (NTZ has no watermark)."""
    df = spark.readStream.schema(EVENTS).parquet(folder)
    return df.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", late)


def tumbling(df: DataFrame, width: str = "1 day", slide: str | None = None) -> DataFrame:
    w = F.window("t", width, slide) if slide else F.window("t", width)
    return df.groupBy("event_type", w.alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("start"), "n")


def sessions(df: DataFrame, gap: str = "6 hours") -> DataFrame:
    return df.groupBy("user_id", F.session_window("t", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def first_seen(df: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once within the watermark."""
    return df.dropDuplicatesWithinWatermark(keys)


def positions(df: DataFrame, gate: float = 0.55) -> DataFrame:
    """The last target exposure of each ticker as state; rows (ticker, seq, signal, confidence) in, (ticker, seq, position) out."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else 0.0
        rows = pd.concat(frames).sort_values("seq")
        out = []
        for s, c in zip(rows.signal, rows.confidence, strict=True):
            if c >= gate and str(s).upper() in TARGET:
                now = TARGET[str(s).upper()]
            out.append(now)
        state.update((now,))
        yield pd.DataFrame({"ticker": key[0], "seq": rows.seq.to_numpy(), "position": out})

    return df.groupBy("ticker").applyInPandasWithState(step, "ticker long, seq long, position double", "now double", "append", GroupStateTimeout.NoTimeout)


def drain(df: DataFrame, sink: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there and return what it wrote to a memory table."""
    w = df.writeStream.format("memory").queryName(sink).outputMode(mode).trigger(availableNow=True)
    q = (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
    q.awaitTermination()
    return df.sparkSession.table(sink)
