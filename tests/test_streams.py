import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronolake.operators import stats, trading, windows


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_averages_go_over_batches(spark, small_batches):
    """Batches that cut tickers, missing values at the start and inside, a null ticker: pandas' averages, without a group in a task."""
    rows = [(t, i, None if (i + len(t or "")) % 5 == 0 or i < len(t or "") - 1 else float(i * i % 17)) for t in ("a", "bb", "ccc", None) for i in range(23)]
    got = windows.ewm(spark.createDataFrame(rows, "ticker string, d int, x double"), {"y": ("x", 0.3), "z": ("y", 0.5), "g": (("x", "y"), 0.2)})
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
    told = {(r.ticker, r.d): (r.y, r.z, r.g) for r in got.collect()}
    for t in ("a", "bb", "ccc", None):
        x = pd.Series([r[2] for r in rows if r[0] == t], dtype=float)
        y = x.ewm(alpha=0.3, adjust=False).mean()
        want = pd.DataFrame({0: y, 1: y.ewm(alpha=0.5, adjust=False).mean(), 2: (x - y).ewm(alpha=0.2, adjust=False).mean()})
        for i in range(23):
            assert told[t, i] == tuple(None if v != v else v for v in want.loc[i])


def test_stacks_go_over_batches(spark, small_batches):
    rows = [(t, i, ("BUY", "SELL", "BUY", "HOLD", "OVERWEIGHT")[(i * 7 + k) % 5], 0.5 + i % 2 / 2) for k, t in enumerate(("a", "b", None)) for i in range(20)]
    got = windows.bounded_stack(spark.createDataFrame(rows, "ticker string, seq int, signal string, confidence double"), 0.7)
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
    told = {(r.ticker, r.seq): r.position for r in got.collect()}
    for t in ("a", "b", None):
        pos = 0.0
        for _, i, s, c in (r for r in rows if r[0] == t):
            pos = min(1.0, max(-1.0, pos + (c >= 0.7) * {"HOLD": 0, "SELL": -1}.get(s, 1)))
            assert told[t, i] == pos


def test_return_within_asks_of_any_day(spark):
    """Days with and without a bar, days asked twice, no later bar, no day: one row a question, and no row a day looked at."""
    day = lambda n: dt.date(2024, 1, n)
    bars = spark.createDataFrame([("a", day(2), 10.0), ("a", day(3), 11.0), ("a", day(4), 12.0), ("a", day(20), 5.0), ("b", day(2), 1.0)], "ticker string, d date, close double")
    asked = spark.createDataFrame([("a", day(2), 1), ("a", day(2), 2), ("a", day(1), 3), ("a", day(4), 4), ("a", None, 5), ("c", day(2), 6), ("b", day(2), 7)], "ticker string, d date, n int")
    got = trading.return_within(asked, bars)
    assert "Generate" not in got._jdf.queryExecution().toString()
    assert {r.n: r.r and round(r.r, 9) for r in got.collect()} == {1: 0.1, 2: 0.1, 3: 0.1, 4: None, 5: None, 6: None, 7: None}


def test_bootstrap_places_by_stretches(spark, block):
    """The same places whether a draw is walked in stretches or whole, also where stretches hold no start."""
    v = spark.range(50).select("id", F.col("id").cast("double").alias("v"))
    places = lambda stretch: sorted(map(tuple, stats.boot_index(v, "id", 5, block, "s", stretch)[1].collect()))
    assert places(4) == places(1 << 14) and len(places(4)) == 250
