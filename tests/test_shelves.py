import os

from pyspark.sql import functions as F

from chronolake.functions import text as X
from chronolake.sources import readers, sinks


def _folders(path) -> int:
    return sum(p.is_dir() for p in path.iterdir())


def _written(path) -> int:
    return sum(n.startswith("part-") for _, _, names in os.walk(path) for n in names)


def test_bars_of_many_tickers_share_folders(spark, tmp_path):
    """Folders are bounded however many tickers there are; columns after the fixed ones are read, and one ticker is found by its shelf."""
    df = spark.range(1000).select(F.lit("2024-01-02").cast("date").alias("Date"), *[F.lit(1.5).alias(c) for c in ("Open", "High", "Low", "Close", "Volume")], F.col("id").alias("ticker"))
    sinks.per_ticker(df, str(tmp_path / "bars"))
    assert 1 < _folders(tmp_path / "bars") <= sinks.SHELVES
    got = readers.bars(spark, str(tmp_path / "bars"), "2024-01-31", more="ticker BIGINT")
    assert sorted(r.ticker for r in got.collect()) == list(range(1000))
    assert [r.ticker for r in sinks.of_ticker(got, 77).collect()] == [77]


def test_assets_keep_the_order_of_a_ticker(spark, tmp_path):
    rows = spark.range(3000).select((F.col("id") % 7).alias("n"), (F.col("id") % 600).cast("string").alias("ticker"), (-F.col("id")).alias("seq"))
    sinks.backtest_assets(rows, spark.createDataFrame([("1", 0.5)], "ticker string, accuracy double"), str(tmp_path / "assets"), by=("seq",))
    assert _folders(tmp_path / "assets" / "signals") <= sinks.SHELVES and _written(tmp_path / "assets" / "signals") <= 2 * sinks.SHELVES
    back = spark.read.schema("n BIGINT, ticker STRING").option("header", True).csv(str(tmp_path / "assets" / "signals"))
    assert back.count() == 3000 and [r.n for r in sinks.of_ticker(back, "5").collect()] == [i % 7 for i in (2405, 1805, 1205, 605, 5)]


def test_states_of_many_tickers_are_appended_to_the_same_folders(spark, tmp_path):
    states = spark.range(500).select(F.col("id").alias("ticker"), F.struct("id").alias("state"))
    at = tmp_path / "states"
    assert not sinks.final_states(states, str(at), backtest=True) and not at.exists()
    assert sinks.final_states(states, str(at)) and sinks.final_states(states, str(at))
    assert _folders(at) <= sinks.SHELVES and spark.read.json(str(at)).where("state.id = ticker").count() == 1000


def test_run_records_are_listed_by_few_tasks(spark, tmp_path):
    """With a schema nothing is read ahead; folders of many tickers aren't listed by a task each, and the setting is as it was."""
    at, listing = str(tmp_path / "records"), "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    records = spark.range(300).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("ticker"), F.lit("2024-01-01").alias("date"), F.col("id").alias("n"))
    readers.write_run_records(records, at)
    before, tracker = spark.conf.get(listing), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("records", "records")
    try:
        got = readers.run_records(spark, at, "n BIGINT")
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("records") for s in tracker.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sum(s.numTasks for s in stages if s) <= 8 * spark.sparkContext.defaultParallelism and spark.conf.get(listing) == before
    assert sorted(r.n for r in got.where("path_ticker = concat('t', n) AND path_date = '2024-01-01'").collect()) == list(range(300))
