"""Sources: typed, explicit schemas; malformed rows are dropped or reported, never guessed."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BARS = "Date DATE, Open DOUBLE, High DOUBLE, Low DOUBLE, Close DOUBLE, Volume DOUBLE"
POLICY = "meeting_date DATE, decision_time TIMESTAMP, target_lower_before DOUBLE, target_upper_before DOUBLE, target_lower_after DOUBLE, target_upper_after DOUBLE, action INT, meeting_type STRING, source_url STRING, source_sha256 STRING"
SAMPLES = "sample_id STRING, text STRING, document_type STRING, event_time STRING, available_time STRING, task_label STRING, meeting_id STRING, source STRING"
SIGNALS = "ticker STRING, date DATE, signal STRING, confidence DOUBLE, horizon STRING, actual_return DOUBLE"
# What a corpus document must have.
DOCUMENT_FIELDS = (
    "document_id", "document_type", "title", "event_time", "available_time", "availability_quality", "source_url", "source_type", "raw_source_sha256", "canonical_text_sha256", "text", "temporal_class",
)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Corpus documents from JSON lines with the first thing that is wrong with each (null: nothing)."""
    df = spark.read.schema(", ".join(f"{c} STRING" for c in DOCUMENT_FIELDS)).json(path)
    reason = F.lit(None).cast("string")
    checks = [(f"missing {c}", F.col(c).isNull()) for c in DOCUMENT_FIELDS]
    checks += [("quality", F.col("availability_quality") != "exact"), ("class", F.col("temporal_class") != "post_cutoff"), ("empty text", F.trim("text") == "")]
    for name, bad in reversed(checks):
        reason = F.when(bad, name).otherwise(reason)
    return df.withColumn("problem", reason)


def calibration_records(spark: SparkSession, path: str, ticker: str | None = None) -> DataFrame:
    """Outcomes of all runs, or of one ticker in either case."""
    df = spark.read.schema("ticker STRING, date DATE, signal STRING, confidence DOUBLE, actual_return DOUBLE").json(path)
    return df if ticker is None else df.where(F.upper("ticker") == ticker.upper())


def signals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SIGNALS).option("header", True).option("recursiveFileLookup", True).csv(path)


def market_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A dated market table in order of its day, times cut to days."""
    df = spark.read.schema(schema.replace("Date DATE", "Date STRING")).option("header", True).csv(path)
    return df.withColumn("Date", F.try_to_timestamp("Date").cast("date")).where("Date IS NOT NULL").orderBy("Date")


def frozen_branches(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """(branch, fields) of a results document that maps branch names to their metrics."""
    df = spark.read.schema(f"branches map<string,struct<{fields}>>").json(path)
    return df.select(F.explode("branches").alias("branch", "m")).select("branch", "m.*")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256, lf_sha256) of the files under a folder, read where Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = path.rstrip("/").split(":")[-1]
    name = F.regexp_replace(F.col("path"), r"^[a-z]+:/*(?=/)", "")
    return files.select(F.replace(name, F.lit(root + "/"), F.lit("")).alias("name"), F.sha2("content", 256).alias("sha256"), F.sha2(F.replace(F.decode("content", "UTF-8"), F.lit("\r\n"), F.lit("\n")).cast("binary"), 256).alias("lf_sha256"))


def tree_digest(files: DataFrame) -> DataFrame:
    """One digest of a source tree: lines of name and digest in order of name; a tree is some thousand files."""
    rows = F.sort_array(F.collect_list(F.struct("name", "lf_sha256")))
    return files.agg(F.sha2(F.array_join(F.transform(rows, lambda r: F.concat(r["name"], F.lit(":"), r["lf_sha256"])), "\n").cast("binary"), 256).alias("digest"), F.count("*").alias("files"))


def bars(spark: SparkSession, path: str, as_of: str | None = None, years: int = 5, more: str = "") -> DataFrame:
    """Daily bars from CSV: malformed lines dropped, null dates and closes dropped, dates up to the as-of.

    `more`: columns after the fixed ones, such as whose bars they are.
    """
    df = spark.read.schema(f"{BARS}, {more}" if more else BARS).option("header", True).option("mode", "DROPMALFORMED").csv(path)
    df = df.where("Date IS NOT NULL AND Close IS NOT NULL")
    if as_of:
        day = F.lit(as_of).cast("date")
        df = df.where((F.col("Date") <= day) & (F.col("Date") >= F.add_months(day, -12 * years)))
    return df


def csv_range(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """CSV rows whose first column is a date in the closed range."""
    df = spark.read.option("header", True).csv(path)
    return df.where(F.try_to_timestamp(F.col(df.columns[0])).cast("date").between(start, end))


def policy_history(spark: SparkSession, path: str, tolerance: float = 1e-6, keys: str = "") -> DataFrame:
    """Policy decisions in order with a flag: does the action follow from the change of the upper target?

    `keys`: columns before the fixed ones, such as whose decision it is.
    """
    df = spark.read.schema(f"{keys}, {POLICY}" if keys else POLICY).option("header", True).csv(path)
    change = F.col("target_upper_after") - F.col("target_upper_before")
    sign = F.when(change > tolerance, 1).when(change < -tolerance, -1).otherwise(0)
    return df.withColumn("consistent", sign == F.col("action")).orderBy("meeting_date")


def next_actions(history: DataFrame, by: list[str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """Each scheduled meeting with the action, rate change and time of the next one, of the same `by` (one bank's are some hundred)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*(by or [])).orderBy("meeting_date", *(ties or []))
    rate = F.bround(F.lead("target_upper_after").over(w) - F.lead("target_upper_before").over(w), 4)
    scheduled = history.where("meeting_type = 'scheduled'")
    return scheduled.withColumns({"future_action": F.lead("action").over(w), "future_rate_change": rate, "future_action_time": F.lead("decision_time").over(w)})


def samples(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Labelled samples: labels strictly -1, 0 or 1 as text or integer, times to UTC; columns beyond the fixed ones become a map."""
    from chronolake.functions.scalars import strict_label

    df = spark.read.option("header", True).option("primitivesAsString", True).format(fmt).load(path)
    fixed = [f.split()[0] for f in SAMPLES.split(", ")]
    extra = [c for c in df.columns if c not in fixed]
    pairs = [x for c in extra for x in (F.lit(c), F.col(c).cast("string"))]
    have = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in fixed]
    out = df.select(*have, (F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")).alias("metadata"))
    return out.withColumns({"task_label": strict_label(F.col("task_label")), **{c: F.try_to_timestamp(c) for c in ("event_time", "available_time")}})


def write_run_records(records: DataFrame, root: str) -> None:
    """A folder for each ticker and a file for each date, from rows (ticker, date, ...): the date names the file of its partition."""
    fields = [c for c in records.columns if c not in ("ticker", "date")]
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})

    def each(batches):
        fs, at = pyarrow.fs.FileSystem.from_uri(root)
        for batch in batches:
            for ticker, date, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                fs.create_dir(f"{at}/{ticker}")
                part = f"{at}/{ticker}/.{date}.{uuid.uuid4().hex}"
                with fs.open_output_stream(part, compression=None) as f:
                    f.write(text.encode())
                fs.move(part, f"{at}/{ticker}/{date}.json")  # whole or not at all, whoever tries again
            yield batch.slice(0, 0).select([0])

    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # files take their time, however small the rows are
    records.select("ticker", "date", body.alias("text")).repartition(parts).mapInArrow(each, "ticker string").write.format("noop").mode("overwrite").save()


def run_records(spark: SparkSession, root: str, schema: str | None = None) -> DataFrame:
    """Run records, one JSON file per ticker and date; both come from the path.

    Without a schema all files are read once more for it.  Folders are listed by some tasks a core, not by a task a folder.
    """
    reader = spark.read.option("multiLine", True).option("recursiveFileLookup", True)
    listing = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(listing)
    spark.conf.set(listing, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        df = (reader.schema(schema) if schema else reader).json(root)
    finally:
        spark.conf.set(listing, before)
    path = F.col("_metadata.file_path")
    return df.select("*", F.regexp_extract(path, r"([^/]+)/[^/]+\.json$", 1).alias("path_ticker"), F.regexp_extract(path, r"([^/]+)\.json$", 1).alias("path_date"))


def posts(*frames: DataFrame) -> DataFrame:
    """All social sources under one schema; missing columns are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def settings(spark: SparkSession, path: str) -> dict:
    """A settings document in JSON, read where Spark reads."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def payload_text(text: str) -> str:
    """A vendor's answer as it is, or `Registry.Busy` if it says that too much was asked."""
    try:
        told = json.loads(text)
    except ValueError:
        return text  # a CSV answer
    if isinstance(told, dict) and "Information" in told and any(w in told["Information"].lower() for w in ("rate limit", "api key")):
        raise Registry.Busy(told["Information"])
    return text


def retried(ask: Callable, times: int = 3, wait: float = 2.0, sleep: Callable = time.sleep):
    """`ask()`, again after 2, 4, 8 ... seconds while the vendor is busy."""
    for k in range(times + 1):
        try:
            return ask()
        except Registry.Busy:
            if k == times:
                raise
            sleep(wait * 2**k)


class Throttle:
    """Calls that are at least `gap` seconds apart."""

    def __init__(self, gap: float = 0.12, clock: Callable = time.monotonic, sleep: Callable = time.sleep):
        self.gap, self.clock, self.sleep, self.last = gap, clock, sleep, None

    def __call__(self, ask: Callable):
        if self.last is not None and (left := self.gap - (self.clock() - self.last)) > 0:
            self.sleep(left)
        self.last = self.clock()
        return ask()


class Prefetch:
    """What one ticker's backtest reads, kept from `fill` to `clear`: only the vendors that are set, only its window.

    Answers are frames for its own ticker and None for any other; on a cluster they are cached by Spark, not copied.
    """

    def __init__(self) -> None:
        self.ticker, self.frames = None, {}

    def fill(self, ticker, sources: dict[str, DataFrame], wanted: list[str], day: str, start: str, end: str) -> None:
        self.clear()
        self.ticker = ticker
        inside = F.col(day).isNull() | F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        self.frames = {k: sources[k].where((F.col("ticker") == ticker) & inside).persist() for k in wanted if k in sources}

    def read(self, ticker, name: str) -> DataFrame | None:
        return self.frames.get(name) if ticker == self.ticker else None

    def clear(self) -> None:
        for f in self.frames.values():
            f.unpersist()
        self.ticker, self.frames = None, {}


class Registry:
    """Which vendor answers a method: the method's own setting, else its category's, else the default.

    Only `Busy` errors fall through to the next vendor; vendors that can't answer for a past date are skipped when one is asked for.
    """

    class Busy(Exception):
        pass

    def __init__(self, categories: dict[str, list[str]], by_method: dict[str, str] | None = None, by_category: dict[str, str] | None = None, default: str = "default"):
        self.categories, self.by_method, self.by_category, self.default = categories, by_method or {}, by_category or {}, default
        self.readers: dict[tuple[str, str], tuple[Callable, bool]] = {}

    def add(self, method: str, vendor: str, reader: Callable, dated: bool = True) -> None:
        self.readers[method, vendor] = (reader, dated)

    def category(self, method: str) -> str:
        for c, methods in self.categories.items():
            if method in methods:
                return c
        raise ValueError(f"unknown method {method}")

    def vendor(self, method: str) -> str:
        return self.by_method.get(method) or self.by_category.get(self.category(method)) or self.default

    def read(self, method: str, *args, as_of=None, **kw):
        first = self.vendor(method)
        order = sorted((v for m, v in self.readers if m == method), key=lambda v: v != first)
        for v in order:
            reader, dated = self.readers[method, v]
            if as_of is not None and not dated:
                continue
            try:
                return reader(*args, as_of=as_of, **kw)
            except Registry.Busy:
                continue
        raise RuntimeError(f"no vendor answered {method}")
