"""Connectors: filters that reach requests, retries, commits that fail and are tried again."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from chronolake.sources import connector as C
from chronolake.sources.readers import Registry

HEAD = "timestamp,open,high,low,close,volume"


@pytest.fixture
def answers(tmp_path):
    for s in ("A", "B", "C", "D E"):
        folder = tmp_path / "answers" / f"symbol={s}"
        folder.mkdir(parents=True)
        (folder / "part-0.csv").write_text("\n".join([HEAD, *(f"2024-01-{d:02d},{d},{d + 1},{d - 1},{d}.5,{d * 10}" for d in range(1, 11))]))
        (folder / "part-1.csv").write_text("\n".join([HEAD, *(f"2024-02-{d:02d},{d},,x,1e2,{d}" for d in range(1, 6))]))
        (folder / "_SUCCESS").write_text("")
    return str(tmp_path / "answers")


@pytest.fixture
def asked(spark, answers, tmp_path):
    """Loads a source whose requests are written down, one file each."""
    C.register(spark)
    log = tmp_path / "log"
    log.mkdir()

    class Logged(C.Files):
        def ask(self, symbol, first=None, last=None):
            at = f"{log}/{symbol}-{os.urandom(4).hex()}"
            with open(at, "w") as f:
                json.dump([symbol, first, last], f)
            if symbol == "B" and sum(x.startswith("B-") for x in os.listdir(log)) < 3:
                return json.dumps({"Information": "Please mind the RATE LIMIT."})
            return super().ask(symbol, first, last)

    class LoggedReader(C.VendorReader):
        def _transport(self):
            return Logged(self.options)

    class LoggedVendor(C.Vendor):
        @classmethod
        def name(cls):
            return "logged"

        def reader(self, schema):
            return LoggedReader(self.options)

    spark.dataSource.register(LoggedVendor)
    requests = lambda: sorted(json.load(open(f"{log}/{x}")) for x in os.listdir(log))  # noqa: E731, SIM115
    return lambda **o: spark.read.format("logged").options(root=answers, gap="0", wait="0", **o).load(), requests


def test_filters_reach_requests(asked):
    load, requests = asked
    got = load(partitions="2").where("symbol IN ('A', 'C', 'Z') AND day > DATE '2024-01-03' AND day <= DATE '2024-02-02' AND volume >= 50")
    assert sorted((r.symbol, r.day.isoformat()) for r in got.collect()) == [(s, f"2024-01-{d:02d}") for s in "AC" for d in range(5, 11)]
    assert requests() == [["A", "2024-01-04", "2024-02-02"], ["C", "2024-01-04", "2024-02-02"]]


def test_busy_vendor_is_asked_again(asked):
    load, requests = asked
    assert load().where("symbol = 'B'").count() == 15
    assert [r[0] for r in requests()] == ["B"] * 3


def test_busy_vendor_gives_up(asked):
    load, requests = asked
    with pytest.raises(Exception, match="RATE LIMIT"):
        load(retries="1").where("symbol = 'B'").count()
    assert [r[0] for r in requests()] == ["B"] * 2


def test_whole_source_and_values(spark, asked):
    load, _ = asked
    rows = load(partitions="3").collect()
    assert len(rows) == 60 and {r.symbol for r in rows} == {"A", "B", "C", "D E"}
    assert load(symbols="A,D E").rdd.getNumPartitions() == 2
    one = next(r for r in rows if r.symbol == "A" and r.day == dt.date(2024, 2, 1))
    assert (one.open, one.high, one.low, one.close, one.volume) == (1.0, None, None, 100.0, 1.0)


def test_answers_in_shelves(spark, tmp_path, monkeypatch):
    """Symbols share files, a file's answers are read once for a run of them, and filters reach them."""
    root, text = str(tmp_path / "shelves"), "\n".join([HEAD, *(f"2024-01-{d:02d},{d},,1e2,{d}.5,{d}" for d in range(1, 11))])
    rows = spark.createDataFrame([(f"s{i}", text) for i in range(300)], "symbol string, answer string")
    rows.withColumn("shelf", (F.col("symbol").substr(2, 9).cast("int") % 4)).repartition(2, "shelf").sortWithinPartitions("shelf", "symbol").write.partitionBy("shelf").parquet(root)
    vendor = C.Shelves({"root": root})
    names, opened = vendor.symbols(), []
    assert sorted(names) == sorted(f"s{i}" for i in range(300)) and sum(map(len, vendor.near(names, 7))) == 300 and sum(vendor.near(names, 7), ()) == tuple(names)
    read = C.pq.ParquetFile.read_row_group
    monkeypatch.setattr(C.pq.ParquetFile, "read_row_group", lambda f, g, columns: opened.append(columns) or read(f, g, columns=columns))
    assert all(len(vendor.ask(n, "2024-01-03", "2024-01-04").split("\n")) == 3 for n in names)
    assert len(os.listdir(root)) < 10 and len([c for c in opened if "answer" in c]) == 4
    C.register(spark)
    load = lambda **o: spark.read.format("vendor").options(root=root, transport="chronolake.sources.connector:Shelves", gap="0", **o).load()
    got = load(partitions="3").where("day > DATE '2024-01-08'").collect()
    assert sorted((r.symbol, r.day.day, r.low, r.high, r.close) for r in got) == sorted((f"s{i}", d, 100.0, None, d + 0.5) for i in range(300) for d in (9, 10))
    assert load().where("symbol IN ('s7', 's8', 'none')").count() == 20


def test_answers_in_both_forms():
    told = json.dumps({"Meta Data": {"1. Information": "Daily", "2. Symbol": "A"}, "Time Series (Daily)": {"2024-01-02": {"1. open": "1.5", "4. close": "None", "5. volume": "7"}, "bad": {"1. open": "1"}}})
    assert C.series("A", told).to_pylist() == [
        {"symbol": "A", "day": dt.date(2024, 1, 2), "open": 1.5, "high": None, "low": None, "close": None, "volume": 7.0},
        {"symbol": "A", "day": None, "open": 1.0, "high": None, "low": None, "close": None, "volume": None},
    ]
    assert C.series("A", "").num_rows == C.series("A", HEAD).num_rows == C.series("A", "{}").num_rows == 0
    with pytest.raises(Registry.Busy):
        C.payload_text(json.dumps({"Information": "bad API key"}))
    assert C.payload_text(json.dumps({"Information": "fine"})) == json.dumps({"Information": "fine"})


SCHEMA = "id BIGINT, text STRING, day DATE, tags ARRAY<STRING>"


def rows(spark, lo, hi):
    i = F.col("id")
    return spark.range(lo, hi, 1, 4).select("id", F.when(i % 5 > 0, F.concat(F.lit('é "x"\n'), i.cast("string"))).alias("text"), F.date_add(F.lit("2024-01-01").cast("date"), i.cast("int")).alias("day"), F.array(i.cast("string")).alias("tags"))


def same(spark, at, want):
    return sorted(map(str, C.archived(spark, at, SCHEMA).collect())) == sorted(map(str, want.collect()))


def test_archive_is_all_or_nothing(spark, tmp_path):
    C.register(spark)
    at, flag = str(tmp_path / "a"), str(tmp_path / "ready")

    class FailingWriter(C.ArchiveWriter):
        def write(self, iterator):
            def until(batches):
                for b in batches:
                    if not os.path.exists(flag) and 55 in b.column(0).to_pylist():
                        raise OSError("disk full")
                    yield b

            return super().write(until(iterator))

    class Failing(C.Archive):
        @classmethod
        def name(cls):
            return "failing"

        def writer(self, schema, overwrite):
            return FailingWriter(self.options, overwrite)

    spark.dataSource.register(Failing)
    assert C.archived(spark, at, SCHEMA).count() == 0 if os.path.exists(f"{at}/manifests") else True
    rows(spark, 0, 40).write.format("archive").option("path", at).mode("append").save()
    with pytest.raises(Exception, match="disk full"):
        rows(spark, 40, 80).write.format("failing").option("path", at).mode("append").save()
    assert same(spark, at, rows(spark, 0, 40))
    assert sum(len(f) for _, _, f in os.walk(f"{at}/parts")) == 4  # nothing is left of the failed job
    open(flag, "w").close()
    rows(spark, 40, 80).write.format("failing").option("path", at).mode("append").save()
    assert same(spark, at, rows(spark, 0, 80))
    assert C.manifests(spark, at).agg(F.sum("rows")).first()[0] == 80
    rows(spark, 5, 9).write.format("archive").option("path", at).mode("overwrite").save()
    assert same(spark, at, rows(spark, 5, 9))
    rows(spark, 0, 9).write.format("archive").options(path=at, archiver="chronolake.sources.connector:Discard").mode("append").save()
    assert same(spark, at, rows(spark, 5, 9))


def test_streaming_batches_are_published_once(spark, tmp_path):
    C.register(spark)
    at, source = str(tmp_path / "b"), str(tmp_path / "in")
    rows(spark, 0, 30).write.parquet(source)

    def drain():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(source)
        stream.writeStream.format("archive").option("path", at).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    drain()
    assert same(spark, at, rows(spark, 0, 30))
    rows(spark, 30, 40).write.mode("append").parquet(source)
    drain()
    assert same(spark, at, rows(spark, 0, 40))
    w = C.ArchiveStream({"path": at}, False)  # a batch that was published is committed again
    names = sorted(os.listdir(f"{at}/manifests"))
    w.commit([w.write(iter(rows(spark, 0, 3).toArrow().to_batches()))], 0)
    assert sorted(os.listdir(f"{at}/manifests")) == names and same(spark, at, rows(spark, 0, 40))
