"""Reads of tables that change, runs that are taken up again, trees of digests, calls by quarter, settings."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from chronolake.operators import records, vendor, windows
from chronolake.sources import readers
from chronolake.sources import versions as V


def ids(df):
    return None if df is None else sorted(r.id for r in df.collect())


def test_snapshots_under_torn_writes(spark, tmp_path):
    now = [0.0]
    at = str(tmp_path / "t")
    writer, reader = V.Snapshots(spark, at), V.Snapshots(spark, at, ttl=5, clock=lambda: now[0])
    assert reader.read() is None
    assert writer.publish(spark.range(3)) == 0
    assert ids(reader.read()) == [0, 1, 2]
    assert writer.publish(spark.range(5)) == 1
    assert ids(reader.read()) == [0, 1, 2]  # within its time the version that was found
    now[0] = 5
    assert ids(reader.read()) == list(range(5)) and ids(reader.read(0)) == [0, 1, 2]
    held = reader.read()
    writer.publish(spark.range(7))
    assert ids(held) == list(range(5))  # a frame stays what it was
    manifests = tmp_path / "t" / "manifests"
    (manifests / f"{3:012d}.json").write_text('{"schema": "x", "files": [["data/n')  # stopped in the manifest
    now[0] = 20
    assert ids(reader.read()) == list(range(7)) and reader.read(3) is None
    told = json.loads((manifests / f"{2:012d}.json").read_text())
    told["files"][0][1] += 1
    (manifests / f"{4:012d}.json").write_text(json.dumps(told))  # a file that isn't whole
    now[0] = 40
    assert ids(reader.read()) == list(range(7)) and ids(V.Snapshots(spark, at).read()) == list(range(7))
    for f in (tmp_path / "t" / "data").rglob("*.parquet"):
        if f.stat().st_size and str(f.relative_to(tmp_path / "t")) in {p for p, _ in told["files"]}:
            f.unlink()
    assert ids(V.Snapshots(spark, at).read()) == list(range(5))  # the last good version
    assert writer.publish(spark.range(0)) == 5
    assert ids(V.Snapshots(spark, at).read()) == []


def test_run_taken_up_again(spark, tmp_path):
    days = spark.range(12).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    source = spark.range(60).select("id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 11).cast("int")).alias("day"))
    asked = []

    def work(some):
        asked.append(sorted(r.day.day for r in some.collect()))
        return source.join(some, "day")

    def failing(some):
        if len(asked) == 1:
            raise RuntimeError("stopped")
        return work(some)

    whole = V.Ledger(spark, str(tmp_path / "whole"))
    assert whole.run(days, lambda some: source.join(some, "day"), most=5) == 12
    run = V.Ledger(spark, str(tmp_path / "run"))
    with pytest.raises(RuntimeError):
        run.run(days, failing, most=4)
    assert asked == [[1, 2, 3, 4]] and sorted({r.day.day for r in run.rows().collect()}) == [1, 2, 3, 4]
    assert V.Ledger(spark, str(tmp_path / "run")).run(days, work, most=4) == 8
    assert asked == [[1, 2, 3, 4], [5, 6, 7, 8], [9, 10, 11, 12]]  # only what was missing
    key = lambda l: sorted((r.day, r.id) for r in l.rows().collect())  # noqa: E731, E741
    assert key(run) == key(whole) and len(key(run)) == 60
    told = {r.day.day: r["rows"] for r in run.finished().collect()}
    assert len(told) == 12 and told[12] == 0 and sum(told.values()) == 60 and run.run(days, work) == 0


def test_trees_of_digests(spark, tmp_path):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = [(f"src/f{i}.py", sha(str(i))) for i in range(900)]
    d = spark.createDataFrame(rows, "name string, digest string")
    tree = V.merkle(d)
    nodes = {(r.level, r.node): (r.digest, r.leaves) for r in tree.collect()}
    depth = max(k for k, _ in nodes)
    assert depth == 3
    want = {}
    for node in {sha(n)[:depth] for n, _ in rows}:
        own = sorted((n, h) for n, h in rows if sha(n).startswith(node))
        want[depth, node] = (sha("\n".join(f"{n}:{h}" for n, h in own)), len(own))
    for level in range(depth - 1, -1, -1):
        for node in {k[:level] for lv, k in want if lv == level + 1}:
            own = sorted((k, want[lv, k]) for lv, k in want if lv == level + 1 and k.startswith(node))
            want[level, node] = (sha("\n".join(f"{k}:{h}" for k, (h, _) in own)), sum(n for _, (_, n) in own))
    assert nodes == want and nodes[0, ""][1] == 900
    assert V.merkle(d.repartition(7)).where("level = 0").first().digest == nodes[0, ""][0]
    other = spark.createDataFrame([*rows[3:], ("src/f7.py", sha("new")), ("a", sha("a"))], d.schema).where(~((F.col("name") == "src/f7.py") & (F.col("digest") == sha("7"))))
    found = {tuple(r) for r in V.differences(d, other).collect()}
    assert found == {("src/f0.py", "gone"), ("src/f1.py", "gone"), ("src/f2.py", "gone"), ("src/f7.py", "changed"), ("a", "added")}
    few = d.limit(3)
    assert {r.change for r in V.differences(few, d).collect()} == {"added"}  # trees of different depth
    assert V.differences(d, d).count() == 0
    at = str(tmp_path / "lock")
    V.lock(spark, d, at)
    assert V.verify(spark, d, at)["locked"]
    told = V.verify(spark, other, at)
    assert not told["locked"] and len(told["changes"]) == 5
    with pytest.raises(Exception, match="exists"):
        V.lock(spark, other, at)


def test_provenance_of_files(spark, tmp_path):
    for name, text in (("a/x.py", "one\r\ntwo"), ("b/y.py", "three"), ("c.yaml", "k: 1"), ("a/__pycache__/z.py", "no"), ("n.txt", "no")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    files, root = V.provenance(spark, str(tmp_path), ["*.py", "*.yaml"])
    assert {r.name: r.digest for r in files.collect()} == {n: hashlib.sha256(t.encode()).hexdigest() for n, t in (("a/x.py", "one\ntwo"), ("b/y.py", "three"), ("c.yaml", "k: 1"))}
    (tmp_path / "b/y.py").write_text("three!")
    assert V.provenance(spark, str(tmp_path), ["*.py", "*.yaml"])[1] != root


def test_latest_candidate_quarters(spark, tmp_path):
    asked = spark.createDataFrame([("a", dt.date(2024, 2, 10)), ("a", dt.date(2024, 4, 1)), ("b", dt.date(2024, 2, 10)), ("c", dt.date(2024, 2, 10))], "ticker string, as_of date")
    got = asked.select(vendor.quarters_before(F.col("as_of")).alias("q")).first().q
    assert [(x.year, x.quarter, x.place) for x in got] == [(2023, 4, 0), (2023, 3, 1), (2023, 2, 2)]
    at = str(tmp_path / "calls")
    spark.createDataFrame([("a", 2023, 3, "old"), ("a", 2024, 1, "new"), ("b", 2023, 2, "third"), ("b", 2023, 1, "too old"), ("c", 2024, 1, "not yet")], "ticker string, year int, quarter int, text string").write.partitionBy("year", "quarter").parquet(at)
    found = vendor.latest_candidates(asked, spark.read.parquet(at))
    assert sorted((r.ticker, r.as_of.isoformat(), r.text, r.place) for r in found.collect()) == [("a", "2024-02-10", "old", 1), ("a", "2024-04-01", "new", 0), ("b", "2024-02-10", "third", 2)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    told = next(x for x in plan.split("\n") if "FileScan" in x and "text#" in x)
    assert "PartitionFilters: [" in told and told.split("PartitionFilters: [")[1].split("]")[0].count("year#") >= 2
    files = {(r.year, r.quarter) for r in found.select("year", "quarter").distinct().collect()}
    assert files == {(2023, 3), (2024, 1), (2023, 2)}
    none = vendor.latest_candidates(asked.limit(0), spark.read.parquet(at))
    assert none.count() == 0


def test_settings_digests(spark):
    raws = ['{"data_vendors": {"b": [1, 2], "a": "é"}, "judge_iterations": 2, "x": 1}', '{"judge_iterations":2,"data_vendors":{"a":"\\u00e9","b":[1,2]}}', "[1]", "{", None]
    got = [r.d for r in spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, r string").orderBy("i").select(records.digest_column(F.col("r")).alias("d")).collect()]
    assert got[0] == got[1] == records.settings_digest(json.loads(raws[0])) and got[2] == got[3] == got[4] == records.settings_digest({}) != got[0]


def test_calibration_warns_of_few_rows(spark):
    rows = [("a", "BUY", 0.55 + 0.01 * (i % 40), 0.1 if i % 3 else -0.1) for i in range(60)] + [("b", "SELL", 0.95, -0.1)] * 3 + [("b", "HOLD", 0.5, 0.0)] * 99
    d = spark.createDataFrame(rows, "ticker string, signal string, confidence double, actual_return double")
    got = windows.calibration(d, by=["ticker"]).collect()
    assert len(got) == 10 and {r.ticker: r.unreliable for r in got} == {"a": False, "b": True}
    assert {r.bin: r.n for r in got if r.ticker == "b"} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 3} and not windows.calibration(d).first().unreliable
    none = windows.calibration(d.limit(0)).collect()
    assert len(none) == 5 and all(r.unreliable and r.n == 0 for r in none)


def test_run_records_and_paths(spark, tmp_path):
    at = str(tmp_path / "records")
    spark.createDataFrame([("T1", "2024-01-02", 3, None), ("T2", "2024-01-03", 4, "x")], "ticker string, date string, n int, note string").write.format("noop").mode("overwrite").save()
    readers.write_run_records(spark.createDataFrame([("T1", "2024-01-02", 3, None), ("T2", "2024-01-03", 4, "x")], "ticker string, date string, n int, note string"), at)
    assert sorted((r.path_ticker, r.path_date, r.n, r.note) for r in readers.run_records(spark, at).collect()) == [("T1", "2024-01-02", 3, None), ("T2", "2024-01-03", 4, "x")]
    assert json.loads((tmp_path / "records" / "T1" / "2024-01-02.json").read_text()) == {"n": 3, "note": None}
