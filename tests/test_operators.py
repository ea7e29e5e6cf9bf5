"""Operators that SQL can't say, boundary cases, sources, sinks and streams."""

import datetime as dt
import hashlib
import json
import random
import re
import unicodedata

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronolake.functions import scalars as S
from chronolake.functions import text as X
from chronolake.operators import corpus, joins, pit, records, stats, trading, vectors, windows
from chronolake.plans.views import view
from chronolake.sources import contracts, readers, sinks
from chronolake.streaming import events as E

SF = "/root/testdata/sf0.001"


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_html_and_hash(spark):
    raw = "<ix:header>hidden</ix:header><script>x</script><p>Net &amp; gross</p><div>a <b>b</b></div>"
    assert one(spark, X.strip_html(F.lit(raw)))[0] == "Net & gross\n a b"
    filing = "<html><ix:header><ix:hidden>us-gaap:Thing</ix:hidden></ix:header><body><p>Real sentence one.</p><script>var x='</p>';</script><STYLE>p {}</STYLE><div>Real&nbsp;two.<br/></div>\n\n\n<li>x</li></body>"
    assert X.filing_text(filing) == "Real sentence one.\n Real two. \n\n x" and X.filing_text("") == "" and X.filing_text("a < b &lt; c<br") == "a < b < c<br"
    t = "ﬁne  print\n"
    want = hashlib.sha256(" ".join(unicodedata.normalize("NFKC", t).split()).encode()).hexdigest()
    assert one(spark, X.text_hash(F.lit(t)))[0] == want
    assert X.filing_text("<ix:header>x<p>text") == "x text" and X.filing_text("<script>a</script>b<SCRIPT type=x>c <b>d</b>") == "b c d" and X.filing_text("<style>a<style>b</style>c") == "c"


def test_chunks_against_searches():
    """Every chunk's end by a search of its own text."""
    rng = random.Random(3)
    for _ in range(300):
        text, size = "".join(rng.choices(["a", "é", ". ", "\n\n", "\n", " ", "word", "👍"], k=rng.randint(0, 120))), rng.randint(2, 40)
        overlap, want, at = rng.randint(0, size), [], 0
        while at < len(text):
            whole = text[at : at + size]
            ends = [m.start() for m in re.finditer(r"(?=\n\n|\. )", whole) if size // 2 < m.start()]
            stop = at + (ends[-1] + 1 if ends and at + size < len(text) else len(whole))
            want.append((at, stop))
            at = len(text) if stop == len(text) else max(at + 1, stop - overlap)
        assert list(X.spans(text, size, overlap)) == want
        assert X.pieces(text, size, overlap, 3) == [text[a:b].strip() for a, b in want[:3] if text[a:b].strip()]


def test_chunks_cover_and_cut(spark):
    text = ". ".join(f"sentence number {i} with words" for i in range(400))
    rows = spark.createDataFrame([(text,), ("",), (None,)], "t string")
    got = rows.select(F.posexplode(X.chunks(F.col("t"))).alias("k", "chunk")).collect()
    assert all(len(r.chunk) <= 1800 for r in got) and [r.k for r in got] == list(range(len(got)))
    assert got[0].chunk == text[: len(got[0].chunk)] and got[-1].chunk == text[-len(got[-1].chunk) :]
    assert all(r.chunk.endswith(".") for r in got[:-1])
    assert len(X.pieces("x" * 2_000_000)) == 600 and len(X.pieces("x" * 2_000_000, most=None)) == 1250


@pytest.mark.parametrize(("as_of", "n"), [("2024-05-14", 0), ("2024-05-15", 1), ("2024-06-28", 1), ("2024-06-29", 1)])
def test_statement_lag_edges(spark, as_of, n):
    df = spark.createDataFrame([(dt.date(2024, 3, 31), 1.0)], "period_end date, value double")
    assert pit.available_statements(df, as_of).count() == n
    assert pit.available_statements(df, as_of, "annual").count() == (as_of >= "2024-06-29")


def test_insider_column_priority(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), dt.date(2024, 1, 9)), (dt.date(2024, 1, 1), None)], "transaction_date date, filing_date date")
    assert pit.available_insider(df, "2024-01-03").count() == 1
    assert pit.available_insider(df.drop("filing_date"), "2024-01-03").count() == 2 and pit.available_insider(df.drop("filing_date"), "2024-01-02").count() == 0
    assert pit.available_insider(df.select(F.lit(1).alias("shares")), "1999-01-01").count() == 2


def test_news_bounds(spark):
    rows = [(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 3)), (3, None), (4, dt.datetime(2024, 1, 3, 0, 0, 1))]
    df = spark.createDataFrame(rows, "i int, pub_ts timestamp_ntz")
    ids = lambda d: sorted(r.i for r in d.collect())
    assert ids(pit.news_between(df, "2024-01-01", "2024-01-02")) == [1, 3] and ids(pit.news_between(df, "2024-01-01", "2024-01-02", closed=True)) == [1, 2, 3]


def test_split_gaps_and_notice(spark):
    s = pit.temporal_split(F.lit("2018-12-31").cast("date"), "2018-06-30", "2019-01-01", "2019-12-31", "2020-01-01")
    assert one(spark, s)[0] is None
    n = lambda a, l: one(spark, pit.snapshot_notice(F.lit(a).cast("date"), None if l is None else F.lit(l).cast("date"), F.lit("data"), "held"))[0]  # noqa: E731, E741
    assert n("2024-01-01", None) == "held" and n(None, None) == "data" and n("2024-01-02", "2024-01-02") == "data" and n("2024-01-01", "2024-01-02") == "held"


def test_signals_and_tags(spark):
    p = X.parse_signal(F.lit("Final SIGNAL:  Buy, Confidence: 85 horizon: 20d+"))
    assert tuple(one(spark, p)[0]) == ("BUY", 0.7, "20d+") and one(spark, X.parse_signal(F.lit("none")))[0] is None
    assert one(spark, X.tagged(F.lit("<verdict> a\nb </verdict>"), "verdict"))[0] == "a\nb" and one(spark, X.tagged(F.lit("x"), "verdict"))[0] is None
    assert one(spark, X.about(F.lit("see $BRK.B now"), F.lit(""), F.lit("BRK.B")))[0] and not one(spark, X.about(F.lit("BRKXB"), F.lit(""), F.lit("BRK.B")))[0]
    assert one(spark, X.about(F.lit("GOOG MSFT"), F.lit(None).cast("string"), F.lit("msft")))[0] and not one(spark, X.about(F.lit("GOOG MSFT GOOG"), F.lit("x"), F.lit("MSFT")))[0]
    assert sorted(one(spark, X.mentions(F.lit("$aapl and THE MSFT $the")))[0]) == ["AAPL", "MSFT", "THE"]
    assert one(spark, X.digest({"a": F.lit(" x "), "b": F.lit("  "), "c": F.lit(None).cast("string")}))[0] == "a: x"


def test_scalars(spark):
    assert one(spark, S.quarter_end(F.lit(2024), F.lit(1)))[0] == dt.date(2024, 3, 31)
    assert one(spark, S.strict_label(F.lit(" 1 ")), S.strict_label(F.lit("1.0")))[:] == (1, None)
    assert one(spark, S.post_time(F.lit("86400")))[0] == dt.datetime(1970, 1, 2) and one(spark, S.post_time(F.lit("bad")))[0] is None
    assert one(spark, S.thousands(F.lit(1500)), S.thousands(F.lit(20)))[:] == ("1.5k", "20")
    assert tuple(one(spark, S.sensitivity(F.lit(0.3), F.lit(0.2), F.lit(0.5)))[0]) == (0.3, 0.0, 0.3, 0.5)
    assert sum(one(spark, X.stance_probabilities(F.lit("inflation will rise")))[0]) == pytest.approx(1)


def test_asof_before_first_and_split_agree(spark):
    left = spark.createDataFrame([("a", dt.date(2024, 1, 1)), ("a", dt.date(2024, 3, 5)), ("b", dt.date(2024, 3, 5))], "k string, d date")
    right = spark.createDataFrame([("a", dt.date(2024, 1, 2), 1.0), ("a", dt.date(2024, 3, 5), 2.0)], "k string, at date, v double")
    got = [sorted(map(tuple, f(left, right, "k", "d", "at", ["v"]).collect())) for f in (joins.asof, joins.asof_split)]
    assert got[0] == got[1] and [r[3] for r in got[0]] == [None, 2.0, None]


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 4))
    y = x @ [1.0, -2.0, 0.5, 0.0] + 3
    rows = [(0, i, "train" if i < 20 else "test", [float(v) for v in x[i]], float(y[i])) for i in range(30)]
    df = spark.createDataFrame(rows, "fold int, event_id long, role string, x array<double>, y double")
    got = {r.event_id: r.pred for r in stats.ridge_probe(df, ["fold"]).collect()}
    a = np.column_stack([x[:20], np.ones(20)])
    w = np.linalg.solve(a.T @ a + np.diag([1, 1, 1, 1, 0]), a.T @ y[:20])
    assert got == pytest.approx({i: float(np.append(x[i], 1) @ w) for i in range(20, 30)})


def test_competence_degenerate(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "y int, p int")
    r = stats.competence(df, "y", "p").first()
    assert r.mcc == 0 and r.macro_f1 == pytest.approx(1 / 3)


def test_indicators_against_pandas(spark):
    bars = view(spark, SF, "bars")
    t = bars.groupBy("ticker").count().orderBy(F.desc("count")).first().ticker
    g = bars.where(F.col("ticker") == t).toPandas().sort_values("d").reset_index(drop=True)
    got = windows.rsi(bars.where(F.col("ticker") == t)).toPandas().sort_values("d")
    delta = g.close.diff().fillna(0)
    up, down = (s.ewm(alpha=1 / 14, adjust=False).mean() for s in (delta.clip(lower=0), (-delta).clip(lower=0)))
    assert np.allclose(got.rsi, 100 - 100 / (1 + up / (down + 1e-9)))


def test_policy_history(spark, tmp_path):
    cols = [f.split()[0] for f in readers.POLICY.split(", ")]
    rows = [["2024-01-31", "2024-01-31T19:00:00Z", 5.25, 5.5, 5.25, 5.5, 0, "scheduled", "u", "h"], ["2024-03-03", "2024-03-03T14:00:00Z", 5.25, 5.5, 4.75, 5.0, -1, "unscheduled", "u", "h"],
            ["2024-03-20", "2024-03-20T18:00:00Z", 4.75, 5.0, 5.0, 5.25, 0, "scheduled", "u", "h"]]
    pd.DataFrame(rows, columns=cols).to_csv(tmp_path / "p.csv", index=False)
    h = readers.policy_history(spark, str(tmp_path / "p.csv"))
    assert [r.consistent for r in h.collect()] == [True, True, False]
    n = readers.next_actions(h).orderBy("meeting_date").collect()
    assert [r.future_rate_change for r in n] == [0.25, None]


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "b.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,1,2,5\n2024-01-03,1,2,1,,5\nbad,x\n2024-02-01,1,2,1,3,5\n")
    assert readers.bars(spark, str(tmp_path / "b.csv"), "2024-01-31").count() == 1
    (tmp_path / "s.jsonl").write_text('{"sample_id": "1", "text": "t", "task_label": 1, "event_time": "2024-01-01T00:00:00Z", "spy": 0.5}\n{"sample_id": "2", "text": "t", "task_label": "1.0"}\n')
    s = {r.sample_id: r for r in readers.samples(spark, str(tmp_path / "s.jsonl")).collect()}
    assert s["1"].task_label == 1 and s["2"].task_label is None and s["1"].metadata == {"spy": "0.5"}
    v = str(tmp_path / "v")
    sinks.append_version(spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string"), v, 1)
    sinks.append_version(spark.createDataFrame([(1, "c")], "id int, x string"), v, 2)
    assert sorted(map(tuple, sinks.current(spark.read.parquet(v)).collect())) == [(1, "c"), (2, "b")]
    with pytest.raises(ValueError):
        sinks.gated(spark.createDataFrame([("MOCK",)], "data_mode string"))
    p = spark.createDataFrame([("reddit", "t", dt.datetime(2024, 1, 1))], "source string, text string, fetched_at timestamp")
    sinks.archive(p, str(tmp_path / "a"))
    assert spark.read.json(str(tmp_path / "a")).count() == 1
    os_dir = tmp_path / "runs" / "ABC"
    os_dir.mkdir(parents=True)
    (os_dir / "2024-01-02.json").write_text('{"status": "completed"}')
    r = readers.run_records(spark, str(tmp_path / "runs")).first()
    assert (r.path_ticker, r.path_date, r.status) == ("ABC", "2024-01-02", "completed")


def test_vendor_routing():
    reg = readers.Registry({"news": ["get_news"]}, by_category={"news": "b"})

    def busy(**_):
        raise readers.Registry.Busy

    reg.add("get_news", "a", lambda as_of: "from a")
    reg.add("get_news", "b", lambda as_of: busy())
    assert reg.vendor("get_news") == "b" and reg.read("get_news") == "from a"
    reg.add("get_news", "a", lambda as_of: "x", dated=False)
    with pytest.raises(RuntimeError):
        reg.read("get_news", as_of="2024-01-01")
    with pytest.raises(ValueError):
        reg.category("other")


def test_search_in_batches(spark):
    """The product of batches and blocks against one product, with ties, few rows and none."""
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (300, 4)).astype(float) + 0.5
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(5)
    asks = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 300, 30)], "qid long, q array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for block in (3, 2000):
        got = {(r.qid, r["rank"]): r.id for r in vectors.search_all(rows, asks, 7, block=block).collect()}
        for q in range(0, 300, 30):
            sim = np.round(unit @ unit[q], 9)
            assert [got[q, n + 1] for n in range(7)] == np.lexsort((np.arange(300), -sim))[:7].tolist()
    assert vectors.search_all(rows.limit(2), asks, 7).count() == 20 and vectors.search_all(rows.limit(0), asks, 7).count() == 0


def test_connectors():
    busy = iter([True, True, False])
    waits = []

    def ask():
        if next(busy):
            raise readers.Registry.Busy
        return "got"

    assert readers.retried(ask, sleep=waits.append) == "got" and waits == [2.0, 4.0]
    with pytest.raises(readers.Registry.Busy):
        readers.retried(lambda: readers.payload_text('{"Information": "our rate limit is 25"}'), times=1, sleep=waits.append)
    assert readers.payload_text("a,b\n1,2") == "a,b\n1,2" and readers.payload_text('{"x": 1}') == '{"x": 1}'
    now = [0.0]
    gate = readers.Throttle(0.5, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    assert [gate(lambda: now[0]) for _ in range(3)] == [0.0, 0.5, 1.0]


def test_prefetch_keeps_one_ticker(spark):
    bars = spark.createDataFrame([(1, dt.date(2024, 1, i)) for i in range(1, 9)] + [(2, dt.date(2024, 1, 2)), (1, None)], "ticker int, d date")
    cache = readers.Prefetch()
    cache.fill(1, {"bars": bars, "news": bars}, ["bars"], "d", "2024-01-02", "2024-01-04")
    assert cache.read(1, "bars").count() == 4 and cache.read(1, "bars").is_cached and cache.read(2, "bars") is None and cache.read(1, "news") is None
    cache.clear()
    assert cache.read(1, "bars") is None


def test_valid_counts_against_every_interval(spark):
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    rows = [(None if i % 5 == 0 else day(i % 7), None if i % 3 == 0 else day(i % 7 + i % 4 - 1)) for i in range(60)]
    t = spark.createDataFrame(rows, "valid_from date, valid_to date")
    days = spark.createDataFrame([(day(i),) for i in range(-1, 14)], "d date")
    got = {r.d: r.valid for r in joins.valid_counts(t, days, "d").collect()}
    assert got == {d: sum((a is None or a <= d) and (b is None or b >= d) for a, b in rows) for d in map(day, range(-1, 14))}


def test_numbers_in_ranges_with_ties_and_nulls(spark):
    rows = spark.createDataFrame([(float(i % 10), i) for i in range(200)], "x double, i int")
    both = [sorted(map(tuple, stats.numbered(rows, ["x", "i"], "n", rows=k).collect())) for k in (10, 1 << 20)]
    assert both[0] == both[1] and sorted(r[2] for r in both[0]) == list(range(200))


def test_contracts_of_runs(spark, tmp_path):
    assert contracts.differences({"a": 1, "b": {"c": 2, "d": 1}}, {"a": 1, "b": {"c": 3, "d": True}, "e": 0}) == ["b.c", "b.d", "e"]
    good = dict.fromkeys(contracts.BINDINGS, "x")
    assert contracts.unauthorized(good, {"seeds": "x"}) == [] and contracts.unauthorized(None, {}) == ["no authorization"]
    assert contracts.unauthorized(good | {"seeds": [], "doses": "y"}, {"doses": "x"}) == ["seeds: missing", "doses: not what runs"]
    assert contracts.overlapping(["a\\b.py", "c"], ["a/b.py", "d"]) == ["a/b.py"]
    rows = spark.createDataFrame([("exact",), (None,)], "availability_quality string")
    with pytest.raises(ValueError):
        contracts.allowed(rows, settings())
    assert contracts.allowed(rows.limit(1), settings()).count() == 1
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "b.py").write_bytes(b"1\r\n")
    (tmp_path / "src" / "a.py").write_bytes(b"2\n")
    tree = readers.tree_digest(readers.digests(spark, str(tmp_path / "src"))).first()
    want = "\n".join(f"{n}:{hashlib.sha256(c).hexdigest()}" for n, c in (("a.py", b"2\n"), ("b.py", b"1\n")))
    assert tree.files == 2 and tree.digest == hashlib.sha256(want.encode()).hexdigest()


def test_settings_digest_in_both_forms(spark):
    full = {"deep_think_provider": "p", "deep_think_llm": 'm"x', "judge_iterations": 3, "output_language": "English", "social_nli_filter": True, "temperature": 1}
    raw = json.dumps(full)
    assert one(spark, records.digest_column(F.lit(raw)))[0] == records.settings_digest(full) == records.settings_digest(full | {"temperature": 2})
    assert records.settings_digest(full) != records.settings_digest(full | {"judge_iterations": 4})


def test_texts_for_readers():
    assert sinks.metrics_markdown([{"a": 1, "b": None}]) == "| a | b |\n|---|---|\n| 1 | n/a |" and sinks.metrics_markdown([]) == ""
    assert sinks.report_markdown({"signal": "BUY", "confidence": 0.8}, {"News": " n ", "Market": " "}) == "# BUY (0.80, 1-5d)\n\n## News\n\nn"


def test_dataset_gate(spark):
    fields = "sample_id string, text string, task_label string, event_time string, available_time string, document_type string, source string, annotation_source string, availability_quality string"
    good = ("1", "t", "-1", "2020-01-01T00:00:00Z", "2020-01-01T00:00:00+00:00", "minutes", "s", "a", "exact")
    assert corpus.checked(spark.createDataFrame([good], fields)).count() == 1
    for bad in ([], [good, good], [good[:2] + ("1.0",) + good[3:]], [good[:3] + ("2020-01-01T00:00:00",) + good[4:]]):
        with pytest.raises(ValueError):
            corpus.checked(spark.createDataFrame(bad, fields))


def test_dose_stream_bounds(spark):
    docs = spark.createDataFrame([(1, "pre", 100), (2, "pre", 30), (3, "post", 7)], "doc_id long, side string, n long")
    rows = corpus.dose_stream(docs, 0.5, 256, 64).collect()
    assert [sum(r[c] for r in rows) for c in ("pre", "post")] == [128, 128] and all(r.pre + r.post == 64 for r in rows) and len(rows) == 4
    for dose, side in ((0.0, "post"), (1.0, "pre")):
        assert sum(r[side] for r in corpus.dose_stream(docs, dose, 128, 64).collect()) == 0
    with pytest.raises(ValueError):
        corpus.dose_stream(docs, 0.5, 256, 64, most_repeated=0.5).collect()
    with pytest.raises(ValueError):
        corpus.dose_stream(docs.where("side = 'pre'"), 0.5, 256, 64)


def test_unknown_indicators():
    assert trading.named("RSI, none ,macd") == (("rsi", "macd"), ["none: not an indicator"])
    with pytest.raises(ValueError):
        trading.indicators(None, ("none",))
    with pytest.raises(ValueError):
        trading.csv_report(None, "mfi", "2024-01-01", 5)


def _feed(spark, tmp_path):
    at = str(tmp_path / "events")
    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.parquet(at)
    return at


def test_streams_equal_batch(spark, tmp_path):
    at = _feed(spark, tmp_path)
    batch = spark.read.parquet(at).withColumn("t", F.col("ts").cast("timestamp"))
    for i, f in enumerate((E.tumbling, E.sessions)):
        got = E.drain(f(E.stream(spark, at, "60 days")), f"out{i}", "complete")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, f(batch).collect()))
    slid = E.drain(E.tumbling(E.stream(spark, at, "60 days"), "7 days", "1 day"), "slid", "complete")
    assert slid.agg(F.sum("n")).first()[0] == 7 * batch.count()
    seen = E.drain(E.first_seen(E.stream(spark, at, "60 days"), ["event_type"]), "seen")
    assert seen.count() == batch.select("event_type").distinct().count()


def test_streamed_positions_equal_batch(spark, tmp_path):
    signals = view(spark, SF, "signals").select(F.col("ticker").cast("long").alias("ticker"), F.col("seq").cast("long").alias("seq"), "signal", "confidence")
    at = str(tmp_path / "signals")
    signals.coalesce(1).write.parquet(at)
    got = E.drain(E.positions(spark.readStream.schema(signals.schema).parquet(at)), "pos")
    want = windows.positions(signals).select("ticker", "seq", "position")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def settings(**changes):
    s = {
        "experiment_name": "x", "random_seed": 1, "time": {"source_timezone": "America/New_York", "internal_timezone": "UTC"},
        "splits": {"train_end": "2015-01-01", "dev_start": "2016-01-01T00:00:00Z", "dev_end": "2017-01-01", "test_start": "2018-01-01"},
        "probe": {"cv": "timeseries", "n_splits": 4, "n_permutations": 500, "alpha": 1.0},
        "bootstrap": {"method": "stationary", "expected_block_length": 4, "n_bootstrap": 1000, "confidence_level": 0.95},
        "economics": {"primary_metric": "delta_ic", "threshold": 0, "transaction_cost_bps": 5, "annualization_factor": 8},
        "pit": {"allowed_availability_qualities": ["exact"], "allow_heuristic_fallback": False, "require_timezone_aware": True, "reject_missing_availability": True},
    }
    for path, v in changes.items():
        part, key = path.split("__")
        s[part] = s[part] | {key: v}
    return s


@pytest.mark.parametrize(
    ("path", "value"),
    [("probe__n_splits", 1), ("probe__n_splits", True), ("probe__alpha", 0), ("bootstrap__confidence_level", 1.0), ("economics__threshold", -1), ("pit__allowed_availability_qualities", []),
     ("pit__allowed_availability_qualities", ["other"]), ("splits__dev_start", "2014-01-01"), ("splits__test_start", "soon"), ("time__source_timezone", " ")],
)
def test_settings_contract(path, value):
    assert contracts.violations(settings()) == []
    assert len(contracts.violations(settings(**{path: value}))) == 1
    assert contracts.violations({}) and len(contracts.violations(settings() | {"random_seed": True})) == 1


def test_formal_settings():
    formal = {"experiment_name": contracts.FORMAL}
    assert contracts.violations(settings() | formal) == []
    assert len(contracts.violations(settings(probe__n_permutations=499, bootstrap__n_bootstrap=999, pit__allow_heuristic_fallback=True) | formal)) == 3
    assert contracts.violations(settings(probe__n_permutations=499)) == []


def test_manifest_gate(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    good = {"a.csv": hashlib.sha256(b"x\n1\n").hexdigest()}
    read = lambda p: spark.read.option("header", True).csv(p)
    assert contracts.read_locked(spark, read, str(tmp_path), "a.csv", good).count() == 1
    assert contracts.changed_files(spark, str(tmp_path), good | {"b.csv": "0" * 64}) == ["b.csv"]
    for manifest in ({}, {"a.csv": "0" * 64}):
        with pytest.raises(ValueError):
            contracts.read_locked(spark, read, str(tmp_path), "a.csv", manifest)


def test_indicator_edges(spark):
    rows = [(1, dt.date(2024, 1, i + 1), 10.0, 12.0 + i, 8.0, 10.0 + i, 0.0 if i < 2 else 5.0) for i in range(4)]
    bars = spark.createDataFrame(rows, "ticker int, d date, open double, high double, low double, close double, volume double")
    got = {c: [r[0] for r in f.orderBy("d").select(c).collect()] for c, f in (("boll_ub", windows.bollinger(bars)), ("atr", windows.atr(bars)), ("mfi", windows.mfi(bars)), ("vwma", windows.vwma(bars)))}
    assert got["boll_ub"][0] is None and abs(got["boll_ub"][1] - (10.5 + 2 * 0.5**0.5)) < 1e-9
    assert got["atr"][0] == 4.0 and got["mfi"] == [50.0, 50.0, 100.0, 100.0] and got["vwma"] == [None, None, 12.0, 12.5]


def test_tail_folds_end_at_the_end(spark):
    got = stats.tail_folds(spark.range(11).withColumnRenamed("id", "event"), ["event"], 4).collect()
    test = {f: sorted(r.event for r in got if r.fold == f and r.role == "test") for f in {r.fold for r in got}}
    assert test == {0: [5, 6], 1: [7, 8], 2: [9, 10]}
    assert all(r.event < test[r.fold][0] for r in got if r.role == "train")


def test_ranks_and_numbers_over_partitions(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(rng.integers(0, 40)) / 4, None if i % 29 == 0 else float(rng.normal())) for i in range(400)]
    d = spark.createDataFrame(rows, "i long, x double, y double").repartition(7)
    want = pd.DataFrame(rows, columns=["i", "x", "y"])
    for limit in (5, 1 << 20):
        got = stats.ranked(stats.ranked(d, "x", "rx", limit), "y", "ry", limit).toPandas().sort_values("i")
        assert np.allclose(got.rx, want.x.rank()) and np.allclose(got.ry, want.y.rank(), equal_nan=True)
        told = {r.i: r.n for r in stats.numbered(d, ["x", "i"], "n", limit).collect()}
        assert [told[i] for i in want.sort_values(["x", "i"]).i] == list(range(400))
    both = want.dropna()
    one = stats.spearman_all(d.where("y IS NOT NULL"), "x", "y").first()
    assert abs(one.ic - both.x.rank().corr(both.y.rank())) < 1e-9 and one.n == len(both)
    assert stats.spearman_all(d.withColumn("x", F.lit(1.0)), "x", "y").first().ic == 0.0


def test_digests_of_corpora(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = [("a", i, sha(str(i))) for i in range(300)] + [("b", 5, sha("x"))]
    d = spark.createDataFrame(rows, "side string, i long, h string").repartition(5)
    got = {r.side: r.digest for r in corpus.ordered_digest(d, ["side"], "i", "h").collect()}
    assert got == {"a": sha("".join(h for s, _, h in rows if s == "a")), "b": sha(sha("x"))}
    with pytest.raises(ValueError, match="300 rows"):
        corpus.ordered_digest(d, ["side"], "i", "h", most=200)
    chain = {r.side: r.digest for r in corpus.chained_digest(d, ["side"], "i", "h", block=4).collect()}
    level = {k: [sha("".join(h for _, _, h in rows[4 * k : 4 * k + 4]))] for k in range(75)}
    while len(level) > 4:
        level = {k: [sha("".join(level[j][0] for j in sorted(level) if j // 4 == k))] for k in {j // 4 for j in level}}
    assert chain["a"] == sha("".join(level[k][0] for k in sorted(level)))
    more = corpus.chained_digest(d.union(d.limit(1)), ["side"], "i", "h", block=4).collect()
    assert {r.side: r.digest for r in more}["a"] != chain["a"] or {r.side: r.digest for r in more}["b"] != chain["b"]  # a repeated row counts


def test_stance_of_a_masked_text_is_asked_without_patterns(spark):
    """A masked text is made once for all its readers, and words are looked for as they are."""
    d = spark.createDataFrame([("The Fed may RAISE rates in 2019.",), ("a.b slowdown",), ("",), (None,)], "t string")
    p = X.stance_probabilities(X.mask(F.col("t"), 3), dose=0.5, future=F.lit(1))
    told = d.select(p.alias("p"))
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Bernanke") == 1 and "RLIKE" not in plan.upper() and "REGEXP" not in plan.upper()
    got = [r.p for r in told.collect()]
    assert got[0][2] > 0.5 > got[1][2] and abs(sum(got[2]) - 1) < 1e-12
