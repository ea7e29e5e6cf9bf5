"""What vendors answer: overviews, statements, insider trades, feeds and posts, each cut off at the as-of of a request.

Requests are rows (ticker, as_of, ...) rather than calls, so that one plan answers all of them; a null as-of asks for
everything.  A ticker that the store doesn't hold has no answer, one whose rows all come too late an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.operators.joins import latest
from chronolake.operators.pit import INSIDER_LAG, LAGS, feed_between

# Labels of an overview and the vendor's names for them, in order.
OVERVIEW = (
    ("Name", "longName"), ("Sector", "sector"), ("Industry", "industry"), ("Market Cap", "marketCap"), ("PE Ratio (TTM)", "trailingPE"), ("Forward PE", "forwardPE"),
    ("PEG Ratio", "pegRatio"), ("Price to Book", "priceToBook"), ("EPS (TTM)", "trailingEps"), ("Forward EPS", "forwardEps"), ("Dividend Yield", "dividendYield"), ("Beta", "beta"),
    ("52 Week High", "fiftyTwoWeekHigh"), ("52 Week Low", "fiftyTwoWeekLow"), ("50 Day Average", "fiftyDayAverage"), ("200 Day Average", "twoHundredDayAverage"),
    ("Revenue (TTM)", "totalRevenue"), ("Gross Profit", "grossProfits"), ("EBITDA", "ebitda"), ("Net Income", "netIncomeToCommon"), ("Profit Margin", "profitMargins"),
    ("Operating Margin", "operatingMargins"), ("Return on Equity", "returnOnEquity"), ("Return on Assets", "returnOnAssets"), ("Debt to Equity", "debtToEquity"),
    ("Current Ratio", "currentRatio"), ("Book Value", "bookValue"), ("Free Cash Flow", "freeCashflow"),
)
REPORT = "struct<fiscalDateEnding:string,reportedDate:string,filingDate:string,filing_date:string,value:bigint>"
REPORTS = f"symbol string, annualReports array<{REPORT}>, quarterlyReports array<{REPORT}>"
FEED = "items string, feed array<struct<title:string,time_published:string>>"
TRADES = "data array<struct<transaction_date:string,filing_date:string,report_date:string,shares:bigint>>"


def overview(raw: Column) -> Column:
    """The labelled fields that a JSON overview holds, in order, as an array of (label, value)."""
    pairs = [F.struct(F.lit(label).alias("label"), F.get_json_object(raw, f"$.{name}").alias("value")) for label, name in OVERVIEW]
    return F.filter(F.array(*pairs), lambda p: p["value"].isNotNull())


def overview_text(ticker: Column, raw: Column) -> Column:
    lines = F.transform(overview(raw), lambda p: F.concat(p["label"], F.lit(": "), p["value"]))
    return F.concat(F.lit("# Company Fundamentals for "), F.upper(ticker), F.lit("\n\n"), F.array_join(lines, "\n"))


def _answered(requests: DataFrame, store: DataFrame, keys: list[str], seen: Column, totals: dict[str, Column]) -> DataFrame:
    """Requests with aggregates of the rows that they may see, and a status: null (not held), 'empty' or 'data'."""
    held = store.select(*keys).distinct().withColumn("_held", F.lit(True))
    ask = requests.withColumn("_ask", F.xxhash64(*requests.columns))
    found = ask.join(store, keys).where(seen).groupBy("_ask").agg(*[c.alias(n) for n, c in totals.items()], F.count("*").alias("n"))
    out = ask.join(held, keys, "left").join(found, "_ask", "left")
    status = F.when(F.col("_held").isNull(), None).when(F.col("n").isNull(), "empty").otherwise("data")
    return out.select(*requests.columns, *totals, F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"))


def statements(requests: DataFrame, store: DataFrame) -> DataFrame:
    """(ticker, kind, freq, as_of) answered from rows (ticker, kind, freq, period_end, value): annual ones after 90 days, others after 45."""
    lag = F.when(F.lower("freq").startswith("a"), LAGS["annual"]).otherwise(LAGS["quarterly"])
    seen = F.col("as_of").isNull() | (F.date_add("period_end", lag) <= F.col("as_of"))
    return _answered(requests, store, ["ticker", "kind", "freq"], seen, {"total": F.sum("value")})


def insider(requests: DataFrame, store: DataFrame) -> DataFrame:
    """(ticker, as_of) answered from trades (ticker, transaction_date, filing_date, shares)."""
    seen = F.col("as_of").isNull() | (F.coalesce("filing_date", F.date_add("transaction_date", INSIDER_LAG)) <= F.col("as_of"))
    return _answered(requests, store, ["ticker"], seen, {"shares": F.sum("shares")})


def reports(payload: Column, as_of: Column) -> Column:
    """A JSON payload of reports without those that weren't out at the as-of: report or filing date, else fiscal end plus the lag; all for a null as-of."""
    day = lambda c: F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date")
    parsed = F.from_json(payload, REPORTS)

    def out_by(name: str, lag: int) -> Column:
        at = lambda r: F.coalesce(day(r["reportedDate"]), day(r["filingDate"]), day(r["filing_date"]), F.date_add(day(r["fiscalDateEnding"]), lag))
        return F.filter(parsed[name], lambda r: as_of.isNull() | F.coalesce(at(r) <= as_of, F.lit(False))).alias(name)

    return F.to_json(F.struct(parsed["symbol"].alias("symbol"), out_by("annualReports", LAGS["annual"]), out_by("quarterlyReports", LAGS["quarterly"])))


def insider_payload(payload: Column, as_of: Column) -> Column:
    """The trades of a JSON payload known at the as-of, compared as text by day; all for a null as-of."""
    day = lambda c: F.substring(c, 1, 10)
    late = lambda c: F.date_format(F.date_add(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date"), INSIDER_LAG), "yyyy-MM-dd")
    known = lambda r: F.coalesce(day(r["filing_date"]), day(r["report_date"]), late(day(r["transaction_date"]))) <= F.date_format(as_of, "yyyy-MM-dd")
    return F.filter(F.from_json(payload, TRADES)["data"], lambda r: as_of.isNull() | F.coalesce(known(r), F.lit(False)))


def feed(payload: Column, start: str, end: str) -> Column:
    """A JSON feed cut to a closed range of days, with its number of items as text."""
    kept = feed_between(F.from_json(payload, FEED)["feed"], start, end)
    return F.struct(F.size(kept).cast("string").alias("items"), kept.alias("feed"))


def first_then_filter(articles: DataFrame, keys: list[str], order: str, most: int, start: str | None, end: str, ts: str = "pub_ts") -> DataFrame:
    """The first `most` articles of each key, and of these those in the half-open range; undated ones stay.  Fewer may be left."""
    head = latest(articles, keys, [F.asc(order)], most) if keys else articles.orderBy(order).limit(most)
    t = F.col(ts)
    ok = t < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")
    if start:
        ok = ok & (t >= F.lit(start).cast("timestamp_ntz"))
    return head.where(t.isNull() | ok)


def first_titles(articles: DataFrame, title: str, order: list[str]) -> DataFrame:
    """Each title once, where it comes first; articles without one go.  Partial sums meet by title, not whole articles."""
    rest = [c for c in articles.columns if c not in (title, *order)]
    first = articles.where(F.length(title) > 0).groupBy(title).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return first.select(title, "_first.*")


def global_news(articles: DataFrame, as_of: str, back: int, most: int, order: str) -> DataFrame:
    """Cached articles of the look-back (closed), undated ones and flat ones whatever their time; the limit comes last, in order of arrival."""
    day = F.lit(as_of).cast("date")
    t = F.col("pub_ts")
    inside = (t <= F.date_add(day, 1).cast("timestamp_ntz")) & (t >= F.date_sub(day, back).cast("timestamp_ntz"))
    return articles.where(F.col("flat") | t.isNull() | inside).orderBy(order).limit(most)


def pages_back(messages: DataFrame, key: str, order: str, ts: str, cutoff: Column, per_page: int = 30, most: int = 10) -> DataFrame:
    """What paging back from the newest message collects: pages up to the first that reaches past the cutoff, at most `most`, and of them what isn't older."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    paged = messages.withColumn("_page", F.floor((F.row_number().over(w) - 1) / per_page)).where(F.col("_page") < most)
    reached = paged.groupBy(key).agg(F.min(F.when(F.col(ts) < cutoff, F.col("_page"))).alias("_last"))
    out = paged.join(reached, key).where(F.col("_last").isNull() | (F.col("_page") <= F.col("_last")))
    return out.where(F.col(ts).isNull() | (F.col(ts) >= cutoff)).drop("_page", "_last")


def forum_text(title: Column, body: Column, most: int = 300) -> Column:
    """Title and the start of the body on one line; null without either."""
    flat = F.trim(F.replace(F.coalesce(body, F.lit("")), F.lit("\n"), F.lit(" ")))
    return F.nullif(F.trim(F.concat(F.trim(F.coalesce(title, F.lit(""))), F.when(flat != "", F.concat(F.lit(" "), F.substring(flat, 1, most))).otherwise(""))), F.lit(""))


def social_status(trade_date: Column, now: Column, days: int = 3) -> Column:
    """'live' while the date is one that public sources still show, else 'historical'; without a date it's live."""
    late = now > trade_date.cast("timestamp") + F.make_dt_interval(F.lit(days))
    return F.when(F.coalesce(late, F.lit(False)), "historical").otherwise("live")


def transcript_date(event_date: Column, quarter_end: Column) -> Column:
    """Struct of the day that a call's transcript counts from, and whether that is estimated as 45 days after the quarter."""
    return F.struct(F.coalesce(event_date, F.date_add(quarter_end, 45)).alias("at"), event_date.isNull().alias("estimated"))


def stance_label(raw: Column) -> Column:
    """0, 1, 2 of the spreadsheet to -1, 1, 0; anything else is no label."""
    return F.when(raw == "0", -1).when(raw == "1", 1).when(raw == "2", 0)


# What is known of a corpus of annotated stances whose days are only years.
STANCE_FLAGS = {"source_verified": True, "annotation_verified": True, "pit_verified": False}


def stance_benchmark(samples: DataFrame) -> tuple[DataFrame, dict[str, bool]]:
    """Samples fit for a baseline and its flags; with them no availability is known, so it never passes as ready for formal results."""
    return samples.withColumn("availability_quality", F.lit("unknown")), dict(STANCE_FLAGS)


def quarters_before(as_of: Column, n: int = 3) -> Column:
    """The last n whole quarters before a day, latest first, as structs (year, quarter, place)."""
    first = F.date_trunc("quarter", as_of)
    at = lambda i: F.add_months(first, -3 * i)
    return F.array(*(F.struct(F.year(at(i)).alias("year"), F.quarter(at(i)).alias("quarter"), F.lit(i - 1).alias("place")) for i in range(1, n + 1)))


def latest_candidates(asked: DataFrame, calls: DataFrame, n: int = 3) -> DataFrame:
    """`asked` (ticker, as_of, ...) with the payload columns of the latest of the n quarters before that has a call; no call, no row.

    `calls` (ticker, year, quarter, ...) is first read by its keys alone, and each request settles on one of its
    candidates.  Only the quarters that some request settled on are then read with their payloads, which is a choice of
    folders where calls are partitioned by year and quarter.  Of several calls of a ticker and quarter all are joined.
    """
    from functools import reduce

    from chronolake.sources.sinks import folder

    keys = calls.select("ticker", "year", "quarter").distinct()
    tried = asked.withColumn("c", F.explode(quarters_before(F.col("as_of"), n))).select("ticker", "as_of", "c.year", "c.quarter", "c.place")
    there = tried.distinct().join(keys, ["ticker", "year", "quarter"], "left_semi")
    at = folder(asked.sparkSession, "settled")
    there.groupBy("ticker", "as_of").agg(F.min_by(F.struct("year", "quarter", "place"), "place").alias("w")).select("ticker", "as_of", "w.*").write.parquet(at)
    settled = asked.sparkSession.read.parquet(at)
    quarters: dict[int, list[int]] = {}
    for r in settled.select("year", "quarter").distinct().collect():  # the quarters of some decades
        quarters.setdefault(r.year, []).append(r.quarter)
    wanted = reduce(lambda x, y: x | y, ((F.col("year") == y) & F.col("quarter").isin(q) for y, q in quarters.items()), F.lit(False))
    return asked.join(settled, ["ticker", "as_of"]).join(calls.where(wanted), ["ticker", "year", "quarter"])
