"""Point-in-time filters: a row is visible if it was available at the as-of date.

Every source has its own availability rule and its own bounds; none is normalised away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAGS = {"annual": 90, "quarterly": 45}  # days after the period's end
INSIDER_LAG = 2  # calendar days after a trade that has no filing date
FILING_DAYS, CALL_DAYS = 1095, 365


def lag_days(freq: str) -> int:
    return LAGS["annual" if freq.lower().startswith("a") else "quarterly"]


def available_statements(df: DataFrame, as_of, freq: str = "quarterly", period: str = "period_end", lag: int | None = None) -> DataFrame:
    """Statement rows in long form whose period ended long enough ago; no as-of keeps all."""
    if not as_of:
        return df
    return df.where(F.date_add(period, lag_days(freq) if lag is None else lag) <= F.lit(as_of).cast("date"))


def available_reports(reports: Column, as_of, freq: str = "quarterly") -> Column:
    """Elements of an array of report structs: reported date, else filing date, else fiscal end plus lag; unparsable ones go."""
    day = lambda c: F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date")
    return F.filter(
        reports,
        lambda r: F.coalesce(day(r["reportedDate"]), day(r["filingDate"]), F.date_add(day(r["fiscalDateEnding"]), lag_days(freq))) <= F.lit(as_of).cast("date"),
    )


def insider_available(filing: str | Column = "filing_date", trade: str | Column = "transaction_date") -> Column:
    """The filing date, or the trade's date plus two calendar days."""
    return F.coalesce(F.col(filing) if isinstance(filing, str) else filing, F.date_add(trade, INSIDER_LAG))


def available_insider(df: DataFrame, as_of) -> DataFrame:
    """First present filing column, else first present trade column plus the lag, else all rows."""
    filing = next((c for c in ("filing_date", "filingDate", "report_date", "reportDate", "Filing Date", "Date Filed") if c in df.columns), None)
    trade = next((c for c in ("transaction_date", "transactionDate", "Start Date", "Transaction Date", "Date") if c in df.columns), None)
    if filing:
        at = F.col(filing) if trade is None else insider_available(filing, trade)
    elif trade:
        at = F.date_add(trade, INSIDER_LAG)
    else:
        return df
    return df.where(at <= F.lit(as_of).cast("date"))


def feed_between(feed: Column, start: str, end: str) -> Column:
    """Feed items whose compact time text lies in the closed day range; items without one go."""
    lo, hi = (d.replace("-", "") + t for d, t in ((start, "T000000"), (end, "T235959")))
    return F.filter(feed, lambda x: x["time_published"].between(lo, hi))


def news_between(df: DataFrame, start: str, end: str, ts: str = "pub_ts", closed: bool = False) -> DataFrame:
    """News from `start` to the day after `end`, half-open or closed; undated rows stay."""
    t, stop = F.col(ts), F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")
    upper = t <= stop if closed else t < stop
    return df.where(t.isNull() | (t >= F.lit(start).cast("timestamp_ntz")) & upper)


def recent_posts(df: DataFrame, trade_date: str, max_age: int = 3, epoch: str = "epoch", keep_undated: bool = False) -> DataFrame:
    """Posts of the `max_age` days up to the end of the trade date (closed); undated ones by policy."""
    ref = F.unix_timestamp(F.date_add(F.lit(trade_date).cast("date"), 1).cast("timestamp"))
    ok = F.col(epoch).between(ref - max_age * 86400, ref)
    return df.where(ok | F.col(epoch).isNull() if keep_undated else ok)


def valid_at(start: Column, end: Column, as_of: Column) -> Column:
    """Closed interval, open where null."""
    return (start.isNull() | (start <= as_of)) & (end.isNull() | (end >= as_of))


def within_days(at: Column, as_of: Column, days: int) -> Column:
    """Dated no later than as_of and no more than `days` before it."""
    return (at <= as_of) & (at >= F.date_sub(as_of, days))


def temporal_split(at: Column, train_end: str, dev_start: str, dev_end: str, test_start: str) -> Column:
    """train, dev or test; dates in the gaps get null."""
    d = lambda x: F.lit(x).cast("date")
    return F.when(at <= d(train_end), "train").when(at.between(d(dev_start), d(dev_end)), "dev").when(at >= d(test_start), "test")


def snapshot_notice(as_of: Column, last_trading_day: Column | None, payload: Column, notice: str) -> Column:
    """Snapshot data are withheld for any as-of, or for one before the last trading day."""
    held = as_of.isNotNull() if last_trading_day is None else as_of < last_trading_day
    return F.when(F.coalesce(held, F.lit(False)), F.lit(notice)).otherwise(payload)
