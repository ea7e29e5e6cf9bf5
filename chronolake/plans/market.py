"""Queries over price bars and signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolake.operators import stats as R
from chronolake.operators import trading as T
from chronolake.operators import windows as W
from chronolake.plans.book import query
from chronolake.plans.views import view

r6 = lambda c: F.round(c, 6)

_NULLED = "SELECT ticker, d, open, high, low, CASE WHEN day(d) % 3 = 0 THEN NULL ELSE close END AS close, volume FROM bars"


def _bars(spark, sf):
    return view(spark, sf, "bars")


def _gappy(spark, sf):
    return _bars(spark, sf).withColumn("close", F.when(F.dayofmonth("d") % 3 == 0, None).otherwise(F.col("close")))


@query(["bars"], f"""SELECT ticker, d, coalesce(last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY d ROWS UNBOUNDED PRECEDING),
  first_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS close FROM ({_NULLED})""")
def s2_bar_cleaning(spark, sf):
    return W.fill_bars(_gappy(spark, sf), ("close",)).select("ticker", "d", "close")


@query(["bars"], "SELECT ticker, d, floor(open * 100 + 0.5::DOUBLE) / 100 AS open, floor(high * 100 + 0.5::DOUBLE) / 100 AS high, floor(low * 100 + 0.5::DOUBLE) / 100 AS low, floor(close * 100 + 0.5::DOUBLE) / 100 AS close, volume FROM bars WHERE d >= DATE '1995-01-01' AND d < DATE '1995-07-01'")
def s3_price_report(spark, sf):
    rows = _bars(spark, sf).where("d >= DATE '1995-01-01' AND d < DATE '1995-07-01'")
    return rows.select("ticker", "d", *[(F.floor(F.col(c) * 100 + 0.5) / 100).alias(c) for c in ("open", "high", "low", "close")], "volume")


@query(["bars"], "SELECT ticker, d, round((lead(close) OVER w - close) / close, 6) AS r1, round((lead(close, 5) OVER w - close) / close, 6) AS r5 FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY d)")
def w4_w16_forward_returns(spark, sf):
    return _bars(spark, sf).select("ticker", "d", r6(W.forward_return(1)).alias("r1"), r6(W.forward_return(5)).alias("r5"))


@query(["bars"], """SELECT ticker, d, CASE WHEN n20 = 20 AND a5 > a20 THEN 1.0::DOUBLE WHEN n20 = 20 AND a5 < a20 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS position FROM (
  SELECT ticker, d, avg(close) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS a5, avg(close) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS a20,
         count(close) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS n20 FROM bars)""")
def w7b_sma_cross(spark, sf):
    return _bars(spark, sf).select("ticker", "d", W.sma_cross().alias("position"))


@query(["bars"], """SELECT ticker, d, round(CASE WHEN n >= 20 THEN (lr - m) / (s + 1e-9) END, 6) AS z FROM (SELECT ticker, d, lr, count(lr) OVER f AS n, avg(lr) OVER f AS m, stddev_samp(lr) OVER f AS s
  FROM (SELECT ticker, d, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY d)) AS lr FROM bars) WINDOW f AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))""")
def w7e_zscore(spark, sf):
    return W.mean_reversion(_bars(spark, sf)).select("ticker", "d", r6("z").alias("z"))


_POS7E = """, z AS (SELECT ticker, d, CASE WHEN n >= 20 THEN (lr - m) / (s + 1e-9) END AS z FROM (SELECT ticker, d, lr, count(lr) OVER f AS n, avg(lr) OVER f AS m, stddev_samp(lr) OVER f AS s
  FROM (SELECT ticker, d, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY d)) AS lr FROM bars) WINDOW f AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))),
t AS (SELECT ticker, d, lag(z) OVER (PARTITION BY ticker ORDER BY d) AS zl FROM z)
SELECT ticker, d, coalesce(last_value(CASE WHEN zl < -1 THEN 1.0::DOUBLE WHEN zl > 1 THEN -1.0::DOUBLE END IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY d ROWS UNBOUNDED PRECEDING), 0.0::DOUBLE) AS position FROM t"""


@query(["bars"], "WITH one AS (SELECT 1)" + _POS7E)
def w7e_mean_reversion(spark, sf):
    return W.mean_reversion(_bars(spark, sf)).select("ticker", "d", "position")


_NUM = "num AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY d) AS i FROM {src})"


def _ema(name: str, src: str, col: str, a: str) -> str:
    """Recursive SQL of an exponential average over rows numbered by i."""
    return f"{name} AS (SELECT ticker, i, {col} AS y FROM {src} WHERE i = 1 UNION ALL SELECT s.ticker, s.i, (1 - {a}) * e.y + {a} * s.{col} FROM {name} e JOIN {src} s ON s.ticker = e.ticker AND s.i = e.i + 1)"


_RSI = f"""WITH RECURSIVE num AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY d) AS i, coalesce(close - lag(close) OVER (PARTITION BY ticker ORDER BY d), 0) AS dl FROM bars),
gl AS (SELECT *, greatest(dl, 0) AS g, greatest(-dl, 0) AS l FROM num), {_ema("ag", "gl", "g", "(1.0::DOUBLE / 14)")}, {_ema("al", "gl", "l", "(1.0::DOUBLE / 14)")}
SELECT gl.ticker, gl.d, round(100 - 100 / (1 + ag.y / (al.y + 1e-9)), 4) AS rsi FROM gl JOIN ag USING (ticker, i) JOIN al USING (ticker, i)"""


@query(["bars"], _RSI)
def w6_rsi(spark, sf):
    return W.rsi(_bars(spark, sf)).select("ticker", "d", F.round("rsi", 4).alias("rsi"))


_KDJ = f"""WITH RECURSIVE num AS (SELECT *, row_number() OVER w AS i, min(low) OVER (w ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS lo, max(high) OVER (w ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS hi FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY d)),
rv AS (SELECT *, CASE WHEN i >= 9 THEN (close - lo) / (hi - lo + 1e-9) * 100 ELSE 50.0::DOUBLE END AS rsv FROM num), {_ema("kk", "rv", "rsv", "(1.0::DOUBLE / 3)")},
kn AS (SELECT ticker, i, y AS k FROM kk), {_ema("dk", "kn", "k", "(1.0::DOUBLE / 3)")}
SELECT rv.ticker, rv.d, round(kk.y, 4) AS k, round(dk.y, 4) AS dd, round(3 * kk.y - 2 * dk.y, 4) AS j FROM rv JOIN kk USING (ticker, i) JOIN dk USING (ticker, i)"""


@query(["bars"], _KDJ)
def w5_kdj(spark, sf):
    return W.kdj(_bars(spark, sf)).select("ticker", "d", F.round("k", 4).alias("k"), F.round("dd", 4).alias("dd"), F.round("j", 4).alias("j"))


_MACD = f"""WITH RECURSIVE num AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY d) AS i FROM bars), {_ema("ef", "num", "close", "(2.0::DOUBLE / 13)")}, {_ema("es", "num", "close", "(2.0::DOUBLE / 27)")},
mc AS (SELECT ticker, i, ef.y - es.y AS m FROM ef JOIN es USING (ticker, i)), {_ema("sg", "mc", "m", "(2.0::DOUBLE / 10)")}
SELECT num.ticker, num.d, round(mc.m, 4) AS macd, round(sg.y, 4) AS line FROM num JOIN mc USING (ticker, i) JOIN sg USING (ticker, i)"""


@query(["bars"], _MACD)
def w7c_macd(spark, sf):
    return W.macd(_bars(spark, sf)).select("ticker", "d", F.round("macd", 4).alias("macd"), F.round("line", 4).alias("line"))


def _whole(spark, sf):
    """Bars of whole numbers, three times the price, so that sums and typical prices are exact in any order."""
    return _bars(spark, sf).withColumns({c: 3 * F.floor(c).cast("double") for c in ("high", "low", "close")})


_WHOLE = "SELECT ticker, d, 3 * floor(high) AS high, 3 * floor(low) AS low, 3 * floor(close) AS close, volume FROM bars"


@query(["bars"], f"""SELECT ticker, d, avg(close) OVER f AS boll, round(avg(close) OVER f + 2 * stddev_samp(close) OVER f, 4) AS boll_ub, round(avg(close) OVER f - 2 * stddev_samp(close) OVER f, 4) AS boll_lb
FROM ({_WHOLE}) WINDOW f AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def w1_bollinger(spark, sf):
    return W.bollinger(_whole(spark, sf)).select("ticker", "d", "boll", *[F.round(c, 4).alias(c) for c in ("boll_ub", "boll_lb")])


_ATR = f"""WITH RECURSIVE num AS (SELECT *, row_number() OVER w AS i, greatest(high, lag(close) OVER w) - least(low, lag(close) OVER w) AS tr FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY d)),
{_ema("av", "num", "tr", "(1.0::DOUBLE / 14)")} SELECT num.ticker, num.d, round(av.y, 4) AS atr FROM num JOIN av USING (ticker, i)"""


@query(["bars"], _ATR)
def w1_atr(spark, sf):
    return W.atr(_bars(spark, sf)).select("ticker", "d", F.round("atr", 4).alias("atr"))


@query(["bars"], f"""SELECT ticker, d, CASE WHEN sum(up + down) OVER f > 0 THEN 100 * sum(up) OVER f / sum(up + down) OVER f ELSE 50.0::DOUBLE END AS mfi FROM (
  SELECT ticker, d, CASE WHEN tp > lag(tp) OVER w THEN tp * volume ELSE 0.0::DOUBLE END AS up, CASE WHEN tp < lag(tp) OVER w THEN tp * volume ELSE 0.0::DOUBLE END AS down
  FROM (SELECT *, (high + low + close) / 3 AS tp FROM ({_WHOLE})) WINDOW w AS (PARTITION BY ticker ORDER BY d)) WINDOW f AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""")
def w1_mfi(spark, sf):
    return W.mfi(_whole(spark, sf)).select("ticker", "d", "mfi")


@query(["bars"], f"""SELECT ticker, d, CASE WHEN sum(volume) OVER f > 0 THEN sum(close * volume) OVER f / sum(volume) OVER f END AS vwma
FROM ({_WHOLE}) WINDOW f AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""")
def w1_vwma(spark, sf):
    return W.vwma(_whole(spark, sf)).select("ticker", "d", "vwma")


_TARGET = "CASE WHEN confidence < 0.55::DOUBLE THEN NULL WHEN signal = 'BUY' THEN 1.0::DOUBLE WHEN signal = 'OVERWEIGHT' THEN 0.75::DOUBLE WHEN signal = 'UNDERWEIGHT' THEN 0.25::DOUBLE WHEN signal = 'SELL' THEN 0.0::DOUBLE END"
_POS = f"pos AS (SELECT *, coalesce(last_value({_TARGET} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY seq ROWS UNBOUNDED PRECEDING), 0.0::DOUBLE) AS position FROM signals)"
_EQ = f"""{_POS}, tn AS (SELECT *, abs(position - coalesce(lag(position) OVER (PARTITION BY ticker ORDER BY seq), 0)) AS turnover FROM pos),
nt AS (SELECT *, position * actual_return - 0.0005::DOUBLE * turnover AS net FROM tn), eq AS (SELECT *, product(1 + net) OVER (PARTITION BY ticker ORDER BY seq ROWS UNBOUNDED PRECEDING) AS equity FROM nt),
dd AS (SELECT *, equity / max(equity) OVER (PARTITION BY ticker ORDER BY seq ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM eq)"""


def _signals(spark, sf):
    return view(spark, sf, "signals")


@query(["signals"], f"WITH {_POS} SELECT ticker, seq, position FROM pos")
def w9_rating_positions(spark, sf):
    return W.positions(_signals(spark, sf)).select("ticker", "seq", "position")


@query(["signals"], f"WITH {_EQ} SELECT ticker, seq, turnover, floor(equity * 1e6 + 0.5::DOUBLE) / 1e6 AS equity, floor(drawdown * 1e6 + 0.5::DOUBLE) / 1e6 AS drawdown FROM dd")
def w11_equity_curve(spark, sf):
    return W.equity(W.positions(_signals(spark, sf))).select("ticker", "seq", "turnover", *[(F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c) for c in ("equity", "drawdown")])


_M = "ds > 0"
_RF = "(pow(1.05::DOUBLE, 1.0::DOUBLE / 252) - 1)"


@query(["signals"], f"""WITH {_EQ}, a AS (SELECT ticker, count(*) AS n, arg_max(equity, seq) AS final, min(drawdown) AS mdd, avg(net) AS m, stddev_pop(net) AS s, sqrt(avg(CASE WHEN net < {_RF} THEN pow(net - {_RF}, 2) END)) AS ds, sum(turnover) AS tv FROM dd GROUP BY ticker)
SELECT ticker, n, round(final - 1, 6) AS total_return, round(CASE WHEN final > 0 THEN pow(final, 252.0::DOUBLE / n) - 1 END, 4) AS annual_return, round(mdd, 6) AS max_drawdown, round(CASE WHEN s > 0 THEN (m - {_RF}) / s * sqrt(252) END, 5) AS sharpe,
  round(CASE WHEN ds > 0 THEN (m - {_RF}) / ds * sqrt(252) END, 5) AS sortino, round(s * sqrt(252), 6) AS volatility, tv AS turnover FROM a""")
def a4_strategy_metrics(spark, sf):
    m = W.strategy_metrics(W.equity(W.positions(_signals(spark, sf))))
    digits = {"annual_return": 4, "sharpe": 5, "sortino": 5}
    return m.select("ticker", "n", *[F.round(c, digits.get(c, 6)).alias(c) for c in ("total_return", "annual_return", "max_drawdown", "sharpe", "sortino", "volatility")], "turnover")


@query(["signals"], f"""WITH {_POS}, c AS (SELECT *, position * actual_return AS step, product(1 + position * actual_return) OVER (PARTITION BY ticker ORDER BY seq ROWS UNBOUNDED PRECEDING) AS curve FROM pos),
p AS (SELECT *, greatest(1.0::DOUBLE, max(curve) OVER (PARTITION BY ticker ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS peak FROM c)
SELECT ticker, round(100 * (arg_max(curve, seq) - 1), 5) AS cr, round(avg(step) / (stddev_samp(step) + 1e-9) * sqrt(252), 5) AS sr, round(-100 * least(0.0::DOUBLE, min(curve / peak - 1)), 5) AS mdd FROM p GROUP BY ticker""")
def a5_capital_metrics(spark, sf):
    return W.capital_metrics(W.positions(_signals(spark, sf))).select("ticker", *[F.round(c, 5).alias(c) for c in ("cr", "sr", "mdd")])


_STEP = "CASE WHEN signal IN ('BUY', 'OVERWEIGHT') THEN 1.0::DOUBLE WHEN signal IN ('SELL', 'UNDERWEIGHT') THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END"


def _stack(gate: str) -> str:
    return f"""WITH RECURSIVE st AS (SELECT ticker, seq, CASE WHEN {gate} THEN {_STEP} ELSE 0.0::DOUBLE END AS s FROM signals),
r AS (SELECT ticker, seq, greatest(-1, least(1, s)) AS p FROM st WHERE seq = 1 UNION ALL SELECT st.ticker, st.seq, greatest(-1, least(1, r.p + st.s)) FROM r JOIN st ON st.ticker = r.ticker AND st.seq = r.seq + 1)
SELECT ticker, seq, p AS position FROM r"""


@query(["signals"], _stack("true"))
def w8a_bounded_stack(spark, sf):
    return W.bounded_stack(_signals(spark, sf).select("ticker", "seq", "signal", "confidence")).select("ticker", "seq", "position")


@query(["signals"], _stack("confidence >= 0.7::DOUBLE"))
def w8b_filtered_stack(spark, sf):
    return W.bounded_stack(_signals(spark, sf).select("ticker", "seq", "signal", "confidence"), 0.7).select("ticker", "seq", "position")


@query(["signals"], """SELECT ticker, seq, round(coalesce(last_value(CASE WHEN signal IN ('BUY', 'OVERWEIGHT') THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, 2 * (confidence - 0.5::DOUBLE)))
  WHEN signal IN ('SELL', 'UNDERWEIGHT') THEN -least(1.0::DOUBLE, greatest(0.0::DOUBLE, 2 * (confidence - 0.5::DOUBLE))) END IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY seq ROWS UNBOUNDED PRECEDING), 0.0::DOUBLE), 6) AS position FROM signals""")
def w8c_scaled_positions(spark, sf):
    return _signals(spark, sf).select("ticker", "seq", r6(W.scaled_positions(W.by(order="seq"))).alias("position"))


_RIGHT = "(signal IN ('BUY', 'OVERWEIGHT') AND actual_return > 0 OR signal IN ('SELL', 'UNDERWEIGHT') AND actual_return < 0)"


@query(["signals"], f"SELECT ticker, round(avg(CAST({_RIGHT} AS DOUBLE)), 6) AS accuracy, count(*) AS n FROM signals WHERE signal IN ('BUY', 'OVERWEIGHT', 'SELL', 'UNDERWEIGHT') GROUP BY ticker")
def a3_directional_accuracy(spark, sf):
    return W.directional_accuracy(_signals(spark, sf)).select("ticker", r6("accuracy").alias("accuracy"), "n")


@query(["signals"], f"""WITH b(bin, lo, hi) AS (VALUES (0, 0.5::DOUBLE, 0.6::DOUBLE), (1, 0.6::DOUBLE, 0.7::DOUBLE), (2, 0.7::DOUBLE, 0.8::DOUBLE), (3, 0.8::DOUBLE, 0.9::DOUBLE), (4, 0.9::DOUBLE, 1.01::DOUBLE)),
g AS (SELECT bin, lo, hi, count(signal) AS n, avg(CASE WHEN signal IS NOT NULL THEN CAST({_RIGHT} AS DOUBLE) END) AS accuracy FROM b LEFT JOIN (SELECT * FROM signals WHERE signal IN ('BUY', 'OVERWEIGHT', 'SELL', 'UNDERWEIGHT')) s ON confidence >= lo AND confidence < hi GROUP BY bin, lo, hi)
SELECT bin, n, round(accuracy, 6) AS accuracy, CASE WHEN n = 0 THEN 'no data' WHEN accuracy - (lo + least(hi, 1.0::DOUBLE)) / 2 > 0.1 THEN 'underconfident' WHEN accuracy - (lo + least(hi, 1.0::DOUBLE)) / 2 < -0.1 THEN 'overconfident' ELSE 'calibrated' END AS assessment FROM g""")
def a1_calibration(spark, sf):
    return W.calibration(_signals(spark, sf)).select("bin", "n", r6("accuracy").alias("accuracy"), "assessment")


@query(["signals"], f"""WITH b(bin, lo, hi) AS (VALUES (0, 0.5::DOUBLE, 0.6::DOUBLE), (1, 0.6::DOUBLE, 0.7::DOUBLE), (2, 0.7::DOUBLE, 0.8::DOUBLE), (3, 0.8::DOUBLE, 0.9::DOUBLE), (4, 0.9::DOUBLE, 1.01::DOUBLE)),
s AS (SELECT * FROM signals WHERE signal IN ('BUY', 'OVERWEIGHT', 'SELL', 'UNDERWEIGHT')), t AS (SELECT ticker, count(*) AS total FROM s GROUP BY ticker),
g AS (SELECT t.ticker, total, bin, lo, hi, count(signal) AS n, avg(CASE WHEN signal IS NOT NULL THEN CAST({_RIGHT} AS DOUBLE) END) AS accuracy FROM t CROSS JOIN b LEFT JOIN s ON s.ticker = t.ticker AND confidence >= lo AND confidence < hi GROUP BY ALL)
SELECT ticker, bin, n, round(accuracy, 6) AS accuracy, total < 50 AS unreliable FROM g""")
def y41_calibration_by_ticker(spark, sf):
    """A calibration table for each ticker, with the warning of those that hold too few signals."""
    return W.calibration(_signals(spark, sf), by=["ticker"]).select("ticker", "bin", "n", r6("accuracy").alias("accuracy"), "unreliable")


@query(["signals"], "SELECT ticker, signal, count(*) AS n, CAST(sum(CAST(round(actual_return * 10000) AS BIGINT)) AS BIGINT) AS points FROM signals GROUP BY CUBE (ticker, signal)")
def a32_signal_cube(spark, sf):
    return _signals(spark, sf).cube("ticker", "signal").agg(F.count("*").alias("n"), F.sum(F.round(F.col("actual_return") * 10000).cast("long")).alias("points"))


# ------------------------------------------------- reports, lookups, evaluation

_IND = f"""WITH RECURSIVE num AS (SELECT *, row_number() OVER w AS i, avg(close) OVER (w ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS sma FROM bars WHERE d <= DATE '1996-06-28' WINDOW w AS (PARTITION BY ticker ORDER BY d)),
{_ema("ef", "num", "close", "(2.0::DOUBLE / 13)")}, {_ema("es", "num", "close", "(2.0::DOUBLE / 27)")}, mc AS (SELECT ticker, i, ef.y - es.y AS m FROM ef JOIN es USING (ticker, i)), {_ema("sg", "mc", "m", "(2.0::DOUBLE / 10)")},
v AS (SELECT num.ticker, num.d, unnest(['close_50_sma', 'macd', 'macdh']) AS indicator, unnest([sma, m, m - sg.y]) AS v FROM num JOIN mc USING (ticker, i) JOIN sg USING (ticker, i)),
g AS (SELECT ticker, CAST(DATE '1996-06-28' - CAST(k AS INT) AS DATE) AS d, unnest(['close_50_sma', 'macd', 'macdh']) AS indicator FROM (SELECT DISTINCT ticker FROM num), (SELECT unnest(range(21)) AS k))"""


@query(["bars"], _IND + " SELECT ticker, d, indicator, round(v, 4) AS v, v IS NULL AS closed FROM g LEFT JOIN v USING (ticker, d, indicator)")
def w1_w2_w3a_indicator_report(spark, sf):
    """Several indicators by name for every calendar day of the look-back; values as text, a notice on days without trading."""
    names, _ = T.named("close_50_sma, MACD, macdh, nonsense")
    r = T.report(_bars(spark, sf), names, "1996-06-28", 20)
    value = T.indicators(_bars(spark, sf).where("d <= DATE '1996-06-28'"), names).unpivot(["ticker", "d"], list(names), "indicator", "v")
    out = r.join(value, ["ticker", "d", "indicator"], "left")
    text = F.col("value").try_cast("double")
    agree = F.col("v").isNull() & (F.col("value") == T.CLOSED) | (F.abs(text - F.col("v")) <= 0.00051)  # the text says what the number is
    return out.select("ticker", "d", "indicator", F.when(agree, F.round("v", 4)).alias("v"), (F.col("value") == T.CLOSED).alias("closed"))


@query(["bars"], _IND + " SELECT ticker, coalesce(CAST(round(max(v) FILTER (d = DATE '1996-06-28'), 3) AS VARCHAR), 'N/A: Not a trading day (weekend or holiday)') AS value FROM v WHERE indicator = 'close_50_sma' GROUP BY ticker")
def w2a_y17_single_indicator(spark, sf):
    one = T.report(_bars(spark, sf), ("close_50_sma",), "1996-06-28", 0)
    number = F.round(F.col("value").try_cast("double"), 3).cast("string")
    return one.select("ticker", F.coalesce(number, F.col("value")).alias("value"))


@query(["bars"], _IND + " SELECT ticker, d, round(v, 4) AS value FROM v WHERE indicator = 'macd' AND d BETWEEN DATE '1996-06-28' - INTERVAL 30 DAY AND DATE '1996-06-28'")
def w3_indicator_vendor_b(spark, sf):
    return T.csv_report(_bars(spark, sf).where("d <= DATE '1996-06-28'"), "macd", "1996-06-28", 30).withColumn("value", F.round("value", 4))


_NEXT = "nx AS (SELECT ticker, d, (lead(close) OVER w - close) / close AS r FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY d))"


@query(["bars"], f"WITH {_NEXT} SELECT a.ticker, a.d, round(coalesce(r, 0.0::DOUBLE), 6) AS r FROM (SELECT ticker, CAST(d + CAST(ticker % 3 AS INT) AS DATE) AS d FROM bars) a LEFT JOIN (SELECT * FROM nx WHERE r IS NOT NULL) n USING (ticker, d)")
def w4_w4a_return_lookup(spark, sf):
    asked = _bars(spark, sf).select("ticker", F.date_add("d", (F.col("ticker") % 3).cast("int")).alias("d"))
    return T.return_on(asked, _bars(spark, sf)).withColumn("r", r6("r"))


@query(["bars"], "SELECT ticker, coalesce(max(d) FILTER (d BETWEEN DATE '1998-11-01' AND DATE '1998-11-20'), DATE '1998-11-20') AS d FROM bars GROUP BY ticker")
def w4_last_trading_day(spark, sf):
    return T.last_trading_day(_bars(spark, sf), "1998-11-01", "1998-11-20")


@query(["bars"], """WITH a AS (SELECT ticker, d, CASE WHEN dayofweek(d) IN (1, 2) THEN 3 WHEN dayofweek(d) = 6 THEN 4 WHEN dayofweek(d) = 0 THEN 3 ELSE 5 END AS k FROM bars),
c AS (SELECT a.ticker, a.d, b.close, row_number() OVER (PARTITION BY a.ticker, a.d ORDER BY b.d) AS n FROM a JOIN bars b ON b.ticker = a.ticker AND b.d >= a.d AND b.d <= a.d + CAST(k AS INT))
SELECT ticker, d, round(max(close) FILTER (n = 2) / max(close) FILTER (n = 1) - 1, 6) AS r FROM c GROUP BY ticker, d""")
def w4b_return_within(spark, sf):
    b = _bars(spark, sf)
    return T.return_within(b.select("ticker", "d"), b).withColumn("r", r6("r"))


@query(["signals"], "SELECT ticker, seq, 1.0::DOUBLE AS position FROM signals")
def w7a_buy_and_hold(spark, sf):
    return _signals(spark, sf).select("ticker", "seq", F.lit(1.0).alias("position"))


@query(["bars"], _MACD.replace("SELECT num.ticker, num.d, round(mc.m, 4) AS macd, round(sg.y, 4) AS line FROM", """SELECT ticker, d, CASE WHEN i < 26 OR x IS NULL THEN 0.0::DOUBLE WHEN round(x, 9) > 0 THEN 1.0::DOUBLE WHEN round(x, 9) < 0 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS position FROM (
  SELECT num.ticker, num.d, i, lag(mc.m - sg.y) OVER (PARTITION BY num.ticker ORDER BY num.d) AS x FROM""") + ")")
def w7c_macd_positions(spark, sf):
    return W.macd(_bars(spark, sf).select("ticker", "d", "close")).select("ticker", "d", "position")


_K = _KDJ[: _KDJ.index("SELECT rv.ticker")].replace("WITH RECURSIVE num AS (", "WITH RECURSIVE num AS (").strip()
_R = _RSI[_RSI.index("gl AS") : _RSI.index("SELECT gl.ticker")].replace("gl AS (SELECT *, greatest", "dl AS (SELECT *, coalesce(close - lag(close) OVER (PARTITION BY ticker ORDER BY d), 0) AS dl FROM num), gl AS (SELECT *, greatest").replace("FROM num), ag", "FROM dl), ag").strip()


@query(["bars"], f"""{_K}, {_R.rstrip(',')}, x AS (SELECT rv.ticker, rv.d, kk.y AS k, kk.y - dk.y AS gap, 100 - 100 / (1 + ag.y / (al.y + 1e-9)) AS rsi FROM rv JOIN kk USING (ticker, i) JOIN dk USING (ticker, i) JOIN ag USING (ticker, i) JOIN al USING (ticker, i)),
t AS (SELECT ticker, d, lag(k) OVER w AS k1, lag(gap) OVER w AS g1, lag(gap, 2) OVER w AS g2, lag(rsi) OVER w AS r1 FROM x WINDOW w AS (PARTITION BY ticker ORDER BY d)),
s AS (SELECT *, CASE WHEN g1 > 0 AND g2 <= 0 AND k1 < 30 OR r1 < 30 THEN 1.0::DOUBLE WHEN g1 < 0 AND g2 >= 0 AND k1 > 70 OR r1 > 70 THEN -1.0::DOUBLE END AS g FROM t)
SELECT ticker, d, coalesce(last_value(g IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY d ROWS UNBOUNDED PRECEDING), 0.0::DOUBLE) AS position FROM s""")
def w7d_kdj_rsi(spark, sf):
    return W.kdj_rsi(_bars(spark, sf)).select("ticker", "d", "position")


_SIM = f"{_POS}, sm AS (SELECT ticker, CAST(seq AS BIGINT) AS step, 10000 * product(1 + position * actual_return) OVER (PARTITION BY ticker ORDER BY seq ROWS UNBOUNDED PRECEDING) AS value FROM pos UNION ALL SELECT DISTINCT ticker, 0, 10000.0::DOUBLE FROM signals)"


@query(["signals"], f"WITH {_SIM} SELECT ticker, step, round(value, 4) AS value FROM sm")
def w10_simulate(spark, sf):
    return T.simulate(W.positions(_signals(spark, sf))).withColumn("value", F.round("value", 4))


_VAL = """rt AS (SELECT *, value / lag(value) OVER w - 1 AS r, value / max(value) OVER (w ROWS UNBOUNDED PRECEDING) - 1 AS fall FROM {src} WINDOW w AS (PARTITION BY ticker{also} ORDER BY step)),
vm AS (SELECT ticker{also}, (arg_max(value, step) / arg_min(value, step) - 1) * 100 AS cr, (pow(arg_max(value, step) / arg_min(value, step), 252.0::DOUBLE / (count(*) - 1)) - 1) * 100 AS ar,
  (avg(r) - (pow(1.05::DOUBLE, 1.0::DOUBLE / 252) - 1)) / (stddev_samp(r) + 1e-9) * sqrt(252) AS sr, abs(min(fall)) * 100 AS mdd FROM rt GROUP BY ticker{also})"""


@query(["signals"], f"WITH {_SIM}, {_VAL.format(src='sm', also='')} SELECT ticker, round(cr, 4) AS cr, round(ar, 3) AS ar, round(sr, 4) AS sr, round(mdd, 4) AS mdd FROM vm")
def a5_value_metrics(spark, sf):
    m = T.value_metrics(T.simulate(W.positions(_signals(spark, sf))))
    return m.select("ticker", *[F.round(c, 3 if c == "ar" else 4).alias(c) for c in ("cr", "ar", "sr", "mdd")])


def _stacked(name: str, gate: str) -> str:
    return f"{name}s AS (SELECT ticker, seq, actual_return, CASE WHEN {gate} THEN {_STEP} ELSE 0.0::DOUBLE END AS s FROM signals), {name} AS (SELECT ticker, seq, greatest(-1, least(1, s)) AS position, actual_return FROM {name}s WHERE seq = 1 UNION ALL SELECT n.ticker, n.seq, greatest(-1, least(1, p.position + n.s)), n.actual_return FROM {name} p JOIN {name}s n ON n.ticker = p.ticker AND n.seq = p.seq + 1)"


_SCALED = """coalesce(last_value(CASE WHEN signal IN ('BUY', 'OVERWEIGHT') THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, 2 * (confidence - 0.5::DOUBLE))) WHEN signal IN ('SELL', 'UNDERWEIGHT') THEN -least(1.0::DOUBLE, greatest(0.0::DOUBLE, 2 * (confidence - 0.5::DOUBLE))) END IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY seq ROWS UNBOUNDED PRECEDING), 0.0::DOUBLE)"""


@query(["signals"], f"""WITH RECURSIVE {_stacked('sa', 'true')}, {_stacked('sb', 'confidence >= 0.7::DOUBLE')}, al AS (SELECT 'Buy & Hold' AS strategy, 0 AS place, ticker, seq, 1.0::DOUBLE AS position, actual_return FROM signals UNION ALL SELECT 'TA-Signal', 5, ticker, seq, position, actual_return FROM sa
UNION ALL SELECT 'TA-Filtered', 6, ticker, seq, position, actual_return FROM sb UNION ALL SELECT 'TA-Scaled', 7, ticker, seq, {_SCALED}, actual_return FROM signals),
sv AS (SELECT ticker, strategy, place, CAST(seq AS BIGINT) AS step, 10000 * product(1 + position * actual_return) OVER (PARTITION BY strategy, ticker ORDER BY seq ROWS UNBOUNDED PRECEDING) AS value FROM al UNION ALL SELECT DISTINCT ticker, strategy, place, 0, 10000.0::DOUBLE FROM al), {_VAL.format(src='sv', also=', strategy, place')}
SELECT ticker, strategy, CAST(place AS INTEGER) AS place, round(cr, 4) AS cr, round(sr, 4) AS sr, round(mdd, 4) AS mdd FROM vm""")
def k2_y43_strategy_table(spark, sf):
    t = T.strategy_table(_signals(spark, sf))
    return t.select("ticker", "strategy", "place", *[F.round(c, 4).alias(c) for c in ("cr", "sr", "mdd")])


_CUT = "CASE WHEN c > 0.20::DOUBLE THEN 1.0::DOUBLE WHEN c < -0.20::DOUBLE THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END"


@query(["signals"], f"""WITH p AS (SELECT ticker, seq, actual_return, {_CUT} AS pos FROM (SELECT *, 2 * confidence - 1.5::DOUBLE AS c FROM signals)), n AS (SELECT *, pos * actual_return - 0.0005::DOUBLE * abs(pos - coalesce(lag(pos) OVER (PARTITION BY ticker ORDER BY seq), 0)) AS net FROM p)
SELECT ticker, round(sum(net), 6) AS total, round(CASE WHEN stddev_pop(net) >= 1e-8 THEN avg(net) / stddev_pop(net) * sqrt(8) ELSE 0 END, 5) AS sharpe, round(avg(net) * 8, 6) AS annual FROM n GROUP BY ticker""")
def a17_threshold_strategy(spark, sf):
    d = _signals(spark, sf).withColumn("stance", 2 * F.col("confidence") - 1.5)
    t = R.threshold_strategy(d, "stance", "actual_return", "seq")
    return t.select("ticker", r6("total").alias("total"), F.round("sharpe", 5).alias("sharpe"), r6("annual").alias("annual"))


_WORTH = "CASE WHEN confidence < 0.6::DOUBLE THEN NULL WHEN signal = 'BUY' THEN 1.0::DOUBLE WHEN signal = 'OVERWEIGHT' THEN 0.4::DOUBLE WHEN signal = 'UNDERWEIGHT' THEN 0.1::DOUBLE WHEN signal = 'SELL' THEN 0.0::DOUBLE END"
_RF5 = "(pow(1.05::DOUBLE, 1.0::DOUBLE / 252) - 1)"


@query(["signals"], f"""WITH ps AS (SELECT *, 'strategy' AS side, coalesce(last_value({_WORTH} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY seq ROWS UNBOUNDED PRECEDING), 0.0::DOUBLE) AS position, 0.001::DOUBLE AS cost FROM signals UNION ALL SELECT *, 'buy_hold', 1.0::DOUBLE, 0.0::DOUBLE FROM signals),
tn AS (SELECT *, abs(position - coalesce(lag(position) OVER (PARTITION BY side, ticker ORDER BY seq), 0)) AS turnover FROM ps), nt AS (SELECT *, position * actual_return - cost * turnover AS net FROM tn),
eq AS (SELECT *, product(1 + net) OVER (PARTITION BY side, ticker ORDER BY seq ROWS UNBOUNDED PRECEDING) AS equity FROM nt), dd AS (SELECT *, equity / max(equity) OVER (PARTITION BY side, ticker ORDER BY seq ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM eq),
a AS (SELECT side, ticker, count(*) AS n, arg_max(equity, seq) - 1 AS total, min(drawdown) AS mdd, avg(net) AS m, stddev_pop(net) AS s, sqrt(avg(CASE WHEN net < {_RF5} THEN pow(net - {_RF5}, 2) END)) AS ds FROM dd GROUP BY side, ticker),
ac AS (SELECT ticker, avg(CAST({_RIGHT} AS DOUBLE)) AS accuracy FROM signals WHERE signal IN ('BUY', 'OVERWEIGHT', 'SELL', 'UNDERWEIGHT') GROUP BY ticker)
SELECT side, ticker, n, round(total, 6) AS total_return, round(mdd, 6) AS max_drawdown, round(CASE WHEN s > 0 THEN (m - {_RF5}) / s * sqrt(252) END, 5) AS sharpe, round(CASE WHEN ds > 0 THEN (m - {_RF5}) / ds * sqrt(252) END, 5) AS sortino, round(accuracy, 6) AS accuracy,
  round((SELECT sum(turnover) FROM tn WHERE tn.side = 'strategy' AND tn.ticker = a.ticker), 6) AS traded FROM a LEFT JOIN ac USING (ticker)""")
def a6_y44_evaluation(spark, sf):
    e = T.evaluate(_signals(spark, sf), gate=0.6, cost_bps=10.0, overweight=0.4, underweight=0.1)
    return e.select("side", "ticker", "n", *[F.round(c, 5 if c in ("sharpe", "sortino") else 6).alias(c) for c in ("total_return", "max_drawdown", "sharpe", "sortino", "accuracy", "traded")])


@query(["signals"], f"""WITH {_EQ}, c AS (SELECT ticker, seq, equity, product(1 + actual_return) OVER (PARTITION BY ticker ORDER BY seq ROWS UNBOUNDED PRECEDING) AS hold FROM dd)
SELECT ticker, len(list(seq)) AS n, round(list_sum(list(equity)), 4) AS strategy, round(arg_max(hold, seq), 6) AS last FROM c GROUP BY ticker""")
def f21_k1_chart_payload(spark, sf):
    """The arrays that a chart of a backtest gets."""
    p = T.payload(T.curves(_signals(spark, sf)))
    total = F.aggregate("strategy", F.lit(0.0), lambda s, x: s + x)
    return p.select("ticker", F.size("seq").cast("long").alias("n"), F.round(total, 4).alias("strategy"), F.round(F.element_at("buy_hold", -1), 6).alias("last"))


@query(["signals"], "SELECT ticker, event_id, CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE printf('%.2f%%', actual_return * 100) END AS percent, printf('%.3f', confidence) AS number FROM signals")
def f20_shown_numbers(spark, sf):
    r = F.when(F.col("event_id") % 10 == 0, None).when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("actual_return"))
    return _signals(spark, sf).select("ticker", "event_id", T.shown(r, True).alias("percent"), T.shown(F.col("confidence"), False, 3).alias("number"))


@query(["signals"], "SELECT ticker, event_id FROM signals WHERE ticker = (SELECT arg_min(ticker, event_id) FROM signals)")
def s37_first_ticker(spark, sf):
    return T.first_ticker(_signals(spark, sf), "event_id").select("ticker", "event_id")


@query(["signals"], "SELECT ticker, count(*) AS n FROM signals WHERE signal <> 'ERROR' AND NOT ticker % 4 = 0 GROUP BY ticker")
def y42_without_failures(spark, sf):
    s = _signals(spark, sf).withColumn("signal", F.when(F.col("ticker") % 4 == 0, "ERROR").otherwise(F.col("signal")))
    return T.without_failures(s).groupBy("ticker").agg(F.count("*").alias("n"))
