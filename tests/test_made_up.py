"""Made-up studies, which no query runs on: each against the same draws in SQL."""

import duckdb
from pyspark.sql import functions as F

from chronolake.operators import models, stats, trading


def same(rows, sql):
    key = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert sorted(map(key, rows), key=str) == sorted(map(key, duckdb.sql(sql).fetchall()), key=str)


_U = "(CAST('0x' || left(md5('42:' || i || ':{}'), 8) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 4294967296::DOUBLE"


def test_demo(spark):
    got = trading.demo(spark).select("i", "d", "signal", "confidence", F.round("actual_return", 8).alias("actual_return"))
    same(got.collect(), f"""WITH d AS (SELECT i, CAST(DATE '2024-01-01' + CAST((i + 1) // 5 * 7 + (i + 1) % 5 AS INT) AS DATE) AS d, {_U.format('signal')} AS u, sqrt(-2 * ln({_U.format('cr')})) * cos(2 * pi() * {_U.format('ca')}) AS c, sqrt(-2 * ln({_U.format('xr')})) * cos(2 * pi() * {_U.format('xa')}) AS x FROM (SELECT unnest(range(60)) AS i))
SELECT i, d, CASE WHEN u < 0.28 THEN 'BUY' WHEN u < 0.46 THEN 'OVERWEIGHT' WHEN u < 0.74 THEN 'HOLD' WHEN u < 0.88 THEN 'UNDERWEIGHT' ELSE 'SELL' END AS signal, round(least(0.99, greatest(0.51, 0.7 + 0.13 * c)), 3) AS confidence, round(0.0005 + 0.014 * x, 8) AS actual_return FROM d""")


_UNIT = "(CAST('0x' || left(md5('power:' || sim || ':' || i || ':{}'), 8) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 4294967296::DOUBLE"


def test_power_simulation(spark):
    got = stats.power_simulation(spark)
    same(got.collect(), f"""WITH x AS (SELECT sim, i, CAST(round((sqrt(-2 * ln({_UNIT.format('r')})) * cos(2 * pi() * {_UNIT.format('a')}) + 0.5::DOUBLE) * 1e6) AS BIGINT) AS v FROM (SELECT unnest(range(50)) AS sim) a, (SELECT unnest(range(32)) AS i) b),
o AS (SELECT sim, sum(v) AS seen FROM x GROUP BY sim),
f AS (SELECT sim, draw, sum(v * CASE WHEN CAST('0x' || left(md5('power:' || sim || ':' || draw || ':' || i), 2) AS INTEGER) % 2 = 0 THEN 1 ELSE -1 END) AS s FROM x, (SELECT unnest(range(99)) AS draw) d GROUP BY sim, draw),
p AS (SELECT sim, (count(*) FILTER (s >= seen) + 1)::DOUBLE / (count(*) + 1) AS p FROM f JOIN o USING (sim) GROUP BY sim) SELECT avg(CAST(p <= 0.05::DOUBLE AS DOUBLE)) AS power, count(*) AS sims FROM p""")


_MOCK = "(CAST('0x' || left(md5('mock:' || seed || ':' || event || ':{}'), 8) AS BIGINT)::DOUBLE / 4294967296::DOUBLE - 0.5::DOUBLE)"


def test_pilot_of_branches(spark):
    got = models.branch_contrasts(models.mock_branch(spark, [42, 43, 44], [i / 4 for i in range(5)])).withColumn("contrast", F.round("contrast", 6))
    same(got.collect(), f"""WITH g AS (SELECT s AS seed, d::DOUBLE / 4 AS dose, e AS event FROM (SELECT unnest([42, 43, 44]) AS s) a, (SELECT unnest(range(5)) AS d) b, (SELECT unnest(range(40)) AS e) c), r AS (SELECT seed, dose, {_MOCK.format('y')} AS y, {_MOCK.format('clean')} AS c FROM g)
SELECT seed::BIGINT AS seed, dose, round(avg(abs(y - c) - abs(y - (c + 0.4::DOUBLE * dose * (y - c)))), 6) AS contrast, count(*) AS events FROM r GROUP BY seed, dose""")
