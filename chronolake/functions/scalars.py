"""Dates, probabilities and small numeric functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quarter_end(year: Column, quarter: Column) -> Column:
    return F.last_day(F.make_date(year, quarter * 3, F.lit(1)))


def int_date(d: Column) -> Column:
    return F.date_format(d, "yyyyMMdd").cast("int")


def api_time(d: Column, end: bool = False) -> Column:
    return F.concat(F.date_format(d, "yyyyMMdd"), F.lit("T2359" if end else "T0000"))


def next_weekday(d: Column) -> Column:
    return F.when(F.dayofweek(d) == 7, F.date_add(d, 2)).when(F.dayofweek(d) == 1, F.date_add(d, 1)).otherwise(d)


def drawer_id(wing: Column, room: Column, d: Column) -> Column:
    return F.concat_ws("_", F.lit("drawer"), wing, room, F.substring(F.sha2(F.concat_ws("_", wing, room, d.cast("string")).cast("binary"), 256), 1, 24))


def strict_label(text: Column) -> Column:
    """-1, 0 or 1 from exactly that text; null otherwise."""
    t = F.trim(text)
    return F.when(t.rlike("^(-1|0|1)$"), t.cast("int"))


def iso_utc(text: Column, default_zone: str | None = None) -> Column:
    """ISO text with an offset or Z to an instant; without one only if a zone is given to read it in, else null."""
    aware = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    naive = F.to_utc_timestamp(F.try_to_timestamp(text), default_zone) if default_zone else F.lit(None).cast("timestamp")
    return F.when(aware, F.try_to_timestamp(text)).otherwise(naive)


def post_time(raw: Column) -> Column:
    """Epoch seconds or ISO text to a timestamp; null if neither."""
    return F.coalesce(F.timestamp_seconds(raw.try_cast("double")), F.try_to_timestamp(raw))


def once(value: Column, use) -> Column:
    """`use(value)` with the value worked out once, however often it is read."""
    return F.transform(F.array(value), use)[0]


def _unit(p: Column) -> Column:
    c = F.transform(p, lambda x: F.greatest(x, F.lit(1e-9)))
    return once(c, lambda v: F.transform(v, lambda x: x / F.aggregate(v, F.lit(0.0), lambda s, y: s + y)))


def js_divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence of clipped, renormalised distributions, natural log."""
    a, b = _unit(p), _unit(q)
    part = lambda x, m: x * F.log(x / m)
    terms = F.zip_with(a, b, lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2)
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def sensitivity(l1: Column, l2: Column, l3: Column) -> Column:
    zero = F.lit(0.0)
    return F.struct(l1.alias("entity"), F.greatest(zero, l2 - l1).alias("person"), F.greatest(zero, l3 - l2).alias("date"), l3.alias("total"))


def contaminate(v: Column, dose: Column, future: Column) -> Column:
    """The vector with dose * future added to its first place."""
    return F.transform(v, lambda x, i: F.when(i == 0, x.cast("double") + dose * future).otherwise(x.cast("double")))


def thousands(n: Column) -> Column:
    return F.when(n >= 1000, F.concat(F.replace(F.format_number(n / 1000.0, 1), F.lit(","), F.lit("")), F.lit("k"))).otherwise(n.cast("string"))
