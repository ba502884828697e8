"""The date vocabulary, as thin column builders, and the same names for SQL as session variables'
expansion (``sql_functions``). All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..plans.interval import Period


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def date_time(x) -> Column:
    return F.to_timestamp(_c(x)).cast("timestamp_ntz")


def date_time_with_format(x, pattern: str) -> Column:
    return F.to_timestamp(_c(x), pattern).cast("timestamp_ntz")


def with_zone(x, zone: str) -> Column:
    """A UTC time as it reads in ``zone``."""
    return F.from_utc_timestamp(_c(x).cast("timestamp"), zone).cast("timestamp_ntz")


def period(text: str) -> Column:
    return Period.parse(text).column()


def date_plus(x, p: str) -> Column:
    return _c(x) + period(p)


def date_minus(x, p: str) -> Column:
    return _c(x) - period(p)


def date_is_before(a, b) -> Column:
    return _c(a) < _c(b)


def date_is_before_or_equal(a, b) -> Column:
    return _c(a) <= _c(b)


def date_is_after(a, b) -> Column:
    return _c(a) > _c(b)


def date_is_after_or_equal(a, b) -> Column:
    return _c(a) >= _c(b)


ELEMENTS = {
    "era": lambda t: F.when(F.year(t) > 0, "AD").otherwise("BC"),
    "centuryOfEra": lambda t: F.floor(F.year(t) / 100).cast("int"),
    "yearOfEra": lambda t: F.year(t),
    "yearOfCentury": lambda t: F.year(t) % 100,
    "year": lambda t: F.year(t),
    "weekyear": lambda t: F.extract(F.lit("YEAROFWEEK"), t),
    "monthOfYear": lambda t: F.month(t),
    "monthOfYearName": lambda t: F.date_format(t, "MMMM"),
    "weekOfWeekyear": lambda t: F.weekofyear(t),
    "dayOfYear": lambda t: F.dayofyear(t),
    "dayOfMonth": lambda t: F.dayofmonth(t),
    "dayOfWeek": lambda t: F.weekday(t) + 1,
    "dayOfWeekName": lambda t: F.date_format(t, "EEEE"),
    "hourOfDay": lambda t: F.hour(t),
    "secondOfMinute": lambda t: F.second(t),
}


def element(name: str, x) -> Column:
    """One of the fifteen elements of a time, by its name."""
    return ELEMENTS[name](_c(x))


SQL_FUNCTIONS = (
    ("dateTime(x STRING) RETURNS TIMESTAMP_NTZ", "cast(to_timestamp(x) AS TIMESTAMP_NTZ)"),
    ("dateTimeWithFormat(x STRING, f STRING) RETURNS TIMESTAMP_NTZ", "cast(to_timestamp(x, f) AS TIMESTAMP_NTZ)"),
    ("dateTimeWithTZ(x STRING, z STRING) RETURNS TIMESTAMP_NTZ", "cast(to_utc_timestamp(to_timestamp(x), z) AS TIMESTAMP_NTZ)"),
    ("withZone(t TIMESTAMP_NTZ, z STRING) RETURNS TIMESTAMP_NTZ", "cast(from_utc_timestamp(t, z) AS TIMESTAMP_NTZ)"),
    ("dateIsBefore(a TIMESTAMP_NTZ, b TIMESTAMP_NTZ) RETURNS BOOLEAN", "a < b"),
    ("dateIsBeforeOrEqual(a TIMESTAMP_NTZ, b TIMESTAMP_NTZ) RETURNS BOOLEAN", "a <= b"),
    ("dateIsAfter(a TIMESTAMP_NTZ, b TIMESTAMP_NTZ) RETURNS BOOLEAN", "a > b"),
    ("dateIsAfterOrEqual(a TIMESTAMP_NTZ, b TIMESTAMP_NTZ) RETURNS BOOLEAN", "a >= b"),
    ("period(p STRING) RETURNS INTERVAL DAY TO SECOND", "make_dt_interval(cast(coalesce(nullif(regexp_extract(p, '([0-9]+)D', 1), ''), '0') AS INT), cast(coalesce(nullif(regexp_extract(p, 'T.*?([0-9]+)H', 1), ''), '0') AS INT), cast(coalesce(nullif(regexp_extract(p, 'T.*?([0-9]+)M', 1), ''), '0') AS INT), cast(coalesce(nullif(regexp_extract(p, 'T.*?([0-9]+)S', 1), ''), '0') AS DECIMAL(18,6)))"),
    ("datePlus(t TIMESTAMP_NTZ, p INTERVAL DAY TO SECOND) RETURNS TIMESTAMP_NTZ", "t + p"),
    ("dateMinus(t TIMESTAMP_NTZ, p INTERVAL DAY TO SECOND) RETURNS TIMESTAMP_NTZ", "t - p"),
    ("era(t TIMESTAMP_NTZ) RETURNS STRING", "CASE WHEN year(t) > 0 THEN 'AD' ELSE 'BC' END"),
    ("centuryOfEra(t TIMESTAMP_NTZ) RETURNS INT", "cast(floor(year(t) / 100) AS INT)"),
    ("yearOfEra(t TIMESTAMP_NTZ) RETURNS INT", "year(t)"),
    ("yearOfCentury(t TIMESTAMP_NTZ) RETURNS INT", "year(t) % 100"),
    ("weekyear(t TIMESTAMP_NTZ) RETURNS INT", "extract(YEAROFWEEK FROM t)"),
    ("monthOfYear(t TIMESTAMP_NTZ) RETURNS INT", "month(t)"),
    ("monthOfYearName(t TIMESTAMP_NTZ) RETURNS STRING", "date_format(t, 'MMMM')"),
    ("weekOfWeekyear(t TIMESTAMP_NTZ) RETURNS INT", "weekofyear(t)"),
    ("dayOfWeekName(t TIMESTAMP_NTZ) RETURNS STRING", "date_format(t, 'EEEE')"),
    ("hourOfDay(t TIMESTAMP_NTZ) RETURNS INT", "hour(t)"),
    ("secondOfMinute(t TIMESTAMP_NTZ) RETURNS INT", "second(t)"),
)


def register(spark: SparkSession) -> list[str]:
    """Makes the vocabulary known to SQL as temporary SQL functions; Catalyst inlines their bodies."""
    for head, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head, _ in SQL_FUNCTIONS]
