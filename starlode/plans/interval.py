"""Half-open time intervals and granularities."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%d", "%Y-%m", "%Y")
NAMED = {"second": 1, "minute": 60, "fifteen_minute": 900, "thirty_minute": 1800, "hour": 3600, "day": 86400}
MS = timedelta(milliseconds=1)


def instant(text: str) -> datetime:
    """An ISO instant, as a naive UTC time."""
    t = text.strip().replace(" ", "T").removesuffix("Z")
    shift = timedelta()
    if m := re.search(r"(?<=:\d\d)([+-])(\d\d):?(\d\d)$|(?<=\.\d{3})([+-])(\d\d):?(\d\d)$", t):
        sign, h, mi = [x for x in m.groups() if x is not None]
        shift, t = timedelta(hours=int(h), minutes=int(mi)) * (1 if sign == "+" else -1), t[: m.start()]
    for f in FORMATS:
        try:
            return datetime.strptime(t, f) - shift
        except ValueError:
            pass
    raise ValueError(f"not an ISO time: {text!r}")


@dataclass(frozen=True)
class Interval:
    """[start, end); None: unbounded. ``empty`` if nothing can be in it."""

    start: datetime | None = None
    end: datetime | None = None

    @staticmethod
    def parse(text: str) -> Interval:
        a, b = text.split("/")
        if b.startswith("P"):
            start = instant(a)
            return Interval(start, start + Period.parse(b).approximate)
        if a.startswith("P"):
            end = instant(b)
            return Interval(end - Period.parse(a).approximate, end)
        return Interval(instant(a), instant(b))

    @property
    def empty(self) -> bool:
        return self.start is not None and self.end is not None and self.start >= self.end

    def overlap(self, other: Interval) -> Interval:
        starts = [x for x in (self.start, other.start) if x is not None]
        ends = [x for x in (self.end, other.end) if x is not None]
        return Interval(max(starts, default=None), min(ends, default=None))

    def covers(self, other: Interval) -> bool:
        return (self.start is None or other.start is not None and self.start <= other.start) and (self.end is None or other.end is not None and other.end <= self.end)

    def narrowed(self, op: str, at: datetime) -> Interval:
        """With a further comparison of the time; bounds have a resolution of a millisecond."""
        return self.overlap({"<": Interval(None, at), "<=": Interval(None, at + MS), ">": Interval(at + MS, None), ">=": Interval(at, None)}[op])

    def holds(self, time: Column) -> Column:
        out = F.lit(not self.empty)
        if self.start is not None:
            out = out & (time >= F.lit(self.start.isoformat(" ")).cast("timestamp_ntz"))
        if self.end is not None:
            out = out & (time < F.lit(self.end.isoformat(" ")).cast("timestamp_ntz"))
        return out

    def months(self) -> tuple[str | None, str | None]:
        """The first and last month that may hold its instants, like 1995-03."""
        last = None if self.end is None else self.end - timedelta(microseconds=1)
        return None if self.start is None else f"{self.start:%Y-%m}", None if last is None else f"{last:%Y-%m}"


@dataclass(frozen=True)
class Period:
    """An ISO period such as P1M or PT15M."""

    years: int = 0
    months: int = 0
    weeks: int = 0
    days: int = 0
    hours: int = 0
    minutes: int = 0
    seconds: int = 0

    @staticmethod
    def parse(text: str) -> Period:
        m = re.fullmatch(r"P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?", text)
        if not m or not any(m.groups()):
            raise ValueError(f"not an ISO period: {text!r}")
        return Period(*(int(x or 0) for x in m.groups()))

    @property
    def fixed(self) -> timedelta:
        return timedelta(weeks=self.weeks, days=self.days, hours=self.hours, minutes=self.minutes, seconds=self.seconds)

    @property
    def approximate(self) -> timedelta:
        """With months of 30 and years of 365 days."""
        return self.fixed + timedelta(days=365 * self.years + 30 * self.months)

    def column(self) -> Column:
        return F.make_interval(*(F.lit(x) for x in (self.years, self.months, self.weeks, self.days, self.hours, self.minutes)), F.lit(self.seconds))


def bucket(time: Column, granularity) -> Column | None:
    """The start of a time's bucket: None for "all", the time itself for "none", else by name, or by
    {"type": "duration", "duration": ms} or {"type": "period", "period": "P1M", timeZone, origin}."""
    if granularity in (None, "all"):
        return None
    if granularity == "none":
        return time
    if isinstance(granularity, str):
        name = granularity.lower()
        if name in ("week", "month", "quarter", "year"):
            return F.date_trunc(name, time).cast("timestamp_ntz")
        return _seconds(time, NAMED[name], None)
    if granularity.get("type") == "duration":
        return _seconds(time, granularity["duration"] / 1000, granularity.get("origin"))
    zone, p = granularity.get("timeZone"), Period.parse(granularity["period"])
    local = F.from_utc_timestamp(time.cast("timestamp"), zone).cast("timestamp_ntz") if zone and zone != "UTC" else time
    months = 12 * p.years + p.months
    if months and p.fixed:
        raise ValueError("a period has either months or shorter parts")
    if months:
        origin = instant(granularity["origin"]) if granularity.get("origin") else datetime(1970, 1, 1)
        at = (F.year(local) * 12 + F.month(local) - 1) - (origin.year * 12 + origin.month - 1)
        first = F.floor(at / months) * months
        out = F.add_months(F.lit(origin.date()), first.cast("int")).cast("timestamp_ntz")
    else:
        origin = granularity.get("origin") or ("1970-01-05" if p.weeks and not p.days else None)  # weeks begin on Mondays
        out = _seconds(local, p.fixed.total_seconds(), origin)
    return F.to_utc_timestamp(out.cast("timestamp"), zone).cast("timestamp_ntz") if zone and zone != "UTC" else out


def _seconds(time: Column, length: float, origin: str | None) -> Column:
    micros, shift = round(length * 1_000_000), 0
    if origin:
        shift = round((instant(origin) - datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    at = F.unix_micros(time.cast("timestamp")) - shift
    return F.timestamp_micros((at - F.pmod(at, F.lit(micros))) + shift).cast("timestamp_ntz")


def buckets(granularity, interval: Interval) -> int:
    """About how many buckets an interval has, for estimates."""
    if granularity in (None, "all"):
        return 1
    if interval.start is None or interval.end is None:
        raise ValueError("an estimate needs a bounded interval")
    span = max(0.0, (interval.end - interval.start).total_seconds())
    if granularity == "none":
        return max(1, round(span * 1000))
    if isinstance(granularity, str):
        length = NAMED.get(granularity) or {"week": 604800, "month": 30 * 86400, "quarter": 91 * 86400, "year": 365 * 86400}[granularity]
    elif granularity.get("type") == "duration":
        length = granularity["duration"] / 1000
    else:
        length = Period.parse(granularity["period"]).approximate.total_seconds()
    return max(1, round(span / length))
