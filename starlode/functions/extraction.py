"""Extraction functions of native queries, as columns."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .script import Unsupported, of_text

def extract(spec: Mapping | None, c: Column, time: Column | None = None) -> Column:
    """``c`` as ``spec`` extracts from it."""
    if spec is None:
        return c
    kind = spec["type"]
    if kind == "regex":
        return F.nullif(F.regexp_extract(c.cast("string"), spec["expr"], 1), F.lit(""))
    if kind == "partial":
        return F.when(F.rlike(c.cast("string"), F.lit(spec["expr"])), c)
    if kind == "searchQuery":
        q = spec["query"]
        return F.when(F.contains(F.lower(c.cast("string")), F.lit((q if isinstance(q, str) else q["value"]).lower())), c)
    if kind == "timeFormat":
        t = c.cast("timestamp")
        zone = spec.get("timeZone") or "UTC"
        return F.date_format(F.from_utc_timestamp(t, zone) if zone != "UTC" else t, spec["format"])
    if kind == "time":
        return F.date_format(F.to_timestamp(c.cast("string"), spec["timeFormat"]), spec["resultFormat"])
    if kind == "lookup":
        table = spec["lookup"]["map"]
        if not table:
            return F.lit(None).cast("string")
        found = F.create_map(*map(F.lit, chain.from_iterable(table.items())))[c.cast("string")]
        return F.coalesce(found, c.cast("string")) if spec.get("retainMissingValue") else found
    if kind == "javascript":
        return of_text(spec["function"], c)
    raise Unsupported(f"extraction function '{kind}' can't be evaluated here")
