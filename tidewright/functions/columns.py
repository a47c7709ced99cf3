"""Column expressions that several operators share; all are built-ins, safe under ANSI mode and free of time zones."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..specs import Period, sql_ntz

#: Labels of the weather condition codes 1 to 27.
CONDITION_LABELS = dict(enumerate("Clear;Fair;Cloudy;Overcast;Fog;Freezing fog;Light rain;Rain;Heavy rain;Freezing rain;Heavy freezing rain;Sleet;Heavy sleet;Light snowfall;Snowfall;Heavy snowfall;Rain shower;Heavy rain shower;Sleet shower;Heavy sleet shower;Snow shower;Heavy snow shower;Lightning;Hail;Thunderstorm;Heavy thunderstorm;Storm".split(";"), 1))
#: Upper limits of the bands of fine particles, in micrograms per cubic metre; beyond the last: hazardous.
PM25_BANDS = {"good": 9.0, "moderate": 35.4, "unhealthy_sensitive": 55.4, "unhealthy": 125.4, "very_unhealthy": 225.4}
PM25_BEYOND = "hazardous"


def in_periods(ts: str | Column, periods: Iterable[Period]) -> Column:
    """Whether a local time lies in one of the half-open periods; no periods: false."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return reduce(lambda a, p: a | ((ts >= sql_ntz(p.start)) & (ts < sql_ntz(p.end))), periods, F.lit(False))


def bands(value: str | Column, limits: Mapping[str, float], beyond: str) -> Column:
    """The first band whose upper limit a value does not exceed; null stays null."""
    value = F.col(value) if isinstance(value, str) else value
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for name, limit in limits.items():
        out = out.when(value <= limit, name)
    return out.otherwise(beyond)


def labelled(code: str | Column, labels: Mapping) -> Column:
    """A code's label; an unknown code: ``Unknown (code)``; null stays null."""
    code = F.col(code) if isinstance(code, str) else code
    table = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    return F.coalesce(F.try_element_at(table, code), F.concat(F.lit("Unknown ("), code.cast("string"), F.lit(")")))


def hour_of(ts: str | Column) -> Column:
    """The hour a local time lies in, as local time: date_trunc would turn it into an instant."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.lit(0), F.lit(0))


def seconds_between(start: str, end: str) -> Column:
    """Whole seconds from one local time to another."""
    return F.expr(f"timestampdiff(SECOND, `{start}`, `{end}`)")


def cents(value: str | Column) -> Column:
    """An amount in whole cents: sums of integers do not depend on the order."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value * 100).cast("bigint")


def mean_cents(value: str) -> Column:
    return F.sum(cents(value)).cast("double") / F.count(value)


def snake(name: str) -> str:
    words = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", re.sub(r"[^A-Za-z0-9]+", "_", name))
    return re.sub(r"_+", "_", words).strip("_").lower() or "column"


def optional(df: DataFrame, name: str, kind: str) -> Column:
    """The column if the frame has it, else a typed null."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast(kind)


def where_valid(value: str, valid: Column) -> Column:
    return F.when(valid, F.col(value))


def clock(date: str, time: str) -> Column:
    """HH:mm:ss from clock texts, durations or mis-dated times that end in one; other texts stay as they are.

    Only texts that end in a real h:mm[:ss] beside a known date are rewritten; nulls stay null.
    """
    found = F.regexp_extract(time, r"(\d{1,2}):(\d{2})(?::(\d{2}))?\s*$", 0)
    full = F.when(F.length(F.regexp_replace(found, "[^:]", "")) == 1, F.concat(F.trim(found), F.lit(":00"))).otherwise(F.trim(found))
    full = F.lpad(full, 8, "0")
    real = (F.substring(full, 1, 2) < "24") & (F.substring(full, 4, 2) < "60") & (F.substring(full, 7, 2) < "60")
    return F.when((found != "") & F.col(date).isNotNull() & real, full).otherwise(F.col(time))


def version_set(column: str) -> Column:
    """Sorted distinct versions of a group."""
    return F.sort_array(F.collect_set(column))


def merged_version_set(column: str) -> Column:
    """Sorted distinct versions over a group's arrays of versions; a null array counts as empty."""
    return F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.coalesce(F.col(column), F.array().cast("array<int>"))))))


def text_hash(columns: Sequence[str], separator: str = "||") -> Column:
    """SHA-256 of the columns' texts; nulls leave no trace, so columns of unlike nulls can collide: kept for old identities."""
    return F.sha2(F.concat_ws(separator, *(F.col(f"`{c}`").cast("string") for c in columns)), 256)


def content_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of the columns as JSON in order of name, nulls included: equal only for equal contents."""
    return F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(columns))), {"ignoreNullFields": "false"}), 256)


def bucket(key: str, n: int, seed: int = 0) -> Column:
    """A pseudo-random but repeatable number below n for each key: 60 bits of the MD5 of seed and key, which any engine has."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % n


def sampled(key: str, share: float, seed: int = 0) -> Column:
    """Whether a key falls into a repeatable sample of the given share."""
    return bucket(key, 1_000_000, seed) < round(share * 1_000_000)


def time_range(df: DataFrame, ts: str, start: str, end: str, year: str | None = None, month: str | None = None) -> DataFrame:
    """Rows of [start, end), with the predicate on year and month partitions that follows from it, so that a scan prunes them."""
    out = df.where(in_periods(ts, [Period(start, end)]))
    if year and month:
        (y, m), (y2, m2) = (map(int, x[:7].split("-")) for x in (start, end))
        months = [(k // 12, k % 12 + 1) for k in range(y * 12 + m - 1, y2 * 12 + m2)]
        by_year: dict[int, list[int]] = {}
        for a, b in months:
            by_year.setdefault(a, []).append(b)
        out = out.where(reduce(lambda c, kv: c | ((F.col(year) == kv[0]) & F.col(month).isin(kv[1])), by_year.items(), F.lit(False)))
    return out
