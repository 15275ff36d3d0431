"""UTC calendar windows over epoch milliseconds."""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MS = {"s": 1000, "m": 60_000, "h": 3_600_000, "D": 86_400_000}
#: A month counts 31 days where only a length is asked for.
MS_M = 31 * MS["D"]
_UNIT = {"s": "second", "m": "minute", "h": "hour", "D": "day", "M": "month"}


def trunc_dim(ms: Column, dim: str) -> Column:
    """Start of the second, minute, hour, day or month that holds a time."""
    if dim in MS:
        return ms - F.pmod(ms, F.lit(MS[dim]))
    return F.unix_millis(F.date_trunc(_UNIT[dim], F.timestamp_millis(ms)))


def add_months(ms: Column, n: int) -> Column:
    """Start of the month ``n`` months after the one that holds a time."""
    return F.unix_millis(F.add_months(F.timestamp_millis(trunc_dim(ms, "M")), n).cast("timestamp"))


def bounds(ms: Column, dim: str, shift: int = 0) -> tuple[Column, Column]:
    """[from, to) of the window that holds a time, ``shift`` windows on."""
    if dim in MS:
        start = trunc_dim(ms, dim) + shift * MS[dim]
        return start, start + MS[dim]
    return add_months(ms, shift), add_months(ms, shift + 1)


def end_of_month(ms: Column) -> Column:
    return add_months(ms, 1) - 1


def yyyymm(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyyMM")


def month_of(ms: int) -> str:
    """The month partition that holds a time."""
    return datetime.fromtimestamp(ms / 1000, UTC).strftime("%Y%m")


def in_months(df: DataFrame, t0: int, t1: int) -> DataFrame:
    """The month partitions from one time to another, where the table is laid out by month: only their files are read."""
    return df.where(F.col("yyyymm").between(month_of(t0), month_of(t1))) if "yyyymm" in df.columns else df


def slot_index(now: Column, ms: Column, dim: str, width: int | None = None) -> Column:
    """Whole windows between a time and ``now``, at least 0; -1 from ``width`` windows on, if one is given."""
    if dim in MS:
        n = (trunc_dim(now, dim) - trunc_dim(ms, dim)) / MS[dim]
    else:
        n = F.months_between(F.timestamp_millis(trunc_dim(now, dim)), F.timestamp_millis(trunc_dim(ms, dim)))
    n = F.greatest(F.lit(0).cast("long"), F.round(n).cast("long"))
    return n if width is None else F.when(n >= width, F.lit(-1).cast("long")).otherwise(n)


def slack_ms(text: str | None) -> int:
    """``10m``, ``2D``...: a number and one of M D h m s; anything else is ten minutes."""
    found = re.fullmatch(r"([0-9]+)([MDhms])", text or "")
    return 600_000 if not found else int(found[1]) * (MS_M if found[2] == "M" else MS[found[2]])


def doc_id(ms: Column, *keys: Column) -> Column:
    """``t/<time, 16 digits>/k/<keys>``: sorts by time."""
    return F.concat(F.lit("t/"), F.lpad(ms.cast("string"), 16, "0"), F.lit("/k/"), F.concat_ws("/", *keys))


def id_time(doc_id: Column) -> Column:
    """The time in a document's id, wherever its part stands; null if there is none."""
    return F.try_to_number(F.nullif(F.regexp_extract(doc_id, r"(?:^|/)t/([0-9]+)(?:/|$)", 1), F.lit("")), F.lit("9" * 19)).cast("long")


def id_keys(doc_id: Column) -> Column:
    """The keys in a document's id, before or after its time; empty if there are none."""
    found = F.regexp_extract(doc_id, r"(?:^|/)k/(.*?)(?:/t/[0-9]+)?$", 1)
    return F.when(found == "", F.array().cast("array<string>")).otherwise(F.split(found, "/"))


def or_zero(x: Column) -> Column:
    """Null and NaN count as 0."""
    return F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))
