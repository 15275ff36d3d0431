"""Reports from stored states: the newest snapshot of a month, and the usage since.

A snapshot holds the mergeable states of a month's usage billed up to a time, in
the version of the tables that it was made from. A report as of a later time adds
what a later version has beside that (documents that were on their way), and of the
snapshot's own files those of days of billing from its time on: what is read grows
with the time since the snapshot, not with the month.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.calendar import bounds, month_of
from ..operators.accumulate import accumulate_by_plan, merge_accumulated
from ..operators.report import report_of
from ..plans.catalog import Catalog
from ..sources.versions import Tables, Version
from .ingest import state_schema

#: Columns of metered usage that states are made from.
_USAGE = "metric string, accumulate string, value double, consuming double, previous_consuming double, start_ms long, end_ms long, arrival_ms long, billing_ms long"


def usage_schema(keys: list[str]) -> str:
    return ", ".join([*(f"{k} string" for k in keys), _USAGE])


def _day(ms: int) -> str:
    from datetime import UTC, datetime

    return datetime.fromtimestamp(ms / 1000, UTC).strftime("%Y%m%d")


def _end_of_month(t: int) -> int:
    from datetime import UTC, datetime

    d = datetime.fromtimestamp(t / 1000, UTC)
    return int(datetime(d.year + d.month // 12, d.month % 12 + 1, 1, tzinfo=UTC).timestamp() * 1000) - 1


def _newest(base: Version, t: int) -> tuple[int, int, list[str]] | None:
    """Time, version and folders of the month's newest snapshot up to t. One of the month's last millisecond is not used: usage that comes in the slack is billed then."""
    found = []
    for part, folders in base.parts.get("snapshots", {}).items():
        month, at, version = re.fullmatch(r"yyyymm=(\d+)/at_ms=(\d+)/made_of=(\d+)", part).groups()
        if month == month_of(t) and int(at) <= t and int(at) < _end_of_month(t):
            found.append((int(at), int(version), folders))
    return max(found, default=None)


def states_as_of(tables: Tables, t: int, catalog: Catalog, keys: list[str] = schemas.KEYS, base: Version | None = None) -> DataFrame:
    """The mergeable states of the month of ``t``, of usage billed by then."""
    base = base or tables.latest()
    month, newest = month_of(t), _newest(base, t)
    parts = {p: fs for p, fs in base.parts.get("usage", {}).items() if p.startswith(f"yyyymm={month}/")}
    start, end = bounds(F.lit(t), "M")
    seen = (F.col("end_ms") >= start) & (F.col("end_ms") < end) & (F.col("billing_ms") <= t)
    day = lambda part: part.split("billed=")[1]
    held: set[str] = set()
    if newest:
        held = {f for fs in tables.version(newest[1]).parts.get("usage", {}).values() for f in fs}
    new = [f for p, fs in parts.items() for f in fs if f not in held and day(p) <= _day(t)]
    since = [f for p, fs in parts.items() for f in fs if f in held and _day(newest[0]) <= day(p) <= _day(t)] if newest else []
    rows = tables.read("usage", usage_schema(keys), folders=new).where(seen)
    if since:
        rows = rows.unionByName(tables.read("usage", usage_schema(keys), folders=since).where(seen & (F.col("billing_ms") > newest[0])))
    states = accumulate_by_plan(rows, catalog, keys, mergeable=True)
    if newest:
        states = merge_accumulated(states.unionByName(tables.read("snapshots", state_schema(keys), folders=newest[2])), keys, catalog)
        if "state" not in states.columns:
            states = states.withColumn("state", F.lit(None).cast("string"))
    return states


def take_snapshot(tables: Tables, t: int, catalog: Catalog, keys: list[str] = schemas.KEYS) -> Version:
    """Stores the states of the month of ``t`` as of then, from the snapshot before and the usage since."""
    base = tables.latest()
    rows = states_as_of(tables, t, catalog, keys, base).withColumns({"yyyymm": F.lit(month_of(t)), "at_ms": F.lit(t), "made_of": F.lit(base.number)})
    return tables.commit(base, {"snapshots": tables.write(rows, "snapshots", ["yyyymm", "at_ms", "made_of"])})


def stored_report(tables: Tables, t: int, catalog: Catalog, orgs: list[str] | None = None) -> DataFrame:
    """``org_report`` as of ``t``, from the newest snapshot and the usage since."""
    states = states_as_of(tables, t, catalog)
    return report_of(states if orgs is None else states.where(F.col("organization_id").isin(*orgs)), t, catalog)
