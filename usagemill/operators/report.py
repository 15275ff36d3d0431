"""Reports as of a time: slots, summaries, ratings, deltas, nested views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.calendar import bounds, in_months, slot_index
from ..plans.catalog import Catalog, picked, resolved
from ..plans.sandbox import names_seen
from .accumulate import accumulate, accumulate_by_plan, aggregate_tree, bucket_end, decimal

LEVEL_KEYS = ["level", "organization_id", "space_id", "consumer_id"]


def as_of(metered: DataFrame, t: int, orgs: DataFrame | list[str] | None = None, resource_id: str | None = None) -> DataFrame:
    """Usage of the month of ``t`` that was billed by then. A table laid out by month (yyyymm, of the usage's end) is read for that month only; organizations and resource narrow the scan."""
    start, end = bounds(F.lit(t), "M")
    out = in_months(metered, t, t).where((F.col("end_ms") >= start) & (F.col("end_ms") < end) & (F.col("billing_ms") <= t))
    if resource_id is not None:
        out = out.where(F.col("resource_id") == resource_id)
    if isinstance(orgs, list):
        out = out.where(F.col("organization_id").isin(*orgs))
    elif orgs is not None:
        out = out.join(orgs.select("organization_id").distinct(), "organization_id", "left_semi")
    return out


def with_slots(df: DataFrame, t: int) -> DataFrame:
    """Adds ``slot``, windows before that of ``t``; windows after it go."""
    at = F.lit(t)
    slot = F.when(F.col("dimension") == "D", slot_index(at, F.col("bucket_ms"), "D")).otherwise(slot_index(at, F.col("bucket_ms"), "M"))
    return df.where(F.col("bucket_ms") <= t).withColumn("slot", slot)


def summary_time_based(t: Column, consuming: Column, consumed: Column, from_ms: Column, to_ms: Column) -> Column:
    """Unit-hours up to t: what is consumed by the window's end, less what would run on after t."""
    span = (from_ms + to_ms - 2 * F.least(t, to_ms)).cast("decimal(14,0)")
    return ((consumed.cast("decimal(28,6)") - (consuming.cast("decimal(18,6)") * span).cast("decimal(28,6)")).cast("double")) / 2 / 3_600_000


def summarize(df: DataFrame, t: int) -> DataFrame:
    """Adds ``summary``: unit-hours for time-based metrics, else the quantity or 0. A metric without a plan has 0."""
    to = bucket_end(F.col("dimension"), F.col("bucket_ms"))
    timed = summary_time_based(F.lit(t), F.col("consuming"), F.col("consumed"), F.col("bucket_ms"), to)
    value = F.when(F.col("accumulate") == "time_based", timed).when(F.col("accumulate").isNotNull(), F.col("quantity"))
    return df.withColumn("summary", F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0)))


def org_report(metered: DataFrame, t: int, orgs: DataFrame | list[str] | None = None, resource_id: str | None = None, catalog: Catalog | None = None) -> DataFrame:
    """The report of organizations as of ``t``, a row per level, plan node, metric and window. No usage gives no rows.

    ``metered`` has the keys, metric, quantities, start_ms, end_ms, arrival_ms and
    billing_ms. With a catalog its plans' own functions accumulate, aggregate and
    summarize; without one the named folds do.
    """
    rows = as_of(metered, t, orgs, resource_id)
    return report_of(accumulate(rows) if catalog is None else accumulate_by_plan(rows, catalog, mergeable=True), t, catalog)


def report_of(states: DataFrame, t: int, catalog: Catalog | None = None) -> DataFrame:
    """The report as of ``t`` from accumulated states of its month."""
    told = with_slots(aggregate_tree(states, catalog), t)
    return (summarize(told, t) if catalog is None else summarize_by_plan(told, t, catalog)).select(*LEVEL_KEYS, *schemas.NODE, "metric", "dimension", "bucket_ms", "slot", "quantity", "consuming", "consumed", "summary")


def account_report(metered: DataFrame, accounts: DataFrame, account_id: str, t: int, catalog: Catalog | None = None) -> DataFrame:
    """The reports of all organizations of an account, in one plan; with a catalog by its plans' own functions."""
    return org_report(metered, t, accounts.where(F.col("account_id") == account_id).select(F.explode("organizations").alias("organization_id")), catalog=catalog)


def instance_report(metered: DataFrame, key: dict[str, str], t: int, catalog: Catalog | None = None) -> DataFrame:
    """The windows of one resource instance; with a catalog by its plans' own functions."""
    rows = as_of(metered, t)
    for k, v in key.items():
        rows = rows.where(F.col(k) == v)
    told = with_slots(accumulate(rows) if catalog is None else accumulate_by_plan(rows, catalog), t)
    return (summarize(told, t) if catalog is None else summarize_by_plan(told, t, catalog)).select(*schemas.KEYS, "metric", "dimension", "bucket_ms", "slot", "quantity", "summary")


def _by_plan(df: DataFrame, catalog: Catalog, plan: str, kind: str) -> tuple[DataFrame, list[str]]:
    """The rows with the number of their plan's expression and whether the plan has the metric at all."""
    table = catalog.metrics if plan == "metering_plan_id" else catalog.rating
    told = table.select(F.col("plan_id").alias(plan), "metric", F.lit(True).alias("_known"), F.col(kind).alias("_"))
    numbers, exprs = catalog.kept(kind, lambda: resolved(told, ["_"]))
    return df.join(numbers.withColumnRenamed("__n", "_n"), [plan, "metric"], "left"), exprs["_"]


def _in_window(df: DataFrame, t: int) -> DataFrame:
    """Adds the names that plan functions see: t, from_ms and to_ms."""
    return df.withColumns({"t": F.lit(t).cast("long"), "from_ms": F.col("bucket_ms"), "to_ms": bucket_end(F.col("dimension"), F.col("bucket_ms"))})


def summarize_by_plan(df: DataFrame, t: int, catalog: Catalog) -> DataFrame:
    """Adds ``summary`` by the metering plan's ``summarize``, without one the quantity; what is no number, and a metric that the plan does not have, is 0."""
    told, exprs = _by_plan(_in_window(df, t), catalog, "metering_plan_id", "summarize")
    value = F.when(F.col("_known"), picked(F.col("_n"), exprs, names_seen("summarize"), otherwise=F.col("quantity")))
    return told.withColumn("summary", F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))).select(*df.columns, "summary")


def rate_by_plan(df: DataFrame, catalog: Catalog) -> DataFrame:
    """Adds ``cost`` by the rating plan's ``rate``, without one price x quantity."""
    told, exprs = _by_plan(df, catalog, "rating_plan_id", "rate")
    cost = picked(F.col("_n"), exprs, names_seen("rate"), otherwise=F.col("price") * F.coalesce("quantity", F.lit(0.0)))
    return told.withColumn("cost", cost).select(*df.columns, "cost")


def charge_by_plan(df: DataFrame, t: int, catalog: Catalog) -> DataFrame:
    """Adds ``charge`` by the rating plan's ``charge``, without one the cost; what is no number is 0."""
    told, exprs = _by_plan(_in_window(df, t), catalog, "rating_plan_id", "charge")
    return told.withColumn("charge", F.coalesce(F.nanvl(picked(F.col("_n"), exprs, names_seen("charge"), otherwise=F.col("cost")), F.lit(0.0)), F.lit(0.0))).select(*df.columns, "charge")


def resource_totals(report: DataFrame) -> DataFrame:
    """Quantities and summaries of a resource over its plans."""
    total = lambda c: F.coalesce(F.sum(decimal(F.col(c))), F.lit(0)).cast("double").alias(c)
    return report.groupBy(*LEVEL_KEYS, "resource_id", "metric", "dimension", "bucket_ms", "slot").agg(total("quantity"), total("summary"))


def rate(df: DataFrame) -> DataFrame:
    """Adds ``cost`` = price x quantity; a time-based state keeps its price along."""
    return df.withColumn("cost", F.when(F.col("accumulate") != "time_based", F.col("price") * F.coalesce("quantity", F.lit(0.0))))


def charge(df: DataFrame, t: int) -> DataFrame:
    """Adds ``charge``: the cost, or for a time-based state unit-hours up to t x price."""
    to = bucket_end(F.col("dimension"), F.col("bucket_ms"))
    hours = summary_time_based(F.lit(t), F.col("consuming"), F.col("consumed"), F.col("bucket_ms"), to)
    return df.withColumn("charge", F.coalesce(F.when(F.col("accumulate") == "time_based", hours * F.col("price")).otherwise(F.col("cost")), F.lit(0.0)))


def report_delta(a: DataFrame, b: DataFrame, on: list[str], values: list[str]) -> DataFrame:
    """a - b, cell by cell; a cell that is missing counts 0."""
    left, right = a.select(*on, *(F.col(v).alias(f"_a_{v}") for v in values)), b.select(*on, *(F.col(v).alias(f"_b_{v}") for v in values))
    # Null-safe keys: levels above the space have no space.
    x, y = left.alias("x"), right.alias("y")
    cond = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in on]
    joined = x.join(y, cond, "full")
    keys = [F.coalesce(F.col(f"x.{k}"), F.col(f"y.{k}")).alias(k) for k in on]
    return joined.select(*keys, *((F.coalesce(f"_a_{v}", F.lit(0.0)) - F.coalesce(f"_b_{v}", F.lit(0.0))).alias(v) for v in values))


def completeness(refs: DataFrame, snapshots: DataFrame, on: list[str]) -> DataFrame:
    """Per organization: whether a referenced snapshot is missing, which makes its report partial."""
    told = refs.join(snapshots.select(*on).distinct().withColumn("_there", F.lit(True)), on, "left")
    return told.groupBy("organization_id").agg(F.count("*").alias("refs"), F.count_if(F.col("_there").isNull()).alias("missing"), F.max(F.col("_there").isNull()).alias("is_partial"))


def flag_partial(report: DataFrame, refs: DataFrame, snapshots: DataFrame, on: list[str]) -> DataFrame:
    """The report with ``is_partial``: whether a snapshot that the organization's references name is missing."""
    told = completeness(refs, snapshots, on).select("organization_id", F.col("is_partial").alias("_partial"))
    return report.join(told, "organization_id", "left").withColumn("is_partial", F.coalesce("_partial", F.lit(False))).drop("_partial")


#: All of the tree: an organization's own resources, its spaces, their consumers, and everywhere the plans.
WHOLE_TREE = {"resources": {"plans": {}}, "spaces": {"resources": {"plans": {}}, "consumers": {"resources": {"plans": {}}}}}


def nested_report(report: DataFrame, select: dict = WHOLE_TREE, values: tuple[str, ...] = ("quantity", "summary")) -> DataFrame:
    """One row an organization, nested as ``select`` says, from the leaves up, with one grouping a level.

    A node (organization, space, consumer) may have ``resources``, and these ``plans``;
    an organization ``spaces`` and a space ``consumers``. Every resource and plan has
    ``usage``: metric, dimension, slot and values, a resource's summed over its plans.
    Levels that are not selected are neither read nor grouped. A node's children come
    together in its row, so select as deep as a row can hold.
    """
    levels = {"org": select, "space": select.get("spaces"), "consumer": (select.get("spaces") or {}).get("consumers")}
    if unknown := {k for v in levels.values() if v for k in v} - {"resources", "spaces", "consumers"} or {k for v in levels.values() if v for k in v.get("resources") or {}} - {"plans"}:
        raise ValueError(f"no such level: {', '.join(sorted(unknown))}")
    place = ["level", "organization_id", "space_id", "consumer_id"]
    wanted = [k for k, v in levels.items() if v is not None]
    rows = report.where(F.col("level").isin(wanted))
    with_plans = [k for k, v in levels.items() if v is not None and "plans" in (v.get("resources") or {})]
    total = lambda c: F.coalesce(F.sum(decimal(F.col(c))), F.lit(0)).cast("double").alias(c)
    usage = lambda: F.sort_array(F.collect_list(F.struct("metric", "dimension", "slot", *values))).alias("usage")
    plan = schemas.NODE[1:]
    plans = rows.where(F.col("level").isin(with_plans)).groupBy(*place, "resource_id", *plan).agg(usage())
    plans = plans.select(*place, "resource_id", F.struct(*plan, "usage").alias("plan"), F.lit(None).cast(plans.schema["usage"].dataType).alias("usage"))
    totals = rows.groupBy(*place, "resource_id", "metric", "dimension", "slot").agg(*(total(v) for v in values)).groupBy(*place, "resource_id").agg(usage())
    both = totals.select(*place, "resource_id", F.lit(None).cast(plans.schema["plan"].dataType).alias("plan"), "usage").unionByName(plans)
    resources = both.groupBy(*place, "resource_id").agg(F.max("usage").alias("usage"), F.sort_array(F.collect_list("plan")).alias("plans"))
    nodes = resources.groupBy(*place).agg(F.sort_array(F.collect_list(F.struct("resource_id", "usage", "plans"))).alias("resources"))

    def above(child: DataFrame | None, level: str, keys: list[str], name: str, key: str) -> DataFrame:
        """The nodes of a level, with their children."""
        own = nodes.where(F.col("level") == level).select(*keys, "resources")
        if child is None:
            return own
        kind = F.struct(key, *(c for c in child.columns if c not in [*keys, key]))
        told = child.select(*keys, F.lit(None).cast(own.schema["resources"].dataType).alias("resources"), kind.alias("_child"))
        own = own.withColumn("_child", F.lit(None).cast(told.schema["_child"].dataType))
        return own.unionByName(told).groupBy(*keys).agg(F.max("resources").alias("resources"), F.sort_array(F.collect_list("_child")).alias(name))

    three = place[1:]
    consumers = nodes.where("level = 'consumer'").select(*three, "resources") if levels["consumer"] is not None else None
    spaces = above(consumers, "space", three[:2], "consumers", "consumer_id") if levels["space"] is not None else None
    return above(spaces, "org", three[:1], "spaces", "space_id")


def report_select(report: DataFrame, level: str | list[str], fields: list[str], leaves: list[str] | None = None) -> DataFrame:
    """Fields of one or several levels of the tree. With ``leaves``, a row for each different ``fields`` with its cells as ``cells``: metric, dimension, slot and those leaves."""
    rows = report.where(F.col("level").isin(level if isinstance(level, list) else [level]))
    if leaves is None:
        return rows.select(*fields)
    cell = F.struct("metric", "dimension", "slot", *leaves)
    # One node of the tree has as many cells as metrics and windows: a few dozen.
    return rows.groupBy(*fields).agg(F.sort_array(F.collect_list(cell)).alias("cells"))


def strip_internal(report: DataFrame) -> DataFrame:
    """Without the ids that are the engine's own."""
    return report.drop("metering_plan_id", "rating_plan_id", "pricing_plan_id")


def nested_windows(report: DataFrame, days: int = 2, months: int = 2) -> DataFrame:
    """``windows`` as [[s], [m], [h], [D...], [M...]], of which only days and months carry cells; slot 0 is the current one."""
    keys = [c for c in report.columns if c not in ("dimension", "bucket_ms", "slot", "quantity", "summary", "consuming", "consumed")]
    cell = F.struct("quantity", "summary")
    maps = report.groupBy(*keys).agg(*(F.map_from_entries(F.collect_list(F.when(F.col("dimension") == d, F.struct("slot", cell.alias("cell"))))).alias(f"_{d}") for d in ("D", "M")))
    empty = F.expr("array(cast(null as struct<quantity:double,summary:double>))")
    row = lambda d, n: F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), lambda s: F.try_element_at(F.col(f"_{d}"), s))
    return maps.select(*keys, F.array(empty, empty, empty, row("D", days), row("M", months)).alias("windows"))
