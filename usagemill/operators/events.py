"""Platform events to usage, and the rollover into a new month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.calendar import trunc_dim, yyyymm

MIB = 1048576


def org_filter(df: DataFrame, orgs: DataFrame) -> DataFrame:
    return df.join(orgs.select("organization_id").distinct(), "organization_id", "left_semi")


def service_filter(df: DataFrame, allowed: DataFrame) -> DataFrame:
    """Only (service_label, service_plan_name) pairs that are allowed."""
    return df.join(allowed.select("service_label", "service_plan_name").distinct(), ["service_label", "service_plan_name"], "left_semi")


def min_age_filter(df: DataFrame, ts: str, now: int, min_age: int = 60_000) -> DataFrame:
    """Events in order up to the first that is too young; nothing at or after it passes. One number bounds the scan."""
    young = df.where(F.col(ts) > now - min_age).agg(F.min(ts).alias("_first"))
    return df.join(F.broadcast(young)).where(F.col("_first").isNull() | (F.col(ts) < F.col("_first"))).drop("_first")


def convert_app_events(df: DataFrame) -> DataFrame:
    """STARTED and STOPPED events as usage measures; others go. A first start, or one after a stop or purge, has nothing before it."""
    start = F.col("state") == "STARTED"
    purge = (F.col("previous_instance_count") == F.col("instance_count")) & (F.col("previous_memory_mb") == F.col("memory_mb"))
    fresh = start & (F.coalesce(F.col("previous_state") == "STOPPED", F.lit(False)) | F.coalesce(purge, F.lit(False)))
    # A previous count of 0 or none falls back to the current one.
    previous = F.when(F.coalesce(F.col("previous_instance_count"), F.lit(0)) == 0, F.col("instance_count")).otherwise(F.col("previous_instance_count"))
    return df.where(F.col("state").isin("STARTED", "STOPPED")).withColumns({
        "current_instance_memory": F.when(start, F.col("memory_mb") * MIB).otherwise(0),
        "current_running_instances": F.when(start, F.col("instance_count")).otherwise(0),
        "previous_instance_memory": F.when(fresh, 0).otherwise(F.col("previous_memory_mb") * MIB),
        "previous_running_instances": F.when(fresh, 0).otherwise(previous),
        "consumer_id": F.concat(F.lit("app:"), "app_guid"), "resource_instance_id": F.concat(F.lit("memory:"), "app_guid"),
    }).withColumns({"resource_id": F.lit("linux-container"), "plan_id": F.lit("standard")})


def flat_app_events(df: DataFrame) -> DataFrame:
    """The nested event document as flat columns."""
    e = F.col("entity")
    return df.select(F.col("metadata.guid").alias("guid"), F.col("metadata.created_at").alias("ts"), e["state"].alias("state"), e["previous_state"].alias("previous_state"), e["org_guid"].alias("organization_id"), e["space_guid"].alias("space_id"), e["app_guid"].alias("app_guid"), e["instance_count"].alias("instance_count"), e["previous_instance_count"].alias("previous_instance_count"), e["memory_in_mb_per_instance"].alias("memory_mb"), e["previous_memory_in_mb_per_instance"].alias("previous_memory_mb"))


def convert_service_events(df: DataFrame) -> DataFrame:
    """CREATED has one instance and none before, any other state none and one before; ids are put together from plan and label."""
    created = F.col("state") == "CREATED"
    guid = F.concat(F.lit("service:"), F.col("service_instance_guid"))
    return df.withColumns({
        "current_instances": F.when(created, 1).otherwise(0), "previous_instances": F.when(created, 0).otherwise(1),
        "consumer_id": guid, "resource_id": F.col("service_label"), "plan_id": F.col("service_plan_name"),
        "resource_instance_id": F.concat_ws(":", guid, "service_plan_name", "service_label"),
    })


def preceding_plan(df: DataFrame, instance: list[str], ts: str, plan: str, order: list[str]) -> DataFrame:
    """Adds ``preceding_plan``: the plan before, of an event of this month or the last."""
    w = Window.partitionBy(*instance).orderBy(*order)
    months = F.months_between(F.timestamp_millis(trunc_dim(F.col(ts), "M")), F.timestamp_millis(trunc_dim(F.lag(ts).over(w), "M")))
    return df.withColumn("preceding_plan", F.when(months <= 1, F.lag(plan).over(w)))


def expand_updates(df: DataFrame, ts: str, plan: str = "service_plan_name") -> DataFrame:
    """UPDATED becomes DELETED of the plan before at its time and CREATED a millisecond later; without a plan before, and of unknown states, nothing."""
    one = lambda state, p, at: F.struct(F.lit(state).alias("state"), p.alias("plan"), at.alias("ts"))
    updated = F.array(one("DELETED", F.col("preceding_plan"), F.col(ts)), one("CREATED", F.col(plan), F.col(ts) + 1))
    same = F.array(F.struct(F.col("state").alias("state"), F.col(plan).alias("plan"), F.col(ts).alias("ts")))
    xs = F.when((F.col("state") == "UPDATED") & F.col("preceding_plan").isNotNull(), updated).when(F.col("state").isin("CREATED", "DELETED"), same)
    return df.withColumn("_x", F.explode(xs)).withColumns({"state": F.col("_x.state"), plan: F.col("_x.plan"), ts: F.col("_x.ts")}).drop("_x")


def monotonic_timestamps(df: DataFrame, key: list[str], ts: str, order: list[str], guid: str | None = None) -> DataFrame:
    """Adds ``adjusted``: the time, or one millisecond after the adjusted one before if that is not earlier.

    Closed form of a fold: max(time - n) so far, plus n. With ``guid``, events
    that repeat the one before count as the same and keep its time.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    if guid:
        df = df.withColumn("_new", F.coalesce((F.lag(guid).over(w) != F.col(guid)).cast("int"), F.lit(1)))
    else:
        df = df.withColumn("_new", F.lit(1))
    df = df.withColumn("_n", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lead = F.max(F.when(F.col("_new") == 1, F.col(ts) - F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("adjusted", lead + F.col("_n")).drop("_n", "_new")


def carry_over(df: DataFrame, key: list[str], ts: str, order: str) -> DataFrame:
    """The latest state, guid and time of each key and month."""
    return df.groupBy(yyyymm(F.col(ts)).alias("month"), *key).agg(F.max_by(F.struct("state", "guid", F.col(ts).alias("timestamp")), order).alias("_x")).select("month", *key, "_x.state", F.col("_x.guid").alias("event_guid"), "_x.timestamp")


def zero_previous(measured_usage: Column) -> Column:
    """Measures named previous... set to 0."""
    return F.transform(measured_usage, lambda x: F.struct(x["measure"].alias("measure"), F.when(x["measure"].startswith("previous"), 0.0).otherwise(x["quantity"]).alias("quantity")))


def strip_to_schema(df: DataFrame) -> DataFrame:
    """Only the usage schema's columns."""
    return df.select(*[c for c in schemas.USAGE.names if c in df.columns])


def renew_usage(carry: DataFrame, usage: DataFrame, key: list[str], now: int, slack: int) -> DataFrame:
    """Usage carried from last month to the start of this one: running instances without a record this month.

    Outside the first ``slack`` ms of the month there is nothing to renew.
    """
    start = trunc_dim(F.lit(now), "M")
    last = yyyymm(start - 1)
    running = carry.where((F.col("month") == last) & F.col("state").isin("STARTED", "CREATED") & (F.lit(now) <= start + slack))
    fresh = running.join(carry.where(F.col("month") == yyyymm(start)).select(*key), key, "left_anti")
    joined = fresh.select(*key, F.col("timestamp").alias("start")).join(usage, [*key, "start"])
    return joined.withColumns({"start": start, "end": start, "measured_usage": zero_previous(F.col("measured_usage"))})


def bridge(df: DataFrame, key: list[str], ts: str, order: list[str], now: int, orgs: DataFrame | None = None, min_age: int = 60_000) -> DataFrame:
    """Events that are old enough, of allowed organizations, converted to usage with times that rise strictly by key."""
    out = min_age_filter(df, ts, now, min_age)
    if orgs is not None:
        out = org_filter(out, orgs)
    return monotonic_timestamps(convert_app_events(out), key, ts, order)
