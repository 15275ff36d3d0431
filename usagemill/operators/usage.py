"""Usage documents: validation, lateness, deduplication, plan lookup, billing time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .. import schemas
from ..functions.calendar import MS, add_months, end_of_month, trunc_dim
from ..plans.catalog import Catalog, gathered
from .documents import document_errors

#: Catalog tables are broadcast up to this many rows.
MAX_BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """A broadcast hint, if the table's counted size allows one."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else df


# ---- validation


def validate_usage(df: DataFrame, raw: str | None = None) -> DataFrame:
    """Adds ``errors``, all of them: missing fields, or with ``raw`` JSON whatever does not fit the document's schema, at any depth. An empty measured_usage is valid."""
    if raw:
        return df.withColumn("errors", document_errors(F.col(raw)))
    missing = [F.when(F.col(c).isNull(), F.lit(f"{c}: required")) for c in schemas.REQUIRED_USAGE]
    bad = [F.when(F.exists("measured_usage", lambda x: x["measure"].isNull()), F.lit("measured_usage: measure required"))]
    return df.withColumn("errors", F.array_compact(F.array(*missing, *bad)))


def validate_instance(df: DataFrame, catalog: Catalog) -> DataFrame:
    """Adds ``instance_error``: (resource, plan) has no metering mapping, or the plan does not exist."""
    mapped = catalog.mappings.where("kind = 'metering'").select(F.col("resource_type").alias("resource_id"), F.col("plan_name").alias("plan_id"), F.col("plan_id").alias("_plan"))
    plans = catalog.metrics.select(F.col("plan_id").alias("_plan"), F.lit(True).alias("_exists")).distinct()
    told = df.join(catalog.kept("mapped", lambda: gathered(mapped)), ["resource_id", "plan_id"], "left").join(catalog.kept("plans", lambda: gathered(plans)), "_plan", "left")
    return told.withColumn("instance_error", F.when(F.col("_plan").isNull(), "no metering mapping").when(F.col("_exists").isNull(), "no such plan")).drop("_plan", "_exists")


def account_orgs(accounts: DataFrame) -> DataFrame:
    """A row for each organization of each account."""
    return accounts.select("account_id", "pricing_country", "license_type", F.explode("organizations").alias("organization_id"))


def validate_account(df: DataFrame, accounts: DataFrame, denied: list[str] | None = None) -> DataFrame:
    """Adds ``account_error``: no account for the organization, or a denied license (empty and N/A pass)."""
    told = df.join(gathered(account_orgs(accounts).select("organization_id", F.col("account_id").alias("_account"), F.col("license_type").alias("_license"))), "organization_id", "left")
    refused = F.col("_license").isin(*(denied or [""])) & ~F.col("_license").isin("", "N/A")
    return told.withColumn("account_error", F.when(F.col("_account").isNull(), "no account").when(refused, "license not supported")).drop("_account", "_license")


def reject_future(end_ms: Column, now: Column) -> Column:
    """True where the end lies after the end of the current day."""
    return end_ms > trunc_dim(now, "D") + MS["D"] - 1


def reject_out_of_slack(end_ms: Column, now: Column, slack: int = 600_000) -> Column:
    """True where usage of an earlier month comes after the slack of the current one."""
    month = trunc_dim(now, "M")
    return (end_ms <= month - 1) & (now > month + slack)


def check_quantity(value: Column) -> Column:
    return value.isNull() | F.isnan(value)


def check_at_once(df: DataFrame, catalog: Catalog, now: int | Column, denied: list[str] | None = None, raw: str | None = None) -> DataFrame:
    """Adds ``error``, the first reason against each document that can be told from it alone: its form (all that is wrong with it), no mapping or plan, no account or its license, usage of days to come."""
    told = validate_account(validate_instance(validate_usage(df, raw), catalog), catalog.accounts, denied)
    at_once = (
        F.when(F.size("errors") > 0, F.array_join("errors", ", ")).when(F.col("instance_error").isNotNull(), F.col("instance_error"))
        .when(F.col("account_error").isNotNull(), F.col("account_error")).when(reject_future(F.col("end_ms"), F.lit(now) if isinstance(now, int) else now), "usage of the future")
    )
    return told.withColumn("error", at_once).drop("errors", "instance_error", "account_error")


def check_repeats(df: DataFrame, order: list[Column], slack: int = 600_000) -> DataFrame:
    """Completes ``error``: a document that repeats one without an error, and usage of a month whose slack is over when it arrives (``arrival_ms``)."""
    # Rejected rows are not compared: all documents without ids would meet in one task. They are dealt out by what they hold.
    alone = F.when(F.col("error").isNotNull(), F.xxhash64(*[c for c in df.columns if not isinstance(df.schema[c].dataType, MapType)]))
    first = F.row_number().over(Window.partitionBy(alone, *(F.when(F.col("error").isNull(), k) for k in _dedup_key())).orderBy(*order))
    later = F.when(first > 1, "duplicate").when(reject_out_of_slack(F.col("end_ms"), F.col("arrival_ms"), slack), "out of slack")
    return df.withColumn("_later", later).withColumn("error", F.coalesce("error", "_later")).drop("_later")


def check_usage(df: DataFrame, catalog: Catalog, now: int, order: list[Column], denied: list[str] | None = None, slack: int = 600_000, raw: str | None = None) -> DataFrame:
    """Adds ``error``, the first reason against each document, null for those that go on: what can be told at once, then repeats and lateness."""
    return check_repeats(check_at_once(df, catalog, now, denied, raw), order, slack)


def split_errors(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(rows without a reason, rows with one in ``error``)."""
    told = df.withColumn("error", reason)
    return told.where("error IS NULL").drop("error"), told.where("error IS NOT NULL")


def span_slack(ts: Column, now: int, past: int = 2, future: int = 2) -> Column:
    """True within so many months of now, by calendar."""
    at = F.timestamp_millis(F.lit(now))
    months = lambda n: F.unix_millis(at + F.make_ym_interval(F.lit(0), F.lit(n)))
    return ts.between(months(-past), months(future))


# ---- deduplication

DEDUP_KEY = ["organization_id", "resource_instance_id", "consumer_id", "resource_id", "plan_id", "dedup_id", "end_ms", "start_ms"]


def dedup_messages(df: DataFrame, key: str) -> DataFrame:
    """Redelivered messages, told by their id, go."""
    return df.dropDuplicates([key])


def _dedup_key() -> list[Column]:
    return [F.struct(F.col(c).isNull(), F.coalesce(F.col(c), F.lit(""))) if c == "dedup_id" else F.coalesce(F.col(c), F.lit("UNKNOWN")) if c == "consumer_id" else F.col(c) for c in DEDUP_KEY]


def dedup_usage(df: DataFrame, order: list[Column]) -> DataFrame:
    """The first arrival of each key stays; an absent id is a value of its own."""
    w = Window.partitionBy(*_dedup_key()).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def dedup_span_events(df: DataFrame, order: list[Column]) -> DataFrame:
    """Starts and stops repeat by id; those without an id all stay."""
    w = Window.partitionBy("kind", "id").orderBy(*order)
    once = df.where("id IS NOT NULL").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return once.unionByName(df.where("id IS NULL"))


# ---- enrichment


def normalize(df: DataFrame, catalog: Catalog) -> DataFrame:
    """Adds resource_type, account_id, pricing_country and the three plan ids; null where there is none."""
    out = df.withColumn("resource_type", F.col("resource_id"))
    plans = catalog.mappings.groupBy("resource_type", F.col("plan_name").alias("plan_id")).pivot("kind", ["metering", "rating", "pricing"]).agg(F.first("plan_id"))
    plans = plans.select("resource_type", "plan_id", *(F.col(k).alias(f"{k}_plan_id") for k in ("metering", "rating", "pricing")))
    orgs = account_orgs(catalog.accounts).select("organization_id", "account_id", "pricing_country")
    return out.join(catalog.kept("plan_ids", lambda: gathered(plans)), ["resource_type", "plan_id"], "left").join(catalog.kept("orgs", lambda: gathered(orgs)), "organization_id", "left")


def plan_lookup_as_of(usage: DataFrame, history: DataFrame, keys: list[str], ts: str = "end_ms", since: str = "valid_from") -> DataFrame:
    """The history row of each key that is valid at the time: valid from its time until the next one's."""
    w = Window.partitionBy(*keys).orderBy(since)
    spans = history.withColumn("_until", F.lead(since).over(w))
    if history.limit(MAX_BROADCAST_ROWS + 1).count() > MAX_BROADCAST_ROWS:
        return _as_of_by_month(usage, spans, keys, ts, since)
    on = [usage[k] == spans[k] for k in keys] + [usage[ts] >= spans[since], spans["_until"].isNull() | (usage[ts] < spans["_until"])]
    return usage.join(F.broadcast(spans), on, "left").drop(*(spans[k] for k in keys)).drop("_until")


def _as_of_by_month(usage: DataFrame, spans: DataFrame, keys: list[str], ts: str, since: str) -> DataFrame:
    """The same lookup in a history too large to broadcast: rows meet by key and month, of the months that have usage (a few hundred), so a key's history is not compared with all its usage."""
    dated = usage.withColumn("_month", trunc_dim(F.col(ts), "M"))
    months = dated.select("_month").distinct()
    valid = (F.col(since) < add_months(F.col("_month"), 1)) & (F.col("_until").isNull() | (F.col("_until") > F.col("_month")))
    near = spans.join(F.broadcast(months), valid).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_month").alias("_of"), since, "_until", *(c for c in spans.columns if c not in (*keys, since, "_until")))
    on = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("_month") == F.col("_of"), F.col(ts) >= F.col(since), F.col("_until").isNull() | (F.col(ts) < F.col("_until"))]
    return dated.join(near, on, "left").drop("_month", "_of", "_until", *(f"_{k}" for k in keys))


def price_lookup(df: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds the price of (pricing plan, metric, country); 0 where there is none."""
    p = prices.select(F.col("plan_id").alias("pricing_plan_id"), "metric", F.col("country").alias("pricing_country"), "price")
    return df.join(small(p), ["pricing_plan_id", "metric", "pricing_country"], "left").withColumn("price", F.coalesce("price", F.lit(0.0)))


def billing_ms(end_ms: Column, arrival_ms: Column) -> Column:
    """Arrival, or the last millisecond of the usage's month if that is over by then."""
    return F.when(end_ms < trunc_dim(arrival_ms, "M"), end_of_month(end_ms)).otherwise(arrival_ms)


def active_refs(df: DataFrame, ts: str, now: int, slack: int = 600_000) -> DataFrame:
    """References younger than two months and the slack."""
    return df.where(F.unix_millis(F.timestamp_millis(F.col(ts)) + F.expr("INTERVAL 2 MONTHS")) + slack > now)
