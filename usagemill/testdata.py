"""Adapters from the benchmark tables to metering inputs, for queries and tests; no operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators.accumulate import side_by_side
from .operators.meter import meter
from .operators.usage import billing_ms, normalize
from .plans.catalog import Catalog, sample_catalog
from .sources.readers import spread

DAY = 86_400_000
GIB = 1073741824
TIE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ms(column: str) -> F.Column:
    return F.unix_millis(F.col(column).cast("timestamp"))


def usage_from_orders(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """Object-storage usage, a document a line item; ``together``: those of an instance and month side by side, while they are still narrow."""
    t = lambda n: table(spark, sf_dir, n)
    # The narrow tables are joined first: line items are shuffled by part, if there are many, and by order.
    customer = t("customer").select("c_custkey", "c_nationkey", "c_mktsegment", F.when(F.col("c_custkey") % 10 != 0, F.col("c_custkey") % 2).alias("consumer"))
    orders = t("orders").select("o_orderkey", "o_custkey").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey", "c_mktsegment", "consumer")
    part = t("part").select("p_partkey", F.when(F.col("p_type").isin("STANDARD", "LARGE", "PROMO"), "standard").otherwise("basic").alias("plan_id"))
    rows = spread(t("lineitem"), "l_orderkey").join(part, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select("c_nationkey", "c_mktsegment", "consumer", "plan_id", (F.col("l_suppkey") % 2).alias("instance"), ms("l_shipdate").alias("end_ms"), (F.col("l_orderkey") % 40).alias("days"), "l_quantity", *TIE)
    if together:
        rows = side_by_side(rows, ["c_nationkey", "c_mktsegment", "consumer", "plan_id", "instance"])
    measure = lambda n, q: F.struct(F.lit(n).alias("measure"), q.cast("double").alias("quantity"))
    return rows.select(
        F.concat(F.lit("org-"), F.col("c_nationkey").cast("string")).alias("organization_id"), F.col("c_mktsegment").alias("space_id"),
        F.concat(F.lit("customer:"), F.col("consumer").cast("string")).alias("consumer_id"),
        F.lit("object-storage").alias("resource_id"), "plan_id", F.concat(F.lit("inst-"), "c_mktsegment", F.lit("-"), F.col("instance").cast("string")).alias("resource_instance_id"),
        F.lit(None).cast("string").alias("dedup_id"), F.col("end_ms").alias("start_ms"), "end_ms", (F.col("end_ms") + F.col("days") * DAY).alias("arrival_ms"),
        F.array(measure("storage", F.col("l_quantity") * GIB), measure("light_api_calls", F.col("l_linenumber") * 1000), measure("heavy_api_calls", F.col("l_quantity"))).alias("measured_usage"),
        *TIE,
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An account a region, over its nations' organizations; every seventh nation's is on trial."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    trial = F.when(F.col("n_nationkey") % 7 == 0, "TRIAL").otherwise("")
    return rows.groupBy(F.concat(F.col("r_name"), F.when(trial != "", "-TRIAL").otherwise("")).alias("account_id"), trial.alias("license_type"), F.when(F.col("r_regionkey") % 2 == 0, "USA").otherwise("EUR").alias("pricing_country")).agg(F.collect_list(F.concat(F.lit("org-"), F.col("n_nationkey").cast("string"))).alias("organizations")).select("account_id", "organizations", "pricing_country", "license_type")


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return sample_catalog(spark, accounts(spark, sf_dir))


def metered_orders(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """Normalized and metered object-storage usage, with its billing time and the consumer UNKNOWN where there is none; if all of it is accumulated, ``together``."""
    c = catalog(spark, sf_dir)
    rows = normalize(usage_from_orders(spark, sf_dir, together), c)
    rows = rows.withColumns({"consumer_id": F.coalesce("consumer_id", F.lit("UNKNOWN")), "billing_ms": billing_ms(F.col("end_ms"), F.col("arrival_ms"))})
    return meter(rows, c)


def events_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream with its time in whole milliseconds (``ts_ms``) and the number in its properties (``k``)."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", ms("ts").alias("ts_ms"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


def span_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events_ms(spark, sf_dir).where("event_type IN ('signup', 'purchase')")
    return e.select("event_id", "user_id", F.col("ts_ms").alias("timestamp"), F.when(F.col("event_type") == "signup", "start").otherwise("stop").alias("kind"))


def memory_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time-based usage: each view sets a user's running instances and their memory."""
    w = Window.partitionBy("user_id").orderBy("ts_ms", "event_id")
    e = events_ms(spark, sf_dir).where("event_type = 'view'").select("user_id", "event_id", "ts_ms", (F.col("k") % 4).cast("double").alias("n"), (1 + F.floor("value") % 8).cast("double").alias("gib"))
    e = e.withColumns({"pn": F.coalesce(F.lag("n").over(w), F.lit(0.0)), "pgib": F.coalesce(F.lag("gib").over(w), F.lit(0.0))})
    measure = lambda n, q: F.struct(F.lit(n).alias("measure"), q.alias("quantity"))
    return e.select(
        F.concat(F.lit("org-"), (F.col("user_id") % 5).cast("string")).alias("organization_id"), F.concat(F.lit("space-"), (F.col("user_id") % 3).cast("string")).alias("space_id"),
        F.concat(F.lit("app:"), F.col("user_id").cast("string")).alias("consumer_id"), F.lit("linux-container").alias("resource_id"), F.lit("standard").alias("plan_id"),
        F.concat(F.lit("memory:"), F.col("user_id").cast("string")).alias("resource_instance_id"), F.col("ts_ms").alias("start_ms"), F.col("ts_ms").alias("end_ms"), F.col("event_id").alias("arrival_ms"), F.col("ts_ms").alias("billing_ms"),
        F.array(measure("current_instance_memory", F.col("gib") * GIB), measure("current_running_instances", F.col("n")), measure("previous_instance_memory", F.col("pgib") * GIB), measure("previous_running_instances", F.col("pn"))).alias("measured_usage"),
    )


def metered_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = sample_catalog(spark)
    return meter(normalize(memory_usage(spark, sf_dir), c), c)


def app_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts_ms", "event_id")
    state = F.when(F.col("event_type") == "click", "STARTED").when(F.col("event_type") == "error", "STOPPED").otherwise("BUILDPACK_SET")
    e = events_ms(spark, sf_dir).withColumns({"state": state, "memory_mb": (64 * (1 + F.floor("value") % 4)).cast("double"), "instance_count": (F.col("k") % 4).cast("double")})
    prior = {f"previous_{c}": F.lag(c).over(w) for c in ("state", "memory_mb", "instance_count")}
    return e.withColumns(prior).select(F.col("event_id").alias("guid"), F.col("ts_ms").alias("ts"), (F.concat(F.lit("org-"), (F.col("user_id") % 5).cast("string"))).alias("organization_id"), F.col("user_id").cast("string").alias("app_guid"), "state", "previous_state", "instance_count", "previous_instance_count", "memory_mb", "previous_memory_mb")


def service_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("event_type") == "signup", "CREATED").when(F.col("event_type") == "view", "UPDATED").when(F.col("event_type") == "purchase", "DELETED").otherwise("OTHER")
    return events_ms(spark, sf_dir).select(F.col("event_id").alias("guid"), F.col("ts_ms").alias("ts"), state.alias("state"), F.col("user_id").cast("string").alias("service_instance_guid"), F.lit("service").alias("service_label"), F.concat(F.lit("plan-"), (F.col("k") % 3).cast("string")).alias("service_plan_name"))
