"""Metering: measures to metrics, by the expressions of the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import Catalog, formula_columns, picked, resolved
from ..plans.sandbox import names_seen
from .usage import check_quantity


def measures_map(measured_usage: Column) -> Column:
    """Measure to quantity; of a measure given twice the last one holds."""
    return F.map_from_entries(measured_usage)


def meter(usage: DataFrame, catalog: Catalog) -> DataFrame:
    """One row a metric of the row's plan: metric, accumulate and value, or consuming and previous_consuming.

    The plans' different expressions become one CASE over their numbers; a metric
    without an expression takes the measure of its name. Usage without a plan, or
    of one that the catalog does not have, stays as one row without a metric.
    """
    plans, exprs = catalog.kept("meter", lambda: _plans(catalog))
    rows = usage.withColumn("m", measures_map(F.col("measured_usage")))
    told = rows.join(plans, "metering_plan_id", "left")
    names = names_seen("meter")
    state = {c: picked(F.col("_timed_n"), exprs["_timed"], names, get=c) for c in ("consuming", "previous_consuming")}
    return told.select("*", picked(F.col("_plain_n"), exprs["_plain"], names).alias("value"), *(c.alias(n) for n, c in state.items())).drop("m", "_plain_n", "_timed_n", "measured_usage")


def _plans(catalog: Catalog) -> tuple[DataFrame, dict[str, list[str]]]:
    """Metrics by metering plan, with the numbers of their expressions: of a quantity, or of a time-based state."""
    metrics = formula_columns(catalog.metrics)
    named = F.concat(F.lit("m['"), F.regexp_replace("metric", r"(['\\])", r"\\$1"), F.lit("']"))
    told = metrics.withColumns({"meter": F.coalesce("meter", named), "accumulate": F.coalesce("accumulate", F.lit("sum"))})
    timed = F.col("accumulate") == "time_based"
    return resolved(told.select(F.col("plan_id").alias("metering_plan_id"), "metric", "unit", "accumulate", F.when(~timed, F.col("meter")).alias("_plain"), F.when(timed, F.col("meter")).alias("_timed")), ["_plain", "_timed"])


def check_metered(metered: DataFrame) -> DataFrame:
    """Adds ``error``: no plan (and so no metric), or a quantity that is no number."""
    quantity = F.when(F.col("accumulate") == "time_based", F.col("consuming")).otherwise(F.col("value"))
    return metered.withColumn("error", F.when(F.col("metric").isNull(), "no metering plan").when(check_quantity(quantity), F.concat("metric", F.lit(": no quantity"))))
