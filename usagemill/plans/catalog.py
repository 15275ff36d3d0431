"""The plan catalog as small tables: samples, formulas, merging, checks.

Plan functions are Spark SQL expressions, joined to the rows by plan and metric
and evaluated as one CASE. ``meter`` sees the map ``m`` of measures with
``start_ms`` and ``end_ms``; ``summarize`` sees t, quantity, consuming, consumed,
from_ms and to_ms, ``charge`` these and price and cost, ``rate`` price, quantity,
consuming and consumed. Expressions that may fail use Spark's ``try_`` functions.
``accumulate`` names a fold (sum, max, avg, time_based), or tells a mergeable one
(``zero: ...; step: ...; merge: ...; finish: ...``, see ``operators.folds``) or an
ordered lambda ``(a, x) -> ...``; ``aggregate`` is sum, max, last or a mergeable fold over the instances' quantities. Any other name
raises an error. Expressions run only after ``sandbox`` has judged them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from .sandbox import expression_rejects, safe

# The sample plans, mappings and prices.
_GIB = "1073741824D"
_STORAGE = [
    ("storage", "GIGABYTE", f"coalesce(m['storage'], 0) / {_GIB}", "max"),
    ("thousand_light_api_calls", "THOUSAND_CALLS", "coalesce(m['light_api_calls'], 0) / 1000", "sum"),
    ("heavy_api_calls", "CALL", "coalesce(m['heavy_api_calls'], 0)", "sum"),
]
_MEMORY = (
    "memory", "GIGABYTE",
    f"named_struct('consuming', coalesce(m['current_instance_memory'], 0) / {_GIB} * coalesce(m['current_running_instances'], 0),"
    f" 'previous_consuming', -coalesce(m['previous_instance_memory'], 0) / {_GIB} * coalesce(m['previous_running_instances'], 0))",
    "time_based",
)
_INSTANCES = ("instances", "HOURS", "named_struct('consuming', coalesce(m['current_instances'], 0), 'previous_consuming', -coalesce(m['previous_instances'], 0))", "time_based")
_SAMPLE_METERING = {
    "basic-object-storage": _STORAGE, "standard-object-storage": _STORAGE, "test-metering-plan": [*_STORAGE, _MEMORY],
    "basic-linux-container": [_MEMORY], "standard-linux-container": [_MEMORY], "standard-service": [_INSTANCES],
    "standard-services-hours": [("usage_hours", "USAGEHOURS", "m['duration'] / 3600000", "sum")],
}
_SAMPLE_MAPPINGS = {
    ("linux-container", "basic"): ("basic-linux-container", "linux-rating-plan", "linux-pricing-basic"),
    ("linux-container", "standard"): ("standard-linux-container", "linux-rating-plan", "linux-pricing-standard"),
    ("object-storage", "basic"): ("basic-object-storage", "object-rating-plan", "object-pricing-basic"),
    ("object-storage", "standard"): ("standard-object-storage", "object-rating-plan", "object-pricing-standard"),
    ("service", "standard"): ("standard-service", "service-rating-standard", "service-pricing-standard"),
    ("services-hours", "standard"): ("standard-services-hours", "standard-services-hours", "standard-services-hours"),
    ("test-resource", "basic"): ("test-metering-plan", "test-rating-plan", "test-pricing-basic"),
    ("test-resource", "standard"): ("test-metering-plan", "test-rating-plan-standard", "test-pricing-standard"),
}
_SAMPLE_PRICES = {"storage": (1.0, 0.7523, 1.06), "thousand_light_api_calls": (0.03, 0.0226, 0.0317), "heavy_api_calls": (0.15, 0.1129, 0.1585)}
_SAMPLE_TIMED_PRICES = {("linux-pricing-basic", "memory"): (0.00014, 0.0001, 0.00015), ("linux-pricing-standard", "memory"): (0.00028, 0.00021, 0.00029), ("service-pricing-standard", "instances"): (0.00028, 0.00021, 0.00029)}
_SAMPLE_TIMED_RATING = {("linux-rating-plan", "memory"), ("service-rating-standard", "instances"), ("test-rating-plan", "memory")}
STANDARD_SERVICE_PLANS = {"metering": "standard-service", "rating": "service-rating-standard", "pricing": "service-pricing-standard"}

#: summary of a time-based state at t, in unit-hours; of any other, the quantity itself.
TIME_BASED_SUMMARY = "(consumed - consuming * (from_ms + to_ms - 2 * least(t, to_ms))) / 2 / 3600000"


@dataclass
class Catalog:
    metrics: DataFrame
    rating: DataFrame
    prices: DataFrame
    mappings: DataFrame
    accounts: DataFrame
    _kept: dict = field(default_factory=dict, init=False, repr=False, compare=False)

    def kept(self, name: str, make: Callable):
        """What ``make`` gives, made once for this catalog."""
        if name not in self._kept:
            self._kept[name] = make()
        return self._kept[name]

    def rejects(self) -> DataFrame:
        """plan_id, metric, kind, expression and reason of every expression that may not run."""
        return expression_rejects(self.metrics, self.rating)

    def checked(self) -> Catalog:
        """The catalog itself, if all its expressions may run; else an error that names the first plans and metrics against it."""
        if found := self.rejects().orderBy("plan_id", "metric", "kind").limit(20).collect():
            raise ValueError("refused: " + "; ".join(f"{r.plan_id} {r.metric} {r.kind}: {r.reason}" for r in found))
        return self


def sample_catalog(spark: SparkSession, accounts: DataFrame | None = None) -> Catalog:
    metrics = [(p, name, unit, "discrete", None, meter, fold, None, TIME_BASED_SUMMARY if fold == "time_based" else None) for p, ms in _SAMPLE_METERING.items() for name, unit, meter, fold in ms]
    mappings = [(kind, r, p, ids[i]) for (r, p), ids in _SAMPLE_MAPPINGS.items() for i, kind in enumerate(("metering", "rating", "pricing"))]
    prices = [(p, m, c, x) for p in ("object-pricing-basic", "object-pricing-standard", "test-pricing-basic", "test-pricing-standard") for m, xs in _SAMPLE_PRICES.items() for c, x in zip(("USA", "EUR", "CAN"), xs, strict=True)]
    prices += [(p, m, c, x) for (p, m), xs in _SAMPLE_TIMED_PRICES.items() for c, x in zip(("USA", "EUR", "CAN"), xs, strict=True)]
    rating = [(p, m, None, None) for p in ("object-rating-plan", "test-rating-plan") for m in _SAMPLE_PRICES]
    # A time-based state has no cost of its own: its price is kept for the charge.
    rating += [(p, m, "cast(null as double)", f"({TIME_BASED_SUMMARY}) * price") for p, m in sorted(_SAMPLE_TIMED_RATING)]
    return Catalog(
        spark.createDataFrame(metrics, schemas.METERING_METRICS), spark.createDataFrame(rating, schemas.RATING_METRICS), spark.createDataFrame(prices, schemas.PRICES),
        spark.createDataFrame(mappings, schemas.MAPPINGS), accounts if accounts is not None else spark.createDataFrame([], schemas.ACCOUNTS),
    )


def load_catalog(spark: SparkSession, path: str, fmt: str = "parquet") -> Catalog:
    """The five tables below ``path``; an expression that may not run raises an error."""
    kinds = {"metrics": schemas.METERING_METRICS, "rating": schemas.RATING_METRICS, "prices": schemas.PRICES, "mappings": schemas.MAPPINGS, "accounts": schemas.ACCOUNTS}
    return Catalog(**{n: spark.read.schema(s).format(fmt).load(f"{path}/{n}") for n, s in kinds.items()}).checked()


#: Different expressions of one kind in a catalog.
MAX_EXPRESSIONS = 1_000


def numbered(table: DataFrame, column: str) -> tuple[DataFrame, list[str]]:
    """The table with ``<column>_n``, the place of each row's expression among the different ones, and these in order."""
    got = table.select(column).where(F.col(column).isNotNull()).distinct().limit(MAX_EXPRESSIONS + 1).collect()
    if len(got) > MAX_EXPRESSIONS:
        raise ValueError(f"more than {MAX_EXPRESSIONS} different expressions in {column}")
    exprs = sorted(r[0] for r in got)
    number = F.create_map(*(x for i, e in enumerate(exprs) for x in (F.lit(e), F.lit(i))))[F.col(column)] if exprs else F.lit(None)
    return table.withColumn(f"{column}_n", number.cast("int")), exprs


#: Rows of a plan table that are gathered and broadcast at most.
MAX_ROWS = 200_000


def gathered(table: DataFrame) -> DataFrame:
    """A small table, read once and broadcast; a larger one as it is."""
    rows = table.limit(MAX_ROWS + 1).toArrow()
    return F.broadcast(table.sparkSession.createDataFrame(rows, table.schema)) if rows.num_rows <= MAX_ROWS else table


def resolved(table: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, list[str]]]:
    """The table, broadcast if it is small, with ``<column>_n`` in place of each column of expressions, and these by column.

    A small table is read once and numbered on the driver, without further jobs.
    """
    rest = [c for c in table.columns if c not in columns]
    rows = table.limit(MAX_ROWS + 1).toArrow()
    if rows.num_rows > MAX_ROWS:
        exprs = {}
        for c in columns:
            table, exprs[c] = numbered(table, c)
        return table.select(*rest, *(f"{c}_n" for c in columns)), exprs
    exprs = {c: sorted({x for x in rows[c].to_pylist() if x is not None}) for c in columns}
    if any(len(e) > MAX_EXPRESSIONS for e in exprs.values()):
        raise ValueError(f"more than {MAX_EXPRESSIONS} different expressions in {', '.join(columns)}")
    out = rows.select(rest)
    for c in columns:
        place = {e: i for i, e in enumerate(exprs[c])}
        out = out.append_column(f"{c}_n", pa.array([None if x is None else place[x] for x in rows[c].to_pylist()], pa.int32()))
    schema = table.select(*rest, *(F.lit(None).cast("int").alias(f"{c}_n") for c in columns)).schema
    return F.broadcast(table.sparkSession.createDataFrame(out, schema)), exprs


def picked(number: Column, exprs: list[str], names: frozenset[str], kind: str = "double", otherwise: Column | None = None, get: str | None = None) -> Column:
    """The value of the expression that a number names, as one CASE; without a number ``otherwise``. An expression that is not allowed, or uses other names, raises an error."""
    out = F.lit(None).cast(kind) if otherwise is None else otherwise
    for i, e in enumerate(exprs):
        value = safe(e, names)
        out = F.when(number == i, (value[get] if get else value).cast(kind)).otherwise(out)
    return out


def formula_columns(metrics: DataFrame) -> DataFrame:
    """Legacy formulas such as ``MAX({a}/12*{b})``: the fold's name (sum if none) and an expression over ``m``."""
    inner = F.regexp_extract("formula", r"^\s*(?:SUM|MAX|AVG)\s*\((.*)\)\s*$", 1)
    body = F.when(inner != "", inner).otherwise(F.col("formula"))
    expr = F.regexp_replace(body, r"\{([A-Za-z0-9_]+)\}", "coalesce(m['$1'], 0)")
    prefix = F.lower(F.regexp_extract("formula", r"^\s*(SUM|MAX|AVG)\s*\(", 1))
    given = F.col("formula").isNotNull()
    return metrics.withColumns({"accumulate": F.when(given, F.when(prefix != "", prefix).otherwise("sum")).otherwise(F.col("accumulate")), "meter": F.when(given, expr).otherwise(F.col("meter"))})


def merge_plans(catalog: DataFrame, changes: DataFrame, key: str = "plan_id") -> tuple[DataFrame, DataFrame]:
    """(new catalog, rejects with a reason). ``changes`` has an ``op`` of insert or update; inserts need new ids, updates known ones."""
    known = catalog.select(key).distinct().withColumn("_known", F.lit(True))
    told = changes.join(known, key, "left").withColumn("reason", F.when((F.col("op") == "insert") & F.col("_known").isNotNull(), "conflict").when((F.col("op") == "update") & F.col("_known").isNull(), "unknown plan"))
    good = told.where("reason IS NULL").select(*catalog.columns)
    return catalog.join(good.select(key).distinct(), key, "left_anti").unionByName(good), told.where("reason IS NOT NULL").drop("_known")


def merge_mappings(mappings: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new mappings, requests in conflict). A request (request_id, kind, resource_type, plan_name, plan_id) conflicts only if all its kinds exist."""
    on = ["kind", "resource_type", "plan_name"]
    told = requests.join(mappings.select(*on, F.lit(1).alias("_there")), on, "left")
    new = told.where("_there IS NULL").select(*mappings.columns)
    full = told.groupBy("request_id").agg(F.count("*").alias("n"), F.count("_there").alias("there")).where("n = there").select("request_id")
    return mappings.unionByName(new), full


def expand_service_mappings(services: DataFrame) -> DataFrame:
    """Every (service, plan) with the standard plan of each kind."""
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(p).alias("plan_id")) for k, p in STANDARD_SERVICE_PLANS.items())))
    return services.select(F.col("service").alias("resource_type"), F.col("plan").alias("plan_name"), kinds.alias("k")).select("k.kind", "resource_type", "plan_name", "k.plan_id")


def validate_plans(catalog: Catalog, sample: DataFrame) -> DataFrame:
    """Per plan and metric: rows of the metered sample, and those whose quantity is no number. What its expressions may not say, ``Catalog.rejects`` tells."""
    from ..operators.meter import meter

    q = F.coalesce("value", "consuming")
    return meter(sample, catalog).groupBy("metering_plan_id", "metric").agg(F.count("*").alias("rows"), F.count_if(q.isNull() | F.isnan(q)).alias("bad"))
