"""Registered queries over the benchmark tables, each beside its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from . import testdata as td
from .functions.calendar import bounds, doc_id, end_of_month, in_months, or_zero, slot_index, trunc_dim, yyyymm
from .operators import accumulate as acc
from .operators import documents
from .operators import events as ev
from .operators import ingest, monitor, report, spans, usage

from .operators.meter import meter
from .plans import catalog as plans
from .session import configure, shared_path
from .sources import readers, state
from .sources.versions import Tables
from .streaming import ingest as ingest_stream
from .streaming import reports as stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
ALL = ["organization_id", "space_id", "consumer_id", "resource_id", "plan_id", "resource_instance_id"]

#: 1998-07-15 12:00 and the end of 1998-06, and in the events 2024-01-20 06:00 UTC, in epoch ms.
T_MID, T_CLOSED, T_EVENTS = 900504000000, 899251199999, 1705730400000


def query(sql: str | None = None):
    """Registers a query under its function's name, with the session settings it needs."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark, sf_dir)
            return f(spark, sf_dir)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# ---- SQL that several queries share

U = """u AS (SELECT 'org-' || c_nationkey AS organization_id, c_mktsegment AS space_id,
  CASE WHEN c_custkey % 10 != 0 THEN 'customer:' || (c_custkey % 2) END AS consumer_id, 'object-storage' AS resource_id,
  CASE WHEN p_type IN ('STANDARD', 'LARGE', 'PROMO') THEN 'standard' ELSE 'basic' END AS plan_id,
  'inst-' || c_mktsegment || '-' || (l_suppkey % 2) AS resource_instance_id, epoch_ms(l_shipdate) AS end_ms,
  epoch_ms(l_shipdate) + (l_orderkey % 40) * 86400000 AS arrival_ms, l_quantity AS q, l_linenumber AS ln,
  l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)"""
BILL = "CASE WHEN end_ms < epoch_ms(date_trunc('month', epoch_ms(arrival_ms))) THEN epoch_ms(date_trunc('month', epoch_ms(end_ms)) + INTERVAL 1 MONTH) - 1 ELSE arrival_ms END"
MET = f"""{U}, met AS (SELECT organization_id, space_id, coalesce(consumer_id, 'UNKNOWN') AS consumer_id, resource_id, plan_id, resource_instance_id, end_ms, arrival_ms,
  {BILL} AS billing_ms, x.metric AS metric, x.fold AS accumulate, x.v AS value
  FROM u, UNNEST([{{'metric': 'storage', 'fold': 'max', 'v': CAST(q AS DOUBLE)}}, {{'metric': 'thousand_light_api_calls', 'fold': 'sum', 'v': CAST(ln AS DOUBLE)}}, {{'metric': 'heavy_api_calls', 'fold': 'sum', 'v': CAST(q AS DOUBLE)}}]) AS t(x))"""


def _acc(source: str = "met", name: str = "a", extra: str = "") -> str:
    return f"""{name} AS (SELECT organization_id, space_id, consumer_id, resource_id, plan_id, resource_instance_id, metric, accumulate, dimension, bucket_ms,
  CASE WHEN accumulate = 'max' THEN greatest(0, max(value)) ELSE sum(value) END AS quantity, count(*) AS n
  FROM (SELECT *, 'D' AS dimension, end_ms - end_ms % 86400000 AS bucket_ms FROM {source} UNION ALL SELECT *, 'M', epoch_ms(date_trunc('month', epoch_ms(end_ms))) FROM {source}) {extra}
  GROUP BY organization_id, space_id, consumer_id, resource_id, plan_id, resource_instance_id, metric, accumulate, dimension, bucket_ms)"""


def _tree(name: str = "tree", source: str = "a") -> str:
    return f"""{name} AS (SELECT CASE WHEN grouping(space_id) = 1 THEN 'org' WHEN grouping(consumer_id) = 1 THEN 'space' ELSE 'consumer' END AS level,
  organization_id, space_id, consumer_id, resource_id, plan_id, metric, dimension, bucket_ms, sum(quantity) AS quantity
  FROM {source} GROUP BY GROUPING SETS ((organization_id, resource_id, plan_id, metric, dimension, bucket_ms),
  (organization_id, space_id, resource_id, plan_id, metric, dimension, bucket_ms), (organization_id, space_id, consumer_id, resource_id, plan_id, metric, dimension, bucket_ms)))"""


def _slot(t: int) -> str:
    return f"CASE WHEN dimension = 'D' THEN ({t} - {t} % 86400000 - bucket_ms) // 86400000 ELSE date_diff('month', epoch_ms(bucket_ms), epoch_ms({t})) END"


def _asof(t: int, where: str = "") -> str:
    return f"{MET}, seen AS (SELECT * FROM met WHERE date_trunc('month', epoch_ms(end_ms)) = date_trunc('month', epoch_ms({t})) AND billing_ms <= {t} {where}), {_acc('seen')}, {_tree()}"


NODE_COLS = ["level", "organization_id", "space_id", "consumer_id", "resource_id", "plan_id", "metric", "dimension", "bucket_ms"]


# ---- metering and accumulation


@query(f"WITH {MET} SELECT organization_id, space_id, consumer_id, resource_instance_id, plan_id || '-object-storage' AS metering_plan_id, end_ms, metric, value FROM met")
def meter_object_storage(spark, d):
    return td.metered_orders(spark, d).select("organization_id", "space_id", "consumer_id", "resource_instance_id", "metering_plan_id", "end_ms", "metric", "value")


def _accumulated(spark, d, fold: str, dimension: str) -> DataFrame:
    a = acc.accumulate(td.metered_orders(spark, d, together=True))
    return a.where((F.col("accumulate") == fold) & (F.col("dimension") == dimension)).select(*ALL, "metric", "bucket_ms", "quantity", "n")


_ACC_SQL = "WITH {0}, {1} SELECT organization_id, space_id, consumer_id, resource_id, plan_id, resource_instance_id, metric, bucket_ms, quantity, n FROM a WHERE accumulate = '{2}' AND dimension = '{3}'"


@query(_ACC_SQL.format(MET, _acc(), "sum", "D"))
def accumulate_sum_day(spark, d):
    return _accumulated(spark, d, "sum", "D")


@query(_ACC_SQL.format(MET, _acc(), "sum", "M"))
def accumulate_sum_month(spark, d):
    return _accumulated(spark, d, "sum", "M")


@query(_ACC_SQL.format(MET, _acc(), "max", "M"))
def accumulate_max_month(spark, d):
    return _accumulated(spark, d, "max", "M")


@query(f"WITH {MET} SELECT organization_id, space_id, consumer_id, plan_id, resource_instance_id, metric, epoch_ms(date_trunc('month', epoch_ms(end_ms))) AS bucket_ms, round(sum(value) / count(*), 6) AS quantity FROM met GROUP BY ALL")
def accumulate_avg_month(spark, d):
    m = td.metered_orders(spark, d, together=True).withColumn("accumulate", F.lit("avg"))
    a = acc.accumulate(m).where("dimension = 'M'")
    return a.select("organization_id", "space_id", "consumer_id", "plan_id", "resource_instance_id", "metric", "bucket_ms", F.round("quantity", 6).alias("quantity"))


MEM = """e AS (SELECT event_id, user_id, (epoch_us(ts) // 1000) AS ts_ms, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
v AS (SELECT *, lag(n, 1, 0) OVER w AS pn, lag(gib, 1, 0) OVER w AS pgib FROM (SELECT user_id, event_id, ts_ms, k % 4 AS n, 1 + CAST(floor(value) AS BIGINT) % 8 AS gib FROM e WHERE event_type = 'view') WINDOW w AS (PARTITION BY user_id ORDER BY ts_ms, event_id)),
b AS (SELECT *, 'D' AS dimension, ts_ms - ts_ms % 86400000 AS f, ts_ms - ts_ms % 86400000 + 86400000 AS t FROM v UNION ALL SELECT *, 'M', epoch_ms(date_trunc('month', epoch_ms(ts_ms))), epoch_ms(date_trunc('month', epoch_ms(ts_ms)) + INTERVAL 1 MONTH) FROM v),
tb AS (SELECT 'org-' || (user_id % 5) AS organization_id, 'memory:' || user_id AS resource_instance_id, dimension, f AS bucket_ms, t AS to_ms, arg_max(n * gib, (ts_ms, event_id)) AS consuming, CAST(sum(CAST(n * gib - pn * pgib AS HUGEINT) * (f + t - 2 * ts_ms)) AS DOUBLE) AS consumed, max(ts_ms) AS since_ms FROM b GROUP BY ALL)"""


@query(f"WITH {MEM} SELECT organization_id, resource_instance_id, dimension, bucket_ms, CAST(consuming AS DOUBLE) AS consuming, consumed, since_ms FROM tb")
def accumulate_time_based(spark, d):
    a = acc.accumulate(td.metered_memory(spark, d))
    return a.select("organization_id", "resource_instance_id", "dimension", "bucket_ms", "consuming", "consumed", "since_ms")


@query(f"WITH {MET}, {_acc()} SELECT organization_id, space_id, consumer_id, plan_id, resource_instance_id, metric, dimension, bucket_ms, quantity FROM a WHERE metric = 'heavy_api_calls'")
def accumulate_custom_fold(spark, d):
    m = td.metered_orders(spark, d).where("metric = 'heavy_api_calls'")
    out = acc.accumulate_custom(m, "if(x.end_ms < x.from_ms OR x.end_ms >= x.to_ms, a, coalesce(a, 0D) + x.value)")
    return out.select("organization_id", "space_id", "consumer_id", "plan_id", "resource_instance_id", "metric", "dimension", "bucket_ms", "quantity")


# A legacy formula for each type of part: its greatest size and how many parts it has pick the fold and the numbers.
FORM = """form AS (SELECT p_type, max(p_size) AS size, CASE count(*) % 3 WHEN 0 THEN 'sum' WHEN 1 THEN 'max' ELSE 'avg' END AS fold FROM part GROUP BY p_type)"""


def _formulas(spark, d) -> DataFrame:
    fold = F.element_at(F.array(*map(F.lit, ("SUM", "MAX", "AVG"))), (F.count("*") % 3 + 1).cast("int"))
    rows = td.table(spark, d, "part").groupBy(F.col("p_type").alias("plan_id")).agg(F.concat(fold, F.lit("({quantity}*"), F.max("p_size").cast("string"), F.lit("+{line})")).alias("formula"))
    none = F.lit(None).cast("string")
    return rows.select("plan_id", F.lit("units").alias("metric"), F.lit("UNIT").alias("unit"), F.lit("discrete").alias("type"), "formula", none.alias("meter"), none.alias("accumulate"), none.alias("aggregate"), none.alias("summarize"))


@query(f"WITH {FORM} SELECT p_type AS plan_id, upper(fold) || '({{quantity}}*' || size || '+{{line}})' AS formula, fold AS accumulate, 'coalesce(m[''quantity''], 0)*' || size || '+coalesce(m[''line''], 0)' AS meter FROM form")
def formula_columns(spark, d):
    return plans.formula_columns(_formulas(spark, d)).select("plan_id", "formula", "accumulate", "meter")


@query(f"""WITH {FORM}, v AS (SELECT p_type, fold, l_suppkey % 10 AS inst, epoch_ms(date_trunc('month', l_shipdate)) AS bucket_ms, CAST(l_quantity * size + l_linenumber AS DOUBLE) AS value FROM lineitem JOIN part ON l_partkey = p_partkey JOIN form USING (p_type))
SELECT p_type AS plan, 'i' || inst AS instance, bucket_ms, round(CASE fold WHEN 'sum' THEN sum(value) WHEN 'max' THEN greatest(0, max(value)) ELSE avg(value) END, 6) AS quantity FROM v GROUP BY p_type, fold, inst, bucket_ms""")
def accumulate_formula(spark, d):
    p = td.table(spark, d, "part").select("p_partkey", "p_type")
    measure = lambda n, q: F.struct(F.lit(n).alias("measure"), q.cast("double").alias("quantity"))
    rows = td.spread(td.table(spark, d, "lineitem"), "l_orderkey").join(p, F.col("l_partkey") == F.col("p_partkey"))
    at = td.ms("l_shipdate")
    used = rows.select(F.col("p_type").alias("metering_plan_id"), F.concat(F.lit("i"), (F.col("l_suppkey") % 10).cast("string")).alias("instance"), at.alias("start_ms"), at.alias("end_ms"), at.alias("arrival_ms"), F.array(measure("quantity", F.col("l_quantity")), measure("line", F.col("l_linenumber"))).alias("measured_usage"))
    c = plans.Catalog(_formulas(spark, d), *(None,) * 4)
    a = acc.accumulate_by_plan(meter(used, c), c, ["metering_plan_id", "instance"]).where("dimension = 'M'")
    return a.select(F.col("metering_plan_id").alias("plan"), "instance", "bucket_ms", F.round("quantity", 6).alias("quantity"))


# ---- the plans' own functions

_GREATEST = "(a, x) -> greatest(coalesce(a, 0D), x.value)"
_CAPPED = "(a, x) -> coalesce(a, 0D) + if(coalesce(x.month, 0D) < 100, x.value, 0D)"


def _with_fold(catalog: plans.Catalog, metric: str, fold: str) -> plans.Catalog:
    """The catalog with another fold of a metric in the basic plan."""
    mine = (F.col("plan_id") == "basic-object-storage") & (F.col("metric") == metric)
    return replace(catalog, metrics=catalog.metrics.withColumn("accumulate", F.when(mine, fold).otherwise(F.col("accumulate"))))


def _metered_by(spark, d, c: plans.Catalog, together: bool = False, written: bool = False) -> DataFrame:
    """Usage metered by a catalog; ``written``: documents are stored first, as an ordered fold reads its usage more than once."""
    docs = td.usage_from_orders(spark, d, together)
    if written:
        path, docs = shared_path(spark, "documents"), docs.select(*schemas.INSTANCE, "start_ms", "end_ms", "arrival_ms", "measured_usage")
        docs.write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
    rows = usage.normalize(docs, c)
    rows = rows.withColumns({"consumer_id": F.coalesce("consumer_id", F.lit("UNKNOWN")), "billing_ms": usage.billing_ms(F.col("end_ms"), F.col("arrival_ms"))})
    return meter(rows, c)


_BY_PLAN = "WITH {0}, {1} SELECT organization_id, space_id, consumer_id, plan_id, resource_instance_id, metric, dimension, bucket_ms, {2} AS quantity FROM a"


@query(_BY_PLAN.format(MET.replace("x.fold AS accumulate", "CASE WHEN plan_id = 'basic' AND x.metric = 'heavy_api_calls' THEN 'max' ELSE x.fold END AS accumulate"), _acc(), "quantity"))
def accumulate_plan_fold(spark, d):
    c = _with_fold(td.catalog(spark, d), "heavy_api_calls", _GREATEST)
    return acc.accumulate_by_plan(_metered_by(spark, d, c, together=True, written=True), c).select("organization_id", "space_id", "consumer_id", "plan_id", "resource_instance_id", "metric", "dimension", "bucket_ms", "quantity")


_MEAN = "zero: named_struct('total', 0D, 'n', 0D); step: (a, x) -> if(x.value > 0, named_struct('total', a.total + x.value, 'n', a.n + 1), null); merge: (a, b) -> named_struct('total', a.total + b.total, 'n', a.n + b.n); finish: a -> round(a.total / a.n, 6)"


def _merged_mean(spark, d) -> tuple[DataFrame, plans.Catalog]:
    """Usage of odd and of even lines accumulated by itself, then merged by the plan's own fold."""
    c = _with_fold(td.catalog(spark, d), "heavy_api_calls", _MEAN)
    m = _metered_by(spark, d, c, together=True)
    m = m.withColumn("part", F.pmod(F.xxhash64("arrival_ms", "end_ms"), F.lit(2)))
    parts = acc.accumulate_by_plan(m, c, [*schemas.KEYS, "part"], mergeable=True)
    return acc.merge_accumulated(parts.drop("part"), catalog=c), c


@query(_BY_PLAN.format(MET.replace("x.fold AS accumulate", "CASE WHEN plan_id = 'basic' AND x.metric = 'heavy_api_calls' THEN 'avg' ELSE x.fold END AS accumulate"), _acc().replace("ELSE sum(value) END", "WHEN accumulate = 'avg' THEN round(sum(value) / count(*), 6) ELSE sum(value) END"), "quantity"))
def accumulate_mergeable_fold(spark, d):
    """A mean by a fold of zero, step, merge and finish: map-side states of two batches, put together."""
    return _merged_mean(spark, d)[0].select("organization_id", "space_id", "consumer_id", "plan_id", "resource_instance_id", "metric", "dimension", "bucket_ms", "quantity")


_CELL = """cell AS (SELECT *, coalesce(sum(value) OVER (PARTITION BY organization_id, space_id, consumer_id, plan_id, resource_instance_id, metric, date_trunc('month', epoch_ms(end_ms)) ORDER BY arrival_ms, value, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS month FROM met WHERE metric = 'heavy_api_calls' AND plan_id = 'basic'),
met2 AS (SELECT * REPLACE (CASE WHEN month < 100 THEN value ELSE 0 END AS value) FROM cell)"""


@query(f"WITH {MET}, {_CELL}, {_acc('met2')} SELECT organization_id, space_id, consumer_id, resource_instance_id, dimension, bucket_ms, quantity FROM a")
def accumulate_cell(spark, d):
    """Usage counts until its month's cell holds 100."""
    c = _with_fold(td.catalog(spark, d), "heavy_api_calls", _CAPPED)
    m = _metered_by(spark, d, c).where("metric = 'heavy_api_calls' AND plan_id = 'basic'")
    return acc.accumulate_by_plan(m, c).select("organization_id", "space_id", "consumer_id", "resource_instance_id", "dimension", "bucket_ms", "quantity")


# ---- tree and reports


@query(f"WITH {MET}, {_acc()}, {_tree()} SELECT * FROM tree")
def aggregate_tree(spark, d):
    return acc.aggregate_tree(acc.accumulate(td.metered_orders(spark, d, together=True))).select(*NODE_COLS, "quantity")


@query(f"WITH {MET}, {_acc()}, {_tree()} SELECT level, organization_id, space_id, consumer_id, resource_id, metric, dimension, bucket_ms, sum(quantity) AS quantity FROM tree GROUP BY ALL")
def resource_rollup(spark, d):
    return acc.resource_tree(acc.accumulate(td.metered_orders(spark, d, together=True)))


@query(f"WITH {MET}, {_acc()}, {_tree()} SELECT level, organization_id, space_id, consumer_id, resource_id, metric, dimension, bucket_ms, sum(quantity) AS quantity FROM tree GROUP BY ALL")
def resource_rollup_of_tree(spark, d):
    """The same from the tree, as averages need it."""
    return acc.rollup_resource(acc.aggregate_tree(acc.accumulate(td.metered_orders(spark, d, together=True))))


@query(f"WITH {_asof(T_MID)} SELECT *, {_slot(T_MID)} AS slot, quantity AS summary FROM tree WHERE bucket_ms <= {T_MID}")
def org_report_asof(spark, d):
    return report.org_report(td.metered_orders(spark, d), T_MID).select(*NODE_COLS, "slot", "quantity", "summary")


@query(f"WITH {_asof(T_CLOSED)} SELECT *, {_slot(T_CLOSED)} AS slot, quantity AS summary FROM tree WHERE bucket_ms <= {T_CLOSED}")
def org_report_closed_month(spark, d):
    return report.org_report(td.metered_orders(spark, d), T_CLOSED).select(*NODE_COLS, "slot", "quantity", "summary")


@query(f"WITH {_asof(T_CLOSED, '''AND organization_id IN (SELECT 'org-' || n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND n_nationkey % 7 != 0)''')} SELECT *, {_slot(T_CLOSED)} AS slot FROM tree WHERE bucket_ms <= {T_CLOSED}")
def account_report(spark, d):
    return report.account_report(td.metered_orders(spark, d), td.accounts(spark, d), "ASIA", T_CLOSED).select(*NODE_COLS, "slot", "quantity")


@query(f"WITH {_asof(T_CLOSED, '''AND resource_id = 'object-storage' AND plan_id = 'basic' ''')} SELECT level, organization_id, sum(quantity) AS quantity FROM tree WHERE metric = 'heavy_api_calls' AND dimension = 'M' GROUP BY ALL")
def report_resource_filter(spark, d):
    r = report.org_report(td.metered_orders(spark, d).where("plan_id = 'basic'"), T_CLOSED, resource_id="object-storage")
    return r.where("metric = 'heavy_api_calls' AND dimension = 'M'").groupBy("level", "organization_id").agg(F.sum("quantity").alias("quantity"))


@query(f"WITH {MET}, seen AS (SELECT * FROM met WHERE date_trunc('month', epoch_ms(end_ms)) = date_trunc('month', epoch_ms({T_CLOSED})) AND billing_ms <= {T_CLOSED} AND organization_id = 'org-3'), {_acc('seen')} SELECT space_id, consumer_id, plan_id, resource_instance_id, metric, dimension, bucket_ms, {_slot(T_CLOSED)} AS slot, quantity, quantity AS summary FROM a")
def instance_report(spark, d):
    r = report.instance_report(td.metered_orders(spark, d), {"organization_id": "org-3"}, T_CLOSED)
    return r.select("space_id", "consumer_id", "plan_id", "resource_instance_id", "metric", "dimension", "bucket_ms", "slot", "quantity", "summary")


def _mean_sql(sql: str) -> str:
    """The same with the mean as the fold of a basic plan's heavy calls."""
    sql = sql.replace("x.fold AS accumulate", "CASE WHEN plan_id = 'basic' AND x.metric = 'heavy_api_calls' THEN 'mean' ELSE x.fold END AS accumulate")
    return sql.replace("ELSE sum(value) END AS quantity", "WHEN accumulate = 'mean' THEN round(sum(value) / count(*), 6) ELSE sum(value) END AS quantity")


@query(_mean_sql(f"WITH {_asof(T_CLOSED, "AND organization_id IN (SELECT 'org-' || n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND n_nationkey % 7 != 0)")} SELECT *, {_slot(T_CLOSED)} AS slot, quantity AS summary FROM tree WHERE bucket_ms <= {T_CLOSED}"))
def account_report_by_plan(spark, d):
    """An account's report in which one plan has a fold of its own."""
    c = _with_fold(td.catalog(spark, d), "heavy_api_calls", _MEAN)
    return report.account_report(_metered_by(spark, d, c), c.accounts, "ASIA", T_CLOSED, c).select(*NODE_COLS, "slot", "quantity", "summary")


@query(_mean_sql(f"WITH {MET}, seen AS (SELECT * FROM met WHERE date_trunc('month', epoch_ms(end_ms)) = date_trunc('month', epoch_ms({T_CLOSED})) AND billing_ms <= {T_CLOSED} AND organization_id = 'org-3'), {_acc('seen')} SELECT space_id, consumer_id, plan_id, resource_instance_id, metric, dimension, bucket_ms, {_slot(T_CLOSED)} AS slot, quantity, quantity AS summary FROM a"))
def instance_report_by_plan(spark, d):
    c = _with_fold(td.catalog(spark, d), "heavy_api_calls", _MEAN)
    r = report.instance_report(_metered_by(spark, d, c), {"organization_id": "org-3"}, T_CLOSED, c)
    return r.select("space_id", "consumer_id", "plan_id", "resource_instance_id", "metric", "dimension", "bucket_ms", "slot", "quantity", "summary")


#: Expressions that plans might say, by p_size % 10, and what is told against them.
_SAID = [
    ("coalesce(m['storage'], 0) * {0}", None), ("length(java_method('java.lang.System', 'getProperty', 'user.home')) + {0}", "function not allowed: java_method"),
    ("(SELECT {0})", "subquery"), ("secret_{0}", "unknown name: secret_{0}"), ("reflect('java.util.UUID', 'randomUUID') * {0}", "function not allowed: reflect"),
    ("greatest(m['storage'], {0}) / (end_ms - start_ms)", None), ("my_function(m['storage'], {0})", "function not allowed: my_function"), ("m['storage'] +* {0}", "syntax"),
    ("sum(m['storage']) OVER (ORDER BY {0})", "not allowed: WindowExpression"), ("CASE WHEN m['storage'] > {0} THEN 1 ELSE try_divide(m['a'], m['b']) END", None),
]


def _quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


@query("SELECT p_brand AS plan_id, reason, count(*) AS n FROM (SELECT p_brand, CASE p_size % 10 " + " ".join(f"WHEN {i} THEN replace({_quoted(r)}, '{{0}}', CAST(p_size AS VARCHAR))" for i, (_, r) in enumerate(_SAID)) + " END AS reason FROM part) WHERE reason IS NOT NULL GROUP BY ALL")
def plan_rejects(spark, d):
    """Plans whose expressions, made from parts, may not run, by reason."""
    size = F.col("p_size").cast("string")
    said = F.lit(None).cast("string")
    for i, (text, _) in enumerate(_SAID):
        said = F.when(F.col("p_size") % 10 == i, F.replace(F.lit(text), F.lit("{0}"), size)).otherwise(said)
    parts = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("plan_id"), F.concat(F.lit("metric-"), F.col("p_partkey").cast("string")).alias("metric"), said.alias("meter"))
    metrics = parts.select("plan_id", "metric", *(F.lit(None).cast("string").alias(c) for c in ("unit", "type", "formula")), "meter", *(F.lit(None).cast("string").alias(c) for c in ("accumulate", "aggregate", "summarize")))
    c = replace(plans.sample_catalog(spark), metrics=metrics)
    return c.rejects().groupBy("plan_id", "reason").agg(F.count("*").alias("n"))


@query(f"WITH {MEM} SELECT organization_id, resource_instance_id, dimension, bucket_ms, round(CAST(consumed - consuming * (bucket_ms + to_ms - 2 * least({T_EVENTS}, to_ms)) AS DOUBLE) / 2 / 3600000, 9) AS summary FROM tb WHERE bucket_ms <= {T_EVENTS}")
def summarize_time_based(spark, d):
    s = report.summarize(acc.accumulate(td.metered_memory(spark, d)).where(F.col("bucket_ms") <= T_EVENTS), T_EVENTS)
    return s.select("organization_id", "resource_instance_id", "dimension", "bucket_ms", F.round("summary", 9).alias("summary"))


@query(f"WITH {MEM} SELECT organization_id, resource_instance_id, dimension, bucket_ms, round(CAST(consumed - consuming * (bucket_ms + to_ms - 2 * least({T_EVENTS}, to_ms)) AS DOUBLE) / 2 / 3600000, 6) AS summary FROM tb WHERE bucket_ms <= {T_EVENTS}")
def summarize_by_plan(spark, d):
    a = acc.accumulate(td.metered_memory(spark, d)).where(F.col("bucket_ms") <= T_EVENTS)
    s = report.summarize_by_plan(a, T_EVENTS, plans.sample_catalog(spark))
    return s.select("organization_id", "resource_instance_id", "dimension", "bucket_ms", F.round("summary", 6).alias("summary"))


@query(f"WITH {MEM} SELECT organization_id, resource_instance_id, dimension, bucket_ms, CASE WHEN organization_id IN ('org-0', 'org-1') THEN 0.00028 ELSE 0.00021 END::DOUBLE AS price, round(CAST(consumed - consuming * (bucket_ms + to_ms - 2 * least({T_EVENTS}, to_ms)) AS DOUBLE) / 2 / 3600000 * CASE WHEN organization_id IN ('org-0', 'org-1') THEN 0.00028 ELSE 0.00021 END::DOUBLE, 6) AS charge FROM tb WHERE bucket_ms <= {T_EVENTS}")
def charge_time_based(spark, d):
    c = plans.sample_catalog(spark)
    m = td.metered_memory(spark, d).withColumn("pricing_country", F.when(F.col("organization_id").isin("org-0", "org-1"), "USA").otherwise("EUR"))
    a = acc.accumulate(m, [*schemas.KEYS, "pricing_country"]).where(F.col("bucket_ms") <= T_EVENTS)
    r = report.charge_by_plan(report.rate_by_plan(usage.price_lookup(a, c.prices), c), T_EVENTS, c)
    return r.select("organization_id", "resource_instance_id", "dimension", "bucket_ms", "price", F.round("charge", 6).alias("charge"))


@query(f"WITH {_asof(T_CLOSED).replace('sum(quantity) AS quantity', 'CASE WHEN metric = ' + chr(39) + 'storage' + chr(39) + ' THEN max(quantity) ELSE sum(quantity) END AS quantity')} SELECT *, {_slot(T_CLOSED)} AS slot, quantity AS summary FROM tree WHERE bucket_ms <= {T_CLOSED}")
def org_report_by_plan(spark, d):
    """The report in which a node's storage is its greatest instance's, as its plan asks for."""
    c = td.catalog(spark, d)
    c = replace(c, metrics=c.metrics.withColumn("aggregate", F.when(F.col("metric") == "storage", "max")))
    return report.org_report(td.metered_orders(spark, d), T_CLOSED, catalog=c).select(*NODE_COLS, "slot", "quantity", "summary")


@query(f"WITH {_asof(T_MID)} SELECT *, {_slot(T_MID)} AS slot, quantity AS summary FROM tree WHERE bucket_ms <= {T_MID}")
def org_report_from_snapshots(spark, d):
    """The as-of report from a snapshot of nine days before, the usage since, and a batch that came in after the snapshot."""
    c = td.catalog(spark, d)
    rows = td.metered_orders(spark, d).withColumn("error", F.lit(None).cast("string")).where(F.col("end_ms").between(T_MID - 40 * 86_400_000, T_MID + 40 * 86_400_000))
    tables = Tables(spark, shared_path(spark, "usage"))
    late = F.pmod(F.xxhash64("arrival_ms", "l_orderkey"), F.lit(9)) == 0
    ingest_stream.store(tables, tables.latest(), rows.where(~late), c)
    stored.take_snapshot(tables, T_MID - 9 * 86_400_000, c)
    ingest_stream.store(tables, tables.latest(), rows.where(late), c)
    return stored.stored_report(tables, T_MID, c).select(*NODE_COLS, "slot", "quantity", "summary")


@query(f"WITH {_asof(T_CLOSED)} SELECT level, organization_id, space_id, consumer_id, resource_id, metric, dimension, bucket_ms, {_slot(T_CLOSED)} AS slot, sum(quantity) AS quantity, sum(quantity) AS summary FROM tree WHERE bucket_ms <= {T_CLOSED} GROUP BY ALL")
def resource_totals(spark, d):
    return report.resource_totals(report.org_report(td.metered_orders(spark, d), T_CLOSED))


@query(
    f"""WITH {_asof(T_CLOSED)}, t AS (SELECT *, {_slot(T_CLOSED)} AS slot FROM tree WHERE bucket_ms <= {T_CLOSED})
SELECT organization_id, count(DISTINCT space_id) AS spaces, count(DISTINCT CASE WHEN level = 'consumer' THEN space_id || '/' || consumer_id END) AS consumers,
  count(DISTINCT CASE WHEN level = 'consumer' THEN space_id || '/' || consumer_id || '/' || resource_id || '/' || plan_id END) AS plans,
  count(CASE WHEN level = 'consumer' THEN 1 END) AS cells, sum(CASE WHEN level = 'consumer' THEN quantity END) AS quantity,
  sum(CASE WHEN level = 'org' AND metric = 'heavy_api_calls' AND dimension = 'M' THEN quantity END) AS own FROM t GROUP BY organization_id"""
)
def nested_report(spark, d):
    """Organization > spaces > consumers > resources > plans as one row, told by what it holds."""
    n = report.nested_report(report.org_report(td.metered_orders(spark, d), T_CLOSED))
    flat = lambda x, f: F.flatten(F.transform(x, f))
    consumers = flat(F.col("spaces"), lambda s: s["consumers"])
    plans_ = flat(flat(consumers, lambda c: c["resources"]), lambda r: r["plans"])
    cells = flat(plans_, lambda p: p["usage"])
    total = lambda xs: F.aggregate(F.transform(xs, lambda u: u["quantity"]), F.lit(0.0), lambda a, q: a + q)
    own = F.filter(flat(F.col("resources"), lambda r: r["usage"]), lambda u: (u["metric"] == "heavy_api_calls") & (u["dimension"] == "M"))
    size = lambda x: F.size(x).cast("long")
    return n.select("organization_id", size("spaces").alias("spaces"), size(consumers).alias("consumers"), size(plans_).alias("plans"), size(cells).alias("cells"), total(cells).alias("quantity"), total(own).alias("own"))


_PRICES = "(VALUES ('storage', 'USA', 1.0), ('storage', 'EUR', 0.7523), ('thousand_light_api_calls', 'USA', 0.03), ('thousand_light_api_calls', 'EUR', 0.0226), ('heavy_api_calls', 'USA', 0.15), ('heavy_api_calls', 'EUR', 0.1129)) p(metric, country, price)"


def _priced(spark, d) -> DataFrame:
    m = td.metered_orders(spark, d)
    a = acc.accumulate(m, keys=[*ALL, "pricing_plan_id", "pricing_country"]).where("dimension = 'M'")
    return usage.price_lookup(a, td.catalog(spark, d).prices)


@query(f"WITH {MET}, {_acc()} SELECT organization_id, space_id, consumer_id, plan_id, resource_instance_id, a.metric, bucket_ms, CAST(price AS DOUBLE) AS price, round(quantity * CAST(price AS DOUBLE), 6) AS cost, round(quantity * CAST(price AS DOUBLE), 6) AS charge FROM a JOIN nation ON organization_id = 'org-' || n_nationkey JOIN {_PRICES} ON a.metric = p.metric AND country = CASE WHEN n_regionkey % 2 = 0 THEN 'USA' ELSE 'EUR' END WHERE dimension = 'M'")
def rate_charge(spark, d):
    r = report.charge(report.rate(_priced(spark, d)), T_CLOSED)
    return r.select("organization_id", "space_id", "consumer_id", "plan_id", "resource_instance_id", "metric", "bucket_ms", "price", F.round("cost", 6).alias("cost"), F.round("charge", 6).alias("charge"))


@query(f"WITH {U} SELECT organization_id, plan_id, coalesce(min(CAST(price AS DOUBLE)), 0) AS price, count(*) AS n FROM u JOIN nation ON organization_id = 'org-' || n_nationkey LEFT JOIN {_PRICES} ON p.metric = CASE WHEN ln % 2 = 0 THEN 'storage' ELSE 'unpriced' END AND country = CASE WHEN n_regionkey % 2 = 0 THEN 'USA' ELSE 'EUR' END GROUP BY organization_id, plan_id, ln % 2")
def price_lookup(spark, d):
    c = td.catalog(spark, d)
    rows = usage.normalize(td.usage_from_orders(spark, d), c).withColumn("metric", F.when(F.col("l_linenumber") % 2 == 0, "storage").otherwise("unpriced"))
    return usage.price_lookup(rows, c.prices).groupBy("organization_id", "plan_id", "metric").agg(F.min("price").alias("price"), F.count("*").alias("n")).drop("metric")


@query(f"WITH {_asof(T_CLOSED)}, r AS (SELECT * FROM tree WHERE level = 'space') SELECT organization_id, space_id, plan_id, metric, bucket_ms, dimension, sum(CASE WHEN plan_id = 'basic' THEN quantity ELSE 0 END) - sum(CASE WHEN bucket_ms % 2 = 0 THEN quantity ELSE 0 END) AS quantity FROM r WHERE plan_id = 'basic' OR bucket_ms % 2 = 0 GROUP BY ALL")
def report_delta(spark, d):
    r = report.org_report(td.metered_orders(spark, d), T_CLOSED).where("level = 'space'")
    on = ["organization_id", "space_id", "plan_id", "metric", "bucket_ms", "dimension"]
    return report.report_delta(r.where("plan_id = 'basic'"), r.where("bucket_ms % 2 = 0"), on, ["quantity"])


@query(f"WITH {U}, refs AS (SELECT DISTINCT organization_id, space_id, coalesce(consumer_id, 'UNKNOWN') AS consumer_id FROM u), s AS (SELECT DISTINCT organization_id, space_id, coalesce(consumer_id, 'UNKNOWN') AS consumer_id, true AS there FROM u WHERE q > 10 AND ln > 2) SELECT organization_id, count(*) AS refs, count(*) FILTER (there IS NULL) AS missing, bool_or(there IS NULL) AS is_partial FROM refs LEFT JOIN s USING (organization_id, space_id, consumer_id) GROUP BY ALL")
def completeness(spark, d):
    u = td.usage_from_orders(spark, d).withColumn("consumer_id", F.coalesce("consumer_id", F.lit("UNKNOWN")))
    on = ["organization_id", "space_id", "consumer_id"]
    q = F.element_at("measured_usage", 3)["quantity"]
    return report.completeness(u.select(*on).distinct(), u.where((q > 10) & (F.col("l_linenumber") > 2)), on)


@query(f"WITH {U} SELECT organization_id, space_id, coalesce(consumer_id, 'UNKNOWN') AS consumer_id, plan_id, resource_instance_id, max(end_ms) AS t, arg_max(arrival_ms, (end_ms, arrival_ms)) AS p FROM u GROUP BY organization_id, space_id, coalesce(consumer_id, 'UNKNOWN'), resource_id, plan_id, resource_instance_id")
def instance_refs(spark, d):
    u = td.usage_from_orders(spark, d).withColumn("consumer_id", F.coalesce("consumer_id", F.lit("UNKNOWN")))
    return acc.instance_refs(u).drop("resource_id")


@query(f"WITH {_asof(T_CLOSED)} SELECT organization_id, space_id, metric, quantity FROM tree WHERE level = 'space' AND dimension = 'M'")
def report_select(spark, d):
    r = report.strip_internal(report.org_report(td.metered_orders(spark, d), T_CLOSED))
    return report.report_select(r.where("dimension = 'M'"), "space", ["organization_id", "space_id", "metric", "quantity"])


@query(f"WITH {MET}, {_acc()} SELECT organization_id, resource_instance_id, metric, arg_max(quantity, bucket_ms) AS quantity FROM (SELECT organization_id, resource_instance_id, metric, bucket_ms, sum(quantity) AS quantity FROM a WHERE dimension = 'M' GROUP BY ALL) GROUP BY ALL")
def aggregate_last(spark, d):
    a = acc.accumulate(td.metered_orders(spark, d)).where("dimension = 'M'").groupBy("organization_id", "resource_instance_id", "metric", "bucket_ms").agg(F.sum("quantity").alias("quantity"))
    return acc.aggregate_last(a, ["organization_id", "resource_instance_id", "metric"], "quantity", "bucket_ms")


# ---- validation, lookups, deduplication


@query(f"WITH {U} SELECT organization_id, space_id, plan_id, resource_instance_id, end_ms, 'object-storage' AS resource_type, plan_id || '-object-storage' AS metering_plan_id, 'object-rating-plan' AS rating_plan_id, 'object-pricing-' || plan_id AS pricing_plan_id, r_name || CASE WHEN n_nationkey % 7 = 0 THEN '-TRIAL' ELSE '' END AS account_id FROM u JOIN nation ON organization_id = 'org-' || n_nationkey JOIN region ON n_regionkey = r_regionkey")
def normalize(spark, d):
    n = usage.normalize(td.usage_from_orders(spark, d), td.catalog(spark, d))
    return n.select("organization_id", "space_id", "plan_id", "resource_instance_id", "end_ms", "resource_type", "metering_plan_id", "rating_plan_id", "pricing_plan_id", "account_id")


@query(f"WITH {U}, h AS (SELECT plan_id, valid_from, name FROM (VALUES ('basic', 0, 'v1'), ('basic', 880000000000, 'v2'), ('standard', 850000000000, 'v1'), ('standard', 920000000000, 'v2')) h(plan_id, valid_from, name)) SELECT organization_id, u.plan_id, end_ms, name, count(*) AS n FROM u ASOF LEFT JOIN h ON u.plan_id = h.plan_id AND u.end_ms >= h.valid_from GROUP BY ALL")
def plan_lookup_as_of(spark, d):
    h = spark.createDataFrame([("basic", 0, "v1"), ("basic", 880000000000, "v2"), ("standard", 850000000000, "v1"), ("standard", 920000000000, "v2")], "plan_id string, valid_from long, name string")
    return usage.plan_lookup_as_of(td.usage_from_orders(spark, d), h, ["plan_id"]).groupBy("organization_id", "plan_id", "end_ms", "name").agg(F.count("*").alias("n"))


@query(f"""WITH {U}, x AS (SELECT organization_id, CASE WHEN ln = 7 THEN NULL ELSE space_id END AS space_id, CASE WHEN l_orderkey % 11 = 0 THEN 'gold' ELSE plan_id END AS plan_id, l_orderkey, ln FROM u)
SELECT organization_id, concat_ws(',', CASE WHEN space_id IS NULL THEN 'space_id: required' END) AS errors, CASE WHEN plan_id = 'gold' THEN 'no metering mapping' END AS instance_error, CASE WHEN n_nationkey % 7 = 0 THEN 'license not supported' END AS account_error, count(*) AS n FROM x JOIN nation ON organization_id = 'org-' || n_nationkey GROUP BY ALL""")
def validate_reasons(spark, d):
    c = td.catalog(spark, d)
    u = td.usage_from_orders(spark, d).withColumns({"space_id": F.when(F.col("l_linenumber") != 7, F.col("space_id")), "plan_id": F.when(F.col("l_orderkey") % 11 == 0, "gold").otherwise(F.col("plan_id")), "start": F.col("start_ms"), "end": F.col("end_ms")})
    told = usage.validate_account(usage.validate_instance(usage.validate_usage(u), c), c.accounts, ["TRIAL"])
    return told.groupBy("organization_id", F.array_join("errors", ",").alias("errors"), "instance_error", "account_error").agg(F.count("*").alias("n"))


_RAW = """'{"start": ' || CASE WHEN k = 1 THEN '"' || l_orderkey || '"' WHEN k = 2 THEN l_orderkey || '.5' ELSE CAST(l_orderkey AS VARCHAR(20)) END || ', "end": 5, ' || CASE WHEN k = 6 THEN '' WHEN k = 3 THEN '"organization_id": null, ' ELSE '"organization_id": "o", ' END ||
  '"space_id": "s", "resource_id": "r", "plan_id": ' || CASE WHEN k = 4 THEN '["p"]' ELSE '"p"' END || ', "resource_instance_id": "i", ' || CASE WHEN k = 5 THEN '"zone": {"a": 1}, ' ELSE '' END || '"measured_usage": ' ||
  CASE WHEN k = 6 THEN '{"measure": "m"}' WHEN k = 7 THEN '[{"measure": "m", "quantity": "' || l_linenumber || '"}, {"measure": 3, "quantity": 1, "unit": "GB"}, 7]' WHEN k = 8 THEN '[{"measure": "m", "quantity": null}, {"quantity": 2.5}]' ELSE '[{"measure": "m", "quantity": ' || l_linenumber || '}]' END || CASE WHEN k = 9 THEN '' ELSE '}' END"""


@query(
    f"""WITH k AS (SELECT *, (l_orderkey + l_linenumber) % 11 AS k FROM lineitem)
SELECT l_linenumber, CASE k WHEN 1 THEN 'start: expected number, got string' WHEN 2 THEN 'start: expected a whole number' WHEN 3 THEN 'organization_id: required' WHEN 4 THEN 'plan_id: expected string, got array' WHEN 5 THEN 'zone: unknown'
  WHEN 6 THEN 'organization_id: required; measured_usage: expected array, got object'
  WHEN 7 THEN 'measured_usage[0].quantity: expected number, got string; measured_usage[1].measure: expected string, got number; measured_usage[1].unit: unknown; measured_usage[2]: expected object, got number'
  WHEN 8 THEN 'measured_usage[0].quantity: required; measured_usage[1].measure: required' WHEN 9 THEN 'document: expected object, got no JSON' ELSE '' END AS errors, count(*) AS n FROM k GROUP BY ALL"""
)
def document_errors(spark, d):
    """All that is wrong with JSON texts made from line items, with its path."""
    lines = td.spread(td.table(spark, d, "lineitem"), "l_orderkey").withColumn("k", (F.col("l_orderkey") + F.col("l_linenumber")) % 11)
    told = lines.select(F.col("l_linenumber"), F.array_join(documents.document_errors(F.expr(_RAW)), "; ").alias("errors"))
    return told.groupBy("l_linenumber", "errors").agg(F.count("*").alias("n"))


# Line items with what can be wrong with them, and the first reason against each.
ING = f"""i AS (SELECT u.* EXCLUDE (space_id, plan_id, q), CASE WHEN ln = 7 THEN NULL ELSE space_id END AS space_id, CASE WHEN u.l_orderkey % 11 = 0 THEN 'gold' ELSE plan_id END AS plan_id, CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE q END AS q, n_nationkey % 7 = 0 AS trial FROM u JOIN nation ON organization_id = 'org-' || n_nationkey),
o AS (SELECT *, CASE WHEN space_id IS NULL THEN 'space_id: required' WHEN plan_id = 'gold' THEN 'no metering mapping' WHEN trial THEN 'license not supported' WHEN end_ms > {T_MID} - {T_MID} % 86400000 + 86399999 THEN 'usage of the future' END AS e0 FROM i),
n AS (SELECT *, row_number() OVER (PARTITION BY e0 IS NULL, organization_id, resource_instance_id, coalesce(consumer_id, 'UNKNOWN'), resource_id, plan_id, end_ms ORDER BY arrival_ms, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax) AS n FROM o),
c AS (SELECT *, coalesce(e0, CASE WHEN n > 1 THEN 'duplicate' WHEN end_ms < epoch_ms(date_trunc('month', epoch_ms(arrival_ms))) AND arrival_ms > epoch_ms(date_trunc('month', epoch_ms(arrival_ms))) + 1209600000 THEN 'out of slack' END) AS e1 FROM n),
mm AS (SELECT organization_id, space_id, coalesce(consumer_id, 'UNKNOWN') AS consumer_id, resource_id, plan_id, resource_instance_id, end_ms, arrival_ms, CASE WHEN e1 IS NULL THEN x.metric END AS metric, x.fold AS accumulate, x.v AS value, coalesce(e1, CASE WHEN x.v IS NULL THEN x.metric || ': no quantity' END) AS error
  FROM c, UNNEST(CASE WHEN e1 IS NULL THEN [{{'metric': 'storage', 'fold': 'max', 'v': CAST(q AS DOUBLE)}}, {{'metric': 'thousand_light_api_calls', 'fold': 'sum', 'v': CAST(ln AS DOUBLE)}}, {{'metric': 'heavy_api_calls', 'fold': 'sum', 'v': CAST(q AS DOUBLE)}}] ELSE [{{'metric': NULL, 'fold': NULL, 'v': NULL}}] END) AS t(x))"""


def _processed(spark, d) -> tuple[DataFrame, DataFrame]:
    c = td.catalog(spark, d)
    nan = lambda x: F.when(F.col("l_partkey") % 13 == 0, F.lit(float("nan"))).otherwise(x)
    measures = F.transform("measured_usage", lambda m: F.struct(m["measure"].alias("measure"), F.when(m["measure"] == "light_api_calls", m["quantity"]).otherwise(nan(m["quantity"])).alias("quantity")))
    u = td.usage_from_orders(spark, d).withColumns({"space_id": F.when(F.col("l_linenumber") != 7, F.col("space_id")), "plan_id": F.when(F.col("l_orderkey") % 11 == 0, "gold").otherwise(F.col("plan_id")), "measured_usage": measures, "start": F.col("start_ms"), "end": F.col("end_ms")})
    return ingest.process_usage(u, c, T_MID, [F.col(x) for x in ["arrival_ms", *td.TIE]], ["TRIAL"], 1209600000)


@query(f"WITH {U}, {ING}, {_acc('(SELECT * FROM mm WHERE error IS NULL)')} SELECT organization_id, space_id, consumer_id, plan_id, resource_instance_id, metric, dimension, bucket_ms, quantity, n FROM a")
def process_usage(spark, d):
    return _processed(spark, d)[0].select("organization_id", "space_id", "consumer_id", "plan_id", "resource_instance_id", "metric", "dimension", "bucket_ms", "quantity", "n")


@query(f"WITH {U}, {ING} SELECT organization_id, consumer_id, plan_id, metric, error, count(*) AS n FROM mm WHERE error IS NOT NULL GROUP BY ALL")
def process_usage_errors(spark, d):
    return _processed(spark, d)[1].groupBy("organization_id", "consumer_id", "plan_id", "metric", "error").agg(F.count("*").alias("n"))


@query(f"WITH {U} SELECT end_ms, end_ms > {T_MID} - {T_MID} % 86400000 + 86399999 AS future, count(*) AS n FROM u GROUP BY ALL")
def reject_future(spark, d):
    return td.usage_from_orders(spark, d).groupBy("end_ms", usage.reject_future(F.col("end_ms"), F.lit(T_MID)).alias("future")).agg(F.count("*").alias("n"))


@query(f"WITH {U}, x AS (SELECT *, epoch_ms(date_trunc('month', epoch_ms(arrival_ms))) AS m FROM u) SELECT organization_id, end_ms, arrival_ms, end_ms <= m - 1 AND arrival_ms > m + 172800000 AS late, count(*) AS n FROM x GROUP BY ALL")
def reject_out_of_slack(spark, d):
    late = usage.reject_out_of_slack(F.col("end_ms"), F.col("arrival_ms"), 172800000)
    return td.usage_from_orders(spark, d).groupBy("organization_id", "end_ms", "arrival_ms", late.alias("late")).agg(F.count("*").alias("n"))


@query(f"WITH {MET} SELECT organization_id, end_ms, arrival_ms, billing_ms, count(*) AS n FROM met WHERE metric = 'storage' GROUP BY ALL")
def with_billing_time(spark, d):
    u = td.usage_from_orders(spark, d).withColumn("billing_ms", usage.billing_ms(F.col("end_ms"), F.col("arrival_ms")))
    return u.groupBy("organization_id", "end_ms", "arrival_ms", "billing_ms").agg(F.count("*").alias("n"))


@query(f"WITH {U} SELECT organization_id, space_id, consumer_id, plan_id, resource_instance_id, end_ms, l_orderkey, l_linenumber, l_partkey FROM u QUALIFY row_number() OVER (PARTITION BY organization_id, resource_instance_id, coalesce(consumer_id, 'UNKNOWN'), resource_id, plan_id, end_ms ORDER BY arrival_ms, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax) = 1")
def dedup_usage(spark, d):
    out = usage.dedup_usage(td.usage_from_orders(spark, d), [F.col(c) for c in ["arrival_ms", *td.TIE]])
    return out.select("organization_id", "space_id", "consumer_id", "plan_id", "resource_instance_id", "end_ms", "l_orderkey", "l_linenumber", "l_partkey")


@query(f"WITH {U} SELECT DISTINCT organization_id || '/' || end_ms AS id FROM u")
def dedup_messages(spark, d):
    u = td.usage_from_orders(spark, d).select(F.concat_ws("/", "organization_id", F.col("end_ms").cast("string")).alias("id"))
    return usage.dedup_messages(u, "id")


@query("WITH e AS (SELECT event_id, user_id, (epoch_us(ts) // 1000) AS ts, event_type FROM events WHERE event_type IN ('signup', 'purchase')) SELECT event_id, user_id, ts AS timestamp FROM e QUALIFY row_number() OVER (PARTITION BY event_type, user_id || '/' || (ts // 3600000) ORDER BY ts, event_id) = 1")
def dedup_span_events(spark, d):
    e = td.span_events(spark, d).withColumn("id", F.concat(F.col("user_id").cast("string"), F.lit("/"), F.floor(F.col("timestamp") / 3600000).cast("string")))
    return usage.dedup_span_events(e, [F.col("timestamp"), F.col("event_id")]).select("event_id", "user_id", "timestamp")


@query(f"WITH {U} SELECT yyyymm, t AS doc_id, n FROM (SELECT strftime(epoch_ms(end_ms), '%Y%m') AS yyyymm, 't/' || lpad(CAST(end_ms AS VARCHAR), 16, '0') || '/k/' || organization_id || '/' || space_id AS t, count(*) AS n FROM u GROUP BY ALL)")
def doc_ids(spark, d):
    u = td.usage_from_orders(spark, d)
    return u.groupBy(yyyymm(F.col("end_ms")).alias("yyyymm"), doc_id(F.col("end_ms"), F.col("organization_id"), F.col("space_id")).alias("doc_id")).agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT (epoch_us(ts) // 1000) AS ts_ms, epoch_ms(date_trunc('second', ts)) AS s, epoch_ms(date_trunc('minute', ts)) AS m, epoch_ms(date_trunc('hour', ts)) AS h, epoch_ms(date_trunc('day', ts)) AS d, epoch_ms(date_trunc('month', ts)) AS mo, epoch_ms(date_trunc('month', ts) + INTERVAL 1 MONTH) - 1 AS month_end, CASE WHEN greatest(0, date_diff('day', ts, epoch_ms({T_EVENTS}))) >= 10 THEN -1 ELSE greatest(0, date_diff('day', ts, epoch_ms({T_EVENTS}))) END AS slot FROM events")
def window_functions(spark, d):
    t = F.col("ts_ms")
    cols = [trunc_dim(t, k).alias(n) for k, n in (("s", "s"), ("m", "m"), ("h", "h"), ("D", "d"), ("M", "mo"))]
    return td.events_ms(spark, d).select("ts_ms", *cols, end_of_month(t).alias("month_end"), slot_index(F.lit(T_EVENTS), t, "D", 10).alias("slot")).distinct()


@query("SELECT event_type, sum(CASE WHEN value > 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) ELSE 0 END) AS total FROM events GROUP BY ALL")
def default_or_zero(spark, d):
    e = td.events_ms(spark, d)
    v = F.when(F.col("value") > 0, F.col("k").cast("double")).when(F.col("value") == 0, F.lit(float("nan")))
    return e.groupBy("event_type").agg(F.sum(or_zero(v)).alias("total"))


# ---- spans

SP = """sp AS (SELECT event_id, user_id, (epoch_us(ts) // 1000) AS ts, CASE event_type WHEN 'signup' THEN 'start' ELSE 'stop' END AS kind FROM events WHERE event_type IN ('signup', 'purchase')),
l AS (SELECT *, lag(kind) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM sp),
tk AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS end_ms FROM l WHERE (kind = 'start' AND (before IS NULL OR before = 'stop')) OR (kind = 'stop' AND before = 'start')),
spans AS (SELECT event_id, user_id, ts AS start_ms, end_ms FROM tk WHERE kind = 'start')"""


def _spans(spark, d) -> DataFrame:
    return spans.build_spans(td.span_events(spark, d), ["user_id"], ["timestamp", "event_id"])[0]


@query(f"WITH {SP} SELECT * FROM spans")
def build_spans(spark, d):
    return _spans(spark, d).select("event_id", "user_id", "start_ms", "end_ms")


@query(f"WITH {SP} SELECT event_id, CASE WHEN kind = 'start' THEN 'conflict' ELSE 'missing' END AS reason FROM l WHERE NOT ((kind = 'start' AND (before IS NULL OR before = 'stop')) OR (kind = 'stop' AND coalesce(before, '') = 'start'))")
def span_rejects(spark, d):
    return spans.build_spans(td.span_events(spark, d), ["user_id"], ["timestamp", "event_id"])[1].select("event_id", "reason")


@query(f"WITH {SP} SELECT user_id, start_ms, end_ms FROM spans")
def build_spans_by_fold(spark, d):
    e = td.span_events(spark, d).withColumn("seq", F.struct("timestamp", "event_id"))
    return spans.build_spans_by_fold(e, ["user_id"], "seq").where("start_ms IS NOT NULL").select("user_id", "start_ms", "end_ms")


_NOW = 1706572800000  # 2024-01-30
IV = f"""{SP}, tgt AS (SELECT *, coalesce(end_ms, CASE WHEN start_ms < {_NOW} - 86400000 THEN {_NOW} - 86400000 END) AS until FROM spans),
pts AS (SELECT event_id, user_id, start_ms, end_ms, start_ms AS p FROM tgt WHERE until IS NOT NULL UNION SELECT event_id, user_id, start_ms, end_ms, until FROM tgt WHERE until IS NOT NULL
  UNION SELECT event_id, user_id, start_ms, end_ms, UNNEST(generate_series(start_ms - start_ms % 86400000 + 86400000, until - 1, 86400000)) FROM tgt WHERE until IS NOT NULL),
iv AS (SELECT event_id, user_id, p AS from_ms, lead(p) OVER (PARTITION BY event_id ORDER BY p) AS until_ms FROM pts QUALIFY until_ms IS NOT NULL)"""


@query(f"WITH {IV} SELECT * FROM iv")
def sample_spans_day(spark, d):
    return spans.sample_spans(_spans(spark, d), _NOW).select("event_id", "user_id", "from_ms", "until_ms")


@query(f"WITH {IV} SELECT user_id, from_ms, CAST(floor((from_ms + until_ms) / 2) AS BIGINT) AS usage_ms, until_ms - from_ms AS duration, sha256(user_id || '|' || from_ms || '|' || until_ms) AS dedup_id FROM iv")
def interval_usage(spark, d):
    i = spans.interval_usage(spans.sample_spans(_spans(spark, d), _NOW), ["user_id"])
    return i.select("user_id", "from_ms", "usage_ms", "duration", "dedup_id")


@query(f"""WITH {SP}, c AS (SELECT *, end_ms + 93600000 AS s FROM spans WHERE end_ms IS NOT NULL),
p AS (SELECT event_id, s AS p FROM c UNION SELECT event_id, end_ms FROM c UNION SELECT event_id, UNNEST(generate_series((s - 1) - (s - 1) % 86400000, end_ms + 1, -86400000)) FROM c)
SELECT event_id, p AS from_ms, lag(p) OVER (PARTITION BY event_id ORDER BY p) AS until_ms FROM p QUALIFY until_ms IS NOT NULL""")
def negative_correction(spark, d):
    s = _spans(spark, d).where("end_ms IS NOT NULL").withColumn("sampled", F.col("end_ms") + 93600000)
    return spans.correct_spans(s, "sampled", _NOW).select("event_id", "from_ms", "until_ms")


@query(f"WITH {SP} SELECT event_id, user_id, start_ms, end_ms FROM spans WHERE end_ms IS NULL OR end_ms >= epoch_ms(epoch_ms({_NOW} + 1296000000) - INTERVAL 1 MONTH)")
def span_cleanup(spark, d):
    return spans.span_cleanup(_spans(spark, d), _NOW + 1296000000).select("event_id", "user_id", "start_ms", "end_ms")


# ---- platform events

AE = """ae AS (SELECT *, lag(state) OVER w AS previous_state, lag(memory_mb) OVER w AS previous_memory_mb, lag(instance_count) OVER w AS previous_instance_count FROM (
  SELECT event_id AS guid, user_id, (epoch_us(ts) // 1000) AS ts, CASE event_type WHEN 'click' THEN 'STARTED' WHEN 'error' THEN 'STOPPED' ELSE 'BUILDPACK_SET' END AS state,
  CAST(64 * (1 + CAST(floor(value) AS BIGINT) % 4) AS DOUBLE) AS memory_mb, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 AS DOUBLE) AS instance_count FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, guid)),
ac AS (SELECT *, state = 'STARTED' AND (coalesce(previous_state = 'STOPPED', false) OR coalesce(previous_instance_count = instance_count AND previous_memory_mb = memory_mb, false)) AS fresh FROM ae WHERE state IN ('STARTED', 'STOPPED'))"""


@query(f"""WITH {AE} SELECT guid, ts, 'app:' || user_id AS consumer_id, CASE WHEN state = 'STARTED' THEN memory_mb * 1048576 ELSE 0 END AS current_instance_memory, CASE WHEN state = 'STARTED' THEN instance_count ELSE 0 END AS current_running_instances,
CASE WHEN fresh THEN 0 ELSE previous_memory_mb * 1048576 END AS previous_instance_memory, CASE WHEN fresh THEN 0 WHEN coalesce(previous_instance_count, 0) = 0 THEN instance_count ELSE previous_instance_count END AS previous_running_instances FROM ac""")
def convert_app_events(spark, d):
    return ev.convert_app_events(td.app_events(spark, d)).select("guid", "ts", "consumer_id", "current_instance_memory", "current_running_instances", "previous_instance_memory", "previous_running_instances")


SE = """se AS (SELECT event_id AS guid, (epoch_us(ts) // 1000) AS ts, user_id, CASE event_type WHEN 'signup' THEN 'CREATED' WHEN 'view' THEN 'UPDATED' WHEN 'purchase' THEN 'DELETED' ELSE 'OTHER' END AS state, 'plan-' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 3) AS plan FROM events)"""


@query(f"WITH {SE} SELECT guid, ts, CASE WHEN state = 'CREATED' THEN 1 ELSE 0 END AS current_instances, CASE WHEN state = 'CREATED' THEN 0 ELSE 1 END AS previous_instances, 'service:' || user_id || ':' || plan || ':service' AS resource_instance_id FROM se WHERE state IN ('CREATED', 'DELETED')")
def convert_service_events(spark, d):
    return ev.convert_service_events(td.service_events(spark, d).where("state IN ('CREATED', 'DELETED')")).select("guid", "ts", "current_instances", "previous_instances", "resource_instance_id")


@query(f"""WITH {SE}, p AS (SELECT *, CASE WHEN date_diff('month', epoch_ms(lag(ts) OVER w), epoch_ms(ts)) <= 1 THEN lag(plan) OVER w END AS pp FROM se WINDOW w AS (PARTITION BY user_id ORDER BY ts, guid))
SELECT guid, ts, state, plan AS service_plan_name FROM p WHERE state IN ('CREATED', 'DELETED') UNION ALL SELECT guid, ts, 'DELETED', pp FROM p WHERE state = 'UPDATED' AND pp IS NOT NULL UNION ALL SELECT guid, ts + 1, 'CREATED', plan FROM p WHERE state = 'UPDATED' AND pp IS NOT NULL""")
def expand_updates(spark, d):
    e = ev.preceding_plan(td.service_events(spark, d), ["service_instance_guid"], "ts", "service_plan_name", ["ts", "guid"])
    return ev.expand_updates(e, "ts").select("guid", "ts", "state", "service_plan_name")


@query("WITH e AS (SELECT event_id, user_id, (epoch_us(ts) // 1000) // 3600000 * 3600000 AS ts FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM e) SELECT event_id, user_id, ts, max(ts - n) OVER (PARTITION BY user_id ORDER BY event_id) + n AS adjusted FROM n")
def monotonic_timestamps(spark, d):
    e = td.events_ms(spark, d).select("event_id", "user_id", trunc_dim(F.col("ts_ms"), "h").alias("ts"))
    return ev.monotonic_timestamps(e, ["user_id"], "ts", ["event_id"])


@query(f"WITH {AE} SELECT strftime(epoch_ms(ts), '%Y%m') AS month, CAST(user_id AS VARCHAR) AS app_guid, arg_max(state, (ts, guid)) AS state, arg_max(guid, (ts, guid)) AS event_guid, max(ts) AS timestamp FROM ae GROUP BY ALL")
def carry_over(spark, d):
    e = td.app_events(spark, d).withColumn("o", F.struct("ts", "guid"))
    return ev.carry_over(e, ["app_guid"], "ts", "o")


# Orders as records of running instances: the last order of a month carries over.
RN = """c AS (SELECT strftime(o_orderdate, '%Y%m') AS month, o_custkey, arg_max(CASE WHEN o_orderstatus = 'F' THEN 'STOPPED' ELSE 'STARTED' END, (o_orderdate, o_orderkey)) AS state, epoch_ms(max(o_orderdate)) AS start FROM orders GROUP BY ALL)"""


@query(f"WITH {RN} SELECT c.o_custkey, epoch_ms(TIMESTAMP '1997-03-01') AS start, count(*) AS n, sum(o_totalprice) > 0 AS paid FROM c JOIN orders o ON o.o_custkey = c.o_custkey AND epoch_ms(o_orderdate) = c.start WHERE month = '199702' AND state = 'STARTED' AND c.o_custkey NOT IN (SELECT o_custkey FROM c WHERE month = '199703') GROUP BY ALL")
def renew_usage(spark, d):
    o = td.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", td.ms("o_orderdate").alias("start"), F.when(F.col("o_orderstatus") == "F", "STOPPED").otherwise("STARTED").alias("state"), F.col("o_orderkey").alias("guid"))
    carry = ev.carry_over(o.withColumn("o", F.struct("start", "o_orderkey")), ["o_custkey"], "start", "o")
    price = F.struct(F.lit("previous_price").alias("measure"), F.col("o_totalprice").alias("quantity"))
    docs = o.select("o_custkey", "start", "o_totalprice", F.array(price).alias("measured_usage"))
    out = ev.renew_usage(carry, docs, ["o_custkey"], 857174400000 + 60_000, 600_000)
    return out.groupBy("o_custkey", "start").agg(F.count("*").alias("n"), (F.sum("o_totalprice") + F.sum(F.element_at("measured_usage", 1)["quantity"]) > 0).alias("paid"))


@query(f"""WITH {AE}, y AS (SELECT min(ts) AS first FROM ae WHERE ts > {T_EVENTS} - 60000), f AS (SELECT ac.* FROM ac, y WHERE (first IS NULL OR ts < first) AND user_id % 5 IN (1, 2)),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY guid) AS n FROM f) SELECT guid, 'org-' || (user_id % 5) AS organization_id, max(ts - n) OVER (PARTITION BY user_id ORDER BY guid) + n AS adjusted FROM n""")
def bridge(spark, d):
    orgs = spark.createDataFrame([("org-1",), ("org-2",)], "organization_id string")
    return ev.bridge(td.app_events(spark, d), ["app_guid"], "ts", ["guid"], T_EVENTS, orgs).select("guid", "organization_id", "adjusted")


@query(f"WITH {SE} SELECT guid, plan AS service_plan_name FROM se WHERE plan = 'plan-1'")
def service_filter(spark, d):
    allowed = spark.createDataFrame([("service", "plan-1")], "service_label string, service_plan_name string")
    return ev.service_filter(td.service_events(spark, d), allowed).select("guid", "service_plan_name")


# ---- state


@query(f"WITH {U} SELECT organization_id, resource_instance_id, max(end_ms) AS end_ms, arg_max(q, (end_ms, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS q FROM u WHERE end_ms >= epoch_ms(date_trunc('month', epoch_ms({T_MID}))) AND end_ms <= {T_MID} GROUP BY ALL")
def latest_per_key(spark, d):
    u = td.usage_from_orders(spark, d).withColumns({"o": F.struct(*td.TIE[:5]), "q": F.element_at("measured_usage", 3)["quantity"]})
    return state.latest_per_key(u, ["organization_id", "resource_instance_id"], "end_ms", T_MID, "o").select("organization_id", "resource_instance_id", "end_ms", "q")


@query("SELECT user_id, (epoch_us(ts) // 1000) // 21600000 AS period, arg_max(event_id, ((epoch_us(ts) // 1000), event_id)) AS event_id FROM events GROUP BY ALL")
def sample_snapshots(spark, d):
    return state.sample_snapshots(td.events_ms(spark, d).withColumn("e", F.col("event_id")), ["user_id"], "ts_ms", 6, "h", "event_id").select("user_id", "period", "event_id")


@query("WITH o AS (SELECT o_custkey, year(o_orderdate) * 100 + (month(o_orderdate) - 1) // 3 * 3 AS period, o_orderkey, o_orderdate FROM orders) SELECT o_custkey, CAST(period AS BIGINT) AS period, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM o GROUP BY ALL")
def sample_snapshots_month(spark, d):
    o = td.table(spark, d, "orders").select("o_custkey", "o_orderkey", td.ms("o_orderdate").alias("ts"))
    return state.sample_snapshots(o, ["o_custkey"], "ts", 3, "M", "o_orderkey").select("o_custkey", "period", "o_orderkey")


@query("WITH e AS (SELECT event_id, user_id, (epoch_us(ts) // 1000) AS ts, event_type FROM events) SELECT event_id FROM e WHERE ts >= 1705276800000 AND NOT EXISTS (SELECT 1 FROM e x WHERE x.event_id = e.event_id AND x.event_type IN ('click', 'error'))")
def replay_unprocessed(spark, d):
    e = td.events_ms(spark, d)
    return state.replay_unprocessed(e, e.where("event_type = 'click'"), e.where("event_type = 'error'"), ["event_id"], "ts_ms", 1706140800000, 864000000).select("event_id")


@query(f"SELECT DISTINCT strftime(l_shipdate, '%Y%m') AS yyyymm FROM lineitem WHERE strftime(l_shipdate, '%Y%m') <= strftime(date_trunc('month', epoch_ms({T_MID})) - INTERVAL 4 MONTH, '%Y%m')")
def apply_retention_preview(spark, d):
    u = td.table(spark, d, "lineitem").select(yyyymm(td.ms("l_shipdate")).alias("yyyymm"))
    return state.expired_months(u, T_MID)


@query(f"WITH {U}, r AS (SELECT organization_id, resource_instance_id, plan_id, max(end_ms) AS t FROM u WHERE end_ms < {T_MID} GROUP BY ALL) SELECT * FROM r WHERE epoch_ms(epoch_ms(t) + INTERVAL 2 MONTHS) + 600000 > {T_MID}")
def active_refs(spark, d):
    r = td.usage_from_orders(spark, d).where(F.col("end_ms") < T_MID).groupBy("organization_id", "resource_instance_id", "plan_id").agg(F.max("end_ms").alias("t"))
    return usage.active_refs(r, "t", T_MID)


@query("WITH e AS (SELECT * FROM events) SELECT i.event_id, coalesce(o.value, r.value) AS value, CASE WHEN o.event_id IS NULL THEN 'bad' END AS error FROM (SELECT event_id FROM e WHERE value > 1) i LEFT JOIN (SELECT * FROM e WHERE event_type = 'click') o ON i.event_id = o.event_id LEFT JOIN (SELECT * FROM e WHERE event_type = 'error') r ON i.event_id = r.event_id WHERE o.event_id IS NOT NULL OR r.event_id IS NOT NULL")
def find_usage(spark, d):
    e = td.events_ms(spark, d)
    return state.find_usage(e.where("value > 1").select("event_id"), e.where("event_type = 'click'"), e.where("event_type = 'error'").withColumn("error", F.lit("bad")), "event_id", ["value"])


@query("SELECT user_id, event_id, (epoch_us(ts) // 1000) AS ts_ms FROM events WHERE user_id = 7 AND (epoch_us(ts) // 1000) BETWEEN 1704067200000 AND 1706140800000 ORDER BY ts DESC, event_id LIMIT 20 OFFSET 5")
def read_range(spark, d):
    from .sources.readers import read_range as page

    return page(td.events_ms(spark, d), "user_id", 7, "ts_ms", 1704067200000, 1706140800000, limit=20, offset=5).select("user_id", "event_id", "ts_ms")


@query("WITH e AS (SELECT user_id, event_type, value, event_id FROM events) SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM e GROUP BY ALL")
def last_version_wins(spark, d):
    return state.last_version_wins(td.events_ms(spark, d).select("user_id", "event_type", "value", "event_id"), ["user_id", "event_type"], "event_id")


# ---- plans


@query("SELECT p_type AS plan_id, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 99 ELSE min(p_size) END AS size FROM part GROUP BY p_type UNION ALL SELECT 'NEW-' || p_type, 1 FROM part WHERE p_type = 'LARGE' GROUP BY p_type")
def merge_plans(spark, d):
    p = td.table(spark, d, "part").groupBy(F.col("p_type").alias("plan_id")).agg(F.min("p_size").alias("size"))
    t = td.table(spark, d, "part").select("p_type").distinct()
    inserts = t.select(F.lit("insert").alias("op"), F.when(F.col("p_type") == "LARGE", "NEW-LARGE").otherwise(F.col("p_type")).alias("plan_id"), F.lit(1).alias("size"))
    updates = t.where("p_type IN ('ECONOMY', 'PROMO')").select(F.lit("update").alias("op"), F.col("p_type").alias("plan_id"), F.lit(99).alias("size"))
    return plans.merge_plans(p, inserts.unionByName(updates))[0]


@query("WITH s AS (SELECT DISTINCT p_type AS service, p_brand AS plan FROM part) SELECT k.kind, s.service AS resource_type, s.plan AS plan_name, k.plan_id FROM s, (VALUES ('metering', 'standard-service'), ('rating', 'service-rating-standard'), ('pricing', 'service-pricing-standard')) k(kind, plan_id)")
def expand_service_mappings(spark, d):
    return plans.expand_service_mappings(td.table(spark, d, "part").select(F.col("p_type").alias("service"), F.col("p_brand").alias("plan")).distinct())


@query(f"WITH {MET} SELECT plan_id || '-object-storage' AS metering_plan_id, metric, count(*) AS rows, 0 AS bad FROM met GROUP BY ALL")
def validate_plans(spark, d):
    c = td.catalog(spark, d)
    return plans.validate_plans(c, usage.normalize(td.usage_from_orders(spark, d), c))


# ---- monitoring

_SIZE = 3600000
_SL = f"s AS (SELECT event_type, value, {T_EVENTS + 1234567} // {_SIZE} - (epoch_us(ts) // 1000) // {_SIZE} AS slot FROM events)"
_GONE = (T_EVENTS + 1234567) % _SIZE


@query(f"WITH {_SL} SELECT event_type, count(*) FILTER (slot = 1) * (1000.0::DOUBLE / {_SIZE}) AS previous_rate, count(*) FILTER (slot = 0) * (1000.0::DOUBLE / {_GONE}) AS current_rate, count(*) * (1000.0::DOUBLE / {_SIZE + _GONE}) AS composite_rate FROM s WHERE slot IN (0, 1) GROUP BY ALL")
def rate_windows(spark, d):
    return monitor.rate_windows(td.events_ms(spark, d), "event_type", "ts_ms", _SIZE, T_EVENTS + 1234567)


@query(f"WITH {_SL} SELECT event_type, min(value) FILTER (slot = 1) AS previous_min, max(value) FILTER (slot = 1) AS previous_max, round(avg(value) FILTER (slot = 1), 6) AS previous_avg, min(value) FILTER (slot = 0) AS current_min, max(value) FILTER (slot = 0) AS current_max, round(avg(value) FILTER (slot = 0), 6) AS current_avg, min(value) AS composite_min, max(value) AS composite_max, round(avg(value), 6) AS composite_avg FROM s WHERE slot IN (0, 1) GROUP BY ALL")
def gauge_windows(spark, d):
    g = monitor.gauge_windows(td.events_ms(spark, d), "event_type", "value", "ts_ms", _SIZE, T_EVENTS + 1234567)
    return g.withColumns({c: F.round(c, 6) for c in g.columns if c.endswith("_avg")})


def _percentile(p: float) -> str:
    rank = f"({p / 100}::DOUBLE * n)"
    return f"CASE WHEN ceil({rank}) >= n THEN l[n] WHEN floor({rank}) = ceil({rank}) THEN l[CAST(floor({rank}) AS BIGINT) + 1] ELSE floor(l[CAST(floor({rank}) AS BIGINT) + 1] + ({rank} - floor({rank})) * (l[CAST(ceil({rank}) AS BIGINT) + 1] - l[CAST(floor({rank}) AS BIGINT) + 1]) + 0.5) END AS p{str(p).replace('.', '_')}"


@query("WITH g AS (SELECT event_type, list_sort(list(value)) AS l, count(*) AS n, avg(value) AS m FROM events GROUP BY ALL) SELECT event_type, " + ", ".join(map(_percentile, monitor.PERCENTS)) + ", round(m, 6) AS mean FROM g")
def latency_percentiles(spark, d):
    return monitor.latency_percentiles(td.events_ms(spark, d), ["event_type"], "value").withColumn("mean", F.round("mean", 6))


@query("WITH e AS (SELECT user_id % 10 AS name, (epoch_us(ts) // 1000) // 3600000 AS b, event_type FROM events), x AS (SELECT name, event_type, UNNEST(generate_series(b, b + 3)) AS b FROM e) SELECT name, b * 3600000 AS bucket_ms, count(*) FILTER (event_type = 'click') AS ok, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'view') AS timeout, count(*) FILTER (event_type = 'signup') AS reject FROM x GROUP BY ALL")
def call_stats(spark, d):
    kinds = F.create_map(*map(F.lit, ["click", "ok", "error", "error", "view", "timeout", "signup", "reject", "purchase", "other"]))
    e = td.events_ms(spark, d).withColumns({"name": F.col("user_id") % 10, "outcome": kinds[F.col("event_type")]})
    return monitor.call_stats(e, "name", "ts_ms", "outcome", 4, 3600000)


@query("SELECT user_id, event_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rank FROM events) WHERE rank <= 3")
def recent_posts(spark, d):
    e = td.table(spark, d, "events")
    return monitor.recent_posts(e, "user_id", [F.col("ts").desc(), F.col("event_id")]).select("user_id", "event_id", "rank")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the report of all organizations for a closed month."""
    configure(spark, sf_dir)
    return report.org_report(td.metered_orders(spark, sf_dir), T_CLOSED)


__all__ = ["ORACLE_SQL", "QUERIES", "entry"]


# ---- what is written and read again, and streams


def _documents(spark, d) -> DataFrame:
    return td.usage_from_orders(spark, d).withColumns({"start": F.col("start_ms"), "end": F.col("end_ms"), "region": F.lit(None).cast("string")})


@query(f"WITH {U} SELECT organization_id, space_id, consumer_id, plan_id, resource_instance_id, count(*) AS n, min(end_ms) AS first_ms, max(end_ms) AS last_ms, 3 * count(*) AS measures FROM u GROUP BY ALL")
def read_usage_json(spark, d):
    """Usage documents, stripped to their schema, written as JSON and read again without inference."""
    path = shared_path(spark, "documents")
    state.write_report(ev.strip_to_schema(_documents(spark, d)), path, "json", compression="gzip")
    got = readers.read_usage(spark, path)
    return got.groupBy("organization_id", "space_id", "consumer_id", "plan_id", "resource_instance_id").agg(F.count("*").alias("n"), F.min("end").alias("first_ms"), F.max("end").alias("last_ms"), F.sum(F.size("measured_usage")).cast("long").alias("measures"))


@query(f"WITH {MET}, {_acc()} SELECT organization_id, metric, dimension, bucket_ms, sum(quantity) AS quantity FROM a GROUP BY ALL")
def stored_catalog(spark, d):
    """Usage metered and accumulated by a catalog that was stored, read and judged."""
    path, c = shared_path(spark, "catalog"), td.catalog(spark, d)
    for n in ("metrics", "rating", "prices", "mappings", "accounts"):
        getattr(c, n).write.parquet(f"{path}/{n}")
    c = plans.load_catalog(spark, path)
    return acc.accumulate_by_plan(_metered_by(spark, d, c, together=True), c).groupBy("organization_id", "metric", "dimension", "bucket_ms").agg(acc.exact_sum(F.col("quantity")).alias("quantity"))


@query(f"WITH {U} SELECT organization_id, plan_id, count(*) AS n, sum(q) AS quantity FROM u WHERE end_ms BETWEEN {T_CLOSED} - 2000000000 AND {T_CLOSED} GROUP BY ALL")
def usage_table_range(spark, d):
    """Usage stored by month and bucket, and read for a range of time."""
    path = shared_path(spark, "usage")
    state.write_usage_table(td.usage_from_orders(spark, d), path, "end_ms", "resource_instance_id")
    t0, t1 = T_CLOSED - 2_000_000_000, T_CLOSED
    rows = in_months(spark.read.parquet(path).withColumn("yyyymm", F.col("yyyymm").cast("string")), t0, t1).where(F.col("end_ms").between(t0, t1))
    return rows.groupBy("organization_id", "plan_id").agg(F.count("*").alias("n"), F.sum(F.element_at("measured_usage", 3)["quantity"]).alias("quantity"))


_UPSERT_SQL = "SELECT o_custkey AS k, strftime(o_orderdate, '%Y') AS year, max(o_orderkey) AS version, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY ALL"


def _order_states(spark, d) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(F.col("o_custkey").alias("k"), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy").alias("year"), F.col("o_orderkey").alias("version"), F.col("o_totalprice").alias("price"))


@query(_UPSERT_SQL)
def upsert_state(spark, d):
    """States of three batches, one of them repeated: the greatest version of a key and year stays."""
    path, rows = shared_path(spark, "states"), _order_states(spark, d)
    for i in (0, 1, 2, 1):
        state.upsert_state(rows.where(F.col("version") % 3 == i), path, ["k", "year"], "version", "year")
    return spark.read.parquet(path).select("k", F.col("year").cast("string").alias("year"), "version", "price")


@query(_UPSERT_SQL)
def upsert_versions(spark, d):
    """The same into tables behind version files."""
    tables, rows = Tables(spark, shared_path(spark, "versions")), _order_states(spark, d)
    for i in (0, 1, 2, 1):
        tables.upsert(rows.where(F.col("version") % 3 == i), "orders", ["k"], "version", "year")
    v = tables.latest()
    years = [tables.read("orders", "k long, version long, price double", v, lambda p, part=part: p == part).withColumn("year", F.lit(part.split("=")[1])) for part in v.parts["orders"]]
    return reduce(DataFrame.unionByName, years).select("k", "year", "version", "price")


@query(f"WITH {U} SELECT organization_id, CASE WHEN l_linenumber % 2 = 0 THEN 'even' ELSE 'seventh' END AS error, count(*) AS n FROM u WHERE (l_linenumber % 2 = 0 OR l_linenumber = 7) AND arrival_ms BETWEEN {T_MID} - 2000000000 AND {T_MID} GROUP BY ALL")
def stored_errors(spark, d):
    """Rejected usage, stored by month and asked for by time."""
    reason = F.when(F.col("l_linenumber") % 2 == 0, "even").when(F.col("l_linenumber") == 7, "seventh")
    _, bad = usage.split_errors(td.usage_from_orders(spark, d), reason)
    path = shared_path(spark, "errors")
    state.write_errors(bad, path, "arrival_ms")
    told = readers.read_errors(spark.read.parquet(path).withColumn("yyyymm", F.col("yyyymm").cast("string")), "arrival_ms", T_MID - 2_000_000_000, T_MID)
    return told.groupBy("organization_id", "error").agg(F.count("*").alias("n"))


@query("SELECT user_id % 5 AS org, event_type, count(*) AS n, sum(event_id) AS ids FROM events WHERE epoch_us(ts) // 1000 > 1705000000000 OR (epoch_us(ts) // 1000 = 1705000000000 AND CAST(event_id AS VARCHAR) > '5') GROUP BY ALL")
def read_event_files(spark, d):
    """App events written as JSON and read after a (time, id) cursor."""
    e = td.events_ms(spark, d)
    path = shared_path(spark, "events")
    e.select(
        F.struct(F.col("event_id").cast("string").alias("guid"), F.col("ts_ms").alias("created_at")).alias("metadata"),
        F.struct(F.col("event_type").alias("state"), (F.col("user_id") % 5).cast("string").alias("org_guid"), F.lit("managed_service_instance").alias("service_instance_type"), F.col("event_type").alias("service_guid")).alias("entity"),
    ).write.json(path)
    got = readers.read_app_events(spark, path, (1705000000000, "5"))
    return got.groupBy(F.col("entity.org_guid").cast("long").alias("org"), F.col("entity.state").alias("event_type")).agg(F.count("*").alias("n"), F.sum(F.col("metadata.guid").cast("long")).alias("ids"))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('view', 'signup') GROUP BY ALL")
def read_service_files(spark, d):
    """Events of service instances, of the services asked for."""
    e = td.events_ms(spark, d)
    path = shared_path(spark, "services")
    twice = e.withColumn("kind", F.explode(F.array(F.lit("managed_service_instance"), F.lit("user_provided_service_instance"))))
    twice.select(F.struct(F.col("event_id").cast("string").alias("guid"), F.col("ts_ms").alias("created_at")).alias("metadata"), F.struct(F.col("kind").alias("service_instance_type"), F.col("event_type").alias("service_guid")).alias("entity")).write.json(path)
    return readers.read_service_events(spark, path, ["view", "signup"]).groupBy(F.col("entity.service_guid").alias("event_type")).agg(F.count("*").alias("n"))


@query(f"""WITH e AS (SELECT epoch_us(ts) // 1000 AS t, event_id FROM events)
SELECT event_id, t BETWEEN epoch_ms(epoch_ms({T_EVENTS}) - INTERVAL 2 MONTH) AND epoch_ms(epoch_ms({T_EVENTS}) + INTERVAL 2 MONTH) AS kept, t - t % 3600000 - 7200000 AS low_h, t - t % 3600000 - 3600000 AS high_h,
  epoch_ms(date_trunc('month', epoch_ms(t)) + INTERVAL 1 MONTH) AS low_m, epoch_ms(date_trunc('month', epoch_ms(t)) + INTERVAL 2 MONTH) AS high_m,
  CASE WHEN event_id % 3 = 0 THEN t - t % 86400000 + 86400000 WHEN event_id % 3 = 1 THEN least(t - t % 86400000 + 86400000, t + 50000000) ELSE greatest((t - 1) - (t - 1) % 86400000, t - 50000000) END AS next_end FROM e""")
def windows_of_events(spark, d):
    """Bounds of shifted windows, the slack of spans, and where the next interval ends."""
    t = F.col("ts_ms")
    low_h, high_h = bounds(t, "h", -2)
    low_m, high_m = bounds(t, "M", 1)
    end = F.when(F.col("event_id") % 3 == 1, t + 50_000_000).when(F.col("event_id") % 3 == 2, t - 50_000_000)
    return td.events_ms(spark, d).select("event_id", usage.span_slack(t, T_EVENTS).alias("kept"), low_h.alias("low_h"), high_h.alias("high_h"), low_m.alias("low_m"), high_m.alias("high_m"), spans.next_interval_end(t, end).alias("next_end"))


@query(f"""WITH {_asof(T_CLOSED)}, t AS (SELECT *, {_slot(T_CLOSED)} AS slot FROM tree WHERE bucket_ms <= {T_CLOSED} AND level = 'space')
SELECT organization_id, space_id, plan_id, metric, max(CASE WHEN dimension = 'D' AND slot = 0 THEN quantity END) AS today, max(CASE WHEN dimension = 'D' AND slot = 1 THEN quantity END) AS yesterday, max(CASE WHEN dimension = 'M' AND slot = 0 THEN quantity END) AS month FROM t GROUP BY ALL""")
def nested_windows(spark, d):
    """Windows as lists, the current one first."""
    r = report.nested_windows(report.org_report(td.metered_orders(spark, d), T_CLOSED).where("level = 'space'"))
    at = lambda i, j: F.col("windows")[i][j]["quantity"]
    return r.select("organization_id", "space_id", "plan_id", "metric", at(3, 0).alias("today"), at(3, 1).alias("yesterday"), at(4, 0).alias("month"))


@query("""WITH r AS (SELECT DISTINCT p_brand AS resource_type, p_type AS plan_name, p_size % 5 AS request_id, CASE WHEN p_size % 2 = 0 THEN 'metering' ELSE 'rating' END AS kind FROM part),
old AS (SELECT DISTINCT kind, resource_type, plan_name FROM r WHERE request_id < 2), new AS (SELECT * FROM r WHERE request_id >= 1),
told AS (SELECT new.*, old.kind IS NOT NULL AS there FROM new LEFT JOIN old ON new.kind = old.kind AND new.resource_type = old.resource_type AND new.plan_name = old.plan_name)
SELECT 'mapping' AS what, kind, resource_type, count(*) AS n FROM (SELECT kind, resource_type, plan_name FROM old UNION ALL SELECT kind, resource_type, plan_name FROM told WHERE NOT there) GROUP BY ALL
UNION ALL SELECT 'conflict', NULL, CAST(request_id AS VARCHAR), 1 FROM told GROUP BY request_id HAVING bool_and(there)""")
def merge_mappings(spark, d):
    """New mappings, and requests that are there already in full."""
    kind = F.when(F.col("p_size") % 2 == 0, "metering").otherwise("rating")
    r = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("resource_type"), F.col("p_type").alias("plan_name"), (F.col("p_size") % 5).alias("request_id"), kind.alias("kind")).distinct().withColumn("plan_id", F.lit("p"))
    on = ["kind", "resource_type", "plan_name", "plan_id"]
    merged, conflicts = plans.merge_mappings(r.where("request_id < 2").select(*on).distinct(), r.where("request_id >= 1"))
    told = merged.groupBy(F.lit("mapping").alias("what"), "kind", "resource_type").agg(F.count("*").alias("n"))
    return told.unionByName(conflicts.select(F.lit("conflict").alias("what"), F.lit(None).cast("string").alias("kind"), F.col("request_id").cast("string").alias("resource_type"), F.lit(1).cast("long").alias("n")))


#: Slack of the streamed documents, two weeks.
_SLACK = 1_209_600_000
#: Days of shipment folded into 59 from 1996-01-01 on: a stream has documents of one or two months at a time.
_FOLD_FROM = 820_454_400_000
_FOLDED = f"({_FOLD_FROM} + (epoch_ms(l_shipdate) // 86400000) % 59 * 86400000)"


@query(f"""WITH {U.replace("epoch_ms(l_shipdate)", _FOLDED)}, s AS (SELECT organization_id, space_id, coalesce(consumer_id, 'UNKNOWN') AS consumer_id, plan_id, resource_instance_id, end_ms, q, ln, arrival_ms AS arr, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM u
  UNION ALL SELECT organization_id, space_id, coalesce(consumer_id, 'UNKNOWN'), plan_id, resource_instance_id, end_ms, q, ln, arrival_ms + 86400000, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM u WHERE l_partkey % 9 = 0),
l AS (SELECT *, end_ms < epoch_ms(date_trunc('month', epoch_ms(arr))) AND arr > epoch_ms(date_trunc('month', epoch_ms(arr))) + {_SLACK} AS late FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY late, organization_id, space_id, consumer_id, plan_id, resource_instance_id, end_ms, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice ORDER BY arr) AS j FROM l)
SELECT organization_id, plan_id, 'heavy_api_calls' AS told, epoch_ms(date_trunc('month', epoch_ms(end_ms))) AS month_ms, count(*) AS n, sum(CAST(q AS DOUBLE)) AS quantity FROM r WHERE NOT late AND j = 1 GROUP BY ALL
UNION ALL SELECT organization_id, plan_id, CASE WHEN late THEN 'out of slack' ELSE 'duplicate' END, NULL, count(*), NULL FROM r WHERE late OR j > 1 GROUP BY ALL""")
def stream_usage(spark, d):
    """Documents and their repeats, streamed in three batches of arrivals: accumulated months, and rejects by reason."""
    c, path = td.catalog(spark, d), shared_path(spark, "stream")
    end = _FOLD_FROM + (F.floor(F.col("end_ms") / 86_400_000) % 59) * 86_400_000
    docs = _documents(spark, d).withColumns({"arrival_ms": F.col("arrival_ms") - F.col("end_ms") + end, "end_ms": end}).withColumns({c: F.col("end_ms") for c in ("start_ms", "start", "end")})
    docs = docs.withColumn("dedup_id", F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).select(*schemas.USAGE.names, "start_ms", "end_ms", "arrival_ms", "l_partkey")
    again = F.explode(F.when(F.col("l_partkey") % 9 == 0, F.array(F.lit(0), F.lit(86_400_000))).otherwise(F.array(F.lit(0))))
    docs = docs.withColumn("_later", again).withColumn("arrival_ms", F.col("arrival_ms") + F.col("_later")).drop("l_partkey", "_later")
    cuts = [_FOLD_FROM + 25 * 86_400_000, _FOLD_FROM + 55 * 86_400_000]
    docs = docs.withColumn("batch", sum((F.col("arrival_ms") > cut).cast("int") for cut in cuts))
    # Each file has an instance's documents side by side: they compress well, stored and shuffled.
    docs.sortWithinPartitions("batch", *schemas.INSTANCE, "end_ms", "arrival_ms").write.partitionBy("batch").parquet(f"{path}/all")
    # Each batch arrives as a whole, in as many files as its writers had, and is taken up by a run of the stream from where the last one ended.
    for i in range(len(cuts) + 1):
        if state.move_into(spark, f"{path}/all/batch={i}", f"{path}/in/{i}"):
            stream = spark.readStream.schema(docs.schema).option("recursiveFileLookup", "true").parquet(f"{path}/in")
            ingest_stream.ingest_stream(stream, c, f"{path}/out", f"{path}/checkpoint", _SLACK, behind="40 days").awaitTermination()
    months = ingest_stream.read_states(spark, f"{path}/out", c).where("metric = 'heavy_api_calls' AND dimension = 'M'")
    months = months.groupBy("organization_id", "plan_id", F.col("metric").alias("told"), F.col("bucket_ms").alias("month_ms")).agg(F.sum("n").alias("n"), acc.exact_sum(F.col("quantity")).alias("quantity"))
    rejects = Tables(spark, f"{path}/out").read("rejects", "organization_id string, plan_id string, error string")
    rejects = rejects.groupBy("organization_id", "plan_id", F.col("error").alias("told")).agg(F.count("*").alias("n"))
    return months.unionByName(rejects.select("organization_id", "plan_id", "told", F.lit(None).cast("long").alias("month_ms"), "n", F.lit(None).cast("double").alias("quantity")))
