"""What plans may say, and their own folds."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from test_metering import at, documents
from usagemill import schemas
from usagemill.operators import accumulate as acc
from usagemill.operators import report, usage
from usagemill.operators.folds import fold_of
from usagemill.operators.meter import meter
from usagemill.plans import sandbox
from usagemill.plans.catalog import load_catalog, sample_catalog

MEAN = "zero: named_struct('total', 0D, 'n', 0L); step: (a, x) -> named_struct('total', a.total + x.value, 'n', a.n + 1); merge: (a, b) -> named_struct('total', a.total + b.total, 'n', a.n + b.n); finish: a -> a.total / a.n"


@pytest.fixture(scope="module")
def catalog(spark):
    return sample_catalog(spark)


def with_fold(catalog, fold, metric="heavy_api_calls"):
    return replace(catalog, metrics=catalog.metrics.withColumn("accumulate", F.when(F.col("metric") == metric, fold).otherwise(F.col("accumulate"))))


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        ("java_method('java.lang.System', 'exit', 1)", "function not allowed: java_method"), ("reflect('java.lang.Math', 'random')", "function not allowed: reflect"),
        ("`java_method`('a', 'b')", "function not allowed: java_method"), ("spark_catalog.default.abs(1)", "function not allowed: spark_catalog.default.abs"), ("my_udf(m)", "function not allowed: my_udf"),
        ("(SELECT 1)", "subquery"), ("start_ms IN (SELECT 1)", "subquery"), ("EXISTS (SELECT 1)", "subquery"), ("if(exists(select 1), 1, (select 2))", "subquery"),
        ("current_user", "unknown name: current_user"), ("input_file_name()", "function not allowed: input_file_name"), ("end_mss + 1", "unknown name: end_mss"),
        ("sum(start_ms) OVER (PARTITION BY end_ms)", "not allowed: WindowExpression"), ("*", "not allowed: UnresolvedStar"), ("start_ms AS x", "not allowed: Alias"),
        ("identifier('start_ms')", "not allowed: ExpressionWithUnresolvedIdentifier"), ("raise_error('x')", "function not allowed: raise_error"), ("sequence(1, 1000000000)", "function not allowed: sequence"),
        ("repeat('a', 1000000000)", "function not allowed: repeat"), ("1 + ", "syntax"), ("1; DROP TABLE x", "syntax"), ("abs(DISTINCT start_ms)", "function not allowed: abs"), ("1" + " + 1" * 5000, "too long"),
        ("m.storage + start_ms / 2", None), ("coalesce(m['a'], 0) * 2 - CASE WHEN end_ms > 1 THEN 1 ELSE -1 END", None), ("cast(null as double)", None), ("named_struct('consuming', 1D).consuming", None),
        ("start_ms + named_struct('a', 1)", "does not fit: DATATYPE_MISMATCH.BINARY_OP_DIFF_TYPES"), ("start_ms.x", "does not fit: INVALID_EXTRACT_BASE_FIELD_TYPE"),
    ],
)
def test_expressions_are_judged(spark, text, reason):
    assert sandbox.judged(text, "meter") == reason


def test_each_function_sees_its_own_names(spark):
    assert sandbox.judged("price * quantity", "rate") is None and sandbox.judged("price * quantity", "summarize") == "unknown name: price"
    assert sandbox.judged("m['a']", "charge") == "unknown name: m" and sandbox.judged("cost + t - from_ms", "charge") is None


@pytest.mark.parametrize(
    ("fold", "reason"),
    [
        ("sum", None), ("(a, x) -> coalesce(a, 0D) + x.value", None), (MEAN, None), ("median", "no such fold: median"), ("(a, x) -> a + x.nothing", "does not fit: FIELD_NOT_FOUND"),
        ("(a, x) -> java_method('a', 'b')", "function not allowed: java_method"), (MEAN.replace("a.total / a.n", "reflect('a', 'b')"), "function not allowed: reflect"),
        (MEAN.replace("x.value", "x.month"), "cells depend on order"), (MEAN.replace("named_struct('total', a.total + b.total, 'n', a.n + b.n)", "a.n + b.n"), "does not fit: DATATYPE_MISMATCH.UNEXPECTED_INPUT_TYPE"), ("zero: 0D; step: (a, x) -> a", "no such fold: zero: 0D; step: (a, x) -> a"),
    ],
)
def test_folds_are_judged(spark, fold, reason):
    assert sandbox.judged(fold, "accumulate") == reason


def test_a_catalog_tells_all_its_rejects_and_is_not_loaded(spark, catalog, tmp_path):
    bad = replace(
        catalog, metrics=catalog.metrics.withColumn("meter", F.when((F.col("plan_id") == "basic-object-storage") & (F.col("metric") == "storage"), "length(java_method('java.lang.System','getProperty','user.home'))").otherwise(F.col("meter"))),
        rating=catalog.rating.withColumn("charge", F.when(F.col("plan_id") == "object-rating-plan", "nobody + cost").otherwise(F.col("charge"))),
    )
    told = {(r.plan_id, r.metric, r.kind, r.reason) for r in bad.rejects().collect()}
    assert told == {("basic-object-storage", "storage", "meter", "function not allowed: java_method"), *(("object-rating-plan", m, "charge", "unknown name: nobody") for m in ("storage", "thousand_light_api_calls", "heavy_api_calls"))}
    for n in ("metrics", "rating", "prices", "mappings", "accounts"):
        getattr(bad, n).write.parquet(f"{tmp_path}/{n}")
    with pytest.raises(ValueError, match="basic-object-storage storage meter: function not allowed: java_method"):
        load_catalog(spark, str(tmp_path))
    assert catalog.checked() is catalog
    # Even a catalog that nobody checked does not run them.
    with pytest.raises(ValueError, match="java_method"):
        meter(usage.normalize(documents(spark, [(at(1), at(1), None, {"storage": 1}, at(1))]), bad), bad)


def test_names_of_metrics_are_no_code(spark, catalog):
    odd = replace(catalog, metrics=spark.createDataFrame([("basic-object-storage", "it's '] or \\", *[None] * 7)], schemas.METERING_METRICS))
    rows = meter(usage.normalize(documents(spark, [(at(1), at(1), None, {"it's '] or \\": 7}, at(1))]), odd), odd)
    assert [r.value for r in rows.collect()] == [7.0]


def metered(spark, catalog, rows):
    return meter(usage.normalize(documents(spark, rows), catalog), catalog)


def test_batches_of_a_mergeable_fold_add_up_to_one(spark, catalog):
    c = with_fold(catalog, MEAN)
    rows = metered(spark, c, [(at(1 + i % 3), at(1 + i % 3), str(i), {"heavy_api_calls": i * i}, at(9) + i) for i in range(60)])
    whole = acc.accumulate_by_plan(rows, c)
    parts = [acc.accumulate_by_plan(rows.where(F.col("arrival_ms") % 3 == i), c, mergeable=True) for i in range(3)]
    merged = acc.merge_accumulated(parts[0].unionByName(parts[1]).unionByName(parts[2]), catalog=c)
    cells = lambda df: sorted((r.metric, r.dimension, r.bucket_ms, r.n, r.quantity) for r in df.collect())
    assert cells(whole) == cells(merged)
    day = {r.bucket_ms: (r.quantity, r.n) for r in whole.where("metric = 'heavy_api_calls' AND dimension = 'D'").collect()}
    assert day == {at(1 + k): (sum(i * i for i in range(k, 60, 3)) / 20, 20) for k in range(3)}
    assert {r.latest_ms for r in merged.where("metric = 'heavy_api_calls' AND dimension = 'M'").collect()} == {at(9) + 59}
    # States of states merge again.
    again = acc.merge_accumulated(acc.merge_accumulated(parts[0].unionByName(parts[1]), catalog=c).unionByName(parts[2]), catalog=c)
    assert cells(again) == cells(whole)


def test_long_windows_of_a_mergeable_fold_have_no_rounds(spark, catalog, monkeypatch):
    from usagemill.operators import folds

    monkeypatch.setattr(folds, "MAX_PACK", 1_000)
    c = with_fold(catalog, MEAN)
    one = metered(spark, c, [(at(1), at(1), None, {"heavy_api_calls": 1}, at(1))]).where("metric = 'heavy_api_calls'")
    rows = one.crossJoin(spark.range(0, 200_000, numPartitions=4).withColumnRenamed("id", "_i")).withColumn("value", F.col("_i").cast("double"))
    assert {(r.n, r.quantity) for r in acc.accumulate_by_plan(rows, c).collect()} == {(200_000, 99_999.5)}


def test_a_step_that_gives_null_skips(spark, catalog):
    for fold in ("(a, x) -> if(x.value > 2, coalesce(a, 0D) + x.value, null)", "zero: 0D; step: (a, x) -> if(x.value > 2, a + x.value, null); merge: (a, b) -> a + b"):
        c = with_fold(catalog, fold)
        rows = metered(spark, c, [(at(1), at(1), str(i), {"heavy_api_calls": i}, at(1) + i) for i in range(5)])
        assert {r.quantity for r in acc.accumulate_by_plan(rows, c).where("metric = 'heavy_api_calls'").collect()} == {7.0}


def test_ordered_folds_do_not_merge(spark, catalog):
    c = with_fold(catalog, "(a, x) -> x.value")
    rows = metered(spark, c, [(at(1), at(1), None, {"heavy_api_calls": 1}, at(1))])
    with pytest.raises(ValueError, match="can't be merged"):
        acc.merge_accumulated(acc.accumulate_by_plan(rows, c, mergeable=True), catalog=c)
    assert not fold_of("(a, x) -> x.value").mergeable and fold_of(MEAN).mergeable


def test_reports_follow_plan_folds(spark, catalog):
    c = with_fold(catalog, MEAN)
    c = replace(c, accounts=spark.createDataFrame([("acc", ["o"], "USA", "")], schemas.ACCOUNTS))
    rows = metered(spark, c, [(at(1), at(1), str(i), {"heavy_api_calls": i}, at(1) + i) for i in range(5)]).withColumn("billing_ms", F.col("arrival_ms"))
    for r in (report.account_report(rows, c.accounts, "acc", at(2), c), report.instance_report(rows, {"resource_instance_id": "i"}, at(2), c)):
        assert {x.summary for x in r.where("metric = 'heavy_api_calls'").collect()} == {2.0}


def test_an_aggregate_may_be_a_fold(spark, catalog):
    """The product of the instances' quantities, on every level."""
    product = "zero: 1D; step: (a, x) -> a * x.value; merge: (a, b) -> a * b"
    c = replace(catalog, metrics=catalog.metrics.withColumn("aggregate", F.when(F.col("metric") == "heavy_api_calls", product)))
    rows = documents(spark, [(at(1), at(1), str(i), {"heavy_api_calls": i, "storage": i << 30}, at(1) + i) for i in (2, 3, 5)])
    rows = rows.withColumns({"resource_instance_id": F.col("dedup_id"), "space_id": F.when(F.col("dedup_id") == "5", "t").otherwise("s")})
    tree = acc.aggregate_tree(acc.accumulate_by_plan(meter(usage.normalize(rows, c), c), c, mergeable=True), c).where("dimension = 'M'").collect()
    assert {(r.level, r.space_id): r.quantity for r in tree if r.metric == "heavy_api_calls" and r.level != "consumer"} == {("org", None): 30, ("space", "s"): 6, ("space", "t"): 5}
    assert {r.quantity for r in tree if r.metric == "storage" and r.level == "org"} == {10}
    assert sandbox.judged(product, "aggregate") is None and sandbox.judged("last", "aggregate") is None
    assert sandbox.judged("(a, x) -> a", "aggregate") == "no such aggregate: (a, x) -> a" and sandbox.judged("median", "aggregate") == "no such aggregate: median"
    bad = replace(catalog, metrics=catalog.metrics.withColumn("aggregate", F.lit("median")))
    with pytest.raises(ValueError, match="no such aggregate"):
        acc.aggregate_tree(acc.accumulate(meter(usage.normalize(rows, c), c), mergeable=True), bad)


def test_resources_are_rolled_up_from_instances_or_from_the_tree(spark, catalog):
    rows = documents(spark, [(at(1 + i % 3), at(1 + i % 3), str(i), {"heavy_api_calls": i, "storage": i << 30}, at(9) + i) for i in range(30)])
    rows = rows.withColumns({"plan_id": F.when(F.col("dedup_id") % 2 == 0, "standard").otherwise("basic"), "space_id": F.concat(F.lit("s"), (F.col("dedup_id") % 3).cast("int").cast("string")), "resource_instance_id": F.col("dedup_id")})
    states = acc.accumulate(meter(usage.normalize(rows, catalog), catalog))
    told = lambda df: sorted(repr(tuple(r[c] for c in ("level", "organization_id", "space_id", "consumer_id", "resource_id", "metric", "dimension", "bucket_ms", "quantity"))) for r in df.collect())
    assert told(acc.resource_tree(states)) == told(acc.rollup_resource(acc.aggregate_tree(states)))
    c = with_fold(catalog, "avg")
    mean = acc.accumulate(meter(usage.normalize(rows, c), c))
    with pytest.raises(Exception, match="rolled up from its tree"):
        acc.resource_tree(mean).collect()
    assert acc.rollup_resource(acc.aggregate_tree(mean)).count() > 0


def test_large_counts_add_up(spark):
    """2 * 10^8 numbers near 10^11 pass 64 bits."""
    from usagemill.operators.accumulate import exact_sum

    df = spark.range(0, 2_000, numPartitions=4).select(F.lit(9.5e10 + 0.25).alias("x"))
    assert df.agg(exact_sum(F.col("x")).alias("s")).first()["s"] == 2_000 * (9.5e10 + 0.25)
    high = spark.range(1).select(F.lit(95_000 * 200_000_000).alias("high"), F.lit(0).alias("low"), F.lit(0).alias("parts"), F.lit(None).cast("double").alias("far"))
    assert high.select(acc.number_of({c: F.col(c) for c in high.columns}).alias("s")).first()["s"] == 1.9e19
    negative = spark.createDataFrame([(-1_500_000.5,), (2_500_000.25,), (-0.75,)], "x double")
    assert negative.agg(exact_sum(F.col("x")).alias("s")).first()["s"] == 999_999.0


def test_documents_without_ids_do_not_meet_in_one_task(spark, catalog):
    rows = documents(spark, [(at(1), at(1), None, {"storage": i}, at(1) + i) for i in range(40)]).withColumn("organization_id", F.lit(None).cast("string"))
    checked = usage.check_usage(rows, catalog, at(2), [F.col("arrival_ms")])
    assert {r.error for r in checked.collect()} == {"organization_id: required"}
    plan = checked._jdf.queryExecution().executedPlan().toString()
    assert "xxhash64" in plan
