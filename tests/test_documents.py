"""Typed documents, ids, nested reports, placement, and state of spans that ends."""

import json

import pytest
from pyspark.sql import functions as F

from test_metering import at, documents
from usagemill import schemas
from usagemill.functions.calendar import doc_id, id_keys, id_time
from usagemill.operators import accumulate as acc
from usagemill.operators import ingest, report, usage
from usagemill.operators.documents import document_errors
from usagemill.operators.meter import meter
from usagemill.plans.catalog import sample_catalog
from usagemill.sources import state
from usagemill.streaming import pipeline

GOOD = {"start": 1, "end": 2, "organization_id": "o", "space_id": "s", "resource_id": "r", "plan_id": "p", "resource_instance_id": "i", "measured_usage": [{"measure": "m", "quantity": 1.5}]}


@pytest.mark.parametrize(
    ("text", "errors"),
    [
        (GOOD, []), (GOOD | {"measured_usage": []}, []), (GOOD | {"dedup_id": None, "region": "eu"}, []), (None, ["document: expected object, got null"]), ("", ["document: expected object, got no JSON"]), ("{", ["document: expected object, got no JSON"]),
        ([GOOD], ["document: expected object, got array"]), (7, ["document: expected object, got number"]), ("null", ["document: expected object, got null"]),
        ({}, [f"{n}: required" for n in schemas.REQUIRED_USAGE]), (GOOD | {"start": "1", "end": None}, ["start: expected number, got string", "end: required"]),
        (GOOD | {"start": 1.5, "end": 2.0}, ["start: expected a whole number"]), (GOOD | {"plan_id": 5, "dedup_id": {"a": 1}}, ["dedup_id: expected string, got object", "plan_id: expected string, got number"]),
        (GOOD | {"zone": 1, "area": [2]}, ["area: unknown", "zone: unknown"]), (GOOD | {"measured_usage": {"measure": "m"}}, ["measured_usage: expected array, got object"]),
        (GOOD | {"measured_usage": [{"measure": "m"}, {"measure": None, "quantity": "x", "unit": "GB"}, None, [1], {"measure": True, "quantity": 1e300}]},
         ["measured_usage[0].quantity: required", "measured_usage[1].measure: required", "measured_usage[1].quantity: expected number, got string", "measured_usage[1].unit: unknown", "measured_usage[3]: expected object, got array", "measured_usage[4].measure: expected string, got boolean"]),
    ],
)
def test_every_error_is_told_with_its_path(spark, text, errors):
    raw = text if text is None or isinstance(text, str) else json.dumps(text)
    df = spark.createDataFrame([(raw,)], "raw string")
    assert df.select(document_errors(F.col("raw")).alias("e")).first()["e"] == errors


def test_ingest_tells_what_json_does_not_fit(spark):
    catalog = sample_catalog(spark)
    df = documents(spark, [(at(1), at(1), str(i), {"storage": 1}, at(1) + i) for i in range(2)]).withColumn("raw", F.when(F.col("dedup_id") == "1", F.lit('{"start": "x"}')).otherwise(F.lit(json.dumps(GOOD))))
    told = ingest.metered_usage(df, catalog, at(2), [F.col("arrival_ms")], raw="raw").select("dedup_id", "error").distinct().collect()
    by = {r.dedup_id: r.error for r in told}
    assert by["0"] == "no account" and by["1"].startswith("start: expected number, got string, end: required, ")


def test_ids_are_taken_apart(spark):
    df = spark.createDataFrame([(1535760000000, "o", "i/x")], "t long, a string, b string")
    r = df.select(doc_id(F.col("t"), F.col("a"), F.col("b")).alias("id")).select(id_time(F.col("id")).alias("t"), id_keys(F.col("id")).alias("k")).first()
    assert (r.t, r.k) == (1535760000000, ["o", "i", "x"])
    odd = spark.createDataFrame([("k/o/i/t/0001535760000000",), ("t/12",), ("nothing",), ("",), (None,)], "id string").select(id_time(F.col("id")).alias("t"), id_keys(F.col("id")).alias("k")).collect()
    assert [(r.t, r.k) for r in odd] == [(1535760000000, ["o", "i"]), (12, []), (None, []), (None, []), (None, None)]


def some_report(spark):
    c = sample_catalog(spark)
    df = documents(spark, [(at(1), at(1), str(i), {"storage": (1 + i) << 30, "heavy_api_calls": i}, at(1) + i) for i in range(12)])
    df = df.withColumns({"space_id": F.concat(F.lit("s"), (F.col("dedup_id") % 2).cast("int").cast("string")), "consumer_id": F.concat(F.lit("c"), (F.col("dedup_id") % 3).cast("int").cast("string")), "plan_id": F.when(F.col("dedup_id") % 4 == 0, "standard").otherwise("basic")})
    rows = meter(usage.normalize(df, c), c).withColumn("billing_ms", F.col("arrival_ms"))
    return report.org_report(rows, at(2))


def test_the_tree_is_nested_as_selected(spark):
    r = some_report(spark)
    whole = report.nested_report(r).collect()
    assert len(whole) == 1 and [s.space_id for s in whole[0].spaces] == ["s0", "s1"]
    assert [[c.consumer_id for c in s.consumers] for s in whole[0].spaces] == [["c0", "c1", "c2"]] * 2
    calls = lambda us: sum(u.quantity for u in us if u.metric == "heavy_api_calls" and u.dimension == "M")
    node = lambda n: sum(calls(x.usage) for x in n.resources)
    assert node(whole[0]) == 66 == sum(node(s) for s in whole[0].spaces) == sum(node(c) for s in whole[0].spaces for c in s.consumers)
    assert {p.plan_id: calls(p.usage) for x in whole[0].resources for p in x.plans} == {"basic": 54, "standard": 12}
    top = report.nested_report(r, {"resources": {}})
    assert top.columns == ["organization_id", "resources"] and [x.plans for x in top.first().resources] == [[]]
    two = report.nested_report(r, {"resources": {"plans": {}}, "spaces": {"resources": {}}}).first()
    assert [len(s) for s in two.spaces] == [2, 2] and two.resources[0].plans and not two.spaces[0].resources[0].plans
    assert report.nested_report(r.where("false")).count() == 0
    with pytest.raises(ValueError, match="no such level"):
        report.nested_report(r, {"rooms": {}})


def test_partial_reports_are_flagged(spark):
    r = some_report(spark)
    refs = spark.createDataFrame([("o", "a"), ("o", "b")], "organization_id string, snapshot string")
    flag = lambda there: {x.is_partial for x in report.flag_partial(r, refs, spark.createDataFrame(there, "snapshot string"), ["snapshot"]).collect()}
    assert flag([("a",), ("b",)]) == {False} and flag([("a",)]) == {True}
    assert {x.is_partial for x in report.flag_partial(r, refs.where("false"), refs.select("snapshot"), ["snapshot"]).collect()} == {False}


def test_placed_tables_need_no_shuffle(spark, tmp_path):
    c = sample_catalog(spark)
    df = documents(spark, [(at(1 + i % 5), at(1 + i % 5), str(i % 7), {"storage": 1 << 30}, at(9) + i) for i in range(60)]).withColumn("resource_instance_id", F.concat(F.lit("i"), (F.col("arrival_ms") % 6).cast("string")))
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    spark.sql("DROP TABLE IF EXISTS placed_usage")
    state.write_bucketed_table(df, "placed_usage", "resource_instance_id", 4)
    try:
        once = usage.dedup_usage(spark.table("placed_usage"), [F.col("arrival_ms")])
        assert "Exchange hash" not in plan(once) and "Exchange hash" in plan(usage.dedup_usage(df, [F.col("arrival_ms")]))
        rows = meter(usage.normalize(once, c), c)
        placed = acc.accumulate(rows)
        assert "Exchange hash" not in plan(placed)
        want = acc.accumulate(meter(usage.normalize(usage.dedup_usage(df, [F.col("arrival_ms")]), c), c))
        assert sorted(map(repr, placed.collect())) == sorted(map(repr, want.collect()))
        latest = spark.table("placed_usage").groupBy("resource_instance_id").agg(F.max("arrival_ms").alias("m"))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert "Exchange hash" not in plan(spark.table("placed_usage").join(latest, "resource_instance_id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS placed_usage")


def test_targets_that_are_stopped_leave_no_state(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "target string, kind string, timestamp long, seq long, note string"
    batches = [[("a", "start", 1, 1, "x"), ("b", "start", 2, 2, "x"), ("c", "start", 3, 3, "x")], [("a", "stop", 5, 5, "x"), ("b", "stop", 6, 6, "x"), ("b", "start", 6, 7, "x")], [("b", "stop", 9, 9, "x"), ("c", "stop", 9, 10, "x")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/src/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/src")
    q = pipeline.pair_spans(stream).writeStream.format("memory").queryName("ended").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["numInputRows"]]
    assert held == [3, 2, 0] and spark.table("ended").where("reason IS NULL").count() == 4


def test_a_document_is_parsed_once(spark):
    """However many fields it has: a branch of a CASE that names the parsed text again would parse it again."""
    told = spark.createDataFrame([("{}",)], "raw string").select(document_errors(F.col("raw")).alias("e"))
    plan = told._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("parse_json") + plan.count("parsejson") == 1
