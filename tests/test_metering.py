"""Golden cases, ordered folds, and streams against batches."""

import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usagemill import schemas
from usagemill.functions.calendar import MS, slack_ms
from usagemill.operators import accumulate as acc
from usagemill.operators import events as ev
from usagemill.operators import report, spans, usage
from usagemill.operators.meter import meter
from usagemill.plans.catalog import merge_mappings, merge_plans, sample_catalog
from usagemill.sources import readers, state
from usagemill.streaming import pipeline


def at(day, hour=0, month=8):
    return int(datetime(2018, month, day, hour, tzinfo=UTC).timestamp() * 1000)


IDS = ("o", "s", "c", "object-storage", "basic", "i")


def documents(spark, rows):
    """(start, end, dedup_id, measures, arrival)."""
    data = [(s, e, d, None, *IDS, [(k, float(v)) for k, v in m.items()], a) for s, e, d, m, a in rows]
    df = spark.createDataFrame(data, T.StructType([*schemas.USAGE.fields, T.StructField("arrival_ms", T.LongType())]))
    return df.withColumns({"start_ms": F.col("start"), "end_ms": F.col("end")})


@pytest.fixture(scope="module")
def catalog(spark):
    return sample_catalog(spark)


def test_three_documents_give_the_known_report(spark, catalog):
    m = {"storage": 1073741824, "light_api_calls": 1000, "heavy_api_calls": 100}
    t = at(15)
    rows = meter(usage.normalize(documents(spark, [(t + i, t + i, None, m, t + i) for i in range(3)]), catalog), catalog)
    r = report.org_report(rows.withColumn("billing_ms", F.col("arrival_ms")), t + 1000).where("dimension = 'M' AND slot = 0")
    got = {(x.level, x.metric): x.summary for x in r.collect()}
    for level in ("org", "space", "consumer"):
        assert [got[level, n] for n in ("storage", "thousand_light_api_calls", "heavy_api_calls")] == [1, 3, 300]


@pytest.mark.parametrize(("first", "second", "n"), [(None, None, 1), (None, "x", 2), ("x", "x", 1), ("x", "y", 2), (None, "", 2)])
def test_dedup_matrix(spark, first, second, n):
    t = at(1)
    df = documents(spark, [(t, t, first, {"storage": 1}, t), (t, t, second, {"storage": 1}, t + 1)])
    assert usage.dedup_usage(df, [F.col("arrival_ms")]).count() == n


CASES = [
    ((20, 8), None, (21, 0)), ((20, 0), None, (21, 0)), ((20, 8), (20, 8), (20, 8)), ((21, 6), (21, 11), (21, 11)), ((21, 0), (21, 11), (21, 11)),
    ((21, 6), (22, 8), (22, 0)), ((21, 0), (22, 8), (22, 0)), ((21, 6), (22, 0), (22, 0)), ((21, 0), (22, 0), (22, 0)), ((21, 6), (23, 8), (22, 0)),
    ((21, 16), (21, 5), (21, 5)), ((22, 0), (21, 5), (21, 5)), ((21, 13), (20, 18), (21, 0)), ((22, 0), (20, 18), (21, 0)), ((21, 13), (21, 0), (21, 0)),
    ((22, 0), (21, 0), (21, 0)), ((22, 13), (20, 18), (22, 0)),
]


def test_interval_cases(spark):
    df = spark.createDataFrame([(at(*a), at(*b) if b else None, at(*c)) for a, b, c in CASES], "a long, b long, c long")
    assert df.where(spans.next_interval_end(F.col("a"), F.col("b")) != F.col("c")).count() == 0


def test_samples_follow_the_interval_rule(spark):
    rng = random.Random(3)
    rows = [(i, at(10) + rng.randrange(6 * MS["D"]), None if i % 5 == 0 else at(10) + rng.choice([0, rng.randrange(6 * MS["D"])])) for i in range(200)]
    now = at(15, 5)
    got = {}
    for r in spans.sample_spans(spark.createDataFrame(rows, "id long, start_ms long, end_ms long"), now).orderBy("id", "n").collect():
        got.setdefault(r.id, []).append((r.from_ms, r.until_ms))

    def step(last, end):
        up = last - last % MS["D"] + MS["D"]
        down = (last - 1) - (last - 1) % MS["D"]
        return up if end is None else min(up, end) if end >= last else max(down, end)

    for i, s, e in rows:
        want, last = [], s
        if e is None:
            while last < now - MS["D"]:
                want.append((last, step(last, None)))
                last = want[-1][1]
        else:
            while not want or last != e:
                want.append((last, step(last, e)))
                last = want[-1][1]
        assert got.get(i, []) == want


def test_lateness(spark):
    df = spark.createDataFrame([(at(31, 23, 7), at(1, 0, 8) + 600_000, False), (at(31, 23, 7), at(1, 0, 8) + 600_001, True), (at(1), at(20), False)], "e long, now long, late boolean")
    assert df.where(usage.reject_out_of_slack(F.col("e"), F.col("now")) != F.col("late")).count() == 0
    assert [slack_ms(x) for x in ("10m", "2D", "1M", "x", None)] == [600_000, 2 * MS["D"], 31 * MS["D"], 600_000, 600_000]
    assert df.select(usage.reject_future(F.lit(at(2)), F.lit(at(1, 23)))).first()[0] is True


def test_folds_equal_the_batch(spark, catalog):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        t = at(1) + rng.randrange(20 * MS["D"])
        rows.append((t, t, None, {"current_instance_memory": rng.randrange(4) << 30, "current_running_instances": rng.randrange(3), "previous_instance_memory": rng.randrange(4) << 30, "previous_running_instances": rng.randrange(3), "storage": rng.randrange(9) << 30}, at(25) + i))
    df = documents(spark, rows).withColumn("resource_id", F.lit("test-resource"))
    got = {(r.metric, r.dimension, r.bucket_ms): r for r in acc.accumulate(meter(usage.normalize(df, catalog), catalog)).collect()}
    month = {}
    peak = 0.0
    for t, _, _, m, _ in rows:
        c = (m["current_instance_memory"] >> 30) * m["current_running_instances"]
        p = -(m["previous_instance_memory"] >> 30) * m["previous_running_instances"]
        td = at(1) + at(1, 0, 9) - 2 * t
        keep = month and month["since"] > t
        month = {"consuming": month["consuming"] if keep else c, "consumed": (month["consumed"] if month else 0) + (c + p) * td, "since": month["since"] if keep else t}
        peak = max(peak, m["storage"] >> 30)
    r = got["memory", "M", at(1)]
    assert (r.consuming, r.consumed, r.since_ms) == (month["consuming"], month["consumed"], month["since"])
    assert got["storage", "M", at(1)].quantity == peak


def test_spans_out_of_order_keep_the_span_open(spark):
    e = spark.createDataFrame([("a", 1, 10, "start"), ("a", 2, 5, "stop"), ("a", 3, 20, "start"), ("a", 4, 30, "stop"), ("a", 5, 40, "stop"), ("a", 6, 50, "start")], "target string, seq long, timestamp long, kind string")
    got = spans.build_spans_by_fold(e, ["target"], "seq").orderBy("start_ms").collect()
    assert [(r.start_ms, r.end_ms) for r in got] == [(10, 30), (50, None)]
    assert (got[0].conflicts, got[0].missing, got[0].disordered) == (1, 1, 1)


def test_validation(spark):
    df = spark.createDataFrame([('{"start":1,"more":2}', 1)], "raw string, start long").select("*", *(F.lit(None).cast(schemas.USAGE[c].dataType).alias(c) for c in schemas.USAGE.names if c != "start"))
    errors = usage.validate_usage(df, "raw").first().errors
    assert "more: unknown" in errors and "end: required" in errors and "start: required" not in errors


def test_catalog_merges(spark):
    plans_ = spark.createDataFrame([("a", 1), ("b", 2)], "plan_id string, v int")
    new, rejects = merge_plans(plans_, spark.createDataFrame([("insert", "a", 9), ("insert", "c", 3), ("update", "b", 7), ("update", "z", 8)], "op string, plan_id string, v int"))
    assert {(r.plan_id, r.v) for r in new.collect()} == {("a", 1), ("b", 7), ("c", 3)}
    assert {r.reason for r in rejects.collect()} == {"conflict", "unknown plan"}
    have = spark.createDataFrame([(k, "r", "p", "x") for k in ("metering", "rating", "pricing")], schemas.MAPPINGS)
    ask = spark.createDataFrame([(1, k, "r", "p", "x") for k in ("metering", "rating", "pricing")] + [(2, "metering", "r", "p", "x"), (2, "rating", "r", "q", "x")], "request_id int, kind string, resource_type string, plan_name string, plan_id string")
    merged, conflicts = merge_mappings(have, ask)
    assert merged.count() == 4 and [r.request_id for r in conflicts.collect()] == [1]


def test_state_tables(spark, tmp_path):
    p = str(tmp_path / "t")
    new = lambda rows: spark.createDataFrame(rows, "k string, v int, yyyymm string")
    for rows in ([("a", 1, "201801"), ("b", 5, "201802")], [("a", 3, "201801"), ("a", 2, "201801"), ("c", 1, "201802")]):
        for _ in range(2):
            state.upsert_state(new(rows), p, ["k"], "v", "yyyymm")
    assert {(r.k, r.v) for r in spark.read.parquet(p).collect()} == {("a", 3), ("b", 5), ("c", 1)}
    assert state.apply_retention(spark, p, at(15, 0, 5), 2) == ["201801", "201802"]
    df = spark.createDataFrame([("a", 1), ("a", 5), ("b", 3)], "k string, ts long")
    assert [r.ts for r in readers.read_range(df, "k", "a", "ts", 0, 9).collect()] == [5, 1]
    with pytest.raises(ValueError):
        readers.read_errors(df, "ts", 0, readers.MAX_ERROR_RANGE + 1)
    state.write_usage_table(df.withColumn("ts", F.col("ts") + at(1)), str(tmp_path / "u"), "ts", "k", 4)
    assert spark.read.parquet(str(tmp_path / "u")).count() == 3


def test_readers(spark, tmp_path):
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "a.json").write_text('{"start":1,"end":2,"organization_id":"o","measured_usage":[{"measure":"m","quantity":3}]}\n')
    assert readers.read_usage(spark, str(tmp_path / "u")).first().measured_usage[0].quantity == 3
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "a.json").write_text('{"metadata":{"guid":"a","created_at":5},"entity":{"state":"STARTED"}}\n{"metadata":{"guid":"b","created_at":5},"entity":{"state":"STOPPED"}}\n')
    got = readers.read_app_events(spark, str(tmp_path / "a"), (5, "a"))
    assert [r.metadata.guid for r in got.collect()] == ["b"]
    assert ev.flat_app_events(got).first().state == "STOPPED"


def test_nested_view(spark, catalog):
    t = at(15)
    rows = meter(usage.normalize(documents(spark, [(t, t, None, {"heavy_api_calls": 2}, t)]), catalog), catalog).withColumn("billing_ms", F.col("arrival_ms"))
    w = report.nested_windows(report.org_report(rows, t + 1).where("metric = 'heavy_api_calls' AND level = 'org'")).first().windows
    assert [len(x) for x in w] == [1, 1, 1, 2, 2] and w[3][0].quantity == 2 and w[3][1] is None and w[4][0].summary == 2


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "src"
    rows = [("a", "start", 10, 1), ("a", "stop", 20, 2), ("b", "stop", 5, 3), ("a", "start", 30, 4), ("b", "start", 6, 5), ("a", "stop", 25, 6), ("b", "stop", 9, 7)]
    for i in (0, 4):
        spark.createDataFrame(rows[i : i + 4] if i == 0 else rows[4:], "target string, kind string, timestamp long, seq long").coalesce(1).write.mode("append").parquet(str(src))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema("target string, kind string, timestamp long, seq long").option("maxFilesPerTrigger", 1).parquet(str(src))

    def process(batch):
        return batch.select(F.concat("target", F.col("seq").cast("string")).alias("k"), F.col("seq").cast("int").alias("v"), F.lit("201801").alias("m"))

    q = pipeline.run_batches(stream, process, str(tmp_path / "out"), str(tmp_path / "cp"), ["k"], "v", "m")
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


def run_to_memory(spark, df, name, tmp_path, mode):
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
    return spark.table(name).collect()


def test_streamed_spans_equal_the_fold(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("a", "start", 10, 1), ("a", "stop", 20, 2), ("b", "stop", 5, 3), ("a", "start", 30, 4), ("b", "start", 6, 5), ("a", "stop", 25, 6), ("b", "stop", 9, 7)]
    schema = "target string, kind string, timestamp long, seq long"
    batch = spark.createDataFrame(rows, schema)
    batch.coalesce(1).write.parquet(str(tmp_path / "src"))
    got = run_to_memory(spark, pipeline.pair_spans(spark.readStream.schema(schema).parquet(str(tmp_path / "src"))), "paired", tmp_path, "append")
    closed = {(r.target, r.start_ms, r.end_ms) for r in got if r.reason is None}
    fold = spans.build_spans_by_fold(batch, ["target"], "seq").where("end_ms IS NOT NULL").collect()
    assert closed == {(r.target, r.start_ms, r.end_ms) for r in fold}
    assert sorted(r.reason for r in got if r.reason) == ["missing", "out of order"]


def test_far_numbers_add_up(spark):
    df = spark.createDataFrame([(1e19,), (0.25,), (-1e19,), (-3.5,), (2.0**30 + 0.5,)], "x double")
    assert df.agg(acc.exact_sum(F.col("x"))).first()[0] == pytest.approx(2.0**30 - 2.75)
    assert df.where("x = 1e19").agg(acc.exact_sum(F.col("x"))).first()[0] == 1e19


def metered(spark, catalog, rows):
    return meter(usage.normalize(documents(spark, rows), catalog), catalog).withColumn("billing_ms", F.col("arrival_ms"))


def test_reports_read_one_month(spark, catalog, tmp_path):
    """Tables laid out by month are read for the months that are asked for only."""
    rows = [(at(d, month=m), at(d, month=m), None, {"heavy_api_calls": 1}, at(d, month=m)) for m in (6, 7, 8) for d in (2, 9)]
    path = str(tmp_path / "t")
    state.write_usage_table(metered(spark, catalog, rows).withColumn("yyyymm", F.lit("x")).drop("yyyymm"), path, "end_ms", "organization_id", 2)
    table, t = spark.read.parquet(path), at(20, month=7)

    def months(df):
        return {f.split("yyyymm=")[1][:6] for r in df.select(F.input_file_name().alias("f")).distinct().collect() for f in [r.f]}

    def filters(df):
        text = df._jdf.queryExecution().executedPlan().toString()
        return [part for part in text.split("PartitionFilters: [")[1:] if "yyyymm" in part.split("]")[0]]

    pruned = [report.as_of(table, t), state.latest_per_key(table, ["organization_id"], "end_ms", t), readers.read_range(table, "organization_id", "o", "end_ms", at(1, month=7), t), state.replay_unprocessed(table, table.limit(0), table.limit(0), ["organization_id"], "end_ms", t, 86_400_000), report.org_report(table, t), report.instance_report(table, {"organization_id": "o"}, t)]
    assert all(filters(df) for df in pruned)
    assert months(report.as_of(table, t)) == {"201807"} and report.as_of(table, t).count() == 2 * 3
    found = state.find_usage(table.select("resource_instance_id").distinct(), table, table.limit(0).withColumn("error", F.lit("e")), "resource_instance_id", ["end_ms"], (t, t))
    assert filters(found) and found.count() == 6
    got = report.org_report(table, t).where("level = 'org' AND metric = 'heavy_api_calls' AND dimension = 'M'").collect()
    assert [r.quantity for r in got] == [2.0]


def test_unknown_folds_raise(spark, catalog):
    from dataclasses import replace

    rows = metered(spark, catalog, [(at(1), at(1), None, {"storage": 1}, at(1))])
    with pytest.raises(Exception, match="no such fold: median"):
        acc.accumulate(rows.withColumn("accumulate", F.lit("median"))).collect()
    odd = replace(catalog, metrics=catalog.metrics.withColumn("accumulate", F.lit("median")))
    with pytest.raises(ValueError, match="no such fold: median"):
        acc.accumulate_by_plan(rows, odd)
    with pytest.raises(Exception, match="no such aggregate: odd"):
        acc.aggregate_tree(acc.accumulate(rows), replace(catalog, metrics=catalog.metrics.withColumn("aggregate", F.lit("odd")))).collect()


def test_folds_of_long_windows_go_piece_by_piece(spark, catalog):
    rows = metered(spark, catalog, [(at(1) + i, at(1) + i, f"d{i}", {"heavy_api_calls": i % 7}, at(2) + i) for i in range(50)] + [(at(5), at(5), "x", {"heavy_api_calls": 3}, at(6))]).where("metric = 'heavy_api_calls'")
    fold = "coalesce(a, 1D) * 0.9D + x.value"
    told = lambda n: sorted((r.dimension, r.bucket_ms, r.quantity) for r in acc.accumulate_custom(rows, fold, piece=n).collect())
    a = None
    for i in range(50):
        a = (1.0 if a is None else a) * 0.9 + i % 7
    want = told(1000)
    assert ("D", at(1), pytest.approx(a)) in want and told(8) == want


def test_aggregate_last_of_a_plan(spark, catalog):
    from dataclasses import replace

    rows = metered(spark, catalog, [(at(1), at(1), None, {"heavy_api_calls": 5}, at(2)), (at(1), at(1), "x", {"heavy_api_calls": 7}, at(3))])
    rows = rows.withColumn("resource_instance_id", F.when(F.col("arrival_ms") == at(2), "a").otherwise("b"))
    c = replace(catalog, metrics=catalog.metrics.withColumn("aggregate", F.when(F.col("metric") == "heavy_api_calls", "last")))
    got = acc.aggregate_tree(acc.accumulate(rows, mergeable=True), c).where("metric = 'heavy_api_calls' AND dimension = 'M'").collect()
    assert {(r.level, r.quantity) for r in got} == {("org", 7.0), ("space", 7.0), ("consumer", 7.0)}


def test_usage_without_a_plan_is_told(spark, catalog):
    from usagemill.operators import ingest
    from usagemill.operators.meter import check_metered

    df = documents(spark, [(at(1), at(1), None, {"storage": 1 << 30}, at(1)), (at(2), at(2), None, {"storage": float("nan")}, at(2))]).withColumn("plan_id", F.when(F.col("start") == at(1), "basic").otherwise("none"))
    told = check_metered(meter(usage.normalize(df, catalog), catalog)).collect()
    assert sorted(str(r.error) for r in told) == ["None", "None", "None", "no metering plan"]
    c = sample_catalog(spark, spark.createDataFrame([("acc", ["o"], "USA", "")], schemas.ACCOUNTS))
    ok, errors = ingest.process_usage(df.withColumn("plan_id", F.lit("basic")), c, at(3), [F.col("arrival_ms")])
    assert [(r.metric, r.error) for r in errors.collect()] == [("storage", "storage: no quantity")]
    assert ok.where("metric = 'storage' AND dimension = 'M'").first().quantity == 1.0


def test_three_batches_equal_one(spark, tmp_path):
    c = sample_catalog(spark)
    rng = random.Random(2)
    rows = []
    for i in range(120):
        t = at(1) + rng.randrange(40 * MS["D"])
        rows.append((t, t, f"d{i}", {"current_instance_memory": rng.randrange(4) << 30, "current_running_instances": rng.randrange(3), "previous_instance_memory": rng.randrange(4) << 30, "previous_running_instances": rng.randrange(3), "storage": rng.randrange(9) << 30, "heavy_api_calls": rng.random()}, at(25) + i))
    df = documents(spark, rows).withColumn("resource_id", F.lit("test-resource"))
    for i in range(3):
        df.where(F.col("arrival_ms") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src"))
    process = lambda batch: acc.accumulate(meter(usage.normalize(batch, c), c), mergeable=True)
    out = str(tmp_path / "out")
    pipeline.accumulate_batches(stream, process, out, str(tmp_path / "cp")).awaitTermination(180)
    assert spark.read.parquet(out).select("batch").distinct().count() == 3
    cols = [*schemas.KEYS, *acc.WINDOW, "n", "quantity", "consuming", "consumed", "since_ms"]
    told = lambda a: sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in a.select(*cols).collect())
    want = told(process(df))
    assert told(pipeline.accumulated(spark, out, schemas.KEYS)) == want
    pipeline.compact(spark, out, str(tmp_path / "compact"), schemas.KEYS)
    assert told(pipeline.accumulated(spark, str(tmp_path / "compact"), schemas.KEYS)) == want


def test_long_histories_are_joined_by_month(spark, monkeypatch):
    history = spark.createDataFrame([("p", 0, "v0"), ("p", at(3, month=7), "v1"), ("p", at(9, month=7), "v2"), ("q", at(5, month=8), "w")], "plan_id string, valid_from long, name string")
    rows = spark.createDataFrame([(i, p, at(d, month=m)) for i, (p, d, m) in enumerate([("p", 1, 7), ("p", 3, 7), ("p", 4, 7), ("p", 20, 8), ("q", 1, 8), ("q", 6, 8), ("x", 1, 8)])], "i int, plan_id string, end_ms long")
    told = lambda: sorted((r.i, str(r["name"])) for r in usage.plan_lookup_as_of(rows, history, ["plan_id"]).collect())
    want = told()
    assert want == [(0, "v0"), (1, "v1"), (2, "v1"), (3, "v2"), (4, "None"), (5, "w"), (6, "None")]
    monkeypatch.setattr(usage, "MAX_BROADCAST_ROWS", 1)
    assert told() == want


def test_selections_of_the_tree(spark, catalog):
    t = at(15)
    r = report.org_report(metered(spark, catalog, [(t, t, None, {"heavy_api_calls": 2, "storage": 1 << 30}, t)]), t + 1)
    got = report.report_select(r.where("metric != 'thousand_light_api_calls'"), ["org", "space"], ["level", "organization_id", "space_id"], ["summary"]).orderBy("level").collect()
    assert [(x.level, x.space_id) for x in got] == [("org", None), ("space", "s")]
    assert [(c.metric, c.dimension, c.slot, c.summary) for c in got[0].cells] == [("heavy_api_calls", "D", 0, 2.0), ("heavy_api_calls", "M", 0, 2.0), ("storage", "D", 0, 1.0), ("storage", "M", 0, 1.0)]


def test_catalog_is_stored_and_read(spark, catalog, tmp_path):
    from usagemill.plans.catalog import load_catalog

    for n in ("metrics", "rating", "prices", "mappings", "accounts"):
        getattr(catalog, n).write.parquet(str(tmp_path / n))
    back = load_catalog(spark, str(tmp_path))
    assert sorted(map(str, back.metrics.collect())) == sorted(map(str, catalog.metrics.collect())) and back.prices.count() == catalog.prices.count()


def test_other_readers_and_writers(spark, catalog, tmp_path):
    """Service and span events, usage streams, error tables, reports, unknown metrics, empty reports, time slack."""
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.json").write_text('{"metadata":{"guid":"a","created_at":5},"entity":{"state":"CREATED","service_instance_type":"managed_service_instance","service_guid":"g"}}\n{"metadata":{"guid":"b","created_at":5},"entity":{"state":"CREATED","service_instance_type":"user_provided"}}\n')
    assert [r.metadata.guid for r in readers.read_service_events(spark, str(tmp_path / "s"), ["g"]).collect()] == ["a"]
    assert readers.read_service_events(spark, str(tmp_path / "s"), ["h"]).count() == 0
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.json").write_text('{"kind":"start","id":"1","timestamp":5,"organization_id":"o"}\n')
    assert readers.read_span_events(spark, str(tmp_path / "p")).first().kind == "start"
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "a.json").write_text('{"start":1,"end":2,"organization_id":"o"}\n')
    assert len(run_to_memory(spark, readers.read_usage_stream(spark, str(tmp_path / "u")), "used", tmp_path, "append")) == 1
    good, bad = usage.split_errors(spark.createDataFrame([(1, at(1)), (2, at(2))], "i int, ts long"), F.when(F.col("i") == 2, "odd"))
    state.write_errors(bad, str(tmp_path / "e"), "ts")
    errors = spark.read.parquet(str(tmp_path / "e"))
    assert good.count() == 1 and [r.error for r in readers.read_errors(errors, "ts", at(1), at(3)).collect()] == ["odd"]
    state.write_report(good, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 1
    t = at(15)
    rows = metered(spark, catalog, [(t, t, None, {"heavy_api_calls": 2}, t)])
    assert report.org_report(rows, t - 40 * MS["D"]).count() == 0
    told = report.summarize_by_plan(acc.accumulate(rows).withColumn("metric", F.lit("unknown")), t, catalog)
    assert {r.summary for r in told.collect()} == {0.0}
    assert ev.strip_to_schema is not None and spark.createDataFrame([(at(1, month=5),), (at(1, month=7),)], "ts long").where(usage.span_slack(F.col("ts"), at(1))).count() == 1


def test_approximate_percentiles(spark):
    from usagemill.operators import monitor

    r = monitor.approximate_percentiles(spark.range(1001).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("v")), ["k"], "v").first()
    assert abs(r.p50 - 500) <= 1 and abs(r.p99_5 - 995) <= 1 and r.p100 == 1000 and r["mean"] == 500


def test_exact_sum_is_the_same_in_any_order(spark):
    values = [0.1] * 10 + [1e15, -1e15, -0.3, 0.000000001, float("nan"), float("inf"), None]
    for xs in (values, values[::-1]):
        df = spark.createDataFrame([(x,) for x in xs], "x double").repartition(3)
        assert df.agg(acc.exact_sum(F.col("x"))).first()[0] == 0.700000001
    assert spark.createDataFrame([(None,)], "x double").agg(acc.exact_sum(F.col("x"))).first()[0] is None


def test_spread_keeps_rows_and_leaves_tables_of_many_files(spark, tmp_path):
    rows = spark.range(100).withColumn("v", F.col("id") % 7)
    rows.coalesce(1).write.parquet(f"{tmp_path}/one")
    one = spark.read.parquet(f"{tmp_path}/one")
    dealt = readers.spread(one, "id")
    assert sorted(dealt.collect()) == sorted(one.collect())
    assert dealt.select(F.spark_partition_id()).distinct().count() > 1
    rows.repartition(spark.sparkContext.defaultParallelism).write.parquet(f"{tmp_path}/many")
    many = spark.read.parquet(f"{tmp_path}/many")
    assert readers.spread(many, "id") is many
