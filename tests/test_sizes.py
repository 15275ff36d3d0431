"""What keeps tasks, shuffles and files from growing with the tables."""

import pytest
from pyspark.sql import functions as F

from usagemill import schemas
from usagemill.operators import accumulate as acc
from usagemill.operators.folds import fold_of
from usagemill.plans.catalog import sample_catalog
from usagemill.queries import QUERIES
from usagemill.session import PARTITION_BYTES, configure
from usagemill.sources import readers, state
from usagemill.streaming.ingest import admit


def test_partitions_grow_with_the_tables(spark, tmp_path):
    with open(tmp_path / "lineitem.parquet", "wb") as f:
        f.truncate(100 * PARTITION_BYTES)  # a sparse file
    try:
        configure(spark, str(tmp_path))
        assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) == 100
    finally:
        for name in ("adaptive.coalescePartitions.initialPartitionNum", "adaptive.advisoryPartitionSizeInBytes", "files.maxPartitionBytes"):
            spark.conf.unset(f"spark.sql.{name}")


def test_a_batch_of_files_is_moved_as_a_whole(spark, tmp_path):
    spark.range(8).repartition(4).write.parquet(str(tmp_path / "all" / "batch=0"))
    assert state.move_into(spark, str(tmp_path / "all" / "batch=0"), str(tmp_path / "in" / "0"))
    assert spark.read.parquet(str(tmp_path / "in" / "0")).count() == 8
    assert not state.move_into(spark, str(tmp_path / "all" / "batch=1"), str(tmp_path / "in" / "1"))


def test_ticks_of_the_stream_are_not_shuffled(spark, tmp_path):
    schema = spark.createDataFrame([], schemas.USAGE).selectExpr("*", "start AS start_ms", "end AS end_ms", "start AS arrival_ms").schema
    told = admit(spark.readStream.schema(schema).parquet(str(tmp_path)), sample_catalog(spark))
    plan = told._jdf.queryExecution().analyzed().toString()
    assert "isnull(at#" in plan and plan.index("isnull(at#") < plan.index("EventTimeWatermark")



def test_folds_that_see_no_bounds_step_by_day():
    fold = lambda step: fold_of(f"zero: 0D; step: {step}; merge: (a, b) -> a + b")
    assert not fold("(a, x) -> a + x.value").reads_window
    assert fold("(a, x) -> a + x.value * (x.to_ms - x.from_ms)").reads_window
    assert fold("(a, x) -> a + length(to_json(x))").reads_window
    assert fold("(a, u) -> a + u.value + if(u IS NULL, 1, 0)").reads_window


def test_ordered_folds_shuffle_usages_before_they_are_put_into_windows(spark):
    rows = spark.createDataFrame([("i", "m", 1.0, 5, 5, 1), ("i", "m", 2.0, 6, 6, 2)], "k string, metric string, value double, start_ms long, end_ms long, arrival_ms long")
    out = acc.accumulate_custom(rows, "coalesce(a, 0D) + x.value", keys=["k"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")
    assert sorted((r.dimension, r.quantity) for r in out.collect()) == [("D", 3.0), ("M", 3.0)]


def test_json_reports_may_be_compressed(spark, tmp_path):
    df = spark.range(3).select(F.col("id").alias("start"), F.lit("o").alias("organization_id"))
    state.write_report(df, str(tmp_path / "r"), "json", compression="gzip")
    assert all(p.name.endswith(".json.gz") for p in (tmp_path / "r").glob("part-*"))
    assert sorted(r.start for r in readers.read_usage(spark, str(tmp_path / "r")).collect()) == [0, 1, 2]


def test_dealt_out_parts_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "PART_ROWS", 10)
    spark.range(1000).repartition(1).write.parquet(str(tmp_path / "t"))
    assert readers.spread(spark.read.parquet(str(tmp_path / "t")), "id").rdd.getNumPartitions() == 100


@pytest.mark.parametrize("name", ["accumulate_sum_day", "accumulate_avg_month", "aggregate_tree", "resource_rollup", "resource_rollup_of_tree", "stored_catalog", "accumulate_mergeable_fold"])
def test_documents_lie_side_by_side_before_they_are_metered(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # A plan's children stand below it: each rebalancing lies under windows and metering, over the scans.
    assert 0 < plan.index("Generate explode") < plan.index("RebalancePartitions") < plan.index("Relation [l_orderkey")
    assert plan.count("RebalancePartitions") == plan.count("Relation [l_orderkey")


def test_an_instance_dealt_to_several_tasks_is_put_together(spark):
    docs = spark.range(4000).selectExpr("'o' AS organization_id", "'s' AS space_id", "cast(id % 2 AS string) AS consumer_id", "'r' AS resource_id", "'p' AS plan_id", "'i' AS resource_instance_id", "id * 3600000 AS start_ms", "id * 3600000 AS end_ms", "id AS arrival_ms", "'n' AS metric", "'sum' AS accumulate", "1D AS value", "0D AS consuming", "0D AS previous_consuming")
    told = lambda rows: sorted(map(tuple, acc.accumulate(rows, schemas.INSTANCE).collect()))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1k")
    try:
        assert told(acc.side_by_side(docs.repartition(4))) == told(docs)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_ordered_folds_read_stored_documents(spark):
    plan = QUERIES["accumulate_plan_fold"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "measured_usage" in plan
