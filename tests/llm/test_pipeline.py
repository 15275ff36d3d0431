"""The pipeline: stages take effect, keep clean rows, and return the documents' columns."""

import duckdb
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
D = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, D).checkpoint()
        counts.append(docs.count())
        if name != "sharding":
            assert docs.columns == columns
    assert counts[1] <= counts[0] and counts[2] < counts[1] and counts[3] < counts[2] and counts[4] == counts[5]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_stages_on_odd_rows_and_none(spark, odd, none):
    """Clashing columns are kept and named, rows without words pass all filters, and empty tables give empty tables."""
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, D).checkpoint()
        if name != "sharding":
            assert docs.columns == before.columns
        if name in ("near_duplicates", "decontamination"):
            assert {0, 1, 2} <= {r.doc_id for r in docs.collect()}
    assert docs.columns == [*odd.columns, "_size", "text_crc32", "curve", "shard", "slot"]
    assert docs.count() == before.count()
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, D).checkpoint()
        assert docs.count() == 0


def test_scratch_is_removed(spark):
    import os

    from usagemill.llm import common

    path = common.scratch_path(spark, "x")
    spark.range(3).write.parquet(path)
    local = path.removeprefix("file:")
    assert os.path.exists(local)
    common.clear_scratch(spark)
    assert not os.path.exists(local)


def test_run_agrees_with_itself(spark):
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, D).collect())) for _ in range(2))
    assert a == b


@pytest.mark.parametrize("name", ["op1_warc", "op2_url_filter"])
def test_sql(spark, name):
    from usagemill.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{D}/pages.parquet'")
    want = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(map(str, (tuple(r[c] for c in names) for r in QUERIES[name](spark, D).collect()))) == sorted(map(str, want.fetchall()))
