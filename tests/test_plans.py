"""Skew helpers and the shape of the plans."""

import re

import pytest
from pyspark.sql import functions as F

from goldrec.operators import golden
from goldrec.plans.chunks import assign_chunks
from goldrec.plans.durable import durable, shared_dir
from goldrec.plans.skew import find_hot_keys, join_unique, salted_join
from goldrec.queries import QUERIES
from goldrec.sources import fixtures
from tests import brute

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def skewed(spark, rows=3000):
    """A third of all rows under key 0."""
    return spark.range(rows).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97 + 1).alias("k"), "id"
    )


def test_hot_keys(spark):
    df = skewed(spark)
    hot = find_hot_keys(df, "k", limit=100)
    assert [(r.k, r.n) for r in hot.table.collect()] == [(0, 1000)]
    assert hot.hot(df).count() == 1000 and hot.cold(df).count() == 2000
    assert find_hot_keys(df, "k", limit=1000) is None


def test_hot_keys_when_buckets_are_shared(spark):
    hot = find_hot_keys(skewed(spark), "k", limit=100, bucket_by=F.lit(1))
    assert [r.k for r in hot.table.collect()] == [0]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_unique_equals_a_plain_join(spark, hot_limit, how):
    hot_limit(100)
    df = skewed(spark)
    dim = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    want, got = df.join(dim, "k", how), join_unique(df, dim, "k", how=how)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_salted_join_keeps_all_pairs_and_splits_the_hot_key(spark, hot_limit):
    hot_limit(50)
    left = skewed(spark, 600).withColumnRenamed("id", "a")
    right = skewed(spark, 300).withColumnRenamed("id", "b")
    want, got = left.join(right, "k"), salted_join(left, right, "k", "a", "b")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert got.count() == want.count() > 600 * 300 // 9


def test_chunks_are_bounded_and_ordered(spark):
    rows = brute.events(21, count=600)
    df = golden.prepare(spark.createDataFrame(rows, brute.EVENT_SCHEMA))
    hot = find_hot_keys(df, "national_id", limit=30)
    chunks = assign_chunks(df, hot, "event_ts")
    spans = (
        chunks.groupBy("national_id", "chunk")
        .agg(F.count("*").alias("n"), F.min("event_ts").alias("lo"), F.max("event_ts").alias("hi"))
        .orderBy("national_id", "chunk")
        .collect()
    )
    assert len(spans) > 5 and chunks.count() == hot.hot(df).count()
    for a, b in zip(spans, spans[1:]):
        if a.national_id == b.national_id:
            assert a.hi < b.lo
    # A chunk ends with the slot that fills it.
    assert max(s.n for s in spans) < 2 * 30


def test_durable_reads_a_table_in_the_shared_folder(spark):
    df = durable(skewed(spark))
    assert "parquet" in plan(df.select("k")).lower() and df.count() == 3000
    assert "ReadSchema: struct<k:" in plan(df.select("k"))
    assert shared_dir(spark)


def test_golden_needs_one_shuffle_of_its_events(spark):
    rows = brute.events(22, count=50)
    stored = durable(spark.createDataFrame(rows, brute.EVENT_SCHEMA))
    text = plan(golden.golden_record(stored))
    assert text.count("Exchange hashpartitioning(national_id") == 1
    assert text.count("Exchange ") == 1


def test_trace_needs_one_shuffle_of_its_events(spark):
    rows = brute.events(22, count=50)
    stored = durable(spark.createDataFrame(rows, brute.EVENT_SCHEMA))
    assert plan(golden.golden_trace(stored)).count("Exchange ") == 1


def test_scans_read_only_the_columns_they_need(spark):
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan(QUERIES["dlq_rate"](spark, SF))).group(1)
    assert set(re.findall(r"(\w+):", schema)) <= {"event_id", "event_type"}


def test_a_lookup_reads_the_snapshot_only(spark):
    for name, column in (("customer_by_national_id", "national_id"), ("customer_by_id", "id")):
        text = plan(QUERIES[name](spark, SF))
        assert f"EqualTo({column}," in text
        assert "Exchange" not in text and text.count("Scan parquet") <= 2 and "golden-snapshot" in text


def test_no_query_uses_a_cross_join_or_a_python_udf(spark):
    names = ["golden_record", "golden_trace", "match_score", "best_match", "idem_classify"]
    for name in [*names, "slo_status", "slo_availability", "dlq_alerts", "alert_error_rate"]:
        text = plan(QUERIES[name](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
        assert "ArrowEvalPython" not in text and "BatchEvalPython" not in text


def test_windowed_counts_shuffle_counts_not_rows(spark):
    text = plan(QUERIES["event_rate"](spark, SF))
    partial = text.index("partial_count")
    assert text.index("Exchange") < partial
