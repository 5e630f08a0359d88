from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from goldrec.operators import dlq, read, slo
from goldrec.operators.golden import golden_record
from goldrec.queries import QUERIES, _failed
from goldrec.sources import fixtures as fx
from tests import brute
from tests.brute import START

SF = "/root/testdata/sf0.001"
LOG = (
    "event_id bigint, event_ts timestamp_ntz, processed_at timestamp_ntz, latency_ms double, "
    "ok boolean, is_duplicate boolean, action string"
)


def log(spark, entries):
    """Entries: (seconds, latency, ok, duplicate)."""
    rows = []
    for i, (second, latency, ok, dup) in enumerate(entries):
        at = START + timedelta(seconds=second)
        rows.append((i, at, at, float(latency), ok, dup, "UPDATED" if dup else "CREATED"))
    return spark.createDataFrame(rows, LOG)


def test_error_classes_follow_the_order_of_the_lists(spark):
    want = {
        "a.ConstraintViolationException": "PERMANENT",
        "a.DataIntegrityViolationException": "PERMANENT",
        "a.DeadlockLoserDataAccessException": "TRANSIENT",
        "a.BusinessRuleValidationException": "BUSINESS",
        "a.TransientBusinessException": "TRANSIENT",
        "a.RuntimeException": "TRANSIENT",
    }
    df = spark.createDataFrame([(k,) for k in want], "exception_class string")
    got = {r.exception_class: (r.error_type, r.retryable) for r in dlq.with_error_type(df).collect()}
    assert got == {k: (v, v == "TRANSIENT") for k, v in want.items()}
    known = df.select(dlq.classify_error(F.col("exception_class"), F.lit("BUSINESS")))
    assert {r[0] for r in known.collect()} == {"BUSINESS"}


def test_dlq_record_round_trip(spark):
    schema = (
        "event_id bigint, event_ts timestamp_ntz, exception_class string, message string, retry_count int, "
        "original_event struct<eventId: string, nationalId: string, name: string, email: string, phone: string, "
        "sourceSystem: string, timestamp: timestamp_ntz>"
    )
    at = START + timedelta(microseconds=123456)
    rows = [
        (1, at, "x.QueryTimeoutException", "m" * 600, 3, ("1", "id1", None, "e", "p", "CRM", at)),
        (2, at, "x.IllegalArgumentException", None, 3, ("2", " ", "n", "e", "p", "CRM", at)),
        (3, at, "x.IllegalArgumentException", "m", 3, ("3", "id3", "n", "e", "p", "", at)),
        (4, at, "x.IllegalArgumentException", "m", 3, None),
    ]
    events = dlq.dlq_events(spark.createDataFrame(rows, schema))
    first = events.filter("event_id = 1").first()
    assert len(first.error_details.message) == 503 and len(first.processing_history[0].error) == 203
    assert first.error_details.exception == "QueryTimeoutException"
    again = {r.original_event_id: r for r in dlq.reprocess(dlq.dlq_records(events)).collect()}
    assert again["1"].reason is None and again["1"].event_ts == at and again["1"].event_id != "1"
    assert again["2"].reason.startswith("nationalId") and again["3"].reason.startswith("sourceSystem")
    assert again[None].reason.startswith("No original")


@pytest.mark.parametrize("name", ["dlq_events", "dlq_reprocess", "sink_dlq"])
def test_messages_are_made_after_the_join_of_failed_events(spark, name):
    """A long message is neither broadcast nor shuffled; the work on it has many tasks."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("repeat(x") == 1
    assert plan.index("repeat(x") < plan.index("RepartitionByExpression") < plan.index("Join ")


def test_failed_events_have_the_messages_of_the_errors(spark):
    want = {(r.event_id, r.message) for r in fx.errors(spark, SF).collect()}
    failed = _failed(spark, SF)
    assert set(failed.columns) >= set(fx.errors(spark, SF).columns)
    assert {(r.event_id, r.message) for r in failed.collect()} == want


def test_sink_dlq_reads_its_value_once(spark):
    plan = QUERIES["sink_dlq"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object") == 0 and plan.count("from_json") + plan.count("JsonToStructs") == 1


def test_dlq_rate_of_98_good_and_2_dead(spark):
    row = dlq.dlq_rate(log(spark, [(i, 1, i >= 2, False) for i in range(100)])).first()
    assert row.dlq_rate == 2.0
    assert dlq.dlq_rate(log(spark, [(0, 1, True, False)]).filter("false")).first().dlq_rate == 0.0


def test_dlq_alerts_go_on_without_events(spark):
    df = log(spark, [(0, 1, False, False), (1, 1, True, False), (1500, 1, True, False)])
    out = dlq.dlq_alerts(df, channels=("email", "pager", "SMS")).collect()
    assert {r.channel for r in out} == {"EMAIL", "SMS"}
    assert len({r.check_at for r in out}) == 6
    assert dlq.dlq_alerts(log(spark, [(0, 1, True, False)])).isEmpty()


def test_rates(spark):
    half = log(spark, [(i, 1, True, i % 2 == 0) for i in range(10)])
    assert slo.duplicate_rate(half).first().duplicate_rate == 50.0
    fifth = log(spark, [(i, 1, i % 5 != 0, False) for i in range(10)])
    assert slo.error_rate(fifth).first().error_rate == 20.0
    empty = half.filter("false")
    assert slo.duplicate_rate(empty).first().duplicate_rate == 0.0
    status = slo.slo_status(empty).first()
    assert (status.budget_remaining, status.burn_rate, status.status) == (100.0, 0.0, "HEALTHY")


@pytest.mark.parametrize(
    "failed,severity,met", [(0, "NORMAL", True), (2, "ELEVATED", False), (5, "HIGH", False), (10, "CRITICAL", False)]
)
def test_slo_status(spark, failed, severity, met):
    df = spark.range(1000).select(
        F.col("id").alias("event_id"),
        F.lit(START).cast("timestamp_ntz").alias("event_ts"),
        F.lit(START).cast("timestamp_ntz").alias("processed_at"),
        F.lit(1.0).alias("latency_ms"),
        (F.col("id") >= failed).alias("ok"),
        F.lit(False).alias("is_duplicate"),
        F.lit("CREATED").alias("action"),
    )
    row = slo.slo_status(df).first()
    assert (row.severity, row.slo_met, row.status) == (severity, met, "HEALTHY" if met else "DEGRADED")
    assert row.burn_rate == pytest.approx(failed)


def test_a_target_of_100_allows_no_error(spark):
    df = spark.createDataFrame([(10, 0), (10, 1), (0, 0)], "t bigint, f bigint")
    got = [r[0] for r in df.select(slo.burn_rate(F.col("t"), F.col("f"), 100.0)).collect()]
    assert got == [0.0, slo.MAX_DOUBLE, 0.0]


def test_histogram_quantile(spark):
    df = log(spark, [(i, v, True, False) for i, v in enumerate([5] * 50 + [80] * 45 + [2000] * 5)])
    row = slo.latency_quantiles(df, "1 hour").first()
    assert row.p50 == 10.0 and row.p95 == 100.0 and row.p99 == 1000.0
    counts = {r.le_ms: r.n for r in slo.latency_histogram(df).collect()}
    assert counts["10"] == 50 and counts["1000"] == 95 and counts["+Inf"] == 100


def test_sustained_alert_needs_its_full_time(spark):
    good = [(i, 1, True, False) for i in range(0, 1800, 10)]
    short = good + [(600, 1, False, False)]
    # One error stays in the five-minute window for ten checks of 30 seconds.
    alert = slo.alert_error_rate(log(spark, short)).collect()
    assert len(alert) == 1
    assert (alert[0].last_true - alert[0].pending_from) == timedelta(seconds=270)
    assert alert[0].fired_at - alert[0].pending_from == timedelta(seconds=120)
    few = log(spark, good + [(i, 1, True, False) for i in range(0, 1800, 2)] + [(600, 1, False, False)])
    assert slo.alert_error_rate(few).isEmpty()


def test_latency_alerts(spark):
    slow = log(spark, [(i, 2000, True, False) for i in range(0, 1200, 15)])
    assert {r.alert for r in slo.alert_latency(slow).collect()} == {
        "MDMProcessingLatencyHigh",
        "MDMProcessingLatencyDegraded",
    }
    assert slo.alert_latency(log(spark, [(i, 20, True, False) for i in range(0, 1200, 15)])).isEmpty()


def test_health(spark):
    mixed = log(spark, [(i, 1, True, i % 2 == 0) for i in range(200)])
    soon, later = (F.lit(START + timedelta(seconds=s)).cast("timestamp_ntz") for s in (300, 600))
    assert slo.processing_health(mixed, soon).first().status == "UP"
    assert slo.processing_health(mixed, later).first().status == "DOWN"
    none = log(spark, [(i, 1, True, False) for i in range(200)])
    assert slo.processing_health(none, soon).first().status == "UNKNOWN"


def test_read_side(spark):
    rows = brute.events(9, count=120)
    golden = golden_record(spark.createDataFrame(rows, brute.EVENT_SCHEMA))
    everyone = sorted(golden.collect(), key=lambda r: (-r.updated_at.timestamp(), r.national_id))
    pages = [r.nationalId for p in range(3) for r in read.list_customers(golden, p, 5).collect()]
    assert pages == [r.national_id for r in everyone][:15]
    after = everyone[4]
    assert [r.nationalId for r in read.customers_after(golden, after.updated_at, after.national_id, 5).collect()] == pages[5:10]
    one = everyone[0].national_id
    assert read.customer_by_national_id(golden, f" {one[:4]}-{one[4:]}").count() == 1
    assert read.customer_by_id(golden, everyone[0].id).first().nationalId == one
    assert read.customer_by_id(golden, "none").isEmpty()
    assert read.search_by_name(golden, None, 0, 100).count() == len(everyone)
    hits = read.search_by_name(golden, "AN", 0, 100).collect()
    assert hits and all("an" in r.name.lower() for r in hits)
    asked = spark.createDataFrame([(one,), (one,), ("nobody",)], "national_id string")
    assert {r.national_id: r.found for r in read.exists_by_national_ids(golden, asked).collect()} == {one: True, "nobody": False}
    counts = {r.table_name: r.rows for r in read.table_row_counts(golden.limit(3), golden).collect()}
    assert counts == {"customer_raw": 3, "customer_golden": len(everyone)}


def test_mastering_rejects_blank_ids_and_long_values(spark):
    rows = [(1, None, "n", "e", "p", "CRM"), (2, "\t", "n", "e", "p", "CRM"), (3, "id", "n" * 256, "e", "p", "CRM"), (4, "id", "n" * 255, "e", "p", "CRM")]
    df = spark.createDataFrame(rows, "event_id int, national_id string, name string, email string, phone string, source_system string")
    got = {r.event_id: r.error_type for r in dlq.mastering_errors(df).collect()}
    assert got == {1: "BUSINESS", 2: "BUSINESS", 3: "PERMANENT"}


def test_sketched_quantiles_have_the_rank_asked_for(spark):
    """Over merged sketches of six-minute windows; three times the error that 99 % of
    sketches keep to, as sketches are random."""
    rows = spark.range(40000).select(
        (F.lit(brute.START) + F.make_dt_interval(secs=F.col("id") * 3)).cast("timestamp_ntz").alias("event_ts"),
        F.when(F.col("id") % 7 != 0, F.pmod(F.xxhash64("id"), F.lit(5000)) * (F.col("id") % 3)).alias("latency_ms"),
    )
    sketches = slo.latency_sketches(rows, "6 minutes")
    got = slo.sketch_quantiles(sketches, "1 day").collect()
    assert sum(r.n for r in got) == rows.filter("latency_ms is not null").count() and len(got) == 2
    day = F.date_trunc("day", "event_ts").cast("timestamp_ntz")
    for r in got:
        values = rows.filter((day == r.window_start) & F.col("latency_ms").isNotNull())
        for q, v in ((0.50, r.p50), (0.95, r.p95), (0.99, r.p99)):
            low, high = values.agg(F.avg((F.col("latency_ms") < v).cast("int")), F.avg((F.col("latency_ms") <= v).cast("int"))).first()
            assert low - 3 * slo.SKETCH_ERROR <= q <= high + 3 * slo.SKETCH_ERROR
    assert slo.latency_sketches(rows.filter("latency_ms is null")).count() == 0
