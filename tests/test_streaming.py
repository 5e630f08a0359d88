import pathlib
import random

from pyspark.sql import functions as F

from goldrec.operators import golden
from goldrec.plans.durable import shared_dir, work_path
from goldrec.sources.raw_events import parse_raw, raw_audit, raw_records, read_raw
from goldrec.sources.tables import compact, current_golden, read_table
from goldrec.streaming.idem import rearm, rearm_batch
from goldrec.streaming.ingest import ingest_batch
from goldrec.streaming.master import master_batch
from tests import brute
from tests.test_golden import expected, frame, golden_rows


def clean(rows):
    """Events that fit the raw table: no phone text longer than its column, and no
    processing time, which raw messages do not carry."""
    return [r[:4] + (r[4] if len(r[4] or "") <= 64 else None,) + r[5:7] + (None,) for r in rows]


def columns(df):
    return df.drop("processed_at")


def test_batches_in_order_equal_one_batch_and_can_be_repeated(spark):
    root = work_path(spark, "test")
    rows = sorted(clean(brute.events(11, count=150)), key=lambda r: (r[6], r[0]))
    parts = [rows[:60], rows[60:100], rows[100:]]
    for i, part in enumerate(parts):
        master_batch(columns(frame(spark, part)), i, root)
    want = expected(rows, golden.MasteringConfig())
    assert golden_rows(current_golden(spark, root)) == want
    master_batch(columns(frame(spark, parts[2])), 2, root)
    assert golden_rows(current_golden(spark, root)) == want
    assert read_table(spark, root, "raw", "event_id bigint").count() == len(rows)
    master_batch(columns(frame(spark, rows[:30])), 3, root)
    assert golden_rows(current_golden(spark, root)) == want
    compact(spark, root, root + "-compact")
    assert golden_rows(current_golden(spark, root + "-compact")) == want


def test_late_events_follow_arrival_order(spark):
    root = work_path(spark, "test")
    rows = clean(brute.events(12, count=120))
    random.Random(12).shuffle(rows)
    states = {}
    for i, part in enumerate((rows[:50], rows[50:])):
        master_batch(columns(frame(spark, part)), i, root)
        states, _ = brute.fold(part, golden.MasteringConfig(), states)
    assert golden_rows(current_golden(spark, root)) == {k: brute.as_row(s) for k, s in states.items()}


def test_bad_events_go_to_the_dead_letters_and_the_rest_is_mastered(spark):
    root = work_path(spark, "test")
    rows = clean(brute.events(13, count=40))
    bad = [(900, " ", "n", "e", "p", "CRM", brute.START, None), (901, "1" * 12, "n" * 300, "e", "p", "CRM", brute.START, None)]
    master_batch(columns(frame(spark, rows + bad)), 0, root)
    dead = read_table(spark, root, "dlq", "event_id bigint, error_type string").collect()
    assert {(r.event_id, r.error_type) for r in dead} == {(900, "BUSINESS"), (901, "PERMANENT")}
    assert golden_rows(current_golden(spark, root)) == expected(rows, golden.MasteringConfig())
    mastered = read_table(spark, root, "mastered", "action string")
    assert mastered.count() == len(rows)


def test_raw_messages_keep_every_value(spark):
    df = columns(frame(spark, clean(brute.events(14, count=60))))
    back = parse_raw(raw_records(df, partitions=3))
    same = df.withColumn("event_id", F.col("event_id").cast("string")).select(*back.columns)
    assert back.exceptAll(same).isEmpty() and same.exceptAll(back).isEmpty()
    audit = raw_audit(df.filter("name is null"))
    assert audit.filter(~F.col("raw_payload").contains('"name":null')).isEmpty()
    headers = raw_records(df).first().headers
    assert [h.key for h in headers] == ["X-Event-ID", "X-Idempotency-Key", "X-Source-System", "X-Timestamp", "X-Event-Version"]


def test_request_files(spark, tmp_path):
    from goldrec.sources.requests import read_requests, stream_requests

    (tmp_path / "a.json").write_text(
        '{"requestId":1,"nationalId":"1","name":"n","sourceSystem":"CRM","idempotencyKey":"k","receivedAt":"2024-01-15T10:30:00"}\n'
    )
    row = read_requests(spark, str(tmp_path)).first()
    assert (row.event_id, row.national_id, row.email, row.client_key) == (1, "1", None, "k")
    assert row.event_ts == brute.START
    stream = stream_requests(spark, str(tmp_path))
    assert stream.isStreaming and stream.columns == read_requests(spark, str(tmp_path)).columns


def request(i, client_key, seconds, national_id="123456789012", source="CRM"):
    return (i, national_id, "n", None, None, source, client_key, brute.START + brute.timedelta(seconds=seconds))


def test_ingest_batches_equal_one_batch_can_be_repeated_and_leave_no_scratch(spark):
    schema = (
        "event_id long, national_id string, name string, email string, phone string, "
        "source_system string, client_key string, event_ts timestamp_ntz"
    )
    rows = [request(1, "a", 0), request(2, "a", 1), request(3, None, 2), request(4, "x", 3, national_id=" "), request(5, "b", 4)]
    rows += [request(6, "a", 5), request(7, "b", 6), request(5, "b", 7), request(8, "c", 8, source="nope")]
    folder = pathlib.Path(shared_dir(spark), "goldrec")

    def run(parts, repeat=()):
        root = work_path(spark, "ingest-test")
        for i, part in [*enumerate(parts), *repeat]:
            ingest_batch(spark.createDataFrame(part, schema), i, root)
        replies = spark.read.parquet(f"{root}/replies").drop("batch_id").collect()
        return sorted(map(str, replies)), sorted(r.event_id for r in read_raw(spark, f"{root}/raw_events").collect())

    before = {p.name for p in folder.glob("*")}
    want = run([rows])
    assert want[1] == ["1", "3", "5"]
    assert sum("REJECTED" in r for r in want[0]) == 2 and sum("CACHED" in r for r in want[0]) == 4
    parts = [rows[:4], rows[4:6], rows[6:]]
    assert run(parts) == want
    assert run(parts, [(1, parts[1]), (2, parts[2])]) == want
    left = {p.name for p in folder.glob("*")} - before
    assert all(name.startswith("ingest-test") for name in left)


def test_rearming_folds_each_batch_from_the_stored_expiries(spark, tmp_path):
    hour, schema = 3_600_000_000, "key_hash string, event_id bigint, event_us bigint, ttl_us bigint"
    draw = random.Random(5)
    rows = [(f"k{draw.randrange(9)}", i, draw.randrange(90) * hour // 4, 2 * hour) for i in range(300)]
    rows += rows[::40]  # deliveries of the same request
    rows.sort(key=lambda r: (r[2], r[1]))
    want, expires = [], {}
    for key, event_id, us, ttl in rows:
        new = key not in expires or us > expires[key]
        want.append((key, event_id, us, "HIT" if not new else "EXPIRED" if key in expires else "MISS"))
        if new:
            expires[key] = us + ttl
    root = str(tmp_path)
    for batch in (0, 1, 2, 1, 2):  # batches are repeated after a failure
        part = [r for r in rows if r[2] // (8 * hour) == batch]
        rearm_batch(spark.createDataFrame(part, schema), batch, root)
    found = spark.read.parquet(f"{root}/rearmed").select("key_hash", "event_id", "event_us", "result").collect()
    assert sorted(map(tuple, found)) == sorted(want)


def test_rearming_calls_no_python_per_key(spark):
    rows = spark.createDataFrame([("k", 1, 1, 1)], "key_hash string, event_id bigint, event_us bigint, ttl_us bigint")
    stored = spark.createDataFrame([], "key_hash string, expires_us bigint")
    plan = rearm(rows, stored)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" in plan and "Python" not in plan and "Pandas" not in plan
