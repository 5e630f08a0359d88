import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from goldrec.operators import dedup, idempotency, ingest
from tests.brute import START

SCHEMA = (
    "event_id bigint, national_id string, name string, email string, phone string, "
    "source_system string, client_key string, event_ts timestamp_ntz, done_ts timestamp_ntz"
)


def requests(seed, count=300, hot_share=0.4):
    rnd = random.Random(seed)
    out = []
    for i in range(count):
        key = 1 if rnd.random() < hot_share else rnd.randrange(2, 8)
        at = START + timedelta(minutes=rnd.randrange(60 * 24 * 4))
        client = rnd.choice((None, None, " ", f"ck{key}"))
        out.append((i, f"{key:012d}", "n", "e", "p", rnd.choice(("CRM", "WEB")), client, at, at + timedelta(minutes=20)))
    return out


def key_of(row):
    client = row[6]
    return ("client", client) if client and client.strip() else ("det", row[1], row[5])


def ttl_of(row):
    return timedelta(hours=24 if key_of(row)[0] == "client" else 6)


def ordered(rows):
    return sorted(rows, key=lambda r: (r[7], r[0]))


def classes(rows, in_flight):
    first, out = {}, {}
    for r in ordered(rows):
        k = key_of(r)
        if k not in first:
            first[k] = r
            out[r[0]] = ("MISS", r[0])
            continue
        start = first[k]
        if r[7] > start[7] + ttl_of(r):
            out[r[0]] = ("EXPIRED", start[0])
        elif in_flight and r[7] < start[8]:
            out[r[0]] = ("PROCESSING", start[0])
        else:
            out[r[0]] = ("HIT", start[0])
    return out


def keyed(spark, rows):
    return idempotency.with_idem_key(spark.createDataFrame(rows, SCHEMA).repartition(3))


@pytest.mark.parametrize("limit", [None, 15], ids=["cold", "hot"])
@pytest.mark.parametrize("in_flight", [False, True])
def test_classes(spark, hot_limit, limit, in_flight):
    if limit:
        hot_limit(limit)
    rows = requests(1)
    got = idempotency.classify(keyed(spark, rows), in_flight).collect()
    assert {r.event_id: (r.result, r.first_event_id) for r in got} == classes(rows, in_flight)


@pytest.mark.parametrize("limit", [None, 40], ids=["cold", "hot"])
def test_rearmed_chain(spark, hot_limit, limit):
    if limit:
        hot_limit(limit)
    rows, expiry, want = requests(2), {}, set()
    for r in ordered(rows):
        k = key_of(r)
        if k not in expiry or r[7] > expiry[k]:
            expiry[k] = r[7] + ttl_of(r)
            want.add(r[0])
    assert {r.event_id for r in idempotency.rearmed(keyed(spark, rows)).collect()} == want


@pytest.mark.parametrize("years", [0, 30])
def test_rearming_takes_no_more_jobs_for_a_longer_time(spark, hot_limit, monkeypatch, years):
    """Against a plain loop; the stored tables are counted."""
    hot_limit(10)
    rnd, made = random.Random(years), []
    at = [START + timedelta(hours=rnd.choice((0, 1, 6, 7)) * i, seconds=rnd.choice((0, 0, 1))) for i in range(120)]
    at += [START + timedelta(days=365 * years), START + timedelta(days=365 * years, hours=6)]
    rows = [(i, "1" * 12, "n", "e", "p", "CRM", None, t, t) for i, t in enumerate(at)]
    rows += [(500 + i, "2" * 12, "n", "e", "p", "CRM", "k", t, t) for i, t in enumerate(at[::2])]
    expiry, want = {}, set()
    for r in ordered(rows):
        if key_of(r) not in expiry or r[7] > expiry[key_of(r)]:
            expiry[key_of(r)] = r[7] + ttl_of(r)
            want.add(r[0])
    own = idempotency.durable
    monkeypatch.setattr(idempotency, "durable", lambda df, name="step": made.append(name) or own(df, name))
    assert {r.event_id for r in idempotency.rearmed(keyed(spark, rows)).collect()} == want
    assert len(made) <= 4 + 2 * 18  # 30 years have 43,800 times to live of six hours


def test_replay_names_the_first_event(spark):
    rows = requests(3)
    out = idempotency.replies(idempotency.classify(keyed(spark, rows))).collect()
    want = classes(rows, False)
    for r in out:
        result, first = want[r.request_id]
        assert r.event_id == (first if result == "HIT" else r.request_id)
        assert r.status == ("CACHED" if result == "HIT" else "ACCEPTED")


def test_a_client_key_hides_the_deterministic_one(spark):
    at = START
    rows = [
        (1, "1" * 12, "n", "e", "p", "CRM", None, at, at),
        (2, "1" * 12, "n", "e", "p", "CRM", "k1", at + timedelta(minutes=1), at),
        (3, "1" * 12, "n", "e", "p", "CRM", "k1", at + timedelta(minutes=2), at),
        (4, "1" * 12, "n", "e", "p", "CRM", None, at + timedelta(hours=6), at),
        (5, "1" * 12, "n", "e", "p", "CRM", None, at + timedelta(hours=6, seconds=1), at),
    ]
    got = {r.event_id: r.result for r in idempotency.classify(keyed(spark, rows)).collect()}
    assert got == {1: "MISS", 2: "MISS", 3: "HIT", 4: "HIT", 5: "EXPIRED"}


def test_keys_are_inserted_once(spark):
    rows = ordered(requests(4))
    old = idempotency.keys_table(keyed(spark, rows[:150]))
    new = idempotency.keys_table(keyed(spark, rows[150:]), old)
    both = old.unionByName(new)
    assert both.select("key_hash").distinct().count() == both.count() == len({key_of(r) for r in rows})


def test_stored_keys_come_first(spark):
    rows = ordered(requests(5))
    old = idempotency.keys_table(keyed(spark, rows[:100]))
    got = idempotency.classify(keyed(spark, rows[100:]), stored=old).collect()
    want = classes(rows, False)
    assert {r.event_id: r.result for r in got} == {r[0]: want[r[0]][0] for r in rows[100:]}


def test_first_failing_rule_rejects(spark):
    cases = [
        (None, "CRM", ingest.REASONS[0]),
        (" - ", "CRM", ingest.REASONS[0]),
        ("12-3", "NOPE", ingest.REASONS[1]),
        ("1" * 14, "CRM", ingest.REASONS[1]),
        ("1" * 12, None, ingest.REASONS[2]),
        ("1" * 12, " \t", ingest.REASONS[2]),
        ("1" * 13, "INVALID", ingest.REASONS[3]),
        ("123-456-789-012", " crm ", None),
    ]
    rows = [(i, n, "n", "e", "p", s, None, START, START) for i, (n, s, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.event_id: r.reason for r in ingest.check_requests(df).collect()}
    assert got == {i: c[2] for i, c in enumerate(cases)}
    valid = {r.event_id for r in ingest.valid_requests(df).collect()}
    assert valid == {i for i, c in enumerate(cases) if c[2] is None}
    assert ingest.invalid_requests(df).count() == len(cases) - len(valid)


@pytest.mark.parametrize("limit", [None, 15], ids=["cold", "hot"])
def test_dedup(spark, hot_limit, limit):
    if limit:
        hot_limit(limit)
    rows = requests(6)
    df = spark.createDataFrame(rows + rows[:50] * 3, SCHEMA)
    stored = spark.createDataFrame([(r[0],) for r in rows[:10]], "event_id bigint")
    got = [r.event_id for r in dedup.dedup_event_id(df, stored).collect()]
    assert sorted(got) == [r[0] for r in rows[10:]]
    flags = dedup.duplicates_by_customer(spark.createDataFrame(rows, SCHEMA)).collect()
    seen, want = set(), {}
    for r in ordered(rows):
        want[r[0]] = r[1] in seen
        seen.add(r[1])
    assert {r.event_id: r.is_duplicate for r in flags} == want


@pytest.mark.parametrize("limit", [None, 3], ids=["cold", "hot"])
def test_a_first_event_delivered_again_is_a_duplicate_once(spark, hot_limit, limit):
    if limit:
        hot_limit(limit)
    rows = requests(8, 60)
    first = ordered(rows)[0]
    rows += [first] * 7
    flags = dedup.duplicates_by_customer(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(flags) == len(rows)
    new = [r for r in flags if not r.is_duplicate]
    assert sorted(r.national_id for r in new) == sorted({r[1] for r in rows})
    assert all((r.event_ts, r.event_id) == min((x[7], x[0]) for x in rows if x[1] == r.national_id) for r in new)


def test_hot_rows_are_not_shuffled_by_the_delivery_test(spark, hot_limit):
    hot_limit(15)
    got = idempotency.classify(keyed(spark, requests(7)))
    plan = got._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert exchanges and all("event_id" not in line.split("hashpartitioning")[1] for line in exchanges)


def test_hot_rows_are_not_shuffled_for_their_first_request(spark, hot_limit):
    hot_limit(15)
    df = keyed(spark, requests(7))
    plan = idempotency.with_first(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert df.filter(F.col("key_hash").isNull()).isEmpty()


@pytest.mark.parametrize("limit", [None, 2], ids=["cold", "hot"])
def test_a_request_delivered_again_is_a_replay(spark, hot_limit, limit):
    if limit:
        hot_limit(limit)
    row = (1, "000000000001", "n", "e", "p", "CRM", None, START, START + timedelta(minutes=20))
    later = (2, *row[1:7], START + timedelta(minutes=5), START + timedelta(minutes=30))
    got = idempotency.classify(keyed(spark, [row, row, later]))
    assert sorted((r.event_id, r.result) for r in got.collect()) == [(1, "HIT"), (1, "MISS"), (2, "HIT")]
    assert idempotency.accepted(got).count() == 1
    stored = idempotency.keys_table(keyed(spark, [row]))
    again = idempotency.classify(keyed(spark, [row, later]), stored=stored)
    assert {r.result for r in again.collect()} == {"HIT"}


def test_rejected_requests_are_not_cleaned(spark):
    plan = ingest.valid_requests(spark.createDataFrame([], SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("reflect") < plan.index("Filter")
