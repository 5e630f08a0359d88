import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from goldrec.config import FieldRule, MasteringConfig
from goldrec.operators import golden
from goldrec.plans.chunks import assign_chunks
from goldrec.plans.skew import find_hot_keys
from tests import brute

TRUSTED = FieldRule("TRUSTED_SOURCE", trusted=("BANK", "GOVERNMENT"))
CONFIGS = {
    "default": MasteringConfig(),
    "field provenance": MasteringConfig(provenance="field"),
    "processing clock": MasteringConfig(clock="processing"),
    "trusted email, latest phone": MasteringConfig()
    .with_rule("email", TRUSTED)
    .with_rule("phone", FieldRule("LATEST_UPDATE")),
    "append": MasteringConfig().with_rule(
        "phone", FieldRule("MERGE", merge_type="APPEND", max_values=4)
    ),
    "keep first": MasteringConfig()
    .with_rule("name", FieldRule("NON_NULL"))
    .with_rule("email", FieldRule("MOST_FREQUENT"))
    .with_rule("phone", FieldRule("MERGE", max_values=2)),
}


def frame(spark, rows):
    return spark.createDataFrame(rows, brute.EVENT_SCHEMA).repartition(4)


def golden_rows(df):
    return {
        r.national_id: (
            r.name,
            r.email,
            tuple(r.phones),
            r.version,
            r.created_at,
            r.updated_at,
            r.last_source_system,
        )
        for r in df.collect()
    }


def expected(rows, cfg, states=None):
    return {k: brute.as_row(s) for k, s in brute.fold(rows, cfg, states)[0].items()}


@pytest.mark.parametrize("limit", [None, 30], ids=["cold", "hot"])
@pytest.mark.parametrize("name", CONFIGS)
def test_golden_equals_event_by_event_fold(spark, hot_limit, name, limit):
    if limit:
        hot_limit(limit)
    for seed in (1,) if limit else (1, 2):
        rows = brute.events(seed)
        got = golden_rows(golden.golden_record(frame(spark, rows), CONFIGS[name]))
        assert got == expected(rows, CONFIGS[name])


@pytest.mark.parametrize("limit", [None, 30], ids=["cold", "hot"])
@pytest.mark.parametrize("name", CONFIGS)
def test_trace_equals_event_by_event_fold(spark, hot_limit, name, limit):
    if limit:
        hot_limit(limit)
    cfg, rows = CONFIGS[name], brute.events(3)
    trace = golden.golden_trace(frame(spark, rows), cfg)
    got = {
        r.event_id: (r.name_after, r.email_after, tuple(r.phones_after), r.version)
        for r in trace.collect()
    }
    _, steps = brute.fold(rows, cfg)
    assert got == {e: brute.as_row(s)[:4] for _, e, s in steps}
    conflicts = golden.field_conflicts(trace, cfg)
    found = sorted((r.event_id, r.field_name) for r in conflicts.collect())
    assert found == sorted((e, f) for _, e, s in steps for f in s["conflicts"])


@pytest.mark.parametrize("limit", [None, 20], ids=["cold", "hot"])
@pytest.mark.parametrize("name", ["default", "trusted email, latest phone", "keep first"])
def test_upsert_goes_on_from_the_snapshot_even_with_late_events(spark, hot_limit, name, limit):
    """The second batch is not later than the first: its late events must lose
    where time decides, as in arrival order."""
    cfg, rows = CONFIGS[name], brute.events(4)
    first, second = rows[:250], rows[250:]
    if limit:
        hot_limit(limit)
    snapshot = golden.golden_record(frame(spark, first), cfg)
    got = golden_rows(golden.golden_upsert(snapshot, frame(spark, second), cfg))
    states, _ = brute.fold(first, cfg)
    assert got == expected(second, cfg, states)


@pytest.mark.parametrize("clock", ["event", "processing"])
def test_golden_from_trace_is_the_golden_record(spark, clock):
    df, cfg = frame(spark, brute.events(5)), MasteringConfig(clock=clock)
    whole = golden.golden_record(df, cfg).select(*golden.GOLDEN_COLUMNS)
    traced = golden.golden_from_trace(golden.golden_trace(df, cfg))
    assert whole.exceptAll(traced).isEmpty() and traced.exceptAll(whole).isEmpty()


def one_customer(spark, *events):
    """Events (source, name, email, phone) one second apart."""
    rows = [
        (i, "123456789012", name, email, phone, source, brute.START + i * (brute.timedelta(seconds=1)), None)
        for i, (source, name, email, phone) in enumerate(events)
    ]
    return golden.golden_record(spark.createDataFrame(rows, brute.EVENT_SCHEMA)).first()


def test_later_email_wins(spark):
    row = one_customer(
        spark, ("CRM", "John Doe", "john@old.com", None), ("BANK", "John Doe", "john@new.com", None)
    )
    assert row.email == "john@new.com" and row.version == 2


def test_trusted_name_is_kept_once_but_not_twice(spark):
    crm, bank, web = (
        ("CRM", "John Michael Doe", None, None),
        ("BANK", "J. Doe", None, None),
        ("WEB", "Johnny", None, None),
    )
    assert one_customer(spark, crm, bank).name == "John Michael Doe"
    assert one_customer(spark, crm, bank, web).name == "Johnny"


def test_phones_keep_order_and_the_newest_five(spark):
    def phones(*names):
        return one_customer(spark, *(("WEB", None, None, n) for n in names)).phones

    assert phones("1", "2", "3") == ["1", "2", "3"]
    assert phones(*"123456") == list("23456")
    assert phones(*"1234561") == list("34561")
    assert phones("1", None, " ", "1") == ["1"]
    assert phones('["1","1"]', "2") == ["1", "2"]
    assert phones('["1","2","3","4","5","6"]') == list("123456")
    assert phones("[broken", "2") == ["[broken", "2"]


def test_unknown_settings_are_refused():
    for make in (
        lambda: FieldRule("NEWEST"),
        lambda: FieldRule("MERGE", merge_type="ZIP"),
        lambda: FieldRule("MERGE", max_values=0),
        lambda: MasteringConfig(clock="wall"),
        lambda: MasteringConfig(provenance="cell"),
        lambda: MasteringConfig().with_rule("name", FieldRule("MERGE")),
    ):
        with pytest.raises(ValueError):
            make()
    assert MasteringConfig(fields={}).rule("name") == FieldRule("LATEST_UPDATE")


CASES = [
    # strategy, trusted, incoming source, seconds later, incoming wins
    ("LATEST_UPDATE", (), "WEB", 5, True),
    ("LATEST_UPDATE", (), "WEB", -5, False),
    ("LATEST_UPDATE", (), "WEB", 0, True),
    ("TRUSTED_SOURCE", ("BANK", "GOVERNMENT"), "BANK", 5, True),
    ("TRUSTED_SOURCE", ("BANK", "GOVERNMENT"), "BANK", -5, True),
    ("TRUSTED_SOURCE", ("CRM",), "WEB", 5, False),
    ("TRUSTED_SOURCE", ("CRM", "BANK"), "BANK", 5, True),
    ("TRUSTED_SOURCE", ("CRM", "BANK"), "BANK", 0, False),
    ("TRUSTED_SOURCE", ("GOVERNMENT",), "WEB", 5, True),
    ("TRUSTED_SOURCE", (), "WEB", 0, False),
    ("MOST_FREQUENT", (), "WEB", 5, False),
    ("NON_NULL", (), "WEB", 5, False),
]


@pytest.mark.parametrize("strategy,trusted,source,later,wins", CASES)
def test_one_conflict(spark, strategy, trusted, source, later, wins):
    """Current value from CRM; the snapshot stands for the earlier event."""
    rule = FieldRule(strategy, trusted=trusted)
    cfg = MasteringConfig().with_rule("email", rule)
    at = brute.START
    old = [(1, "123456789012", None, "a", None, "CRM", at, at)]
    new = [(2, "123456789012", None, "b", None, source, at + brute.timedelta(seconds=later), at)]
    snapshot = golden.golden_record(spark.createDataFrame(old, brute.EVENT_SCHEMA), cfg)
    row = golden.golden_record(spark.createDataFrame(new, brute.EVENT_SCHEMA), cfg, snapshot).first()
    assert row.email == ("b" if wins else "a")


def test_phone_chunks_settle_for_stubborn_sequences(spark, hot_limit):
    """Cycles of cap + 1 phones: every event evicts the phone that comes next."""
    hot_limit(9)
    cfg = MasteringConfig().with_rule("phone", FieldRule("MERGE", max_values=3))
    cycle = itertools.cycle("abcd")
    at = brute.START
    rows = [
        (i, "123456789012", None, None, next(cycle), "WEB", at + brute.timedelta(seconds=i), at)
        for i in range(101)
    ]
    got = golden_rows(golden.golden_record(spark.createDataFrame(rows, brute.EVENT_SCHEMA), cfg))
    assert got == expected(rows, cfg)


def test_most_frequent_takes_the_first_on_a_tie(spark):
    at = brute.START
    rows = [
        (i, "123456789012", n, None, None, "WEB", at + brute.timedelta(seconds=i), at)
        for i, n in enumerate(["b", "a", "a", "b", "c", None])
    ]
    row = golden.most_frequent(spark.createDataFrame(rows, brute.EVENT_SCHEMA), "name").first()
    assert (row.name, row.seen) == ("b", 5)


def test_mastered_events_say_created_once(spark):
    trace = golden.golden_trace(frame(spark, brute.events(7)))
    out = golden.mastered_events(trace)
    created = out.filter("action = 'CREATED'").groupBy("national_id").count()
    assert created.filter("count <> 1").isEmpty()
    assert out.select("event_id").distinct().count() == trace.count()
    assert created.count() == trace.select("national_id").distinct().count()


def test_conflict_counts_list_every_strategy(spark):
    trace = golden.golden_trace(frame(spark, brute.events(8)))
    counts = {r.strategy: r.n for r in golden.conflicts_by_strategy(golden.field_conflicts(trace)).collect()}
    assert counts["NON_NULL"] == 0 and counts["MERGE"] > 0 and len(counts) == 5
    log = golden.conflict_log(golden.field_conflicts(trace))
    assert log.filter(~F.col("national_id").startswith("***")).isEmpty()


@pytest.mark.parametrize("limit", [None, 2], ids=["cold", "hot"])
def test_a_repeat_after_a_list_over_the_cap_counts(spark, hot_limit, limit):
    """The first event's list is not cut, so it may be longer than the cap; the next
    event cuts it and may cut the phone it brings, and a repeat brings that back."""
    if limit:
        hot_limit(limit)
    at = [brute.START + brute.timedelta(seconds=10 * i) for i in range(12)]
    lists = {
        "A": [json.dumps(list("abcdefg")), "a", "a", "a"],
        "B": [json.dumps(list("abcdefg")), "a", None, "a", "b", "a"],
        "C": ["x", "x", json.dumps(list("abcdefgh")), "x", "x", "x", "c", "c", "c", "x"],
        "D": [None, json.dumps(list("abcdef")), "a", json.dumps(["a"]), "a", "f", "a"],
    }
    rows = [
        (100 * k + i, f"0000-0000000{key}", "n", None, phone, "CRM", at[i], at[i])
        for k, (key, phones) in enumerate(lists.items())
        for i, phone in enumerate(phones)
    ]
    cfg = MasteringConfig()
    got = golden_rows(golden.golden_record(frame(spark, rows), cfg))
    assert got == expected(rows, cfg)
    assert got["00000000000A"][2] == ("d", "e", "f", "g", "a")
    last = {}
    for r in golden.golden_trace(frame(spark, rows), cfg).orderBy("national_id", "version").collect():
        last[r.national_id] = tuple(r.phones_after)
    assert last == {k: v[2] for k, v in got.items()}


def test_few_phones_settle_at_once_whatever_the_chunks(spark, hot_limit, monkeypatch):
    """Four phones in random order: the list never forgets its first order."""
    hot_limit(20)
    stored, rnd, at = [], random.Random(4), brute.START
    durable = golden.durable
    monkeypatch.setattr(golden, "durable", lambda df, *a: stored.append(a) or durable(df, *a))
    counts = []
    for n in (200, 800):
        rows = [
            (i, "123456789012", None, None, rnd.choice("abcd"), "WEB", at + brute.timedelta(seconds=i), at)
            for i in range(n)
        ]
        stored.clear()
        got = golden_rows(golden.golden_record(spark.createDataFrame(rows, brute.EVENT_SCHEMA)))
        assert got == expected(rows, MasteringConfig())
        counts.append(len(stored))
    assert counts[0] == counts[1] <= 4


@pytest.mark.parametrize("name", ["default", "field provenance", "append", "keep first"])
def test_a_customer_with_all_events_at_one_time(spark, hot_limit, name):
    """Ten times the limit under one key and one timestamp: bounded chunks in order of the
    event id, and the rows of the event-by-event fold."""
    hot_limit(30)
    cfg, rnd, at = CONFIGS[name], random.Random(5), brute.START
    rows = [
        (i, "123456789012", rnd.choice(["a", "b", None]), rnd.choice(["x", "y"]), rnd.choice("0123456"),
         rnd.choice(["CRM", "BANK", "WEB"]), at, at)
        for i in range(300)
    ]
    rows += [(1000 + i, "123456789012", "z", None, None, "CRM", at + brute.timedelta(seconds=i + 1), at) for i in range(40)]
    rows += [(2000 + i, f"{i % 20:012d}", "n", None, "1", "CRM", at, at) for i in range(100)]
    events = golden.prepare(frame(spark, rows))
    chunks = assign_chunks(events, find_hot_keys(events, "national_id", limit=30), "event_ts", then="event_id")
    spans = chunks.groupBy("chunk").agg(F.count("*").alias("n"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    spans = spans.orderBy("chunk").collect()
    assert sum(s.n for s in spans) == 340 and max(s.n for s in spans) < 60 and len(spans) > 5
    assert all(a.hi < b.lo for a, b in zip(spans, spans[1:]))
    assert golden_rows(golden.golden_record(frame(spark, rows), cfg)) == expected(rows, cfg)
    got = {r.event_id: (r.name_after, r.email_after, tuple(r.phones_after), r.version)
           for r in golden.golden_trace(frame(spark, rows), cfg).collect()}
    assert got == {e: brute.as_row(s)[:4] for _, e, s in brute.fold(rows, cfg)[1]}
