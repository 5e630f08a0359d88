"""Stores by key: what is read, what is written, merges, and the name index over them."""

import pathlib

import pytest
from pyspark.sql import functions as F

from goldrec.operators import golden, idempotency, read
from goldrec.plans.durable import durable, work_path
from goldrec.sources import names, store as stores
from goldrec.sources.store import FAN, Store
from goldrec.sources.tables import current_golden, golden_store, upsert_golden
from goldrec.streaming.idem import idem_batch, keys_store
from goldrec.streaming.master import master_batch
from tests import brute
from tests.test_golden import expected, frame, golden_rows
from tests.test_streaming import clean, columns, request


def latest(rows):
    return rows.groupBy("k").agg(F.max_by("v", "v").alias("v"))


def put(spark, store, low, high, batch_id, v=0):
    store.merge(batch_id)
    store.write(spark.range(low, high).select(F.col("id").alias("k"), (F.col("id") + v).alias("v")), batch_id)


def size(root):
    return sum(p.stat().st_size for p in pathlib.Path(root).rglob("*.parquet"))


def test_merges_keep_every_row_and_runs_grow_with_the_logarithm(spark, monkeypatch):
    monkeypatch.setattr(stores, "FAN", 3)
    store = Store(spark, work_path(spark, "store"), "k", "k bigint, v bigint", latest)
    for i in range(11):
        put(spark, store, i, i + 3, i, v=100 * i)
    want = {}
    for i in range(11):
        want.update({k: k + 100 * i for k in range(i, i + 3)})
    assert {r.k: r.v for r in store.rows().collect()} == want
    assert [(r.start, r.end) for r in store._cover(0, None)] == [(0, 9), (9, 10), (10, 11)]
    assert len(store.runs()) <= 9
    # A repeated batch sees what its first run saw, and replaces itself.
    assert store.rows(before=10).count() == 12
    put(spark, store, 10, 11, 10, v=5000)
    assert {r.k: r.v for r in store.rows().collect()}[10] == 5010 and store.rows().count() == 12
    assert store.matching(spark.range(0).withColumnRenamed("id", "k")).count() == 0


def test_a_lookup_reads_the_buckets_of_its_keys_only(spark):
    store = Store(spark, work_path(spark, "store"), "k", "k bigint, v bigint")
    for i in range(FAN + 1):
        put(spark, store, 1000 * i, 1000 * (i + 1), i)
    files = store.rows().inputFiles()
    asked = spark.createDataFrame([(5,), (5,), (8500,), (99999,), (None,)], "k bigint")
    hit = store.matching(asked)
    assert sorted(r.k for r in hit.collect()) == [5, 8500]
    # Four different keys in two runs: at most four buckets of each.
    assert 2 <= len(store.paths(asked)) <= 8 and len(set(hit.inputFiles())) <= 8 < len(files) / 10


def test_rows_without_files_and_unfinished_runs(spark):
    root = work_path(spark, "store")
    store = Store(spark, root, "k", "k string, v bigint")
    assert store.rows().count() == 0 and store.runs() == []
    store.write(store.rows(), 0)
    store.write(spark.createDataFrame([(None, 1), ("", 2), ("x", 3), ("x", 4)], "k string, v bigint"), 1)
    assert sorted(r.v for r in store.rows().collect()) == [1, 2, 3, 4]
    assert sorted(r.v for r in store.matching(spark.createDataFrame([("x",), (None,)], "k string")).collect()) == [3, 4]
    pathlib.Path(root, "run=1-2-16", "_SUCCESS").unlink()
    assert store.rows().count() == 0


def test_a_hot_bucket_is_written_as_several_files(spark):
    store = Store(spark, work_path(spark, "store"), "k", "k string, v string")
    advisory = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(advisory, "64k")
    try:
        rows = spark.range(0, 20000, 1, 8).select(F.lit("hot").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
        store.write(rows, 0)
    finally:
        spark.conf.unset(advisory)
    assert len(store.rows().inputFiles()) > 4 and store.rows().distinct().count() == 20000


def test_upsert_writes_what_the_batch_touches(spark):
    root = work_path(spark, "golden")
    rows = sorted(clean(brute.events(31, count=2000)), key=lambda r: (r[6], r[0]))
    events = frame(spark, rows)
    many = spark.range(20000).select(
        (F.col("id") + 500000).alias("event_id"), F.concat(F.lit("77777"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("national_id"),
        F.lit("n").alias("name"), F.lit(None).cast("string").alias("email"), F.lit("1").alias("phone"),
        F.lit("CRM").alias("source_system"), F.lit(brute.START).cast("timestamp_ntz").alias("event_ts"),
        F.lit(None).cast("timestamp_ntz").alias("processed_at"),
    )
    upsert_golden(spark, root, many.select(*events.columns), 0)
    for i, part in enumerate((rows[:1900], rows[1900:]), 1):
        upsert_golden(spark, root, frame(spark, part), i)
    want = expected(rows, golden.MasteringConfig())
    got = golden_rows(current_golden(spark, root).filter(~F.col("national_id").startswith("77777")))
    assert got == {k: v for k, v in want.items() if not k.startswith("77777")}
    assert current_golden(spark, root).filter(F.col("national_id").startswith("77777")).count() == 20000
    store = golden_store(spark, root)
    first, last = store.runs()[0], store.runs()[-1]
    sizes = [size(f"{root}/golden/{run.folder}") for run in (first, last)]
    assert sizes[1] < sizes[0] / 5, sizes


def test_mastering_over_merges_equals_one_batch(spark, monkeypatch):
    monkeypatch.setattr(stores, "FAN", 2)
    root = work_path(spark, "test")
    rows = sorted(clean(brute.events(33, count=120)), key=lambda r: (r[6], r[0]))
    for i in range(5):
        part = rows[24 * i : 24 * i + 24] + rows[: 5 * i]
        master_batch(columns(frame(spark, part)), i, root)
    assert [(r.start, r.end) for r in golden_store(spark, root)._cover(0, None)] == [(0, 4), (4, 5)]
    assert golden_rows(current_golden(spark, root)) == expected(rows, golden.MasteringConfig())


def test_keys_over_merges_equal_one_batch(spark, monkeypatch):
    monkeypatch.setattr(stores, "FAN", 2)
    schema = (
        "event_id long, national_id string, name string, email string, phone string, "
        "source_system string, client_key string, event_ts timestamp_ntz"
    )
    rows = [request(i, f"k{i * i % 23}" if i % 3 else None, 420 * i, f"12345678{i * i % 7:04}") for i in range(100)]

    def keyed(part):
        return idempotency.with_idem_key(spark.createDataFrame(part, schema))

    def run(parts):
        root = work_path(spark, "keys")
        for i, part in enumerate(parts):
            idem_batch(keyed(part), i, root)
        kept = keys_store(keyed([]), root).rows()
        classes = spark.read.parquet(f"{root}/classified").select("event_id", "result", "expires_at", "first_event_id")
        return sorted(map(tuple, classes.collect())), sorted(map(str, kept.collect()))

    assert run([rows[20 * i : 20 * i + 20] for i in range(5)]) == run([rows])


@pytest.mark.parametrize("text", ["jon", "JON", "n", "ann", "mar", "anna b", "zzz", "", None, "söd", "aaaa"])
def test_indexed_search_equals_a_scan(spark, named, text):
    root, rows = named
    want = read.search_by_name(rows, text, 0, 500).collect()
    got = names.search_indexed(spark, root, text, 0, 500)
    assert got.collect() == want
    assert text in (None, "", "n", "zzz") or want


@pytest.fixture(scope="module")
def named(spark):
    """Golden rows in two batches; the second renames some of the first."""
    root = work_path(spark, "names")
    given = ["Jon", "Anna", "Marianne", "Söder", "aaaaa", "x", None, "Bo JONson", "Anna B"]
    template = {r: F.lit(None).cast(t) for r, t in current_golden(spark, root).dtypes}

    def batch(low, high, shift):
        pick = F.element_at(F.array(*map(F.lit, given)), ((F.col("id") + shift) % len(given) + 1).cast("int"))
        values = {**template, "national_id": F.lpad(F.col("id").cast("string"), 12, "0"), "name": pick, "version": F.lit(shift + 1).cast("bigint")}
        return durable(spark.range(low, high).select(*(c.alias(n) for n, c in values.items())))

    for i, rows in enumerate((batch(0, 300, 0), batch(100, 150, 1))):
        golden_store(spark, root).write(rows, i)
        names.index_names(spark, root, rows, i)
    return root, current_golden(spark, root)


def test_indexed_search_reads_candidates_only(spark):
    root = work_path(spark, "names")
    values = {r: F.lit(None).cast(t) for r, t in current_golden(spark, root).dtypes}
    values |= {"national_id": F.lpad(F.col("id").cast("string"), 12, "0"), "name": F.concat(F.lit("n"), F.sha2(F.col("id").cast("string"), 256)), "version": F.lit(1).cast("bigint")}
    rows = durable(spark.range(2000).select(*(c.alias(n) for n, c in values.items())))
    golden_store(spark, root).write(rows, 0)
    names.index_names(spark, root, rows, 0)
    one = rows.filter("national_id like '%77'").first()
    hits = names.search_indexed(spark, root, one["name"].upper()[:20])
    assert [r.nationalId for r in hits.collect()] == [one.national_id]
    looked_at = {f for f in hits.inputFiles() if "/golden/" in f}
    assert len(looked_at) == 1 < len(current_golden(spark, root).inputFiles())
