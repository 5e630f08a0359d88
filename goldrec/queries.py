"""Every job as a query over the given tables: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from goldrec import config as C
from goldrec.config import FieldRule, MasteringConfig
from goldrec.functions import phones as P
from goldrec.functions import similarity as S
from goldrec.functions import text as T
from goldrec.operators import dedup, dlq, golden, idempotency, ingest, match, read, slo
from goldrec.plans.durable import durable, work_path
from goldrec.plans.skew import hot_rows, spread
from goldrec.sources import fixtures as fx
from goldrec.sources import names, raw_events, requests, tables
from goldrec.sources.snapshot import folder_state, golden_snapshot
from goldrec.streaming import jobs as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LONG_TTL = 24
AS_OF = "2024-01-31 00:00:00"
SPLIT_AT = "2024-01-16 00:00:00"


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


# ---- shared inputs --------------------------------------------------------


def _valid(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.valid_requests(fx.requests(spark, sf))


def _keyed(spark: SparkSession, sf: str, factor: int = 1) -> DataFrame:
    return idempotency.with_idem_key(_valid(spark, sf), factor)


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """The stored table behind the requests: it bounds their number."""
    return fx.table(spark, sf, "events")


def _stored_if_large(rows: DataFrame, bound: DataFrame, name: str) -> DataFrame:
    """Rows that hot keys are sought among are read more than once: they are made once."""
    return durable(rows, name) if bound.count() > hot_rows(rows.sparkSession) else rows


def _classified(spark: SparkSession, sf: str, factor: int = 1, in_flight: bool = False) -> DataFrame:
    keyed = _stored_if_large(_keyed(spark, sf, factor), _events(spark, sf), "keyed")
    return idempotency.classify(keyed, in_flight, bound=_events(spark, sf))


def _accepted(spark: SparkSession, sf: str) -> DataFrame:
    return idempotency.accepted(_classified(spark, sf))


def _sized(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Accepted events and the requests that they are among, to seek hot customers in."""
    source = _events(spark, sf)
    keyed = _stored_if_large(_keyed(spark, sf), source, "keyed")
    return idempotency.accepted(idempotency.classify(keyed, bound=source)), keyed


def _golden(
    spark: SparkSession,
    sf: str,
    cfg: MasteringConfig = MasteringConfig(),
    sized: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    events, keyed = sized or _sized(spark, sf)
    return golden.golden_record(events, cfg, sizes=keyed, bound=_events(spark, sf))


_SNAPSHOTS: dict[tuple, DataFrame] = {}


def _snapshot(spark: SparkSession, sf: str, sized: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The golden table as the read side sees it: written once per application and
    state of the folder. ``sized``: see ``_sized``, where it is at hand."""
    key = spark.sparkContext.applicationId, sf, folder_state(spark, sf)
    if key not in _SNAPSHOTS:
        _SNAPSHOTS[key] = golden_snapshot(_golden(spark, sf, sized=sized))
    return _SNAPSHOTS[key]


def _trace(spark: SparkSession, sf: str, cfg: MasteringConfig = MasteringConfig()) -> DataFrame:
    events, keyed = _sized(spark, sf)
    return golden.golden_trace(events, cfg, sizes=keyed, bound=_events(spark, sf))


def _conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return golden.field_conflicts(_trace(spark, sf))


def _failed(spark: SparkSession, sf: str) -> DataFrame:
    """Errors with the event that failed. Some originals lack their id or source. Messages
    may be long: the sides are joined without them, and the work on them is spread."""
    original = fx.requests(spark, sf).select(
        "event_id",
        F.struct(
            F.col("event_id").cast("string").alias("eventId"),
            F.when(F.col("event_id") % 17 != 0, F.col("national_id")).alias("nationalId"),
            "name",
            "email",
            "phone",
            F.when(F.col("event_id") % 19 == 0, " ")
            .otherwise(F.col("source_system"))
            .alias("sourceSystem"),
            F.col("event_ts").alias("timestamp"),
        ).alias("original_event"),
    )
    return fx.with_message(spread(fx.short_errors(spark, sf).join(original, "event_id"), "event_id"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each incoming contact beside the golden contact it was derived from."""
    incoming = match.with_profile(fx.incoming_contacts(spark, sf))
    known = match.with_profile(fx.golden_contacts(spark, sf))

    def side(df: DataFrame, row_id: str, prefix: str) -> DataFrame:
        df = df.withColumns(match.name_parts())
        fields = ("email", "name", "phone", "first_name", "last_name")
        return df.select(row_id, *(F.col(f).alias(f"{prefix}_{f}") for f in fields))

    left = side(incoming, "incoming_id", "in").withColumn(
        "national_id", F.lpad(F.substring("incoming_id", 4, 20), 12, "0")
    )
    return left.join(side(known, "national_id", "gold"), "national_id")


def _score(spark: SparkSession, sf: str, name: str, value: Column) -> DataFrame:
    return _pairs(spark, sf).select("incoming_id", "national_id", F.round(value, 6).alias(name))


def _both(field: str) -> tuple[Column, Column]:
    return F.col(f"in_{field}"), F.col(f"gold_{field}")


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return match.scored_pairs(fx.incoming_contacts(spark, sf), fx.golden_contacts(spark, sf))


def _golden_out(df: DataFrame) -> DataFrame:
    """Golden rows with the phone list as text."""
    cols = [c for c in golden.GOLDEN_COLUMNS if c != "phones"]
    return df.select(*cols, P.serialize_phones(F.col("phones")).alias("phone_json"))


# ---- sources and sinks ----------------------------------------------------


@query
def src_requests(spark, sf):
    bodies = fx.requests(spark, sf).select(
        "event_id", "client_key", "event_ts", requests.to_body().alias("body")
    )
    return requests.parse_requests(bodies)


@query
def src_raw_events(spark, sf):
    return raw_events.parse_raw(raw_events.raw_records(_accepted(spark, sf)))


@query
def sink_raw_events(spark, sf):
    records = raw_events.raw_records(_accepted(spark, sf))
    header = F.col("headers")
    return records.select(
        "key",
        F.get_json_object("value", "$.eventId").alias("event_id"),
        F.get_json_object("value", "$.name").alias("name"),
        F.get_json_object("value", "$.metadata.enrichmentStatus").alias("enrichment"),
        F.size(header).alias("n_headers"),
        header[1]["value"].alias("idempotency_header"),
        header[4]["value"].alias("version"),
    )


@query
def raw_audit(spark, sf):
    rows = raw_events.raw_audit(_accepted(spark, sf))
    payload_email = F.get_json_object("raw_payload", "$.email")
    return rows.select(*(c for c in rows.columns if c != "raw_payload"), payload_email.alias("payload_email"))


@query
def mastered_events(spark, sf):
    return golden.mastered_events(_trace(spark, sf))


@query
def sink_dlq(spark, sf):
    records = dlq.dlq_records(dlq.dlq_events(_failed(spark, sf)))
    value = F.from_json("value", dlq.VALUE_PARTS)  # one pass over a long text
    return records.withColumn("parts", value).select(
        "key",
        "error_type",
        "header_count",
        F.col("parts.originalEvent.eventId").alias("event_id"),
        F.col("parts.errorDetails.exception").alias("exception"),
        F.col("parts.schemaVersion").alias("schema_version"),
        F.col("headers")[3]["value"].alias("message_header"),
    )


@query
def conflict_log(spark, sf):
    return golden.conflict_log(_conflicts(spark, sf))


# ---- column transforms ----------------------------------------------------


def _column(name: str, value: Callable[[], Column], source=fx.requests) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = source(spark, sf)
        return rows.select(rows.columns[0], value().alias(name))

    QUERIES[name] = run


_column("norm_national_id", lambda: T.norm_national_id(F.col("national_id"), blank_to_null=True))
_column("norm_text", lambda: T.norm_text(F.concat(F.lit("\t Zoë "), F.col("name"))))
_column("norm_source", lambda: T.norm_source(F.col("source_system")))
_column("norm_email", lambda: T.norm_email(F.col("email")), fx.incoming_contacts)
_column("norm_name", lambda: T.norm_name(F.col("name")))
_column("norm_phone", lambda: T.norm_phone(F.col("phone")), fx.incoming_contacts)
_column("mask_national_id", lambda: T.mask_national_id(F.col("national_id")))
_column("mask_key", lambda: T.mask_key(F.col("client_key")))
_column("det_key", lambda: T.det_key(F.col("national_id"), F.col("source_system")))
_column("client_key_hash", lambda: T.client_key_hash(F.col("client_key")))
_column("serialize_phones", lambda: P.serialize_phones(P.parse_phones(F.col("phone"))))
_column("truncate_msg", lambda: T.truncate_text(F.col("message"), dlq.MESSAGE_CHARS), fx.errors)


@query
def parse_phones(spark, sf):
    """One row per phone; every third request gives its phone as a JSON list."""
    text = F.when(
        F.col("event_id") % 3 == 0, F.concat(F.lit('["'), F.col("phone"), F.lit('","+1-555-0000"]'))
    ).otherwise(F.col("phone"))
    rows = fx.requests(spark, sf).select("event_id", P.parse_phones(text).alias("p"))
    return rows.select("event_id", F.posexplode("p").alias("position", "phone"))


@query
def names_match(spark, sf):
    return _pairs(spark, sf).select(
        "incoming_id", T.names_match(F.col("in_name"), F.col("gold_name")).alias("names_match")
    )


# ---- validation -----------------------------------------------------------


@query
def valid_requests(spark, sf):
    return _valid(spark, sf)


@query
def invalid_requests(spark, sf):
    return ingest.invalid_requests(fx.requests(spark, sf))


@query
def require_national_id(spark, sf):
    """Mastering input whose id is blank in every 13th event: the events to reject."""
    events = _valid(spark, sf).withColumn(
        "national_id", F.when(F.col("event_id") % 13 == 0, " ").otherwise(F.col("national_id"))
    )
    rejected = dlq.mastering_errors(events)
    return rejected.select("event_id", "error_type", "error_message")


@query
def validation_summary(spark, sf):
    return ingest.validation_summary(fx.requests(spark, sf))


# ---- idempotency ----------------------------------------------------------


@query
def idem_key(spark, sf):
    return _keyed(spark, sf).select("event_id", "key_type", "key_hash", "ttl_hours")


def _classes(df: DataFrame) -> DataFrame:
    return df.select("event_id", "key_hash", "first_event_id", "expires_at", "result")


@query
def idem_classify(spark, sf):
    return _classes(_classified(spark, sf))


@query
def idem_classify_long_ttl(spark, sf):
    return _classes(_classified(spark, sf, LONG_TTL))


@query
def idem_accepted(spark, sf):
    return idempotency.replies(_classified(spark, sf, LONG_TTL))


@query
def idem_keys_table(spark, sf):
    """Keys of the later requests that the earlier ones have not stored."""
    keyed = _keyed(spark, sf)
    split = F.lit(SPLIT_AT).cast("timestamp_ntz")
    stored = idempotency.keys_table(keyed.filter(F.col("event_ts") < split))
    fresh = idempotency.keys_table(keyed.filter(F.col("event_ts") >= split), stored)
    return stored.unionByName(fresh)


@query
def idem_rearm(spark, sf):
    return idempotency.rearmed(_keyed(spark, sf, LONG_TTL))


@query
def idem_stream(spark, sf):
    return _classes(streams.run_idem_stream(spark, _keyed(spark, sf, LONG_TTL)))


@query
def ingest_stream(spark, sf):
    """Replies to all requests, valid or not, from the ingestion job."""
    replies, _ = streams.run_ingest_stream(spark, fx.requests(spark, sf).drop("done_ts"), ttl_factor=LONG_TTL)
    return replies.withColumn("event_id", F.col("event_id").cast("string"))


@query
def ingest_stream_events(spark, sf):
    """The raw events that the ingestion job published."""
    _, events = streams.run_ingest_stream(spark, fx.requests(spark, sf).drop("done_ts"), ttl_factor=LONG_TTL)
    return events


@query
def idem_rearm_stream(spark, sf):
    return streams.run_rearm_stream(spark, _keyed(spark, sf, LONG_TTL))


@query
def idem_stats(spark, sf):
    return idempotency.idem_stats(_classified(spark, sf, LONG_TTL))


@query
def idem_in_flight(spark, sf):
    return _classes(_classified(spark, sf, LONG_TTL, in_flight=True))


# ---- raw-event dedup ------------------------------------------------------


@query
def dedup_event_id(spark, sf):
    """Deliveries, every seventh event twice, against the events stored before."""
    events = durable(_accepted(spark, sf), "raw")
    deliveries = fx.with_copies(events, 7)
    stored = events.filter(F.col("event_ts") < F.lit("2024-01-08").cast("timestamp_ntz"))
    return dedup.dedup_event_id(deliveries, stored).select("event_id", "national_id", "event_ts")


@query
def duplicates_by_customer(spark, sf):
    return dedup.duplicates_by_customer(_accepted(spark, sf)).select(
        "event_id", "national_id", "is_duplicate"
    )


# ---- golden record --------------------------------------------------------


@query
def golden_record(spark, sf):
    return _golden_out(_golden(spark, sf))


@query
def golden_upsert(spark, sf):
    """The first half of the month as snapshot, the second half merged into it."""
    events = durable(_accepted(spark, sf), "raw")
    split = F.lit(SPLIT_AT).cast("timestamp_ntz")
    early = events.filter(F.col("event_ts") < split)
    snapshot = durable(golden.golden_record(early, bound=events), "golden")
    return _golden_out(golden.golden_upsert(snapshot, events.filter(F.col("event_ts") >= split)))


@query
def golden_upsert_stored(spark, sf):
    """The same two halves as two batches of a stored golden table."""
    root = work_path(spark, "golden-store")
    events = durable(_accepted(spark, sf), "raw")
    split = F.lit(SPLIT_AT).cast("timestamp_ntz")
    tables.upsert_golden(spark, root, events.filter(F.col("event_ts") < split), 0)
    tables.upsert_golden(spark, root, events.filter(F.col("event_ts") >= split), 1)
    return _golden_out(tables.current_golden(spark, root))


@query
def golden_trace(spark, sf):
    return _trace(spark, sf).select(
        "national_id",
        "event_id",
        "version",
        "action",
        F.col("name_after").alias("name"),
        F.col("email_after").alias("email"),
        P.serialize_phones(F.col("phones_after")).alias("phone_json"),
    )


@query
def field_conflicts(spark, sf):
    return _conflicts(spark, sf)


@query
def pre_rules(spark, sf):
    return golden.pre_rules(_trace(spark, sf))


def _resolved(strategy: str, **options) -> Query:
    rule = FieldRule(strategy, **options)
    cfg = MasteringConfig().with_rule("name", rule).with_rule("email", rule)

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _golden(spark, sf, cfg).select("national_id", "name", "email", "version")

    return run


QUERIES["resolve_latest_update"] = _resolved("LATEST_UPDATE")
QUERIES["resolve_trusted_source"] = _resolved("TRUSTED_SOURCE", trusted=("BANK", "GOVERNMENT"))
QUERIES["resolve_most_frequent"] = _resolved("MOST_FREQUENT")
QUERIES["resolve_non_null"] = _resolved("NON_NULL")


@query
def resolve_most_frequent_mode(spark, sf):
    return golden.most_frequent(_accepted(spark, sf), "name")


@query
def resolve_merge(spark, sf):
    """Phone lists capped at three."""
    rule = FieldRule("MERGE", merge_type="UNION", max_values=3)
    rows = _golden(spark, sf, MasteringConfig().with_rule("phone", rule))
    return rows.select("national_id", P.serialize_phones(F.col("phones")).alias("phone_json"))


@query
def strategy_config(spark, sf):
    """Golden names and e-mails where an unlisted field falls back to the default."""
    cfg = MasteringConfig(
        fields={"phone": FieldRule("LATEST_UPDATE"), "name": FieldRule("TRUSTED_SOURCE")},
        default=FieldRule("NON_NULL"),
    )
    rows = _golden(spark, sf, cfg)
    phone = P.serialize_phones(F.col("phones")).alias("phone_json")
    return rows.select("national_id", "name", "email", phone)


@query
def golden_field_provenance(spark, sf):
    cfg = MasteringConfig(provenance="field")
    return _golden(spark, sf, cfg).select("national_id", "name", "version")


@query
def golden_processing_clock(spark, sf):
    """The processing clock: an event is compared with the end of the one before."""
    events = _accepted(spark, sf).withColumn("processed_at", F.col("done_ts"))
    cfg = MasteringConfig(clock="processing")
    rows = golden.golden_record(events, cfg, sizes=_valid(spark, sf), bound=_events(spark, sf))
    return rows.select("national_id", "name", "email", "updated_at")


@query
def conflicts_by_strategy(spark, sf):
    return golden.conflicts_by_strategy(_conflicts(spark, sf))


@query
def master_stream(spark, sf):
    return _golden_out(streams.run_master_stream(spark, _accepted(spark, sf)))


# ---- matching -------------------------------------------------------------


@query
def match_members(spark, sf):
    """Every contact beside the one that stands for it and its copies in the matches."""

    def of(contacts: DataFrame, row_id: str, side: str) -> DataFrame:
        rows = match.match_members(contacts, row_id)
        return rows.select(F.col(row_id).alias("contact"), "representative", F.lit(side).alias("side"))

    incoming = of(fx.incoming_contacts(spark, sf), "incoming_id", "incoming")
    return incoming.unionByName(of(fx.golden_contacts(spark, sf), "national_id", "golden"))


@query
def match_email_exact(spark, sf):
    return match.match_email_exact(fx.incoming_contacts(spark, sf), fx.golden_contacts(spark, sf))


@query
def levenshtein(spark, sf):
    return _score(spark, sf, "edits", F.levenshtein(*_both("name")))


@query
def soundex_ref(spark, sf):
    rows = fx.golden_contacts(spark, sf)
    last = F.element_at(F.split(F.col("name"), r"\s+"), -1)
    return rows.select("national_id", S.sound_code(T.norm_name(last)).alias("code"))


@query
def score_email(spark, sf):
    return _score(spark, sf, "score", S.score_email(*_both("email")))


@query
def score_email_gmail(spark, sf):
    return _score(spark, sf, "score", S.score_email_gmail(*_both("email")))


@query
def score_name(spark, sf):
    return _score(spark, sf, "score", S.score_name(*_both("name")))


@query
def score_phonetic(spark, sf):
    value = S.score_phonetic(*_both("first_name"), *_both("last_name"))
    return _score(spark, sf, "score", value)


@query
def score_nickname(spark, sf):
    return _score(spark, sf, "score", S.score_nickname(*_both("first_name")))


@query
def score_phone(spark, sf):
    return _score(spark, sf, "score", S.score_phone(*_both("phone")))


@query
def match_candidates(spark, sf):
    pairs = match.match_candidates(fx.incoming_contacts(spark, sf), fx.golden_contacts(spark, sf))
    return pairs.select("incoming_id", "national_id", "in_copies", "gold_copies")


@query
def match_score(spark, sf):
    names = ("email_score", "name_score", "phone_score", "phonetic_score")
    return _scored(spark, sf).select(
        "incoming_id", "national_id", *(F.round(n, 6).alias(n) for n in names), "score", "matched_rules"
    )


@query
def match_classify(spark, sf):
    return match.match_classify(_scored(spark, sf)).select("incoming_id", "national_id", "match_type")


@query
def best_match(spark, sf):
    incoming = fx.incoming_contacts(spark, sf)
    return match.best_match(incoming, *match.placed_pairs(incoming, fx.golden_contacts(spark, sf)))


@query
def review_queue(spark, sf):
    return match.review_queue(_scored(spark, sf))


# ---- read side ------------------------------------------------------------


@query
def list_customers(spark, sf):
    return read.list_customers(_snapshot(spark, sf), page=1, size=20)


@query
def list_customers_by_name(spark, sf):
    return read.list_customers(_snapshot(spark, sf), page=2, size=25, sort="name", descending=False)


@query
def customers_after(spark, sf):
    """The second page of the default order, from the last row of the first one."""
    snapshot = _snapshot(spark, sf)
    last = snapshot.orderBy(F.desc("updated_at"), "national_id").limit(20).select("updated_at", "national_id").tail(1)
    after = last[0] if last else (None, "")
    return read.customers_after(snapshot, *after, size=20)


@query
def customer_by_id(spark, sf):
    return read.customer_by_id(_snapshot(spark, sf), golden.golden_id(F.lit("000000000008")))


@query
def customer_by_national_id(spark, sf):
    return read.customer_by_national_id(_snapshot(spark, sf), " 0000-00000008")


@query
def customers_by_national_ids(spark, sf):
    wanted = fx.incoming_contacts(spark, sf).select(
        F.lpad(F.substring("incoming_id", 4, 20), 12, "0").alias("national_id")
    )
    return read.customers_by_national_ids(_snapshot(spark, sf), wanted)


@query
def search_by_name(spark, sf):
    return read.search_by_name(_snapshot(spark, sf), "JON", page=0, size=50)


@query
def search_by_name_indexed(spark, sf):
    root = work_path(spark, "names")
    rows = _snapshot(spark, sf)
    tables.golden_store(spark, root).write(rows, 0)
    names.index_names(spark, root, rows, 0)
    return names.search_indexed(spark, root, "JON", page=0, size=50)


@query
def exists_by_national_id(spark, sf):
    wanted = fx.golden_contacts(spark, sf).select("national_id")
    return read.exists_by_national_ids(_snapshot(spark, sf), wanted)


@query
def customer_count(spark, sf):
    return read.customer_count(_snapshot(spark, sf))


@query
def read_model(spark, sf):
    return read.read_model(_snapshot(spark, sf))


@query
def table_row_counts(spark, sf):
    sized = _sized(spark, sf)
    return read.table_row_counts(sized[0], _snapshot(spark, sf, sized))


# ---- dead letters ---------------------------------------------------------


@query
def classify_error(spark, sf):
    return dlq.with_error_type(fx.errors(spark, sf)).select("event_id", "error_type", "disposition")


@query
def retryable(spark, sf):
    return dlq.with_error_type(fx.errors(spark, sf)).select("event_id", "retryable")


@query
def dlq_events(spark, sf):
    rows = dlq.dlq_events(_failed(spark, sf))
    entry = F.col("processing_history")[0]
    return rows.select(
        "event_id",
        "error_type",
        F.col("original_event.nationalId").alias("national_id"),
        F.col("original_event.sourceSystem").alias("source_system"),
        F.col("error_details.exception").alias("exception"),
        F.col("error_details.message").alias("message"),
        F.size("processing_history").alias("history_size"),
        entry["attempt"].alias("attempt"),
        entry["timestamp"].alias("failed_at"),
        entry["error"].alias("history_error"),
        "schema_version",
    )


@query
def mastering_errors(spark, sf):
    """Events with blank ids and over-long names mixed in."""
    e = F.col("event_id")
    events = fx.requests(spark, sf).withColumns(
        {
            "national_id": F.when(e % 13 == 0, F.lit(None).cast("string"))
            .when(e % 13 == 1, "\t ")
            .otherwise(F.col("national_id")),
            "name": F.when(e % 10 == 0, F.repeat(F.lit("name"), 60 + e % 9)).otherwise(F.col("name")),
        }
    )
    return dlq.mastering_errors(events).select("event_id", "error_type")


@query
def dlq_reprocess(spark, sf):
    return dlq.reprocess(dlq.dlq_records(dlq.dlq_events(_failed(spark, sf))))


@query
def dlq_counts(spark, sf):
    return dlq.dlq_counts(dlq.with_error_type(fx.errors(spark, sf)))


@query
def dlq_rate(spark, sf):
    return dlq.dlq_rate(fx.processing_log(spark, sf))


@query
def dlq_alerts(spark, sf):
    return dlq.dlq_alerts(fx.processing_log(spark, sf))


@query
def retry_schedule(spark, sf):
    return dlq.retry_schedule(fx.errors(spark, sf))


# ---- service levels -------------------------------------------------------


def _log_query(name: str, run: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf: run(fx.processing_log(spark, sf))


_log_query("sli_totals", slo.sli_totals)
_log_query("duplicate_rate", slo.duplicate_rate)
_log_query("error_rate", slo.error_rate)
_log_query("latency_histogram", slo.latency_histogram)
_log_query(
    "lookup_latency_histogram",
    lambda log: slo.latency_histogram(log, C.LOOKUP_BUCKETS_MS),
)
_log_query("latency_quantiles", lambda log: slo.latency_quantiles(log, "1 hour"))
_log_query(
    "latency_quantiles_sketched",
    lambda log: slo.sketch_quantiles(durable(slo.latency_sketches(log), "sketches"), "1 day"),
)
_log_query("slo_status", slo.slo_status)
_log_query("slo_by_window", slo.slo_by_window)
_log_query(
    "processing_health",
    lambda log: slo.processing_health(log, F.lit(AS_OF).cast("timestamp_ntz")),
)
_log_query("event_rate", slo.event_rate)
_log_query("golden_rate", slo.golden_rate)
_log_query("dup_rate_window", slo.dup_rate_window)
_log_query("error_rate_window", slo.error_rate_window)
_log_query("slo_latency_compliance", slo.slo_latency_compliance)
_log_query("slo_availability", slo.slo_availability)
_log_query("alert_error_rate", slo.alert_error_rate)
_log_query(
    "alert_latency",
    lambda log: slo.alert_latency(log.withColumn("latency_ms", F.col("latency_ms") * 5)),
)
_log_query("alert_dup_anomaly", lambda log: slo.alert_dup_anomaly(log, min_rate=0.0))
_log_query("alert_dup_anomaly_under_load", slo.alert_dup_anomaly)
_log_query("daily_throughput", slo.daily_throughput)


@query
def sli_stream(spark, sf):
    return streams.run_sli_stream(spark, fx.processing_log(spark, sf))
