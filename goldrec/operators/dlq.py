"""Failed events: classes, dead-letter records, reprocessing and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from goldrec import config as C
from goldrec.functions.text import is_blank, norm_national_id, truncate_text
from goldrec.schema import RAW_EVENT
from goldrec.sources.raw_events import JSON

# ---- fixed values ---------------------------------------------------------
PERMANENT_NAMES = ("ConstraintViolation", "DataIntegrityViolation", "IllegalArgumentException")
TRANSIENT_NAMES = ("Deadlock", "QueryTimeout", "SQLTransient", "Transient")
BUSINESS_NAMES = ("Validation", "Business")
MESSAGE_CHARS = 500
HISTORY_CHARS = 200
HEADER_CHARS = 256
SCHEMA_VERSION = "v1"
VALUE_PARTS = "originalEvent struct<eventId string>, errorDetails struct<exception string>, schemaVersion string"
ORIGINAL_TOPIC = "customer.raw"
COLUMN_CHARS = {"national_id": 64, "name": 255, "email": 255, "phone": 64, "source_system": 50}
DISPOSITIONS = {"TRANSIENT": "RETRY_THEN_DLQ", "PERMANENT": "DLQ", "BUSINESS": "SKIP"}
# ---------------------------------------------------------------------------


def classify_error(exception_class: Column, known_type: Column | None = None) -> Column:
    """TRANSIENT, PERMANENT or BUSINESS by class name; the first list that matches
    decides, unknown classes count as transient, a known type passes through."""

    def names(parts: tuple[str, ...]) -> Column:
        return exception_class.rlike("|".join(parts))

    by_name = (
        F.when(names(PERMANENT_NAMES), "PERMANENT")
        .when(names(TRANSIENT_NAMES), "TRANSIENT")
        .when(names(BUSINESS_NAMES), "BUSINESS")
        .otherwise("TRANSIENT")
    )
    return by_name if known_type is None else F.coalesce(known_type, by_name)


def is_retryable(error_type: Column) -> Column:
    return error_type == "TRANSIENT"


def disposition(error_type: Column) -> Column:
    chain = F
    for kind, action in DISPOSITIONS.items():
        chain = chain.when(error_type == kind, action)
    return chain


def with_error_type(errors: DataFrame) -> DataFrame:
    return errors.withColumn("error_type", classify_error(F.col("exception_class"))).withColumns(
        {
            "retryable": is_retryable(F.col("error_type")),
            "disposition": disposition(F.col("error_type")),
        }
    )


def dlq_events(errors: DataFrame) -> DataFrame:
    """Nested dead-letter records from errors with their ``original_event`` struct."""
    typed = with_error_type(errors)
    simple_name = F.element_at(F.split("exception_class", r"\."), -1)
    return typed.select(
        "event_id",
        "error_type",
        "disposition",
        "retry_count",
        "original_event",
        F.struct(
            simple_name.alias("exception"),
            truncate_text(F.col("message"), MESSAGE_CHARS).alias("message"),
            F.concat_ws(": ", "exception_class", "message").alias("stackTrace"),
        ).alias("error_details"),
        F.array(
            F.struct(
                F.col("retry_count").alias("attempt"),
                F.col("event_ts").alias("timestamp"),
                truncate_text(F.col("message"), HISTORY_CHARS).alias("error"),
            )
        ).alias("processing_history"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
    )


def dlq_records(dlq: DataFrame) -> DataFrame:
    """Key, JSON value and headers of each dead-letter message. A record without a
    national id is keyed by its event, which spreads such records."""
    value = F.struct(
        F.col("original_event").alias("originalEvent"),
        F.col("error_details").alias("errorDetails"),
        F.col("processing_history").alias("processingHistory"),
        F.col("schema_version").alias("schemaVersion"),
    )
    event_text = F.concat(F.lit("EventId="), F.col("event_id").cast("string"))
    headers = {
        "X-Original-Topic": F.lit(ORIGINAL_TOPIC),
        "X-Original-Offset": F.coalesce(F.col("event_id").cast("string"), F.lit("")),
        "X-Error-Type": F.col("error_type"),
        "X-Error-Message": F.left(F.coalesce(event_text, F.lit("Unknown event")), F.lit(HEADER_CHARS)),
        "X-Retry-Count": F.col("retry_count").cast("string"),
        "X-Original-Timestamp": F.col("processing_history")[0]["timestamp"].cast("string"),
        "X-Schema-Version": F.col("schema_version"),
    }
    return dlq.select(
        F.coalesce(
            F.col("original_event.nationalId"),
            F.sha2(F.concat(F.lit("dlq|"), F.col("event_id").cast("string")), 256),
        ).alias("key"),
        F.to_json(value, {**JSON, "ignoreNullFields": "false"}).alias("value"),
        F.array(
            *(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in headers.items())
        ).alias("headers"),
        F.lit(len(headers)).alias("header_count"),
        "error_type",
    )


def check_mastering(events: DataFrame) -> DataFrame:
    """Events with ``error_type`` (null = can be mastered): no national id is a
    business error, a value too long for its column a permanent one."""
    too_long = F.lit(False)
    for column, limit in COLUMN_CHARS.items():
        too_long = too_long | F.coalesce(F.length(column) > limit, F.lit(False))
    no_id = norm_national_id(F.col("national_id"), blank_to_null=True).isNull()
    return events.withColumn(
        "error_type", F.when(no_id, "BUSINESS").when(too_long, "PERMANENT")
    ).withColumn(
        "error_message",
        F.when(
            no_id,
            F.concat(
                F.lit("Event has null or blank nationalId: eventId="), F.col("event_id").cast("string")
            ),
        ).when(too_long, "Data integrity violation"),
    )


def mastering_errors(events: DataFrame) -> DataFrame:
    return check_mastering(events).filter(F.col("error_type").isNotNull())


def reprocess(records: DataFrame) -> DataFrame:
    """Original events read back from dead-letter JSON (column ``value``), with the
    reason a record cannot be sent again (null = sent as a new raw event)."""
    schema = f"originalEvent struct<{RAW_EVENT}>"
    event = F.from_json("value", schema, JSON)["originalEvent"]
    rows = records.select(event.alias("e")).select("e", "e.*")
    reason = (
        F.when(F.col("e").isNull(), "No original event found in DLQ message")
        .when(is_blank(F.col("nationalId")), "nationalId is required in the original event")
        .when(is_blank(F.col("sourceSystem")), "sourceSystem is required in the original event")
    )
    return rows.select(
        F.col("eventId").alias("original_event_id"),
        F.sha2(F.concat(F.lit("reprocess|"), F.col("eventId")), 256).alias("event_id"),
        F.col("nationalId").alias("national_id"),
        "name",
        "email",
        "phone",
        F.col("sourceSystem").alias("source_system"),
        F.col("timestamp").alias("event_ts"),
        reason.alias("reason"),
    )


def dlq_counts(typed: DataFrame) -> DataFrame:
    """Messages and retries per error type, zero included."""
    counts = typed.agg(
        *(
            F.struct(
                F.lit(kind).alias("error_type"),
                F.count_if(F.col("error_type") == kind).alias("messages"),
                F.coalesce(
                    F.sum(F.when(F.col("error_type") == kind, F.col("retry_count"))), F.lit(0)
                ).alias("retries"),
            ).alias(kind)
            for kind in C.ERROR_TYPES
        )
    )
    return counts.select(F.inline(F.array(*C.ERROR_TYPES)))


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(100.0 * part / whole)


def dlq_rate(log: DataFrame) -> DataFrame:
    """Dead-lettered share of processed events, each event counted once."""
    dead, total = F.count_if(~F.col("ok")), F.count(F.lit(1))
    return log.agg(dead.alias("dlq"), total.alias("processed")).withColumn(
        "dlq_rate", F.round(_percent(F.col("dlq"), F.col("processed")), 6)
    )


def dlq_alerts(
    log: DataFrame,
    threshold: float = C.DLQ_ALERT_PERCENT,
    seconds: int = C.DLQ_ALERT_WINDOW_SECONDS,
    channels: tuple[str, ...] = C.ALERT_CHANNELS[:2],
) -> DataFrame:
    """Alerts of the periodic check of the *cumulative* rate, one per check above
    the threshold and known channel. Checks go on while no events arrive.

    Events are counted per check first; the running sum runs over checks, whose
    number depends on the time spanned only.
    """
    step = F.expr(f"interval {seconds} seconds")
    checks = log.groupBy(F.window("event_ts", f"{seconds} seconds")["end"].alias("check_at")).agg(
        F.count_if(~F.col("ok")).alias("dlq"), F.count(F.lit(1)).alias("processed")
    )
    span = checks.agg(F.min("check_at").alias("lo"), F.max("check_at").alias("hi"))
    grid = span.select(F.explode(F.sequence("lo", "hi", step)).alias("check_at"))
    so_far = W.orderBy("check_at").rowsBetween(W.unboundedPreceding, 0)
    known = F.array(*(F.lit(c.upper()) for c in channels if c.lower() in C.ALERT_CHANNELS))
    return (
        grid.join(checks, "check_at", "left")
        .select(
            "check_at",
            F.coalesce(F.sum("dlq").over(so_far), F.lit(0)).alias("dlq"),
            F.coalesce(F.sum("processed").over(so_far), F.lit(0)).alias("processed"),
        )
        .withColumn("rate", _percent(F.col("dlq"), F.col("processed")))
        .filter(F.col("rate") > threshold)
        .select("check_at", F.explode(known).alias("channel"), "dlq", "processed", F.round("rate", 6).alias("rate"))
    )


def retry_schedule(errors: DataFrame) -> DataFrame:
    """Planned attempts of retryable failures: the delay doubles up to a cap."""
    typed = with_error_type(errors).filter("retryable")
    attempt = F.explode(F.sequence(F.lit(1), F.lit(C.RETRY_ATTEMPTS)))
    # Waiting time before attempt k is the sum of the k-1 delays so far.
    delays = [
        min(C.RETRY_INITIAL_MS * C.RETRY_MULTIPLIER**i, C.RETRY_MAX_MS)
        for i in range(C.RETRY_ATTEMPTS - 1)
    ]
    waits = [int(sum(delays[:k])) for k in range(C.RETRY_ATTEMPTS)]
    wait = F.element_at(F.array(*(F.lit(w) for w in waits)), F.col("attempt"))
    return typed.select("event_id", "event_ts", attempt.alias("attempt")).select(
        "event_id",
        "attempt",
        wait.alias("wait_ms"),
        (F.col("event_ts") + F.make_dt_interval(secs=wait / 1000)).alias("attempt_at"),
    )
