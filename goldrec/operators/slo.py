"""Service levels from a processing log ``(event_ts, processed_at, latency_ms,
ok, is_duplicate, action)``.

Rows are always reduced to counts per time slot first (partial aggregation);
everything that slides, accumulates or looks for runs works on those counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from goldrec import config as C

# ---- fixed values ---------------------------------------------------------
SEVERITIES = ((10, "CRITICAL"), (5, "HIGH"), (2, "ELEVATED"))
SEVERITY_TEXT = {
    "CRITICAL": "10x+ burn rate - Immediate action required",
    "HIGH": "5x+ burn rate - Urgent attention needed",
    "ELEVATED": "2x+ burn rate - Monitor closely",
    "NORMAL": "Normal operations",
}
HEALTH_TEXT = {
    "DOWN": "No events processed recently",
    "UNKNOWN": "Anomalous duplicate rate",
    "UP": "healthy",
}
ERRORS_HIGH = "MDMProcessingErrorRateHigh"
LATENCY_HIGH = "MDMProcessingLatencyHigh"
LATENCY_DEGRADED = "MDMProcessingLatencyDegraded"
DUPLICATES_LOW = "MDMDuplicateRateAnomalyLow"
DUPLICATES_HIGH = "MDMDuplicateRateAnomalyHigh"
# ---------------------------------------------------------------------------
MAX_DOUBLE = 1.7976931348623157e308


# ---- rates as Columns over grouped counts ---------------------------------


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(100.0 * part / whole)


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def _max_error(target: float) -> float:
    return 1.0 - target / 100.0


def burn_rate(total: Column, failed: Column, target: float = C.SLO_TARGET) -> Column:
    """Error rate over the allowed error rate."""
    allowed = _max_error(target)
    rate = failed / F.greatest(total, F.lit(1))
    if allowed == 0:
        return F.when(failed > 0, MAX_DOUBLE).otherwise(0.0)
    return F.when(total == 0, 0.0).otherwise(rate / allowed)


def budget_remaining(total: Column, failed: Column, target: float = C.SLO_TARGET) -> Column:
    """Share of the error budget left, in percent."""
    allowed = _max_error(target)
    rate = failed / F.greatest(total, F.lit(1))
    if allowed == 0:
        left = F.lit(0.0)
    else:
        left = F.greatest(F.lit(0.0), (allowed - rate) / allowed * 100.0)
    return F.when(total == 0, 100.0).otherwise(left)


def budget_minutes(target: float = C.SLO_TARGET) -> dict[str, float]:
    allowed = _max_error(target)
    return {
        "monthly_budget_minutes": allowed * 30 * 24 * 60,
        "weekly_budget_minutes": allowed * 7 * 24 * 60,
        "daily_budget_minutes": allowed * 24 * 60,
        "monthly_budget_seconds": allowed * 30 * 24 * 60 * 60,
        "max_error_percent": allowed * 100.0,
    }


def severity(burn: Column) -> Column:
    chain = F
    for least, name in SEVERITIES:
        chain = chain.when(burn >= least, name)
    return chain.otherwise("NORMAL")


def severity_text(name: Column) -> Column:
    chain = F
    for key, text in SEVERITY_TEXT.items():
        chain = chain.when(name == key, text)
    return chain


def log_counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("processed"),
        F.count_if(~F.col("ok")).alias("errors"),
        F.count_if(F.col("ok") & F.col("is_duplicate")).alias("duplicates"),
        F.count_if(F.col("ok") & (F.col("action") == "CREATED")).alias("created"),
        F.count_if(F.col("ok") & (F.col("action") == "UPDATED")).alias("updated"),
    ]


# ---- totals ---------------------------------------------------------------


def sli_totals(log: DataFrame) -> DataFrame:
    return log.agg(*log_counts())


def duplicate_rate(log: DataFrame) -> DataFrame:
    rate = F.round(percent(F.col("duplicates"), F.col("processed")), 6)
    return sli_totals(log).select("duplicates", "processed", rate.alias("duplicate_rate"))


def error_rate(log: DataFrame) -> DataFrame:
    rate = F.round(percent(F.col("errors"), F.col("processed")), 6)
    return sli_totals(log).select("errors", "processed", rate.alias("error_rate"))


def _bucket_counts(column: str, buckets: tuple[int, ...]) -> list[Column]:
    return [F.count_if(F.col(column) <= le).alias(f"le_{le}") for le in buckets]


def latency_histogram(
    log: DataFrame, buckets: tuple[int, ...] = C.LATENCY_BUCKETS_MS, column: str = "latency_ms"
) -> DataFrame:
    """Cumulative counts per upper bound (text), the unbounded bucket last."""
    counts = log.agg(*_bucket_counts(column, buckets), F.count(column).alias("total"))
    bounds = [(str(le), f"le_{le}") for le in buckets] + [("+Inf", "total")]
    rows = [F.struct(F.lit(le).alias("le_ms"), F.col(c).alias("n")) for le, c in bounds]
    return counts.select(F.inline(F.array(*rows)))


def histogram_quantile(
    q: float, buckets: tuple[int, ...], total: Column, prefix: str = "le_"
) -> Column:
    """Quantile read from cumulative buckets: linear inside the bucket that holds
    the rank, the last bound when the rank lies beyond it."""
    rank = q * total
    chain = F.when(total == 0, F.lit(None).cast("double"))
    low, below = 0.0, F.lit(0)
    for le in buckets:
        count = F.col(f"{prefix}{le}")
        inside = low + (le - low) * (rank - below) / (count - below)
        chain = chain.when(count >= rank, inside)
        low, below = float(le), count
    return chain.otherwise(low)


def latency_quantiles(
    log: DataFrame,
    width: str = "5 minutes",
    buckets: tuple[int, ...] = C.LATENCY_BUCKETS_MS,
    column: str = "latency_ms",
) -> DataFrame:
    """p50, p95 and p99 per window from histogram counts, which merge; no window's
    values are ever gathered."""
    counts = log.groupBy(F.window("event_ts", width)["start"].alias("window_start")).agg(
        *_bucket_counts(column, buckets), F.count(column).alias("total")
    )
    quantiles = {"p50": 0.50, "p95": 0.95, "p99": 0.99}
    return counts.select(
        "window_start",
        F.col("total").alias("n"),
        *(
            F.round(histogram_quantile(q, buckets, F.col("total")), 6).alias(name)
            for name, q in quantiles.items()
        ),
    )


#: Size of a latency sketch. A quantile read from it has a rank within ``SKETCH_ERROR`` of
#: the one asked for (the library's bound at 99 % confidence), merged or not.
SKETCH_K = 200
SKETCH_ERROR = 0.0133


def latency_sketches(log: DataFrame, width: str = "5 minutes", column: str = "latency_ms") -> DataFrame:
    """One quantile sketch per window: a few hundred values, however many rows it has.
    Rows without a latency count for nothing; a window of such rows has no sketch."""
    rows = log.filter(F.col(column).isNotNull())
    return rows.groupBy(F.window("event_ts", width)["start"].alias("window_start")).agg(
        F.kll_sketch_agg_bigint(F.col(column).cast("bigint"), SKETCH_K).alias("sketch")
    )


def sketch_quantiles(sketches: DataFrame, width: str) -> DataFrame:
    """p50, p95 and p99 per wider window, from the merged sketches of its parts; the log is
    not read again."""
    merged = sketches.groupBy(F.window("window_start", width)["start"].alias("window_start")).agg(
        F.kll_merge_agg_bigint("sketch").alias("sketch")
    )
    quantiles = {"p50": 0.50, "p95": 0.95, "p99": 0.99}
    return merged.select(
        "window_start",
        F.kll_sketch_get_n_bigint("sketch").alias("n"),
        *(F.kll_sketch_get_quantile_bigint("sketch", F.lit(q)).alias(name) for name, q in quantiles.items()),
    )


# ---- SLO status -----------------------------------------------------------


def _slo_columns(target: float) -> list[Column]:
    total, failed = F.col("processed"), F.col("errors")
    burn = burn_rate(total, failed, target)
    left = budget_remaining(total, failed, target)
    return [
        F.round(100.0 - percent(failed, total), 6).alias("availability"),
        F.round(left, 6).alias("budget_remaining"),
        F.round(burn, 6).alias("burn_rate"),
        severity(burn).alias("severity"),
        (left > 0).alias("slo_met"),
    ]


def slo_status(log: DataFrame, target: float = C.SLO_TARGET) -> DataFrame:
    """One row: availability, budget, burn rate, severity, budgets and verdict."""
    budgets = budget_minutes(target)
    return (
        sli_totals(log)
        .select(
            "processed",
            "errors",
            *_slo_columns(target),
            F.round(percent(F.col("duplicates"), F.col("processed")), 6).alias("duplicate_rate"),
            *(F.round(F.lit(v), 6).alias(k) for k, v in budgets.items()),
            F.lit(target).alias("slo_target"),
        )
        .withColumn("description", severity_text(F.col("severity")))
        .withColumn("status", F.when(F.col("slo_met"), "HEALTHY").otherwise("DEGRADED"))
    )


def slo_by_window(log: DataFrame, width: str = "1 day", target: float = C.SLO_TARGET) -> DataFrame:
    counts = log.groupBy(F.window("event_ts", width)["start"].alias("window_start")).agg(*log_counts())
    return counts.select("window_start", "processed", "errors", *_slo_columns(target))


def processing_health(log: DataFrame, as_of: Column, timeout_minutes: int = 5) -> DataFrame:
    """DOWN when nothing succeeded lately, UNKNOWN on an odd duplicate share, else UP."""
    done = F.col("ok")
    totals = log.agg(
        F.max(F.when(done, F.col("processed_at"))).alias("last_success"),
        F.count_if(done).alias("processed"),
        F.count_if(done & F.col("is_duplicate")).alias("duplicates"),
    )
    share = F.when(F.col("processed") > 0, F.expr("duplicates * 100 div processed")).otherwise(0)
    quiet = as_of > F.col("last_success") + F.make_dt_interval(mins=F.lit(timeout_minutes))
    odd = (F.col("processed") > 100) & ((share == 0) | (share > 95))
    return totals.select(
        F.when(quiet, "DOWN").when(odd, "UNKNOWN").otherwise("UP").alias("status"),
        F.when(quiet, HEALTH_TEXT["DOWN"])
        .when(odd, HEALTH_TEXT["UNKNOWN"])
        .otherwise(HEALTH_TEXT["UP"])
        .alias("detail"),
        "last_success",
        "processed",
        "duplicates",
        share.alias("duplicate_percent"),
    )


# ---- rates per window -----------------------------------------------------


def event_rate(log: DataFrame) -> DataFrame:
    """Events per second in each minute."""
    per = log.groupBy(F.window("event_ts", "1 minute")["start"].alias("window_start"))
    return per.agg(F.count(F.lit(1)).alias("n")).withColumn(
        "events_per_sec", F.round(F.col("n") / 60.0, 6)
    )


def golden_rate(log: DataFrame) -> DataFrame:
    """Records created and updated per second in each five minutes."""
    per = log.groupBy(F.window("event_ts", "5 minutes")["start"].alias("window_start")).agg(*log_counts())
    return per.select(
        "window_start",
        *(F.round(F.col(c) / 300.0, 6).alias(f"{c}_per_sec") for c in ("created", "updated")),
    )


def _ratio_window(log: DataFrame, part: str, width: str) -> DataFrame:
    per = log.groupBy(F.window("event_ts", width)["start"].alias("window_start")).agg(*log_counts())
    value = F.round(ratio(F.col(part), F.col("processed")), 6)
    return per.select("window_start", part, "processed", value.alias("ratio"))


def dup_rate_window(log: DataFrame, width: str = "5 minutes") -> DataFrame:
    return _ratio_window(log, "duplicates", width)


def error_rate_window(log: DataFrame, width: str = "5 minutes") -> DataFrame:
    return _ratio_window(log, "errors", width)


def daily_throughput(log: DataFrame) -> DataFrame:
    per = log.groupBy(F.window("event_ts", "1 day")["start"].alias("day"))
    return per.agg(F.count(F.lit(1)).alias("events"))


def _trailing(log: DataFrame, days: int, *counts: Column) -> DataFrame:
    """Sums over the ``days`` days that end with each day that has events. Daily counts are sent to
    the days they belong to, so no single ordered pass over all days is needed."""
    daily = log.groupBy(F.window("event_ts", "1 day")["start"].alias("slot")).agg(*counts)
    names = [c for c in daily.columns if c != "slot"]
    ahead = F.expr(f"sequence(slot, slot + interval {days - 1} days, interval 1 day)")
    spread = daily.select("slot", F.explode(ahead).alias("day"), *names)
    sums = spread.groupBy("day").agg(
        F.max(F.col("slot") == F.col("day")).alias("has_events"), *(F.sum(n).alias(n) for n in names)
    )
    return sums.filter("has_events").drop("has_events")


def slo_latency_compliance(log: DataFrame, bound_ms: int = 100, days: int = 30) -> DataFrame:
    """Share of events at most ``bound_ms`` slow over the trailing days."""
    sums = _trailing(
        log,
        days,
        F.count_if(F.col("latency_ms") <= bound_ms).alias("fast"),
        F.count(F.lit(1)).alias("processed"),
    )
    return sums.withColumn("compliance", F.round(ratio(F.col("fast"), F.col("processed")), 6))


def slo_availability(log: DataFrame, days: int = 30) -> DataFrame:
    """Availability over the trailing days and the budget gauge, whose formula sets
    an error count against seconds."""
    sums = _trailing(
        log, days, F.count_if(~F.col("ok")).alias("errors"), F.count(F.lit(1)).alias("processed")
    )
    budget = 0.001 * 30 * 24 * 60 * 60
    return sums.select(
        "day",
        "errors",
        "processed",
        F.round(1.0 - F.col("errors") / F.col("processed"), 6).alias("availability"),
        F.round(F.greatest(F.lit(0.0), (budget - F.col("errors")) / budget), 6).alias("budget_gauge"),
    )


# ---- sustained alerts -----------------------------------------------------


def sliding(log: DataFrame, step: int, width: int, *counts: Column) -> DataFrame:
    """Counts over the ``width`` seconds before every check, checks ``step`` seconds
    apart (column ``t``). Rows are counted per step once; the step counts, not the
    rows, are sent to the checks they belong to. Checks without events are absent.
    """
    slots = log.groupBy(F.window("event_ts", f"{step} seconds")["end"].alias("slot")).agg(*counts)
    names = [c for c in slots.columns if c != "slot"]
    reach = F.expr(
        f"sequence(slot, slot + interval {width - step} seconds, interval {step} seconds)"
    )
    return (
        slots.select(F.explode(reach).alias("t"), *names)
        .groupBy("t")
        .agg(*(F.sum(n).alias(n) for n in names))
    )


def sustained(checks: DataFrame, name: str, condition: Column, step: int, hold: int) -> DataFrame:
    """Alerts from runs of neighbouring checks where ``condition`` holds for at
    least ``hold`` seconds: pending from, fired at, last true check.

    The run search is ordered over true checks only; their number is bounded by
    the time spanned, not by the events.
    """
    true = checks.filter(F.coalesce(condition, F.lit(False))).select("t")
    rank = F.row_number().over(W.orderBy("t"))
    run = F.col("t") - F.make_dt_interval(secs=rank * F.lit(step))
    hold_for = F.make_dt_interval(secs=F.lit(hold))
    return (
        true.withColumn("run", run)
        .groupBy("run")
        .agg(F.min("t").alias("pending_from"), F.max("t").alias("last_true"))
        .filter(F.col("last_true") >= F.col("pending_from") + hold_for)
        .select(
            F.lit(name).alias("alert"),
            "pending_from",
            (F.col("pending_from") + hold_for).alias("fired_at"),
            "last_true",
        )
    )


def alert_error_rate(log: DataFrame) -> DataFrame:
    """Five-minute error ratio above 1 % for two minutes, checked every 30 s."""
    checks = sliding(
        log, 30, 300, F.count_if(~F.col("ok")).alias("errors"), F.count(F.lit(1)).alias("processed")
    )
    high = F.col("errors") / F.col("processed") > 0.01
    return sustained(checks, ERRORS_HIGH, high, 30, 120)


def alert_latency(log: DataFrame, buckets: tuple[int, ...] = C.LATENCY_BUCKETS_MS) -> DataFrame:
    """p99 above 500 ms for five minutes (30 s checks) and p95 above 100 ms for ten
    minutes (one-minute checks)."""
    counts = [*_bucket_counts("latency_ms", buckets), F.count(F.lit(1)).alias("total")]

    def quantile(q: float) -> Column:
        return histogram_quantile(q, buckets, F.col("total"))

    slow = sustained(
        sliding(log, 30, 300, *counts), LATENCY_HIGH, quantile(0.99) > 500, 30, 300
    )
    degraded = sustained(
        sliding(log, 60, 300, *counts), LATENCY_DEGRADED, quantile(0.95) > 100, 60, 600
    )
    return slow.unionByName(degraded)


def alert_dup_anomaly(log: DataFrame, min_rate: float = 10.0) -> DataFrame:
    """One-hour duplicate ratio below 1 % under load, or above 50 %, for one hour."""
    checks = sliding(
        log,
        60,
        3600,
        F.count_if(F.col("ok") & F.col("is_duplicate")).alias("duplicates"),
        F.count(F.lit(1)).alias("processed"),
    )
    share = F.col("duplicates") / F.col("processed")
    low = (share < 0.01) & (F.col("processed") / 3600.0 > min_rate)
    return sustained(checks, DUPLICATES_LOW, low, 60, 3600).unionByName(
        sustained(checks, DUPLICATES_HIGH, share > 0.5, 60, 3600)
    )
