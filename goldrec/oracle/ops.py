"""Checks of the dead-letter path and the service levels."""

from goldrec.operators.dlq import COLUMN_CHARS
from goldrec.oracle.common import ERRORS, LOG, REQUESTS, SQL, alnum, jtrim, with_

# ---- dead letters ---------------------------------------------------------

TYPE = """case when regexp_matches(exception_class, 'ConstraintViolation|DataIntegrityViolation|IllegalArgumentException')
    then 'PERMANENT'
  when regexp_matches(exception_class, 'Deadlock|QueryTimeout|SQLTransient|Transient') then 'TRANSIENT'
  when regexp_matches(exception_class, 'Validation|Business') then 'BUSINESS' else 'TRANSIENT' end"""
TYPED = f"{ERRORS}, typed as (select *, {TYPE} as error_type from fx_errors)"
FAILED = f"""{TYPED}, {REQUESTS}, failed as (
  select t.event_id, t.event_ts, t.exception_class, t.message, t.retry_count, t.error_type,
    case when t.event_id % 17 <> 0 then r.national_id end as national_id,
    case when t.event_id % 19 = 0 then ' ' else r.source_system end as source_system,
    r.name, r.email, r.phone, r.event_ts as request_ts, split_part(exception_class, '.', -1) as exception
  from typed t join fx_requests r using (event_id))"""


def cut(n: int) -> str:
    return f"case when length(message) > {n} then left(message, {n}) || '...' else message end"


SQL["classify_error"] = f"""{with_(TYPED)} select event_id, error_type,
  case error_type when 'TRANSIENT' then 'RETRY_THEN_DLQ' when 'PERMANENT' then 'DLQ' else 'SKIP' end as disposition
from typed"""
SQL["retryable"] = f"{with_(TYPED)} select event_id, error_type = 'TRANSIENT' as retryable from typed"
SQL["dlq_events"] = f"""{with_(FAILED)} select event_id, error_type, national_id, source_system, exception,
  {cut(500)} as message, 1 as history_size, retry_count as attempt, event_ts as failed_at,
  {cut(200)} as history_error, 'v1' as schema_version from failed"""
SQL["sink_dlq"] = f"""{with_(FAILED)} select coalesce(national_id, sha256('dlq|' || event_id::varchar)) as key,
  error_type, 7 as header_count, event_id::varchar as event_id, exception, 'v1' as schema_version,
  'EventId=' || event_id::varchar as message_header from failed"""
SQL["dlq_reprocess"] = f"""{with_(FAILED)} select event_id::varchar as original_event_id,
  sha256('reprocess|' || event_id::varchar) as event_id, national_id, name, email, phone, source_system,
  request_ts as event_ts,
  case when national_id is null or {jtrim('national_id')} = '' then 'nationalId is required in the original event'
    when {jtrim('source_system')} = '' then 'sourceSystem is required in the original event' end as reason
from failed"""
_long = " or ".join(f"coalesce(length({c}) > {n}, false)" for c, n in COLUMN_CHARS.items())
SQL["mastering_errors"] = f"""{with_(REQUESTS, f'''changed as (
  select event_id, case when event_id % 13 = 0 then null when event_id % 13 = 1 then chr(9) || ' '
      else national_id end as national_id,
    case when event_id % 10 = 0 then repeat('name', (60 + event_id % 9)::int) else name end as name,
    email, phone, source_system from fx_requests)''')}
select event_id, error_type from (
  select event_id, case when national_id is null or {jtrim('national_id')} = '' then 'BUSINESS'
    when {_long} then 'PERMANENT' end as error_type from changed) where error_type is not null"""
SQL["dlq_counts"] = f"""{with_(TYPED)} select k.error_type, count(t.event_id) as messages,
  coalesce(sum(t.retry_count), 0)::bigint as retries
from (values ('TRANSIENT'), ('PERMANENT'), ('BUSINESS')) k(error_type)
left join typed t using (error_type) group by 1"""
SQL["dlq_rate"] = f"""{with_(LOG)} select dlq, processed,
  round(case when processed = 0 then 0.0 else 100.0 * dlq / processed end, 6)::double as dlq_rate
from (select count(*) filter (not ok) as dlq, count(*) as processed from fx_log)"""
SQL["dlq_alerts"] = f"""{with_(LOG, '''checks as (
  select time_bucket(interval '300 seconds', event_ts) + interval '300 seconds' as check_at,
    count(*) filter (not ok) as dlq, count(*) as processed from fx_log group by 1),
grid as (select unnest(generate_series(min(check_at), max(check_at), interval '300 seconds')) as check_at from checks),
total as (select check_at, (sum(coalesce(dlq, 0)) over w)::bigint as dlq,
    (sum(coalesce(processed, 0)) over w)::bigint as processed
  from grid left join checks using (check_at) window w as (order by check_at))''')}
select check_at, channel, dlq, processed, round(100.0 * dlq / processed, 6)::double as rate
from total, (values ('EMAIL'), ('PROMETHEUS')) c(channel) where 100.0 * dlq / processed > 1.0"""
SQL["retry_schedule"] = f"""{with_(TYPED)} select event_id, attempt, wait_ms,
  event_ts + wait_ms * interval 1 millisecond as attempt_at
from typed, (values (1, 0), (2, 1000), (3, 3000)) w(attempt, wait_ms) where error_type = 'TRANSIENT'"""

# ---- service levels -------------------------------------------------------

COUNTS = """count(*) as processed, count(*) filter (not ok) as errors,
  count(*) filter (ok and is_duplicate) as duplicates,
  count(*) filter (ok and action = 'CREATED') as created,
  count(*) filter (ok and action = 'UPDATED') as updated"""
BUCKETS = (10, 25, 50, 100, 250, 500, 1000)
LE = ", ".join(f"count(*) filter (latency_ms <= {b}) as le_{b}" for b in BUCKETS)


def by(width: str, columns: str = COUNTS) -> str:
    return with_(
        LOG,
        f"w as (select time_bucket(interval '{width}', event_ts) as window_start, {columns} from fx_log group by 1)",
    )


def percent(part: str, whole: str = "processed") -> str:
    return f"(case when {whole} = 0 then 0.0 else 100.0 * {part}::double / {whole} end)"


def quantile(q: float) -> str:
    rank = f"({q} * total)"
    out, low, below = "case when total = 0 then null", 0, "0"
    for b in BUCKETS:
        out += f" when le_{b} >= {rank} then {low} + ({b} - {low}) * ({rank} - {below})::double / (le_{b} - {below})"
        low, below = b, f"le_{b}"
    return f"({out} else 1000 end)::double"


TOTALS = with_(LOG, f"t as (select {COUNTS} from fx_log)")
SQL["sli_totals"] = f"{TOTALS} select * from t"
SQL["duplicate_rate"] = f"{TOTALS} select duplicates, processed, round({percent('duplicates')}, 6) as duplicate_rate from t"
SQL["error_rate"] = f"{TOTALS} select errors, processed, round({percent('errors')}, 6) as error_rate from t"


def histogram(bounds: tuple[int, ...]) -> str:
    rows = " union all ".join(
        f"select '{b}' as le_ms, count(*) filter (latency_ms <= {b}) as n from fx_log" for b in bounds
    )
    return f"{with_(LOG)} {rows} union all select '+Inf', count(*) from fx_log"


SQL["latency_histogram"] = histogram(BUCKETS)
SQL["lookup_latency_histogram"] = histogram((1, 5, 10, 25, 50))
SQL["latency_quantiles"] = by("1 hour", f"{LE}, count(*) as total") + f"""
select window_start, total as n, round({quantile(0.5)}, 6) as p50, round({quantile(0.95)}, 6) as p95,
  round({quantile(0.99)}, 6) as p99 from w"""

BURN = "(errors::double / processed / (1.0::double - 99.9::double / 100.0::double))"
LEFT = "greatest(0.0::double, ((1.0::double - 99.9::double / 100.0::double) - errors::double / processed) / (1.0::double - 99.9::double / 100.0::double) * 100.0::double)"
SEVERITY = f"case when {BURN} >= 10 then 'CRITICAL' when {BURN} >= 5 then 'HIGH' when {BURN} >= 2 then 'ELEVATED' else 'NORMAL' end"
STATUS = f"""processed, errors, round(100.0 - {percent('errors')}, 6) as availability,
  round({LEFT}, 6) as budget_remaining, round({BURN}, 6) as burn_rate, {SEVERITY} as severity, {LEFT} > 0 as slo_met"""
SQL["slo_status"] = f"""{TOTALS} select {STATUS}, round({percent('duplicates')}, 6) as duplicate_rate,
  43.2::double as monthly_budget_minutes, 10.08::double as weekly_budget_minutes,
  1.44::double as daily_budget_minutes, 2592.0::double as monthly_budget_seconds,
  0.1::double as max_error_percent, 99.9::double as slo_target,
  case {SEVERITY} when 'CRITICAL' then '10x+ burn rate - Immediate action required'
    when 'HIGH' then '5x+ burn rate - Urgent attention needed'
    when 'ELEVATED' then '2x+ burn rate - Monitor closely' else 'Normal operations' end as description,
  case when {LEFT} > 0 then 'HEALTHY' else 'DEGRADED' end as status from t"""
SQL["slo_by_window"] = f"{by('1 day')} select window_start, {STATUS} from w"
SQL["processing_health"] = f"""{with_(LOG, '''t as (
  select max(processed_at) filter (ok) as last_success, count(*) filter (ok) as processed,
    count(*) filter (ok and is_duplicate) as duplicates from fx_log),
h as (select *, case when processed > 0 then duplicates * 100 // processed else 0 end as duplicate_percent,
  timestamp '2024-01-31 00:00:00' > last_success + interval 5 minute as quiet from t)''')}
select case when quiet then 'DOWN' when processed > 100 and (duplicate_percent = 0 or duplicate_percent > 95)
    then 'UNKNOWN' else 'UP' end as status,
  case when quiet then 'No events processed recently'
    when processed > 100 and (duplicate_percent = 0 or duplicate_percent > 95) then 'Anomalous duplicate rate'
    else 'healthy' end as detail, last_success, processed, duplicates, duplicate_percent from h"""
SQL["event_rate"] = by("1 minute", "count(*) as n") + """
select window_start, n, round(n / 60.0::double, 6) as events_per_sec from w"""
SQL["golden_rate"] = by("5 minutes") + """
select window_start, round(created / 300.0::double, 6) as created_per_sec,
  round(updated / 300.0::double, 6) as updated_per_sec from w"""


def ratio_window(part: str) -> str:
    return by("5 minutes") + f"""
select window_start, {part}, processed, round({part}::double / processed, 6) as ratio from w"""


SQL["dup_rate_window"] = ratio_window("duplicates")
SQL["error_rate_window"] = ratio_window("errors")
SQL["daily_throughput"] = by("1 day", "count(*) as events") + "select window_start as day, events from w"
TRAILING = """range between interval 29 days preceding and current row"""
SQL["slo_latency_compliance"] = by("1 day", "count(*) as n, count(*) filter (latency_ms <= 100) as f") + f"""
select window_start as day, (sum(f) over d)::bigint as fast, (sum(n) over d)::bigint as processed,
  round((sum(f) over d)::double / sum(n) over d, 6) as compliance
from w window d as (order by window_start {TRAILING})"""
SQL["slo_availability"] = by("1 day", "count(*) as n, count(*) filter (not ok) as e") + f"""
select day, errors, processed, round(1.0 - errors::double / processed, 6) as availability,
  round(greatest(0.0::double, (2592.0::double - errors) / 2592.0::double), 6) as budget_gauge
from (select window_start as day, (sum(e) over d)::bigint as errors, (sum(n) over d)::bigint as processed
  from w window d as (order by window_start {TRAILING}))"""


def alert(tag: str, name: str, step: int, width: int, hold: int, columns: str, condition: str) -> tuple[str, str]:
    """Checks on a full grid; each check counts the events of its own window."""
    ctes = f"""{tag}_s as (
  select time_bucket(interval '{step} seconds', event_ts) + interval '{step} seconds' as slot, {columns}
  from fx_log group by 1),
{tag}_g as (select unnest(generate_series(min(slot), max(slot) + interval '{width} seconds',
  interval '{step} seconds')) as t from {tag}_s),
{tag}_c as (select t, sum(columns(* exclude (t, slot))) from {tag}_g join {tag}_s
  on slot <= t and slot > t - interval '{width} seconds' group by t),
{tag}_r as (select t, row_number() over (order by t) as n from {tag}_c where {condition}),
{tag}_i as (select min(t) as pending_from, max(t) as last_true from {tag}_r
  group by t - n * interval '{step} seconds')"""
    out = f"""select '{name}' as alert, pending_from, pending_from + interval '{hold} seconds' as fired_at, last_true
from {tag}_i where last_true - pending_from >= interval '{hold} seconds'"""
    return ctes, out


def alerts(log: str, *rules: tuple[str, str]) -> str:
    return with_(log, *(r[0] for r in rules)) + " union all ".join(r[1] for r in rules)


SQL["alert_error_rate"] = alerts(
    LOG,
    alert("a", "MDMProcessingErrorRateHigh", 30, 300, 120,
          "count(*) as processed, count(*) filter (not ok) as errors", "errors / processed > 0.01"),
)
SLOW = LOG.replace("fx_log as (", "fx_log as (select * replace (latency_ms * 5 as latency_ms) from (") + ")"
SQL["alert_latency"] = alerts(
    SLOW,
    alert("a", "MDMProcessingLatencyHigh", 30, 300, 300, f"{LE}, count(*) as total", f"{quantile(0.99)} > 500"),
    alert("b", "MDMProcessingLatencyDegraded", 60, 300, 600, f"{LE}, count(*) as total", f"{quantile(0.95)} > 100"),
)
DUP = "count(*) as processed, count(*) filter (ok and is_duplicate) as duplicates"
SQL["alert_dup_anomaly"] = alerts(
    LOG,
    alert("a", "MDMDuplicateRateAnomalyLow", 60, 3600, 3600, DUP,
          "duplicates / processed < 0.01 and processed / 3600.0 > 0.0"),
    alert("b", "MDMDuplicateRateAnomalyHigh", 60, 3600, 3600, DUP, "duplicates / processed > 0.5"),
)
SQL["alert_dup_anomaly_under_load"] = SQL["alert_dup_anomaly"].replace("3600.0 > 0.0", "3600.0 > 10.0")
SQL["sli_stream"] = by("5 minutes") + """
select window_start, processed, errors, duplicates, round(processed / 300.0::double, 6) as events_per_sec,
  round(errors::double / processed, 6) as error_ratio,
  round(duplicates::double / processed, 6) as duplicate_ratio from w"""
