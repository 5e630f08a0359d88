"""Checks of the golden record, its trace and the read side."""

from goldrec.config import STRATEGIES, FieldRule, MasteringConfig
from goldrec.oracle.common import (
    ACCEPTED,
    CONTACTS,
    GOLDEN,
    JSON_PHONES,
    LAST,
    SQL,
    fold,
    golden,
    trace,
    with_,
)

COLUMNS = (
    "id, national_id, name, email, phone_json, confidence_score, version, created_at, "
    "updated_at, last_source_system"
)
SQL["golden_record"] = f"{golden()} select {COLUMNS} from golden"
SQL["golden_upsert"] = SQL["golden_record"]
SQL["master_stream"] = SQL["golden_record"]
SQL["golden_trace"] = f"""{trace()} select national_id, event_id, version,
  case when version = 1 then 'CREATED' else 'UPDATED' end as action, name, email,
  {JSON_PHONES} as phone_json from states"""


def iso(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%dT%H:%M:%S.%fZ')"


CONFLICTS = f"""conflicts as (
  select national_id, event_id, event_ts, prev_source as current_source,
    source_system as incoming_source, 'name' as field_name, name_before as current_value,
    name_in as incoming_value, 'TRUSTED_SOURCE' as strategy,
    case when source_system = 'CRM' and prev_source <> 'CRM' then 'INCOMING'
      when prev_source = 'CRM' and source_system <> 'CRM' then 'CURRENT'
      when event_ts > prev_ts then 'INCOMING' else 'CURRENT' end as winner,
    name as resolved_value,
    case when prev_source = 'CRM' and source_system <> 'CRM'
        then 'CRM is a trusted source, keeping current value'
      when source_system = 'CRM' and prev_source <> 'CRM'
        then 'CRM is a trusted source, preferring incoming value'
      when source_system = 'CRM' and event_ts > prev_ts
        then 'Both sources trusted, CRM has later timestamp'
      when source_system = 'CRM' then 'Both sources trusted, CRM has later or equal timestamp'
      else 'No trusted sources configured, falling back to latest update' end as reason
  from states where name_before <> name_in
  union all
  select national_id, event_id, event_ts, prev_source, source_system, 'email', email_before,
    email_in, 'LATEST_UPDATE', case when event_ts >= prev_ts then 'INCOMING' else 'CURRENT' end,
    email,
    case when event_ts > prev_ts then source_system || ' event has later timestamp (' ||
        {iso('event_ts')} || ' > ' || {iso('prev_ts')} || ')'
      when event_ts < prev_ts then 'Current value has later timestamp (' ||
        {iso('prev_ts')} || ' > ' || {iso('event_ts')} || ')'
      else 'Same timestamp, preferring incoming value from ' || source_system end
  from states where email_before <> email_in
  union all
  select national_id, event_id, event_ts, prev_source, source_system, 'phone',
    to_json(phones_before)::varchar, to_json([phone_in])::varchar, 'MERGE', 'MERGED',
    to_json(phones)::varchar,
    'Merged ' || len(phones)::varchar || ' values using UNION strategy (max: 5)'
  from states where len(phones_before) > 0 and phone_in is not null and phones_before <> [phone_in])"""
WITH_CONFLICTS = with_(ACCEPTED, fold(), CONFLICTS, recursive=True)

SQL["field_conflicts"] = f"{WITH_CONFLICTS} select * from conflicts"
SQL["conflict_log"] = f"""{WITH_CONFLICTS} select event_ts as "timestamp",
  '***' || right(national_id, 4) as national_id, field_name, current_value, incoming_value,
  current_source, incoming_source, strategy, resolved_value, reason from conflicts"""
_strategies = ", ".join(f"('{s}')" for s in STRATEGIES)
SQL["conflicts_by_strategy"] = f"""{WITH_CONFLICTS} select s.strategy, count(c.strategy) as n
from (values {_strategies}) s(strategy) left join conflicts c using (strategy) group by 1"""


def outcome(before: str, incoming: str) -> str:
    return f"""case when {before} is null and {incoming} is null then 'BOTH_NULL'
      when {before} is null then 'CURRENT_NULL' when {incoming} is null then 'INCOMING_NULL'
      when {before} = {incoming} then 'EQUAL' else 'CONFLICT' end"""


PB = "(case when len(phones_before) > 0 then phones_before end)"
PI = "(case when phone_in is not null then [phone_in] end)"
SQL["pre_rules"] = f"""{trace()} select field_name, outcome, count(*) as n from (
  select 'name' as field_name, {outcome('name_before', 'name_in')} as outcome from states
  union all select 'email', {outcome('email_before', 'email_in')} from states
  union all select 'phone', {outcome(PB, PI)} from states) group by 1, 2"""


def resolved(strategy: str, **options) -> str:
    rule = FieldRule(strategy, **options)
    cfg = MasteringConfig().with_rule("name", rule).with_rule("email", rule)
    return f"{golden(cfg)} select national_id, name, email, version from golden"


SQL["resolve_latest_update"] = resolved("LATEST_UPDATE")
SQL["resolve_trusted_source"] = resolved("TRUSTED_SOURCE", trusted=("BANK", "GOVERNMENT"))
SQL["resolve_most_frequent"] = resolved("MOST_FREQUENT")
SQL["resolve_non_null"] = resolved("NON_NULL")
SQL["resolve_most_frequent_mode"] = f"""{with_(ACCEPTED)} select national_id, name,
  (sum(n) over (partition by national_id))::bigint as seen from (
  select national_id, name, count(*) as n, min((event_ts, event_id)) as o from accepted
  where name is not null group by 1, 2)
qualify row_number() over (partition by national_id order by n desc, o) = 1"""
_three = FieldRule("MERGE", merge_type="UNION", max_values=3)
SQL["resolve_merge"] = (
    f"{golden(MasteringConfig().with_rule('phone', _three))} select national_id, phone_json from golden"
)
_config = MasteringConfig(
    fields={"phone": FieldRule("LATEST_UPDATE"), "name": FieldRule("TRUSTED_SOURCE")},
    default=FieldRule("NON_NULL"),
)
SQL["strategy_config"] = f"{golden(_config)} select national_id, name, email, phone_json from golden"
SQL["golden_field_provenance"] = (
    f"{golden(MasteringConfig(provenance='field'))} select national_id, name, version from golden"
)
SQL["golden_processing_clock"] = (
    f"{golden(MasteringConfig(clock='processing'))} select national_id, name, email, updated_at from golden"
)

# ---- read side ------------------------------------------------------------

MODEL = """id, national_id as "nationalId", name, email, phone_json as phone,
  confidence_score as "confidenceScore", version, created_at as "createdAt",
  updated_at as "updatedAt", last_source_system as "lastSourceSystem" """
ONE = "national_id = '000000000008'"
SQL["list_customers"] = f"""{golden()} select {MODEL} from (
  select * from golden order by updated_at desc, national_id limit 20 offset 20)"""
SQL["list_customers_by_name"] = f"""{golden()} select {MODEL} from (
  select * from golden order by name, national_id limit 25 offset 50)"""
SQL["customers_after"] = SQL["list_customers"]
SQL["customer_by_id"] = f"{golden()} select {MODEL} from golden where id = sha256('golden|000000000008')"
SQL["customer_by_national_id"] = f"{golden()} select {MODEL} from golden where {ONE}"
WANTED = "select lpad(substr(incoming_id, 4), 12, '0') from fx_incoming"
WITH_CONTACTS = with_(ACCEPTED, fold(), LAST, GOLDEN, CONTACTS, recursive=True)
SQL["customers_by_national_ids"] = (
    f"{WITH_CONTACTS} select {MODEL} from golden where national_id in ({WANTED})"
)
SQL["search_by_name"] = f"""{golden()} select {MODEL} from (
  select * from golden where contains(lower(name), 'jon') order by national_id limit 50)"""
SQL["exists_by_national_id"] = f"""{WITH_CONTACTS} select national_id,
  national_id in (select national_id from golden) as found from fx_golden"""
SQL["customer_count"] = f"{golden()} select count(*) as customers from golden"
SQL["read_model"] = f"{golden()} select {MODEL} from golden"
SQL["table_row_counts"] = f"""{golden()} select 'customer_raw' as table_name, count(*) as "rows" from accepted
union all select 'customer_golden', count(*) from golden"""
