"""Checks of sources, sinks, column transforms, validation and idempotency."""

from goldrec.oracle.common import (
    ACCEPTED,
    CHECKED,
    CONTACTS,
    ERRORS,
    REQUESTS,
    SQL,
    VALID,
    alnum,
    classified,
    jtrim,
    keyed,
    trace,
    with_,
)

REQ = with_(REQUESTS)
FIXTURE_COLUMNS = (
    "event_id, client_key, event_ts, national_id, name, email, phone, source_system"
)

SQL["src_requests"] = f"{REQ} select {FIXTURE_COLUMNS} from fx_requests"
SQL["src_raw_events"] = (
    with_(ACCEPTED)
    + "select event_id::varchar as event_id, national_id, name, email, phone, source_system, event_ts from accepted"
)
SQL["sink_raw_events"] = with_(ACCEPTED) + """
select lower(trim(national_id)) as key, event_id::varchar as event_id, name, 'FULL' as enrichment,
  5 as n_headers, national_id as idempotency_header, '1.0' as version from accepted"""
SQL["raw_audit"] = with_(ACCEPTED) + """
select sha256('raw|' || event_id::varchar) as id, event_id, national_id, name, email, phone,
  source_system, event_ts as created_at, email as payload_email from accepted"""
SQL["mastered_events"] = trace() + """
select sha256('mastered|' || event_id::varchar) as event_id,
  sha256('golden|' || national_id) as golden_record_id, national_id, name, email,
  case when len(phones) > 0 then to_json(phones)::varchar end as phone,
  case when version = 1 then 'CREATED' else 'UPDATED' end as action, event_ts as "timestamp"
from states"""

SQL["norm_national_id"] = f"""{REQ} select event_id,
  case when {jtrim('national_id')} <> '' then {alnum('national_id')} end as norm_national_id
from fx_requests"""
zoe = "chr(9) || ' Zoe' || chr(776) || ' ' || name"
SQL["norm_text"] = f"{REQ} select event_id, nfc_normalize({jtrim(zoe)}) as norm_text from fx_requests"
SQL["norm_source"] = f"{REQ} select event_id, upper({jtrim('source_system')}) as norm_source from fx_requests"
SQL["norm_email"] = f"""{with_(CONTACTS)} select incoming_id,
  nullif(lower({jtrim('email')}), '') as norm_email from fx_incoming"""
SQL["norm_name"] = f"{REQ} select event_id, coalesce(lower({jtrim('name')}), '') as norm_name from fx_requests"
DIGITS = "regexp_replace(phone, '[^0-9]', '', 'g')"
SQL["norm_phone"] = f"""{with_(CONTACTS)} select incoming_id,
  coalesce(case when {DIGITS} like '1%' and length({DIGITS}) = 11 then substr({DIGITS}, 2)
    else {DIGITS} end, '') as norm_phone from fx_incoming"""
SQL["mask_national_id"] = f"""{REQ} select event_id, case when length(national_id) > 4
  then '***' || right(national_id, 4) else '***' end as mask_national_id from fx_requests"""
SQL["mask_key"] = f"""{REQ} select event_id, case when length(client_key) > 8
  then left(client_key, 4) || '...' || right(client_key, 4) else '***' end as mask_key from fx_requests"""
SQL["det_key"] = f"""{REQ} select event_id,
  sha256(lower({alnum('national_id')}) || '|' || upper({jtrim('source_system')})) as det_key
from fx_requests"""
SQL["client_key_hash"] = f"{REQ} select event_id, sha256(client_key) as client_key_hash from fx_requests"
SQL["serialize_phones"] = f"""{REQ} select event_id,
  case when phone is not null then to_json([phone])::varchar end as serialize_phones from fx_requests"""
SQL["truncate_msg"] = f"""{with_(ERRORS)} select event_id, case when length(message) > 500
  then left(message, 500) || '...' else message end as truncate_msg from fx_errors"""
SQL["parse_phones"] = f"""{REQ} select event_id, 0 as position, phone from fx_requests
  where phone is not null
union all select event_id, 1, '+1-555-0000' from fx_requests
  where phone is not null and event_id % 3 = 0"""
SQL["names_match"] = f"""{with_(CONTACTS)} select incoming_id,
  lower({jtrim('i.name')}) is not distinct from lower({jtrim('g.name')}) as names_match
from fx_incoming i join fx_golden g on g.national_id = lpad(substr(incoming_id, 4), 12, '0')"""

SQL["valid_requests"] = f"{with_(VALID)} select * from valid"
SQL["invalid_requests"] = f"{with_(CHECKED)} select * from checked where reason is not null"
SQL["require_national_id"] = f"""{with_(VALID)} select event_id, 'BUSINESS' as error_type,
  'Event has null or blank nationalId: eventId=' || event_id::varchar as error_message
from valid where event_id % 13 = 0"""
SQL["validation_summary"] = f"""{with_(CHECKED)}
select coalesce(reason, 'accepted') as reason, count(*) as n from checked group by 1"""

CLASS_COLUMNS = "event_id, key_hash, first_event_id, expires_at, result"
SQL["idem_key"] = f"{with_(keyed())} select event_id, key_type, key_hash, ttl_hours from keyed"
SQL["idem_classify"] = f"{with_(classified())} select {CLASS_COLUMNS} from classified"
SQL["idem_classify_long_ttl"] = f"{with_(classified(24))} select {CLASS_COLUMNS} from classified"
SQL["idem_stream"] = SQL["idem_classify_long_ttl"]
SQL["ingest_stream"] = f"""{with_(classified(24))}
select event_id as request_id,
  (case when result = 'HIT' then first_event_id else event_id end)::varchar as event_id,
  case when result = 'HIT' then 'CACHED' else 'ACCEPTED' end as status, null::varchar as reason from classified
union all select event_id, null, 'REJECTED', reason from checked where reason is not null"""
SQL["ingest_stream_events"] = f"""{with_(classified(24))} select event_id::varchar as event_id, national_id,
  name, email, phone, source_system, event_ts from classified where result in ('MISS', 'EXPIRED')"""
SQL["idem_in_flight"] = f"{with_(classified(24, True))} select {CLASS_COLUMNS} from classified"
SQL["idem_accepted"] = f"""{with_(classified(24))} select event_id as request_id,
  case when result = 'HIT' then first_event_id else event_id end as event_id,
  case when result = 'HIT' then 'CACHED' else 'ACCEPTED' end as status from classified"""
SQL["idem_keys_table"] = f"""{with_(classified())} select key_hash, client_key, event_id,
  'COMPLETED' as status, event_ts as created_at, expires_at from classified where result = 'MISS'"""
SQL["idem_stats"] = f"""{with_(classified(24))} select key_type, result, count(*) as n,
  round(count(*) / sum(count(*)) over (partition by key_type), 6) as ratio
from classified group by key_type, result"""
SQL["idem_rearm"] = f"""{with_(keyed(24),
  "ord as (select *, row_number() over (partition by key_hash order by event_ts, event_id) as rn from keyed)",
  '''walk as (
    select key_hash, rn, event_ts, event_id, true as taken,
      event_ts + ttl_hours * interval 1 hour as expiry from ord where rn = 1
    union all
    select o.key_hash, o.rn, o.event_ts, o.event_id, o.event_ts > w.expiry,
      case when o.event_ts > w.expiry then o.event_ts + o.ttl_hours * interval 1 hour else w.expiry end
    from walk w join ord o on o.key_hash = w.key_hash and o.rn = w.rn + 1)''', recursive=True)}
select key_hash, event_ts, event_id from walk where taken"""
SQL["idem_rearm_stream"] = SQL["idem_rearm"]

SQL["dedup_event_id"] = f"""{with_(ACCEPTED)} select event_id, national_id, event_ts from accepted
where event_ts >= timestamp '2024-01-08'"""
SQL["duplicates_by_customer"] = f"""{with_(ACCEPTED)} select event_id, national_id,
  row_number() over (partition by national_id order by event_ts, event_id) > 1 as is_duplicate
from accepted"""
