"""Shared parts of the check statements: inputs, keys and the step-by-step fold."""

from __future__ import annotations

from goldrec.config import SOURCE_SYSTEMS, FieldRule, MasteringConfig
from goldrec.operators.ingest import REASONS
from goldrec.sources import fixtures as fx

SQL: dict[str, str] = {}


def fixture(name: str, text: str) -> str:
    body = text.format(events="events", customer="customer")
    return f"{name} as ({body})"


REQUESTS = fixture("fx_requests", fx.REQUESTS)
LOG = fixture("fx_log", fx.PROCESSING_LOG)
ERRORS = fixture("fx_errors", fx.ERRORS)
CONTACTS = ", ".join(
    (
        fixture("fx_golden", fx.GOLDEN_CONTACTS),
        fixture("fx_incoming", fx.INCOMING_CONTACTS),
    )
)


def jtrim(c: str) -> str:
    return rf"regexp_replace({c}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


def alnum(c: str) -> str:
    return f"regexp_replace({c}, '[^a-zA-Z0-9]', '', 'g')"


def with_(*ctes: str, recursive: bool = False) -> str:
    return ("with recursive " if recursive else "with ") + ", ".join(ctes) + " "


_sources = ", ".join(f"'{s}'" for s in SOURCE_SYSTEMS)
CHECKED = f"""{REQUESTS}, clean as (
  select event_id, {alnum('national_id')} as national_id,
    nfc_normalize({jtrim('name')}) as name, nfc_normalize({jtrim('email')}) as email,
    nfc_normalize({jtrim('phone')}) as phone, upper({jtrim('source_system')}) as source_system,
    client_key, event_ts, done_ts
  from fx_requests),
checked as (
  select *, case
    when national_id is null or national_id = '' then '{REASONS[0]}'
    when length(national_id) not between 12 and 13 then '{REASONS[1]}'
    when source_system is null or source_system = '' then '{REASONS[2]}'
    when source_system not in ({_sources}) then '{REASONS[3]}' end as reason
  from clean)"""
VALID = f"{CHECKED}, valid as (select * exclude (reason) from checked where reason is null)"


def keyed(factor: int = 1) -> str:
    has = f"client_key is not null and {jtrim('client_key')} <> ''"
    return f"""{VALID}, keyed as (
  select *, case when {has} then 'CLIENT' else 'DETERMINISTIC' end as key_type,
    case when {has} then sha256(client_key)
      else sha256(lower(national_id) || '|' || upper(source_system)) end as key_hash,
    case when {has} then {24 * factor} else {6 * factor} end as ttl_hours
  from valid)"""


def classified(factor: int = 1, in_flight: bool = False) -> str:
    processing = "when event_ts < first_done then 'PROCESSING'" if in_flight else ""
    return f"""{keyed(factor)}, firsts as (
  select key_hash, min(event_ts) as first_ts, arg_min(event_id, (event_ts, event_id)) as first_event_id,
    arg_min(done_ts, (event_ts, event_id)) as first_done
  from keyed group by key_hash),
classified as (
  select *, case when event_id = first_event_id then 'MISS'
    when event_ts > expires_at then 'EXPIRED' {processing} else 'HIT' end as result
  from (select *, first_ts + ttl_hours * interval 1 hour as expires_at
        from keyed join firsts using (key_hash)))"""


ACCEPTED = f"""{classified()}, accepted as (
  select event_id, national_id, name, email, phone, source_system, client_key, event_ts, done_ts
  from classified where result in ('MISS', 'EXPIRED'))"""


def _wins(rule: FieldRule, source: str = "s.last_source") -> str:
    later = "e.event_ts > s.updated_at"
    if rule.strategy == "LATEST_UPDATE":
        return "e.event_ts >= s.updated_at"
    if rule.strategy in ("MOST_FREQUENT", "NON_NULL"):
        return "false"
    if not rule.trusted:
        return later
    names = ", ".join(f"'{t}'" for t in rule.trusted)
    new, old = f"e.source_system in ({names})", f"{source} in ({names})"
    return f"(case when {old} and not {new} then false when {new} and not {old} then true else {later} end)"


def _pick(field: str, wins: str, value: str = "") -> str:
    value = value or field
    return (
        f"case when s.{field} is null then e.{value} when e.{value} is null then s.{field} "
        f"when s.{field} = e.{value} then s.{field} when {wins} then e.{value} else s.{field} end"
    )


def fold(cfg: MasteringConfig = MasteringConfig(), source: str = "accepted") -> str:
    """``states``: the record after each event, one recursion step per event."""
    name, email, phone = (cfg.rule(f) for f in ("name", "email", "phone"))
    if cfg.provenance == "field":
        name_wins = _wins(name, "s.name_source")
    else:
        name_wins = _wins(name)
    clock = "e.done_ts" if cfg.clock == "processing" else "greatest(s.updated_at, e.event_ts)"
    start = "done_ts" if cfg.clock == "processing" else "event_ts"
    if phone.strategy == "MERGE":
        joined = "case when list_contains(s.phones, e.phone) then s.phones else list_append(s.phones, e.phone) end"
        n = phone.max_values
        phones = f"""case when e.phone is null then s.phones when len(s.phones) = 0 then [e.phone]
          when s.phones = [e.phone] then s.phones
          else list_slice({joined}, greatest(1, len({joined}) - {n - 1}), len({joined})) end"""
    else:
        phones = f"""case when e.phone is null then s.phones when len(s.phones) = 0 then [e.phone]
          when s.phones = [e.phone] then s.phones
          when {_wins(phone)} then [e.phone] else s.phones end"""
    none = "[]::varchar[]"
    vouched = ", ".join(f"'{t}'" for t in name.trusted) or "null"
    took = f"""(s.name is null and e.name is not null)
      or (e.name is not null and s.name <> e.name and {name_wins})
      or (e.name = s.name and e.source_system in ({vouched}))"""
    return f"""ev as (
  select *, row_number() over (partition by national_id order by event_ts, event_id) as rn
  from {source}),
states as (
  select national_id, rn, event_id, event_ts, source_system, 1::bigint as version,
    name, email, case when phone is null then {none} else [phone] end as phones,
    source_system as last_source, source_system as name_source, {start} as updated_at,
    event_ts as created_at, null::varchar as name_before, null::varchar as email_before,
    {none} as phones_before, name as name_in, email as email_in, phone as phone_in,
    null::varchar as prev_source, null::timestamp as prev_ts
  from ev where rn = 1
  union all
  select e.national_id, e.rn, e.event_id, e.event_ts, e.source_system, s.version + 1,
    {_pick('name', name_wins)}, {_pick('email', _wins(email))}, {phones},
    e.source_system, case when {took} then e.source_system else s.name_source end, {clock},
    s.created_at, s.name, s.email, s.phones, e.name, e.email, e.phone, s.last_source, s.updated_at
  from states s join ev e on e.national_id = s.national_id and e.rn = s.rn + 1)"""


LAST = """last_state as (
  select * from states qualify rn = max(rn) over (partition by national_id))"""
JSON_PHONES = "case when len(phones) > 0 then to_json(phones)::varchar end"
GOLDEN = f"""golden as (
  select sha256('golden|' || national_id) as id, national_id, name, email,
    {JSON_PHONES} as phone_json, 100::smallint as confidence_score, version, created_at,
    updated_at, last_source as last_source_system
  from last_state)"""


def golden(cfg: MasteringConfig = MasteringConfig()) -> str:
    return with_(ACCEPTED, fold(cfg), LAST, GOLDEN, recursive=True)


def trace(cfg: MasteringConfig = MasteringConfig()) -> str:
    return with_(ACCEPTED, fold(cfg), recursive=True)
