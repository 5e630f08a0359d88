"""The same results computed one event at a time in plain Python."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

from goldrec.config import MasteringConfig

START = datetime(2024, 1, 15, 10, 30)
SOURCES = ("CRM", "BANK", "WEB", "GOVERNMENT", "MOBILE")
EVENT_SCHEMA = (
    "event_id bigint, national_id string, name string, email string, phone string, "
    "source_system string, event_ts timestamp_ntz, processed_at timestamp_ntz"
)


def events(seed: int, count: int = 400, customers: int = 12, hot_share: float = 0.34):
    """Random events with nulls, equal times, phone lists and one hot customer."""
    rnd = random.Random(seed)
    rows = []
    for i in range(count):
        key = 0 if rnd.random() < hot_share else rnd.randrange(customers)
        phones = [f"+1-555-{rnd.randrange(9)}" for _ in range(rnd.choice((1, 1, 1, 2, 6)))]
        phone = rnd.choice((None, "", " ", phones[0], phones[0], phones[0], json.dumps(phones)))
        at = START + timedelta(seconds=rnd.randrange(count // 2))
        rows.append(
            (
                i,
                f"{key:04d}-{key:08d}",
                rnd.choice((None, "Ann", "Anna", "Bob", "Al")),
                rnd.choice((None, "a@x.org", "b@x.org", "")),
                phone,
                rnd.choice(SOURCES),
                at,
                at + timedelta(seconds=rnd.randrange(3)),
            )
        )
    rnd.shuffle(rows)
    return rows


def parse(phone):
    if phone is None or not phone.strip():
        return []
    return json.loads(phone) if phone.strip().startswith("[") else [phone]


def wins(rule, source, ts, last_source, last_ts):
    if rule.strategy == "LATEST_UPDATE":
        return ts >= last_ts
    if rule.strategy in ("MOST_FREQUENT", "NON_NULL"):
        return False
    if rule.trusted and (source in rule.trusted) != (last_source in rule.trusted):
        return source in rule.trusted
    return ts > last_ts


def merged(current, incoming, rule):
    values = [v for v in current + incoming if v is not None]
    if rule.merge_type == "UNION":
        values = list(dict.fromkeys(values))
    return values[-rule.max_values :]


def step(state, row, cfg: MasteringConfig):
    """The record after one event; ``state`` is None for a new customer."""
    event_id, key, name, email, phone, source, ts, processed = row
    incoming = {"name": name, "email": email, "phone": parse(phone) or None}
    if state is None:
        now = processed if cfg.clock == "processing" else ts
        return dict(
            incoming,
            version=1,
            source=source,
            updated=now,
            created=ts,
            kept_from={f: source for f in incoming},
            conflicts=[],
        )
    new = dict(state, version=state["version"] + 1, source=source, conflicts=[])
    new["kept_from"] = dict(state["kept_from"])
    for field, value in incoming.items():
        rule, current = cfg.rule(field), state[field]
        if value is None:
            continue
        if value == current:
            # A trusted source that gives the kept value vouches for it.
            if source in rule.trusted:
                new["kept_from"][field] = source
            continue
        if current is None:
            new[field], new["kept_from"][field] = value, source
            continue
        if rule.strategy == "MERGE":
            new[field] = merged(current, value, rule)
        else:
            last = state["kept_from"][field] if cfg.provenance == "field" else state["source"]
            if wins(rule, source, ts, last, state["updated"]):
                new[field], new["kept_from"][field] = value, source
        new["conflicts"].append(field)
    new["updated"] = processed if cfg.clock == "processing" else max(state["updated"], ts)
    return new


def fold(rows, cfg=MasteringConfig(), states=None):
    """Final state per customer and the trace, events taken in (time, id) order."""
    states, trace = dict(states or {}), []
    for row in sorted(rows, key=lambda r: (r[6], r[0])):
        key = "".join(c for c in row[1] if c.isalnum())
        states[key] = step(states.get(key), row, cfg)
        trace.append((key, row[0], states[key]))
    return states, trace


def as_row(state):
    return (
        state["name"],
        state["email"],
        tuple(state["phone"] or ()),
        state["version"],
        state["created"],
        state["updated"],
        state["source"],
    )
