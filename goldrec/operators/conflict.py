"""Conflict rules: which side wins when a field has two different values.

A rule is a Column over one event and the record state just before it:
``source_system, event_ts`` (incoming) and ``prev_source, prev_ts`` (current).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from goldrec.config import FieldRule

# ---- fixed values: texts of the conflict log ------------------------------
INCOMING_LATER = "%s event has later timestamp (%s > %s)"
CURRENT_LATER = "Current value has later timestamp (%s > %s)"
SAME_TIME = "Same timestamp, preferring incoming value from %s"
CURRENT_TRUSTED = "%s is a trusted source, keeping current value"
INCOMING_TRUSTED = "%s is a trusted source, preferring incoming value"
BOTH_TRUSTED_LATER = "Both sources trusted, %s has later timestamp"
BOTH_TRUSTED_KEEP = "Both sources trusted, %s has later or equal timestamp"
NONE_TRUSTED = "No trusted sources configured, falling back to latest update"
MOST_FREQUENT = (
    "Current value '%s' preferred as most frequent (observed longer than incoming '%s' from %s)"
)
FIRST_SEEN = "Both values non-null, keeping first seen value from %s"
MERGED = "Merged %d values using %s strategy (max: %d)"
# ---------------------------------------------------------------------------



def _event() -> tuple[Column, Column]:
    return F.col("source_system"), F.col("event_ts")


def _previous() -> tuple[Column, Column]:
    return F.col("prev_source"), F.col("prev_ts")


def is_later() -> Column:
    """The event is strictly later than the record; unknown counts as not."""
    return F.coalesce(F.col("event_ts") > F.col("prev_ts"), F.lit(False))


def _trusted(source: Column, rule: FieldRule) -> Column:
    return F.coalesce(source.isin(*rule.trusted), F.lit(False))


def latest_update(rule: FieldRule) -> Column:
    return F.col("event_ts") >= F.col("prev_ts")


def trusted_source(rule: FieldRule) -> Column:
    if not rule.trusted:
        return is_later()
    incoming = _trusted(F.col("source_system"), rule)
    current = _trusted(F.col("prev_source"), rule)
    return F.when(incoming == current, is_later()).otherwise(incoming)


def keep_current(rule: FieldRule) -> Column:
    return F.lit(False)


INCOMING_WINS = {
    "LATEST_UPDATE": latest_update,
    "TRUSTED_SOURCE": trusted_source,
    "MOST_FREQUENT": keep_current,
    "NON_NULL": keep_current,
}


def incoming_wins(rule: FieldRule) -> Column:
    """True when the incoming value replaces a different current one."""
    if rule.strategy not in INCOMING_WINS:
        raise ValueError(f"{rule.strategy} does not choose a side")
    return F.coalesce(INCOMING_WINS[rule.strategy](rule), F.lit(False))


def is_trusted_event(rule: FieldRule) -> Column:
    return _trusted(F.col("source_system"), rule)


def _iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def reason(rule: FieldRule, current: Column, incoming: Column, size: Column | None = None) -> Column:
    """The log text of one resolved conflict. ``size`` is the merged list's size."""
    (source, ts), (prev_source, prev_ts) = _event(), _previous()
    if rule.strategy == "LATEST_UPDATE":
        return (
            F.when(ts > prev_ts, F.format_string(INCOMING_LATER, source, _iso(ts), _iso(prev_ts)))
            .when(ts < prev_ts, F.format_string(CURRENT_LATER, _iso(prev_ts), _iso(ts)))
            .otherwise(F.format_string(SAME_TIME, source))
        )
    if rule.strategy == "TRUSTED_SOURCE":
        if not rule.trusted:
            return F.lit(NONE_TRUSTED)
        new, old = _trusted(source, rule), _trusted(prev_source, rule)
        return (
            F.when(old & ~new, F.format_string(CURRENT_TRUSTED, prev_source))
            .when(new & ~old, F.format_string(INCOMING_TRUSTED, source))
            .when(new & old & (ts > prev_ts), F.format_string(BOTH_TRUSTED_LATER, source))
            .when(new & old, F.format_string(BOTH_TRUSTED_KEEP, prev_source))
            .otherwise(NONE_TRUSTED)
        )
    if rule.strategy == "MOST_FREQUENT":
        return F.format_string(MOST_FREQUENT, current, incoming, source)
    if rule.strategy == "NON_NULL":
        return F.format_string(FIRST_SEEN, prev_source)
    return F.format_string(MERGED, size, F.lit(rule.merge_type), F.lit(rule.max_values))
