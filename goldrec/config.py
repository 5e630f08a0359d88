"""Settings of the jobs. Defaults are the values the service ships with."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# ---- fixed values ---------------------------------------------------------
SOURCE_SYSTEMS = ("CRM", "BANK", "WEB", "MOBILE", "PARTNER", "GOVERNMENT")
NATIONAL_ID_MIN = 12
NATIONAL_ID_MAX = 13
CLIENT_TTL_HOURS = 24
DETERMINISTIC_TTL_HOURS = 6
ERROR_TYPES = ("TRANSIENT", "PERMANENT", "BUSINESS")
STRATEGIES = ("LATEST_UPDATE", "TRUSTED_SOURCE", "MOST_FREQUENT", "NON_NULL", "MERGE")
SLO_TARGET = 99.9
LATENCY_BUCKETS_MS = (10, 25, 50, 100, 250, 500, 1000)
LOOKUP_BUCKETS_MS = (1, 5, 10, 25, 50)
ALERT_CHANNELS = ("email", "prometheus", "sms")
DLQ_ALERT_PERCENT = 1.0
DLQ_ALERT_WINDOW_SECONDS = 300
RETRY_ATTEMPTS = 3
RETRY_INITIAL_MS = 1000
RETRY_MULTIPLIER = 2.0
RETRY_MAX_MS = 10000
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class FieldRule:
    """How one field settles a conflict."""

    strategy: str = "LATEST_UPDATE"
    trusted: tuple[str, ...] = ()
    merge_type: str = "UNION"
    max_values: int = 10

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy!r}")
        if self.merge_type not in ("UNION", "APPEND"):
            raise ValueError(f"unknown merge type {self.merge_type!r}")
        if self.max_values < 1:
            raise ValueError("max_values must be at least 1")


def _default_fields() -> dict[str, FieldRule]:
    return {
        "nationalId": FieldRule("TRUSTED_SOURCE", trusted=("BANK", "GOVERNMENT")),
        "email": FieldRule("LATEST_UPDATE"),
        "phone": FieldRule("MERGE", merge_type="UNION", max_values=5),
        "name": FieldRule("TRUSTED_SOURCE", trusted=("CRM",)),
    }


@dataclass(frozen=True)
class MasteringConfig:
    """Per-field rules plus the clock and provenance the merge uses.

    ``clock="event"`` compares an event's time with the latest time already
    applied; ``clock="processing"`` compares it with the ``processed_at`` of the
    previously applied event. ``provenance="record"`` asks whether the *last*
    event of the record came from a trusted source; ``"field"`` asks whether one
    gave or confirmed the kept value.
    """

    fields: dict[str, FieldRule] = field(default_factory=_default_fields)
    default: FieldRule = FieldRule()
    clock: str = "event"
    provenance: str = "record"

    def __post_init__(self):
        if self.clock not in ("event", "processing"):
            raise ValueError(f"unknown clock {self.clock!r}")
        if self.provenance not in ("record", "field"):
            raise ValueError(f"unknown provenance {self.provenance!r}")
        for name in ("name", "email"):
            if self.rule(name).strategy == "MERGE":
                raise ValueError(f"{name} holds one value and cannot use MERGE")

    def rule(self, name: str) -> FieldRule:
        return self.fields.get(name, self.default)

    def with_rule(self, name: str, rule: FieldRule) -> "MasteringConfig":
        return replace(self, fields={**self.fields, name: rule})
