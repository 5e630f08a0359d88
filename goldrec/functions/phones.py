"""The phone list: parsing, storing and merging."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from goldrec.config import FieldRule
from goldrec.functions.text import is_blank, jtrim

_LIST = "array<string>"


def parse_phones(c: Column) -> Column:
    """Blank gives no phones, JSON list text gives its members, other text one phone."""
    single = F.array(c)
    parsed = F.from_json(c, _LIST)
    return (
        F.when(is_blank(c), F.array().cast(_LIST))
        .when(jtrim(c).startswith("["), F.coalesce(parsed, single))
        .otherwise(single)
    )


def serialize_phones(phones: Column) -> Column:
    return F.when(F.size(phones) > 0, F.to_json(phones))


def some(phones: Column) -> Column:
    """The list, or null when it is empty."""
    return F.when(F.size(phones) > 0, phones)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed one time however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def merge_phones(current: Column, incoming: Column, rule: FieldRule) -> Column:
    """One merge step over non-null lists: an empty side or an equal side keeps
    the other as it is; otherwise the ordered union, cut to the newest values."""
    joined = F.array_compact(F.concat(current, incoming))
    if rule.merge_type == "UNION":
        joined = F.array_distinct(joined)

    def newest(values: Column) -> Column:
        start = F.greatest(F.lit(1), F.size(values) - F.lit(rule.max_values - 1))
        return F.slice(values, start, rule.max_values)

    merged = _once(joined, newest)
    merged = _once(merged, lambda values: F.when(F.size(values) > 0, values).otherwise(current))
    return (
        F.when(F.size(incoming) == 0, current)
        .when(F.size(current) == 0, incoming)
        .when(current == incoming, current)
        .otherwise(merged)
    )
