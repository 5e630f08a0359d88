"""Cleaning, keys and masks, as Columns over whole tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character up to U+0020. Spark's own trim() removes spaces only.
_EDGES = "".join(map(chr, range(0x21)))


def jtrim(c: Column) -> Column:
    return F.btrim(c, F.lit(_EDGES))


def is_blank(c: Column) -> Column:
    """Null, empty, or white space only."""
    return c.isNull() | (jtrim(c) == "")


def nfc(c: Column) -> Column:
    """Unicode NFC. ASCII values are NFC already and skip the call."""
    composed = F.call_function(
        "reflect",
        F.lit("com.ibm.icu.text.Normalizer"),
        F.lit("compose"),
        c,
        F.lit(False),
    )
    return F.when(F.octet_length(c) > F.length(c), composed).otherwise(c)


def norm_national_id(c: Column, blank_to_null: bool = False) -> Column:
    cleaned = F.regexp_replace(c, "[^a-zA-Z0-9]", "")
    return F.when(~is_blank(c), cleaned) if blank_to_null else cleaned


def norm_text(c: Column) -> Column:
    return nfc(jtrim(c))


def norm_source(c: Column) -> Column:
    return F.upper(jtrim(c))


def norm_email(c: Column, blank_to_null: bool = True) -> Column:
    lowered = F.lower(jtrim(c))
    return F.when(lowered != "", lowered) if blank_to_null else lowered


def norm_name(c: Column) -> Column:
    return F.coalesce(F.lower(jtrim(c)), F.lit(""))


def norm_phone(c: Column) -> Column:
    digits = F.regexp_replace(c, "[^0-9]", "")
    local = F.when(
        digits.startswith("1") & (F.length(digits) == 11), F.substring(digits, 2, 10)
    ).otherwise(digits)
    return F.coalesce(local, F.lit(""))


def names_match(a: Column, b: Column) -> Column:
    return F.lower(jtrim(a)).eqNullSafe(F.lower(jtrim(b)))


def mask_national_id(c: Column) -> Column:
    return F.when(F.length(c) > 4, F.concat(F.lit("***"), F.right(c, F.lit(4)))).otherwise("***")


def mask_key(c: Column) -> Column:
    return F.when(
        F.length(c) > 8, F.concat(F.left(c, F.lit(4)), F.lit("..."), F.right(c, F.lit(4)))
    ).otherwise("***")


def det_key(national_id: Column, source: Column) -> Column:
    """SHA-256 over ``lower(id)|UPPER(source)``; null when either part is null."""
    return F.sha2(det_text(norm_national_id(national_id), norm_text(source)), 256)


def det_text(national_id: Column, source: Column) -> Column:
    """The text behind the deterministic key, from a cleaned id and source."""
    return F.concat(F.lower(national_id), F.lit("|"), F.upper(source))


def client_key_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def truncate_text(c: Column, limit: int) -> Column:
    """The first ``limit`` characters and dots. Counting characters passes over the whole
    text, so only as many bytes as they can take are counted and cut."""
    most = 4 * limit  # bytes of ``limit`` characters in UTF-8
    head = F.substring(c.cast("binary"), 1, most).cast("string")
    too_long = (F.octet_length(c) > most) | (F.length(head) > limit)
    return F.when(too_long, F.concat(F.left(head, F.lit(limit)), F.lit("..."))).otherwise(c)
