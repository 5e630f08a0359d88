"""Sanitize and validate customer requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldrec.config import NATIONAL_ID_MAX, NATIONAL_ID_MIN, SOURCE_SYSTEMS
from goldrec.functions import text as T

# ---- fixed values ---------------------------------------------------------
REASONS = (
    "nationalId is required",
    f"nationalId must be between {NATIONAL_ID_MIN} and {NATIONAL_ID_MAX} alphanumeric characters",
    "sourceSystem is required",
    "sourceSystem must be one of: " + ", ".join(SOURCE_SYSTEMS),
)
# ---------------------------------------------------------------------------


def sanitize_requests(requests: DataFrame) -> DataFrame:
    """Strip the id, trim and compose the texts, upper-case the source."""
    return requests.withColumns(
        {
            "national_id": T.norm_national_id(F.col("national_id")),
            "name": T.norm_text(F.col("name")),
            "email": T.norm_text(F.col("email")),
            "phone": T.norm_text(F.col("phone")),
            "source_system": T.norm_source(F.col("source_system")),
        }
    )


def reject_reason(national_id: Column, source: Column) -> Column:
    """First failing rule, id before source; null for a valid request. A cleaned
    id holds letters and digits only, so that rule cannot fail here."""
    size = F.length(national_id)
    return (
        F.when(T.is_blank(national_id), REASONS[0])
        .when((size < NATIONAL_ID_MIN) | (size > NATIONAL_ID_MAX), REASONS[1])
        .when(T.is_blank(source), REASONS[2])
        .when(~source.isin(*SOURCE_SYSTEMS), REASONS[3])
    )


def check_requests(requests: DataFrame) -> DataFrame:
    """Sanitized requests with ``reason`` (null = accepted)."""
    clean = sanitize_requests(requests)
    return clean.withColumn("reason", reject_reason(F.col("national_id"), F.col("source_system")))


def is_valid(national_id: Column, source: Column) -> Column:
    """``reject_reason`` is null, said so that a filter cleans each value once."""
    sizes = range(NATIONAL_ID_MIN, NATIONAL_ID_MAX + 1)
    return F.length(national_id).isin(*sizes) & source.isin(*SOURCE_SYSTEMS)


def valid_requests(requests: DataFrame) -> DataFrame:
    """The filter stands below the cleaning: texts of rejected rows are never cleaned."""
    valid = is_valid(T.norm_national_id(F.col("national_id")), T.norm_source(F.col("source_system")))
    return sanitize_requests(requests.filter(valid))


def invalid_requests(requests: DataFrame) -> DataFrame:
    return check_requests(requests).filter(F.col("reason").isNotNull())


def validation_summary(requests: DataFrame) -> DataFrame:
    reason = F.coalesce(F.col("reason"), F.lit("accepted"))
    return check_requests(requests).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
