"""Read customer requests: a JSON body with a fixed schema plus the key header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from goldrec.schema import REQUEST

FIELDS = {
    "national_id": "nationalId",
    "name": "name",
    "email": "email",
    "phone": "phone",
    "source_system": "sourceSystem",
}
FILE_SCHEMA = (
    f"{REQUEST}, requestId bigint, idempotencyKey string, receivedAt timestamp_ntz"
)


def to_body(columns: dict[str, str] = FIELDS) -> Column:
    """The JSON body of a request row."""
    return F.to_json(F.struct(*(F.col(c).alias(json) for c, json in columns.items())))


def parse_requests(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Typed request columns from JSON text; fields the body lacks are null."""
    parsed = bodies.withColumn("_r", F.from_json(body, REQUEST))
    typed = {column: F.col(f"_r.{json}") for column, json in FIELDS.items()}
    return parsed.withColumns(typed).drop("_r", body)


def _named(files: DataFrame) -> DataFrame:
    return files.select(
        F.col("requestId").alias("event_id"),
        *(F.col(json).alias(column) for column, json in FIELDS.items()),
        F.col("idempotencyKey").alias("client_key"),
        F.col("receivedAt").alias("event_ts"),
    )


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return _named(spark.read.schema(FILE_SCHEMA).json(path))


def stream_requests(spark: SparkSession, path: str) -> DataFrame:
    return _named(spark.readStream.schema(FILE_SCHEMA).json(path))
