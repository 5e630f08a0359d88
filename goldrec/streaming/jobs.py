"""Run the streaming jobs over a stored table to its end and read what they wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from goldrec.plans.durable import durable, work_path
from goldrec.sources.raw_events import raw_records, read_raw, stream_raw
from goldrec.sources.requests import FIELDS, stream_requests
from goldrec.sources.tables import current_golden
from goldrec.streaming.idem import idem_stream, rearm_stream
from goldrec.streaming.ingest import ingest_stream
from goldrec.streaming.master import master_stream
from goldrec.streaming.sli import sli_stream


FILE_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _drain(query: StreamingQuery) -> None:
    query.awaitTermination()


def write_slices(df: DataFrame, path: str, slices: int, ts: str) -> None:
    """Write ``df`` cut by time into ``slice=0..`` folders. It is computed once: the borders
    are taken from its stored rows."""
    df = durable(df, "unsliced")
    low, high = df.agg(F.min(_micros(ts)), F.max(_micros(ts))).first()
    number = F.floor((_micros(ts) - low) * slices / F.lit(high - low + 1)).cast("int")
    df.withColumn("slice", number).write.partitionBy("slice").parquet(path)


def run_ingest_stream(
    spark: SparkSession, requests: DataFrame, slices: int = 3, ttl_factor: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Replies and published events after streaming request files in event-ordered slices."""
    path = work_path(spark, "ingest-stream")
    write_slices(requests, f"{path}/slices", slices, "event_ts")
    for i in range(slices):
        part = spark.read.schema(requests.schema).parquet(f"{path}/slices/slice={i}")
        body = part.select(
            F.col("event_id").alias("requestId"),
            *(F.col(column).alias(json) for column, json in FIELDS.items()),
            F.col("client_key").alias("idempotencyKey"),
            F.col("event_ts").alias("receivedAt"),
        )
        body.write.mode("append").option("timestampNTZFormat", FILE_TIME).json(f"{path}/in")
        stream = stream_requests(spark, f"{path}/in")
        _drain(ingest_stream(stream, path, f"{path}/checkpoint", ttl_factor))
    return spark.read.parquet(f"{path}/replies").drop("batch_id"), read_raw(spark, f"{path}/raw_events")


def run_idem_stream(spark: SparkSession, keyed: DataFrame, slices: int = 3) -> DataFrame:
    """Classes after streaming the requests in event-ordered slices."""
    path = work_path(spark, "idem-stream")
    write_slices(keyed, f"{path}/slices", slices, "event_ts")
    for i in range(slices):
        part = spark.read.schema(keyed.schema).parquet(f"{path}/slices/slice={i}")
        part.write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(keyed.schema).parquet(f"{path}/in")
        _drain(idem_stream(stream, path, f"{path}/checkpoint"))
    return spark.read.parquet(f"{path}/classified").drop("batch_id")


def run_rearm_stream(spark: SparkSession, keyed: DataFrame, slices: int = 2) -> DataFrame:
    """Accepted requests of the re-arming stream."""
    path = work_path(spark, "rearm-stream")
    rows = keyed.select(
        "key_hash",
        "event_id",
        _micros("event_ts").alias("event_us"),
        (F.col("ttl_hours") * F.lit(3_600_000_000)).alias("ttl_us"),
        "event_ts",
    )
    write_slices(rows, f"{path}/slices", slices, "event_ts")
    rows = rows.drop("event_ts")
    for i in range(slices):
        part = spark.read.schema(rows.schema).parquet(f"{path}/slices/slice={i}")
        part.write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
        _drain(rearm_stream(stream, path, f"{path}/checkpoint"))
    new = spark.read.parquet(f"{path}/rearmed").filter(F.col("result") != "HIT")
    at = F.timestamp_micros("event_us").cast("timestamp_ntz")
    return new.select("key_hash", at.alias("event_ts"), "event_id")


def run_master_stream(spark: SparkSession, events: DataFrame, slices: int = 3) -> DataFrame:
    """Golden rows after streaming the events in event-ordered slices. Each slice is
    one run of the query, which goes on from its checkpoint."""
    path = work_path(spark, "master-stream")
    write_slices(events, f"{path}/slices", slices, "event_ts")
    for i in range(slices):
        part = spark.read.schema(events.schema).parquet(f"{path}/slices/slice={i}")
        raw_records(part).write.mode("append").parquet(f"{path}/in")
        _drain(master_stream(stream_raw(spark, f"{path}/in"), path, f"{path}/checkpoint"))
    return current_golden(spark, path)


def run_sli_stream(spark: SparkSession, log: DataFrame) -> DataFrame:
    """Windows of the service-level stream. The append sink holds back windows the
    watermark has not passed, so the input ends with one row a day after the last
    event; the window of that row never closes."""
    path = work_path(spark, "sli-stream")
    log.withColumn("event_ts", F.col("event_ts").cast("timestamp")).write.parquet(f"{path}/in")
    written = spark.read.parquet(f"{path}/in")
    stream = spark.readStream.schema(written.schema).parquet(f"{path}/in")

    def run() -> None:
        _drain(
            sli_stream(stream)
            .writeStream.format("parquet")
            .option("path", f"{path}/out")
            .option("checkpointLocation", f"{path}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )

    run()
    last = written.agg(F.max("event_ts") + F.expr("interval 1 day")).first()[0]
    closing = written.limit(1).withColumn("event_ts", F.lit(last))
    closing.write.mode("append").parquet(f"{path}/in")
    run()
    out = spark.read.parquet(f"{path}/out")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
