"""The golden table as a stored snapshot that the read side looks things up in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from goldrec.plans.durable import work_path

LOOKUPS = ("national_id", "id")


def write_snapshot(golden: DataFrame, path: str) -> None:
    """Write golden rows for lookups by customer and by id.

    The rows come out of an aggregate by customer and stay where it left them; within
    a file they are sorted by customer, so a page index prunes, and both lookup columns
    have Bloom filters, so a lookup skips the files that do not hold its key.
    """
    writer = golden.sortWithinPartitions("national_id").write
    for column in LOOKUPS:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path)


def golden_snapshot(golden: DataFrame) -> DataFrame:
    """``golden`` read back from a snapshot of its own."""
    spark = golden.sparkSession
    path = work_path(spark, "golden-snapshot")
    write_snapshot(golden, path)
    return spark.read.schema(golden.schema).parquet(path)


def folder_state(spark: SparkSession, folder: str) -> tuple[tuple[str, int, int], ...]:
    """Name, length and time of everything in a folder; differs after a rewrite."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(sc._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in found))
