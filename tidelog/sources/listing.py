"""File listings and their snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.operators import telemetry


def list_files(spark: SparkSession, directory: str, snapshot_ts: Column | None = None) -> DataFrame:
    """(snapshot_ts, dir, name, size_bytes, mtime) of a directory's files.

    Only metadata columns are selected, so no file is opened.
    """
    at = snapshot_ts if snapshot_ts is not None else F.current_timestamp()
    parts = F.split("path", "/")
    return spark.read.format("binaryFile").load(directory).select(
        at.alias("snapshot_ts"),
        F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("dir"),
        F.element_at(parts, -1).alias("name"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("mtime"),
    )


def keep_snapshot(listing: DataFrame, path: str) -> None:
    """Append one scan to the table of scans, for rates between scans."""
    listing.write.mode("append").parquet(path)


def growth_check(spark: SparkSession, directory: str, scans_path: str, disk: DataFrame, snapshot_ts: Column | None = None) -> DataFrame:
    """One round of the periodic growth monitor: scan, keep the scan, rate it
    against the previous one, forecast.

    ``disk`` holds (dir, free_mb, disk_pct); a directory listed there without files
    or without a folder shows as missing. Schedule this instead of streaming it.
    """
    keep_snapshot(list_files(spark, directory, snapshot_ts), scans_path)
    scans = spark.read.parquet(scans_path)
    newest = scans.agg(F.max("snapshot_ts").alias("t")).scalar()
    # The last two scans of each directory, however long ago they were.
    marks = scans.select("dir", "snapshot_ts").distinct()
    place = F.row_number().over(Window.partitionBy("dir").orderBy(F.desc("snapshot_ts")))
    recent = scans.join(marks.withColumn("__place", place).where("__place <= 2").drop("__place"), ["dir", "snapshot_ts"], "left_semi")
    files = telemetry.parse_listing(recent)
    stats = telemetry.prefix_stats(files)
    rates = telemetry.file_rates(stats, recent.select("dir", "snapshot_ts"))
    totals = stats.groupBy("dir", "snapshot_ts").agg(F.sum("total_mb").alias("total_mb"), F.sum("total_gb").alias("total_gb"))
    latest = rates.join(totals, ["dir", "snapshot_ts"], "left").where(F.col("snapshot_ts") == newest)
    report = disk.join(latest, "dir", "left").withColumn("exists", F.col("snapshot_ts").isNotNull())
    return telemetry.forecast(report)
