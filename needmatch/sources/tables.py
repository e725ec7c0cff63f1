"""Readers and writers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..plans.skew import SLICE_ROWS

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """For CPU-heavy work per row (parsing, tokenizing): a table with fewer input splits than cores is
    dealt out to all cores; any larger one is returned as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_events(log: DataFrame, project: str | None = None, event_type: str | None = None,
                after_sequence: int | None = None, start=None, end=None) -> DataFrame:
    """Event log with optional predicates; all of them reach the parquet scan."""
    if project is not None:
        log = log.filter(F.col("project_id") == project)
    if event_type is not None:
        log = log.filter(F.col("event_type") == event_type)
    if after_sequence is not None:
        log = log.filter(F.col("sequence") > after_sequence)
    if start is not None:
        log = log.filter(F.col("created_at") >= F.lit(start))
    if end is not None:
        log = log.filter(F.col("created_at") <= F.lit(end))
    return log


def append_log(batch: DataFrame, path: str) -> None:
    """Append sequenced events, laid out by project and day so that both prune."""
    (batch.withColumn("day", F.to_date("created_at"))
     .write.mode("append").partitionBy("project_id", "day").parquet(path))


@dataclass
class SlicedLog:
    """A stored log, partitioned by ranges of ``rows`` sequence numbers, with its zone map: per project and slice the rows,
    first and last sequence. An append adds zone rows of its own; they are summed when read."""

    spark: SparkSession
    path: str
    rows: int = SLICE_ROWS

    def append(self, batch: DataFrame) -> None:
        """``batch`` has sequences already and is written once."""
        sliced = batch.withColumn("slice", F.floor(F.col("sequence") / F.lit(self.rows)).cast("bigint"))
        sliced.repartition("slice", F.pmod(F.xxhash64("project_id"), F.lit(8))).write.mode("append").partitionBy("slice").parquet(f"{self.path}/events")
        (sliced.groupBy("project_id", "slice")
         .agg(F.count(F.lit(1)).alias("rows"), F.min("sequence").alias("first"), F.max("sequence").alias("last"))
         .write.mode("append").parquet(f"{self.path}/zones"))

    def events(self) -> DataFrame:
        events = self.spark.read.parquet(f"{self.path}/events")
        return events.withColumn("slice", F.col("slice").cast("bigint"))

    def zones(self) -> DataFrame:
        """(project_id, slice, rows, first, last, before, zone): ``before`` rows of the project stand in earlier slices, and
        ``zone`` numbers its slices."""
        per_slice = (self.spark.read.parquet(f"{self.path}/zones").groupBy("project_id", "slice")
                     .agg(F.sum("rows").alias("rows"), F.min("first").alias("first"), F.max("last").alias("last")))
        along = Window.partitionBy("project_id").orderBy("slice")
        return (per_slice.withColumn("before", F.coalesce(F.sum("rows").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
                .withColumn("zone", F.row_number().over(along)))


def write_bundle(bundle: DataFrame, path: str) -> None:
    """Export sections as JSON lines, one folder per project and section."""
    bundle.write.mode("errorifexists").partitionBy("project_id", "section").json(path)


def write_audit_csv(trail: DataFrame, path: str) -> None:
    trail.write.mode("errorifexists").option("header", True).csv(path)


def write_archive(rows: DataFrame, path: str, at: str = "created_at") -> None:
    rows.withColumn("day", F.to_date(at)).write.mode("append").partitionBy("day").json(path)
