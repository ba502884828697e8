"""Roll-ups and month-partitioned copies on Parquet, and what is known about their segments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.interval import Interval, bucket

SEGMENT = "seg"


@dataclass(frozen=True)
class Metric:
    """What a roll-up holds of a column or expression. kind: count, sum, min, max, hll, theta."""

    name: str
    kind: str
    expr: str | None = None

    def build(self) -> Column:
        c = F.expr(self.expr) if self.expr else F.lit(1)
        how = {"count": lambda: F.count("*"), "sum": lambda: F.sum(c), "min": lambda: F.min(c), "max": lambda: F.max(c), "hll": lambda: F.hll_sketch_agg(c), "theta": lambda: F.theta_sketch_agg(c)}
        return how[self.kind]().alias(self.name)

    def merge(self) -> Column:
        c = F.col(self.name)
        how = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max, "hll": F.hll_union_agg, "theta": F.theta_union_agg}
        return how[self.kind](c)


@dataclass(frozen=True)
class Rollup:
    path: str
    time_col: str
    grain: str
    dims: tuple[str, ...]
    metrics: tuple[Metric, ...]
    interval: Interval | None = None
    extra: Mapping = field(default_factory=dict)

    def read(self, spark: SparkSession, interval: Interval | None = None) -> DataFrame:
        df = spark.read.parquet(self.path)
        return df if interval is None else prune(df, interval)

    def metric(self, kind: str, expr: str | None = None) -> Metric | None:
        return next((m for m in self.metrics if m.kind == kind and (m.expr or "") == (expr or "")), None)


def _partitioned(df: DataFrame, time_col: str, path: str, mode: str) -> None:
    """One shuffle by month and a spread over it, so that a month isn't written by one task, nor by
    all; only the months that ``df`` has are replaced."""
    with_seg = df.withColumn(SEGMENT, F.date_format(time_col, "yyyy-MM"))
    writer = with_seg.hint("rebalance", F.col(SEGMENT)).write.mode(mode).option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(SEGMENT).parquet(path)


def build_rollup(df: DataFrame, path: str, time_col: str, grain: str, dims: Sequence[str], metrics: Sequence[Metric], interval: Interval | None = None, mode: str = "overwrite") -> Rollup:
    """Groups by ``dims`` and the time at ``grain``, writes by month, and describes the result."""
    rows = df if interval is None else df.where(interval.holds(F.col(time_col)))
    at = bucket(F.col(time_col), grain)
    if at is None:
        raise ValueError("a roll-up needs a grain finer than 'all'")
    grouped = rows.groupBy(at.alias(time_col), *dims).agg(*(m.build() for m in metrics))
    _partitioned(grouped, time_col, path, mode)
    return Rollup(path, time_col, grain, tuple(dims), tuple(metrics), interval)


def build_index(df: DataFrame, path: str, time_col: str, mode: str = "overwrite", sort: Sequence[str] = ()) -> DataFrame:
    """A month-partitioned copy; ``sort`` puts rows of like dimensions together within files, which
    makes Parquet's statistics and dictionaries prune."""
    rows = df.sortWithinPartitions(*sort) if sort else df
    _partitioned(rows, time_col, path, mode)
    return df.sparkSession.read.parquet(path)


def insert_overwrite(df: DataFrame, path: str, time_col: str) -> None:
    """Replaces the months that ``df`` has, keeps the others."""
    _partitioned(df, time_col, path, "overwrite")


def drop(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def prune(df: DataFrame, interval: Interval) -> DataFrame:
    """The partitions that an interval may need; the caller still compares the time itself."""
    if SEGMENT not in df.columns:
        return df
    first, last = interval.months()
    seg = F.col(SEGMENT).cast("string")
    if first is not None:
        df = df.where(seg >= first)
    return df if last is None else df.where(seg <= last)


def segments(df: DataFrame, time_col: str) -> DataFrame:
    """seg, n_rows, first and last time and number of files of each partition."""
    return df.groupBy(F.col(SEGMENT).cast("string").alias(SEGMENT)).agg(
        F.count("*").alias("n_rows"), F.min(time_col).alias("first_time"), F.max(time_col).alias("last_time"), F.countDistinct(F.col("_metadata.file_path")).alias("n_files")
    )


def time_boundary(df: DataFrame, time_col: str) -> DataFrame:
    return df.agg(F.min(time_col).alias("min_time"), F.max(time_col).alias("max_time"))
