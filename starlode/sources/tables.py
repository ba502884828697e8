"""Raw tables: Parquet, delimited text, JSON, ORC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def delimited(spark: SparkSession, path: str, schema: T.StructType | str, separator: str = "|", header: bool = False) -> DataFrame:
    """Text with a declared schema: inferring one would read everything twice."""
    return spark.read.csv(path, schema=schema, sep=separator, header=header)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rows of one task where tables are dealt out by key. A join with a group a key takes some 400 bytes of memory a row.
TASK_ROWS = 500_000


def dealt(spark: SparkSession, folder: str, keys: dict[str, str]) -> dict[str, DataFrame]:
    """Tables in equally many parts by their keys, so that joining them and forming groups by key takes one task the
    same memory at any size and any number of shuffle partitions. Tables of up to eight parts fit one task and stay as
    they are, which lets small ones be broadcast. Rows are counted from the files' footers; a key's rows stay together."""
    found = {n: table(spark, folder, n) for n in keys}
    parts = -(-sum(df.count() for df in found.values()) // TASK_ROWS)
    if parts <= 8:
        return found
    return {n: df.repartition(max(parts, spark.sparkContext.defaultParallelism), keys[n]) for n, df in found.items()}


def views(spark: SparkSession, folder: str, names: tuple[str, ...] = NAMES[:8]) -> None:
    """Temporary views of a folder's tables, and of nation and region in both their parts."""
    for n in names:
        table(spark, folder, n).createOrReplaceTempView(n)
    for side, prefix in (("cust", "c"), ("supp", "s")):
        spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {side}nation AS SELECT n_nationkey AS {prefix}n_nationkey, n_name AS {prefix}n_name, n_regionkey AS {prefix}n_regionkey FROM nation")
        spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {side}region AS SELECT r_regionkey AS {prefix}r_regionkey, r_name AS {prefix}r_name FROM region")
