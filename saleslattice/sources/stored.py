"""Stored tables that change: rows deleted from partitions, bucketed masters, versions switched by a pointer.

A delete rewrites only the partitions that hold rows to go, by dynamic partition overwrite; all other files stay as they are.
Partitions of which nothing is left are removed after. A delete that is stopped half-way is finished by running it again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .facts import DEFAULT
from .scratch import checkpointed


def hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Hadoop objects."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete_where(spark: SparkSession, path: str, by: str, gone: Column, where: Column | None = None) -> DataFrame:
    """Delete the rows for which gone is true from the table at path, partitioned by the column by. where: a condition on by
    that all partitions with such rows meet, so that others aren't looked at. Returns by and n, the rows deleted from each
    partition that lost any."""
    table = spark.read.parquet(path)
    some = table if where is None else table.where(where)
    hit = checkpointed(some.where(gone).groupBy(by).agg(F.count(F.lit(1)).alias("n")))
    touched = [r[0] for r in hit.select(by).collect()]  # names of partitions
    if not touched:
        return hit
    here = table.where(F.col(by).isin([t for t in touched if t is not None]) | (F.col(by).isNull() if None in touched else F.lit(False)))
    left = here.where(~F.coalesce(gone, F.lit(False)))
    full = {r[0] for r in left.select(by).distinct().collect()}
    left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    for t in touched:
        if t not in full:
            name = "__HIVE_DEFAULT_PARTITION__" if t is None else spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(t))
            fs, at = hadoop(spark, f"{path.rstrip('/')}/{by}={name}")
            fs.delete(at, True)
    return hit


def delete_range(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """Delete the stored fact's rows with a bill_date from first to last, both included. Only the fiscal years that the range
    touches, and the partition of other dates, are looked at. Returns fy_part and n."""
    y0, y1 = (int(d[:4]) - (d[5:7] < "04") for d in (first, last))
    years = [f"{y}-{(y + 1) % 100:02d}" for y in range(y0, y1 + 1)]
    d = F.col("bill_date").cast("date")
    return delete_where(spark, path, "fy_part", d.between(F.lit(first).cast("date"), F.lit(last).cast("date")), F.col("fy_part").isin([*years, DEFAULT]))


OPEN = "__open__"


def sink_ledger(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append jobs to a ledger partitioned by the month of their end; those without one are open."""
    df.withColumn("ended_month", F.coalesce(F.date_format("ended", "yyyy-MM"), F.lit(OPEN))).hint("rebalance", "ended_month").write.mode(mode).partitionBy("ended_month").parquet(path)


def purge_jobs(spark: SparkSession, path: str, today: str, days: int = 90) -> DataFrame:
    """Delete finished jobs that ended over days before today from the stored ledger. Months after that day and open jobs
    aren't looked at. Returns ended_month and n."""
    cut = F.date_sub(F.lit(today).cast("date"), days)
    gone = F.col("status").isin("completed", "failed", "cancelled") & (F.col("ended") < cut)
    return delete_where(spark, path, "ended_month", gone, (F.col("ended_month") != OPEN) & (F.col("ended_month") <= F.date_format(cut, "yyyy-MM")))


def store_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int, path: str) -> None:
    """df as the table name, dealt to buckets by keys, its files at path."""
    df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)


def publish(spark: SparkSession, path: str, version: str) -> None:
    """Make version the current one at path: one committed row of the pointer table, which readers see whole or not at all."""
    n = max((r[0] for r in _pointer(spark, path).select("n").collect()), default=0) if exists(spark, f"{path}/pointer") else 0
    spark.createDataFrame([(n + 1, version)], "n long, version string").coalesce(1).write.mode("append").parquet(f"{path}/pointer")


def remove(spark: SparkSession, path: str) -> None:
    fs, at = hadoop(spark, path)
    fs.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = hadoop(spark, path)
    return fs.exists(at)


def _pointer(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("n long, version string").parquet(f"{path}/pointer")


def new_version(path: str) -> tuple[str, str]:
    """Name and folder of a version to be written."""
    version = uuid.uuid4().hex
    return version, f"{path}/versions/{version}"


def current(spark: SparkSession, path: str) -> str | None:
    """Folder of the current version at path; None before the first."""
    if not exists(spark, f"{path}/pointer"):
        return None
    rows = _pointer(spark, path).orderBy(F.desc("n"), F.desc("version")).limit(1).collect()
    return f"{path}/versions/{rows[0].version}" if rows else None


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete all but the last keep versions at path; returns how many went. Versions still being written are not in the
    pointer table and stay."""
    old = [r.version for r in _pointer(spark, path).orderBy(F.desc("n"), F.desc("version")).collect()[max(1, keep):]]
    return sum(fs.delete(at, True) for fs, at in (hadoop(spark, f"{path}/versions/{v}") for v in old))
