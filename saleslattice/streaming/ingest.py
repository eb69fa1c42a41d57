"""Incremental ingest of new files: enriched facts, and rollups kept by merging partial sums."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lookups import enrich_fact
from ..operators.rollups import SUMS, rollup
from ..sources.facts import sink_fact
from ..sources.stored import hadoop, exists


def ingest_stream(spark: SparkSession, schema, in_dir: str, out: str, checkpoint: str, masters: dict[str, DataFrame]):
    """Enrich and append each new file's rows. A batch that runs again overwrites its own part."""

    def write(batch: DataFrame, n: int) -> None:
        sink_fact(enrich_fact(batch, masters), f"{out}/batch={n}", "overwrite")

    return spark.readStream.schema(schema).parquet(in_dir).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Parts of single batches that are put together at a time.
EVERY = 8


def _parts(spark: SparkSession, path: str) -> dict[tuple[int, int], str]:
    """Whole parts of the rollup at path: range of batches to folder."""
    fs, at = hadoop(spark, path)
    if not fs.exists(at):
        return {}
    out = {}
    for x in fs.listStatus(at):
        name = x.getPath().getName()
        if (m := re.fullmatch(r"part-(\d+)-(\d+)", name)) and exists(spark, f"{path}/{name}/_SUCCESS"):
            out[int(m[1]), int(m[2])] = f"{path}/{name}"
    return out


def _cover(parts) -> list[tuple[int, int]]:
    """The ranges that no other one holds: batches are read once, whichever parts were put together already."""
    return sorted(p for p in parts if not any(q != p and q[0] <= p[0] and p[1] <= q[1] for q in parts))


def compact(spark: SparkSession, path: str, every: int = EVERY) -> None:
    """Put a rollup's parts together, if every single batches or more are apart. The new part names its batches and counts once
    it is whole; those it holds are ignored from then on and deleted by the next call, so that readers may finish."""
    parts = _parts(spark, path)
    cover = _cover(parts)
    for p in set(parts) - set(cover):
        fs, at = hadoop(spark, parts[p])
        fs.delete(at, True)
    if len([p for p in cover if p[0] == p[1]]) >= every:
        merged(spark, path).write.mode("overwrite").parquet(f"{path}/part-{cover[0][0]}-{cover[-1][1]}")


def rollup_stream(spark: SparkSession, schema, in_dir: str, path: str, checkpoint: str, name: str, every: int = EVERY, **options):
    """Add each batch's sums to the stored rollup at path: a part of its own, put together with the others from time to time.
    A batch that runs again writes its part again; where it was put together already, the part is ignored. options: of the
    file source."""

    def write(batch: DataFrame, n: int) -> None:
        rollup(batch, name).write.mode("overwrite").parquet(f"{path}/part-{n}-{n}")
        compact(spark, path, every)

    return spark.readStream.schema(schema).options(**options).parquet(in_dir).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark: SparkSession, path: str) -> DataFrame:
    """The rollup over all batches."""
    parts = _parts(spark, path)
    stored = spark.read.parquet(*(parts[p] for p in _cover(parts)))
    dims = [c for c in stored.columns if c not in (*SUMS.values(), "fact_row_count")]
    return stored.groupBy(*dims).agg(*(F.sum(c).cast(stored.schema[c].dataType).alias(c) for c in SUMS.values()), F.sum("fact_row_count").alias("fact_row_count"))
