"""Made-up releases: a repeatable sample of what is there, moved to a later time, with faults, written with a manifest."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import write_single
from ..specs import DatasetSpec
from .release import hour_spine, write_manifest


def numbered(df: DataFrame, key: str, n_buckets: int = 256) -> DataFrame:
    """Rows numbered from 0 in an order that only depends on the key: positions within buckets plus the buckets' offsets.

    Only the buckets' sizes, a fixed number of rows, pass through one task.
    """
    b = df.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(n_buckets)))
    sizes = b.groupBy("_b").agg(F.count("*").alias("_c"))
    offsets = sizes.select("_b", (F.sum("_c").over(Window.orderBy("_b")) - F.col("_c")).alias("_o"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy(F.xxhash64(key), key)) - 1
    return b.withColumn("_p", place).join(F.broadcast(offsets), "_b").withColumn("sequence", F.col("_o") + F.col("_p")).drop("_b", "_p", "_o")


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """The n rows whose hashed keys come first; of equal keys one."""
    return df.dropDuplicates([key]).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def station_hours(spark: SparkSession, stations: DataFrame, start: str, hours: int) -> DataFrame:
    """Every station at every hour."""
    return stations.crossJoin(hour_spine(spark, start, hours))


def made_up_aqi(particles: str) -> Column:
    """An index of 0 to 500 that rises with the particles."""
    return F.least(F.lit(500.0), F.greatest(F.lit(0.0), F.round(F.col(particles) * 4.0, 0)))


def with_fault(df: DataFrame, key: str, changes: dict[str, Column]) -> DataFrame:
    """The frame with one row more: the first row by key, with values that a rule rejects."""
    first = df.orderBy(key).limit(1)
    return df.unionByName(first.withColumns(changes).select(*df.columns))


def export(frames: dict[str, tuple[DataFrame, int]], specs: dict[str, DatasetSpec], folder: str, release_id: str) -> str:
    """Writes each dataset's rows, in the given contract version, as one file, and the manifest; returns its path."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    entries = []
    for name, (df, version) in frames.items():
        contract = specs[name].contract(version)
        rows = df.select(*(F.col(f"`{c}`") for c in contract.columns))
        file = f"{name}.{contract.format}"
        write_single(rows, f"{folder}/{file}", contract.format)
        entries.append({"dataset": name, "path": file, "schema_version": version, "records": rows.count()})
    return write_manifest(folder, release_id, entries)
