"""Data products: specifications compiled to aggregates, materialised with metadata, catalogued and refreshed by scope."""

from __future__ import annotations

import json
from collections.abc import Iterable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import CONDITION_LABELS, PM25_BANDS, PM25_BEYOND, bands, labelled
from ..operators.cleaners import lineage_sets
from ..operators.diff import changed_rows
from ..sources.snapshot import SnapshotTable
from ..specs import ProductSpec

#: The lineage columns of a product.
LINEAGE = ("taxi_schema_version", "pickup_zone_schema_version", "dropoff_zone_schema_version", "weather_schema_version", "air_quality_schema_versions")
CATALOG = "product_name string, title string, grain array<string>, scope array<string>, inputs array<string>, table_path string, table_version bigint, source_version bigint, records bigint, bytes bigint, files bigint, schema_versions_json string, partitions array<string>, refresh_kind string, seconds double, built_at timestamp"


def _measures() -> list:
    return [F.count("*").alias("trip_count"), F.avg("trip_distance").alias("avg_distance"), F.avg("trip_duration_seconds").alias("avg_duration_seconds"), F.avg("fare_amount").alias("avg_fare")]


def daily_mobility(df: DataFrame) -> DataFrame:
    """By day: trips, passengers, means, revenue, and the busiest hour, the earliest of equals."""
    days = ["pickup_date", "pickup_year", "pickup_month"]
    totals = df.groupBy(*days).agg(*_measures(), F.sum("passenger_count").alias("passenger_count"), F.sum("total_amount").alias("total_revenue"), *lineage_sets(df))
    per_hour = df.groupBy("pickup_date", F.hour("pickup_timestamp").alias("h")).agg(F.count("*").alias("n"))
    peak = per_hour.groupBy("pickup_date").agg(F.max_by(F.struct("h", "n"), F.struct("n", -F.col("h"))).alias("p"))
    return totals.join(peak, "pickup_date", "left").withColumns({"peak_hour": F.col("p.h"), "peak_hour_trips": F.col("p.n")}).drop("p")


def zone_statistics(df: DataFrame) -> DataFrame:
    known = df.where(F.col("pickup_zone").isNotNull())
    return known.groupBy("pickup_year", "pickup_month", "pickup_location_id", "pickup_zone", "pickup_borough").agg(*_measures(), F.sum("total_amount").alias("total_revenue"), *lineage_sets(df))


def weather_impact(df: DataFrame) -> DataFrame:
    known = df.where(F.col("weather_condition_code").isNotNull()).withColumn("weather_condition", labelled("weather_condition_code", CONDITION_LABELS))
    return known.groupBy("pickup_year", "pickup_month", "weather_condition_code", "weather_condition").agg(*_measures(), *lineage_sets(df))


def air_quality_impact(df: DataFrame) -> DataFrame:
    known = df.where(F.col("pm25_avg_ug_m3").isNotNull()).withColumn("pm25_category", bands("pm25_avg_ug_m3", PM25_BANDS, PM25_BEYOND))
    return known.groupBy("pickup_year", "pickup_month", "pm25_category").agg(*_measures(), F.avg("pm25_avg_ug_m3").alias("avg_pm25"), *lineage_sets(df))


_TRIP = ("pickup_date", "pickup_year", "pickup_month", "trip_distance", "trip_duration_seconds", "fare_amount", *LINEAGE)
MONTH = ("pickup_year", "pickup_month")
PRODUCTS = {
    p.name: p
    for p in (
        ProductSpec("daily_mobility", daily_mobility, ("pickup_date",), ("pickup_date",), (*_TRIP, "pickup_timestamp", "passenger_count", "total_amount"), "Mobility by day"),
        ProductSpec("zone_statistics", zone_statistics, (*MONTH, "pickup_location_id"), MONTH, (*_TRIP, "pickup_location_id", "pickup_zone", "pickup_borough", "total_amount"), "Zones by month"),
        ProductSpec("weather_impact", weather_impact, (*MONTH, "weather_condition_code"), MONTH, (*_TRIP, "weather_condition_code"), "Demand by weather"),
        ProductSpec("air_quality_impact", air_quality_impact, (*MONTH, "pm25_category"), MONTH, (*_TRIP, "pm25_avg_ug_m3"), "Demand by air quality"),
    )
}
AGGREGATES = {
    p.name: p
    for p in (
        ProductSpec("trips_per_borough", lambda df: df.groupBy("pickup_borough").agg(F.count("*").alias("trip_count"), *lineage_sets(df)), ("pickup_borough",), ("pickup_borough",), ("pickup_borough", *LINEAGE)),
        ProductSpec("avg_trip_duration_per_day", lambda df: df.groupBy("pickup_date").agg(F.avg("trip_duration_seconds").alias("avg_duration_seconds"), *lineage_sets(df)), ("pickup_date",), ("pickup_date",), ("pickup_date", "trip_duration_seconds", *LINEAGE)),
        ProductSpec("avg_fare_per_borough", lambda df: df.groupBy("pickup_borough").agg(F.avg("fare_amount").alias("avg_fare"), *lineage_sets(df)), ("pickup_borough",), ("pickup_borough",), ("pickup_borough", "fare_amount", *LINEAGE)),
    )
}


def snapshot_versions(df: DataFrame) -> dict[str, list[int]]:
    """All versions behind a frame, as one row to the driver."""
    return {k: list(v or []) for k, v in df.agg(*lineage_sets(df)).first().asDict().items()}


def build(spec: ProductSpec, source: SnapshotTable, target: SnapshotTable, catalog: SnapshotTable | None = None, version: int | None = None, changed: DataFrame | None = None, txn: str | None = None) -> int | None:
    """Builds a product from a pinned version of its source; with ``changed`` rows only their scopes, from all their rows."""
    import time

    started = time.time()
    pinned = source.info(version)
    rows = source.read(pinned.version)
    if changed is None or not target.exists():
        out, kind = _stamped(spec, spec.build(rows), pinned.version), "full"
        done = target.overwrite(out, txn)
    else:
        scopes = changed.select(*spec.scope).distinct()
        fresh = _stamped(spec, spec.build(rows.join(scopes, list(spec.scope), "left_semi")), pinned.version)
        done, kind = target.replace_scopes(fresh, scopes, list(spec.scope), txn), "scoped"
    if catalog is not None and done is not None:
        register(source.spark, catalog, spec, target, pinned.version, snapshot_versions(rows), kind, time.time() - started)
    return done


def _stamped(spec: ProductSpec, df: DataFrame, version: int) -> DataFrame:
    versions = [c for c in df.columns if c.endswith("schema_versions")]
    return df.withColumns({"_product": F.lit(spec.name), "_source_version": F.lit(version).cast("bigint"), "_source_schema_versions": F.to_json(F.struct(*versions)) if versions else F.lit(None).cast("string"), "_built_at": F.current_timestamp()})


def register(spark: SparkSession, catalog: SnapshotTable, spec: ProductSpec, target: SnapshotTable, source_version: int, versions: dict, kind: str, seconds: float) -> None:
    """One row per product; the other products' rows stay."""
    now = target.info()
    row = (spec.name, spec.title, list(spec.grain), list(spec.scope), list(spec.inputs), str(target.path), now.version, source_version, now.rows, now.bytes, now.files, json.dumps(versions, sort_keys=True), list(target.partitions), kind, seconds, datetime.now(UTC))
    catalog.merge(spark.createDataFrame([row], CATALOG), ["product_name"])


def affected_products(before: DataFrame, after: DataFrame, key: str, specs: Iterable[ProductSpec]) -> dict[str, DataFrame]:
    """Products with a changed input column, each with the before and after images of the rows behind the change."""
    out = {}
    for spec in specs:
        columns = [c for c in spec.inputs if c in after.columns]
        wanted = [key, *dict.fromkeys([*columns, *(c for c in spec.scope if c not in columns)])]
        new, old = after.select(*wanted), before.select(*wanted)
        moved = changed_rows(new, old, [key], columns)
        gone = changed_rows(old, new, [key], columns)
        both = moved.unionByName(gone)
        if not both.isEmpty():
            out[spec.name] = both
    return out
