"""Cleaners: raw revisions to one valid row per business key, with the rejected rows beside them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clock, in_periods, optional
from ..specs import Period
from .keys import by_ingestion, latest_complete
from .rollups import merged_version_set
from .rules import at_least, between, classify, combined, non_empty, predicate, require_key, required

#: The counties and the unit of the particle sensors.
COUNTIES, STATE, UNIT = ("Bronx", "Kings", "Queens"), "New York", "Micrograms/cubic meter (LC)"
#: The measures of the weather files and their names.
MEASURES = {"temperature_c": "temp", "relative_humidity_pct": "rhum", "precipitation_mm": "prcp", "snow_depth_mm": "snwd", "wind_direction_deg": "wdir", "wind_speed_kmh": "wspd", "wind_gust_kmh": "wpgt", "pressure_hpa": "pres", "cloud_cover_pct": "cldc"}

Cleaned = tuple[DataFrame, DataFrame]


def zones(raw: DataFrame) -> Cleaned:
    now, incomplete = latest_complete(raw, ["location_id"], by_ingestion(raw))
    good, bad = classify(now, [non_empty(c) for c in ("borough", "zone", "service_zone")])
    out = good.select("location_id", *(F.trim(c).alias(c) for c in ("borough", "zone", "service_zone")), F.col("_schema_version").alias("source_schema_version"))
    return require_key(out, ["location_id"]), combined([incomplete, bad])


def weather(raw: DataFrame) -> Cleaned:
    """Hourly weather; a text that is blank or no number is null, a measure out of range rejects the row."""
    keys = ["year", "month", "day", "hour"]
    now, incomplete = latest_complete(raw, keys, by_ingestion(raw))
    made = {name: optional(now, c, "double").try_cast("double") if c in now.columns else F.lit(None).cast("double") for name, c in MEASURES.items()}
    stamp = F.expr("try_make_timestamp_ntz(try_cast(year AS int), try_cast(month AS int), try_cast(day AS int), try_cast(hour AS int), 0, 0)")
    typed = now.withColumns(made | {"event_hour": stamp, "weather_condition_code": optional(now, "coco", "int").try_cast("int"), "humidity_pct": optional(now, "humidity", "double").try_cast("double")})
    rules = [predicate("timestamp.valid", "the hour must exist", lambda: F.col("event_hour").isNull()), between("humidity_pct", 0, 100), between("relative_humidity_pct", 0, 100), *(at_least(c, 0) for c in ("precipitation_mm", "snow_depth_mm", "wind_speed_kmh", "wind_gust_kmh")), between("wind_direction_deg", 0, 360), between("cloud_cover_pct", 0, 100)]
    good, bad = classify(typed, rules)
    out = good.select("event_hour", *MEASURES, "humidity_pct", "weather_condition_code", F.col("_schema_version").alias("source_schema_version"))
    return require_key(out, ["event_hour"]), combined([incomplete, bad])


def air_quality(raw: DataFrame) -> Cleaned:
    """Hourly mean over the sensors of the three counties; other places are left out without a trace."""
    here = raw.where((F.col("state_name") == STATE) & F.col("county_name").isin(*COUNTIES))
    here = here.withColumn("time_local", clock("date_local", "time_local"))
    keys = ["state_code", "county_code", "site_num", "parameter_code", "poc", "date_local", "time_local"]
    now, incomplete = latest_complete(here, keys, by_ingestion(here))
    stamp = F.to_timestamp_ntz(F.concat_ws(" ", F.col("date_local").cast("string"), F.col("time_local")))
    real = F.col("time_local").rlike(r"^([01]\d|2[0-3]):[0-5]\d:[0-5]\d$") & F.col("date_local").isNotNull()
    typed = now.withColumns({"event_time": F.when(real, stamp), "aqi": optional(now, "aqi", "double")})
    rules = [predicate("timestamp.valid", "date and time must exist", lambda: F.col("event_time").isNull()), required("sample_measurement"), at_least("sample_measurement", 0), between("aqi", 0, 500), predicate("unit", "unknown unit", lambda: ~F.col("units_of_measure").eqNullSafe(UNIT))]
    good, bad = classify(typed, rules)
    t = F.col("event_time")
    hour = F.make_timestamp_ntz(F.year(t), F.month(t), F.dayofmonth(t), F.hour(t), F.lit(0), F.lit(0)).alias("event_hour")
    out = good.groupBy(hour).agg(
        F.avg("sample_measurement").alias("pm25_avg_ug_m3"), F.min("sample_measurement").alias("pm25_min_ug_m3"), F.max("sample_measurement").alias("pm25_max_ug_m3"), F.max("aqi").alias("aqi_max"),
        F.count("*").alias("air_quality_observation_count"), F.count_distinct("county_code", "site_num").alias("air_quality_site_count"), F.sort_array(F.collect_set("_schema_version")).alias("source_schema_versions"),
    )
    return require_key(out, ["event_hour"]), combined([incomplete, bad])


def trips(raw: DataFrame, periods: Iterable[Period], max_seconds: int = 86_400, max_distance: float = 500.0) -> Cleaned:
    now, incomplete = latest_complete(raw, ["_record_hash"], by_ingestion(raw))
    typed = now.withColumn("trip_duration_seconds", F.expr("timestampdiff(SECOND, pickup_timestamp, dropoff_timestamp)"))
    periods = list(periods)
    rules = [
        *(required(c) for c in ("pickup_timestamp", "dropoff_timestamp", "pickup_location_id", "dropoff_location_id", "trip_distance", "fare_amount")),
        predicate("pickup.period", "picked up outside the periods", lambda: ~in_periods("pickup_timestamp", periods)),
        predicate("duration.known", "no duration", lambda: F.col("pickup_timestamp").isNotNull() & F.col("dropoff_timestamp").isNotNull() & F.col("trip_duration_seconds").isNull(), "incomplete"),
        predicate("duration.range", f"the trip must last up to {max_seconds} s", lambda: (F.col("trip_duration_seconds") <= 0) | (F.col("trip_duration_seconds") > max_seconds)),
        between("trip_distance", 0, max_distance),
    ]
    good, bad = classify(typed, rules)
    t = F.col("pickup_timestamp")
    out = good.withColumns({
        "trip_id": F.col("_record_hash"), "has_invalid_distance": F.lit(False), "is_zero_distance": F.col("trip_distance") == 0, "is_financial_adjustment": (F.col("fare_amount") < 0) | (F.col("total_amount") < 0),
        "trip_duration_minutes": F.col("trip_duration_seconds") / 60, "pickup_hour": F.make_timestamp_ntz(F.year(t), F.month(t), F.dayofmonth(t), F.hour(t), F.lit(0), F.lit(0)),
        "pickup_date": F.to_date(t), "pickup_year": F.year(t), "pickup_month": F.month(t), "source_schema_version": F.col("_schema_version"),
    })
    return out.drop(*(c for c in out.columns if c.startswith("_"))), combined([incomplete, bad])


def integrated(trip: DataFrame, zone: DataFrame, hourly: DataFrame, air: DataFrame) -> DataFrame:
    """Trips with both zones and the weather and air of their hour; every trip stays."""
    from .enrich import with_context, with_role

    out = trip.withColumnRenamed("source_schema_version", "taxi_schema_version")
    for role in ("pickup", "dropoff"):
        out = with_role(out, zone, f"{role}_location_id", "location_id", {"zone": f"{role}_zone", "borough": f"{role}_borough", "service_zone": f"{role}_service_zone", "source_schema_version": f"{role}_zone_schema_version"})
    names = {c: c for c in hourly.columns if c not in ("event_hour", "source_schema_version")} | {"source_schema_version": "weather_schema_version"}
    out = with_context(out, hourly, "pickup_hour", "event_hour", names, "weather_available", "temperature_c")
    names = {c: c for c in air.columns if c not in ("event_hour", "source_schema_versions")} | {"source_schema_versions": "air_quality_schema_versions"}
    return with_context(out, air, "pickup_hour", "event_hour", names, "air_quality_available", "pm25_avg_ug_m3")


def lineage_sets(df: DataFrame) -> list:
    """Sorted version sets of an integrated fact's five lineage columns, as aggregates."""
    single = ("taxi_schema_version", "pickup_zone_schema_version", "dropoff_zone_schema_version", "weather_schema_version")
    return [*(F.sort_array(F.collect_set(c)).alias(f"{c}s") for c in single), merged_version_set("air_quality_schema_versions").alias("air_quality_schema_versions")]
