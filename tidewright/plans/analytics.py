"""The analytical queries over three views, as SQL; ties and gaps as noted."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import CONDITION_LABELS, in_periods
from ..operators.enrich import with_bounds
from ..specs import Period

QUERIES = {
    # all peak hours of a weekday stay if they are equal
    "peak_hour_by_weekday": """
        WITH hourly AS (SELECT dayofweek(pickup_timestamp) AS d, hour(pickup_timestamp) AS pickup_hour, count(*) AS trip_count FROM trips GROUP BY 1, 2)
        SELECT element_at(array('Sunday', 'Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday'), d) AS weekday, pickup_hour, trip_count
        FROM (SELECT *, dense_rank() OVER (PARTITION BY d ORDER BY trip_count DESC) AS r FROM hourly) WHERE r = 1 ORDER BY (d + 5) % 7, pickup_hour""",
    "monthly_zone_demand": """
        SELECT pickup_year, pickup_month, pickup_location_id, pickup_zone, pickup_borough, count(*) AS trip_count FROM trips
        GROUP BY ALL ORDER BY pickup_year, pickup_month, trip_count DESC, pickup_location_id""",
    # a month without a predecessor has no change, whatever month came before it in the data
    "monthly_demand_trend": """
        WITH monthly AS (SELECT make_date(pickup_year, pickup_month, 1) AS month, count(*) AS trip_count FROM trips GROUP BY 1)
        SELECT a.month, a.trip_count, a.trip_count - b.trip_count AS change, 100.0D * (a.trip_count - b.trip_count) / b.trip_count AS change_pct
        FROM monthly a LEFT JOIN monthly b ON b.month = add_months(a.month, -1) ORDER BY a.month""",
    "avg_distance_by_weather": """
        SELECT weather_condition_code, {label} AS weather_condition, count(*) AS trip_count, round(avg(trip_distance), 3) AS avg_distance
        FROM trips WHERE weather_condition_code IS NOT NULL GROUP BY 1, 2 ORDER BY trip_count DESC, 1""",
    # hours without a trip count as zero demand
    "air_quality_demand_relationship": """
        WITH demand AS (SELECT pickup_hour, count(*) AS n FROM trips GROUP BY 1)
        SELECT round(corr(pm25_avg_ug_m3, cast(coalesce(n, 0) AS double)), 4) AS correlation, round(avg(coalesce(n, 0)), 3) AS mean_demand, round(avg(pm25_avg_ug_m3), 3) AS mean_pm25, count(*) AS hours_analyzed
        FROM air_quality LEFT JOIN demand ON pickup_hour = event_hour WHERE pm25_avg_ug_m3 IS NOT NULL""",
    # mean demand per hour of each condition; a condition in which a zone had no trip counts as zero
    "zone_weather_variation": """
        WITH hours AS (SELECT weather_condition_code AS code, count(*) AS n_hours FROM weather WHERE weather_condition_code IS NOT NULL GROUP BY 1),
        zones AS (SELECT DISTINCT pickup_location_id AS id, pickup_zone AS zone FROM trips WHERE pickup_location_id IS NOT NULL),
        demand AS (SELECT pickup_location_id AS id, w.weather_condition_code AS code, count(*) AS n FROM trips t JOIN weather w ON t.pickup_hour = w.event_hour GROUP BY 1, 2),
        grid AS (SELECT z.id, z.zone, cast(coalesce(n, 0) AS double) / n_hours AS per_hour FROM zones z CROSS JOIN hours h LEFT JOIN demand d ON d.id = z.id AND d.code = h.code)
        SELECT id AS pickup_location_id, zone AS pickup_zone, max(per_hour) - min(per_hour) AS variation, stddev_pop(per_hour) AS deviation, avg(per_hour) AS mean_per_hour
        FROM grid GROUP BY 1, 2 ORDER BY variation DESC, 1""",
}


def register(trips: DataFrame, weather: DataFrame, air: DataFrame, periods: Iterable[Period] | None = None) -> dict[str, DataFrame]:
    """The three views: context is cut to the periods and to the hours between the first and the last trip."""
    def cut(df: DataFrame) -> DataFrame:
        return with_bounds(df.where(in_periods("event_hour", periods)) if periods else df, trips, "event_hour", "pickup_hour")

    views = {"trips": trips, "weather": cut(weather), "air_quality": cut(air)}
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return views


def text(name: str) -> str:
    cases = " ".join(f"WHEN {k} THEN '{v}'" for k, v in CONDITION_LABELS.items())
    return QUERIES[name].replace("{label}", f"CASE weather_condition_code {cases} ELSE concat('Unknown (', weather_condition_code, ')') END")


def run(spark: SparkSession, name: str, target=None) -> DataFrame:
    """A query's result; with a snapshot table it is stored there and read back, so that it runs once."""
    out = spark.sql(text(name))
    if target is None:
        return out
    target.overwrite(out)
    return target.read()


