"""The registered queries of the engine and the SQL each is held against.

Roles on the test tables: a trip is an order line (picked up at the order date, dropped off at the ship date, its zone
the customer's nation); hourly context comes from ``events``. Means are taken over whole cents, so they do not depend
on the order of addition, and times come out as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import diff, enrich, keys, rollups, rules
from ..sources import contracts
from ..specs import Period, Reference, SchemaContract

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL where SQL can express it."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def zones(spark, d) -> DataFrame:
    """Nations with their region: the zone dimension."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_nationkey", F.col("n_name").alias("zone"), F.col("r_name").alias("borough"))


def trips(spark, d) -> DataFrame:
    """Order lines as trips, with the zone of the customer."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    where = table(spark, d, "customer").join(zones(spark, d), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "zone", "borough", F.col("n_nationkey").alias("zone_id"))
    return lines.join(where, F.col("o_custkey") == F.col("c_custkey")).withColumns({"pickup_date": F.to_date("o_orderdate"), "y": F.year("o_orderdate"), "m": F.month("o_orderdate")})


TRIPS = """(SELECT l.*, o.*, n_nationkey AS zone_id, n_name AS zone, r_name AS borough, CAST(o_orderdate AS DATE) AS pickup_date, year(o_orderdate) AS y, month(o_orderdate) AS m
    FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
HOUR = "strftime(ts, '%Y-%m-%d %H:00:00')"


def _text_hour(ts: str = "ts"):
    return F.date_format(ts, "yyyy-MM-dd HH:00:00")


def _cents(c: str) -> str:
    return f"CAST(round({c} * 100) AS BIGINT)"


def _mean(c: str) -> str:
    return f"CAST(sum({_cents(c)}) AS DOUBLE) / count({c})"


# --- aggregates -----------------------------------------------------------------------------------------------------


@query(f"SELECT borough, count(*) AS n_trips FROM {TRIPS} GROUP BY 1")
def count_by_region(spark, d):
    return rollups.count_by(trips(spark, d), "borough", name="n_trips")


@query(f"SELECT borough, {_mean('l_extendedprice')} AS mean_cents FROM {TRIPS} GROUP BY 1")
def avg_amount_by_region(spark, d):
    return rollups.mean_by(trips(spark, d), "borough", "l_extendedprice", "mean_cents")


@query(f"""SELECT strftime(pickup_date, '%Y-%m-%d') AS pickup_date, CAST(sum(CAST(epoch(l_shipdate) - epoch(o_orderdate) AS BIGINT)) AS DOUBLE) / count(*) AS mean_seconds FROM {TRIPS} GROUP BY 1""")
def avg_duration_by_day(spark, d):
    t = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    t = t.withColumn("s", C.seconds_between("o_orderdate", "l_shipdate"))
    return t.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("pickup_date")).agg((F.sum("s").cast("double") / F.count("s")).alias("mean_seconds"))


@query(f"""SELECT l_returnflag AS flag, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS versions FROM lineitem GROUP BY 1""")
def version_sets(spark, d):
    df = rollups.with_versions(table(spark, d, "lineitem"), ["l_returnflag"], ["l_linenumber"])
    return df.select(F.col("l_returnflag").alias("flag"), F.array_join(F.transform("l_linenumbers", lambda x: x.cast("string")), ",").alias("versions"))


@query(f"""SELECT {HOUR} AS hour, {_mean('value')} AS mean_cents, min(value) AS min_value, max(value) AS max_value, count(*) AS n_observations, count(DISTINCT (user_id, event_type)) AS n_sites FROM events GROUP BY 1""")
def hourly_rollup(spark, d):
    return rollups.hourly_sensors(table(spark, d, "events").withColumn("hour", _text_hour()), "hour", "value", ["user_id", "event_type"])


@query(f"""WITH h AS (SELECT strftime(ts, '%Y-%m-%d') AS day, hour(ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2),
    p AS (SELECT day, hour AS peak_hour, n AS peak_count FROM h QUALIFY row_number() OVER (PARTITION BY day ORDER BY n DESC, hour) = 1),
    t AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_trips, CAST(sum({_cents('value')}) AS BIGINT) AS total_cents, {_mean('value')} AS mean_cents FROM events GROUP BY 1)
    SELECT * FROM t LEFT JOIN p USING (day)""")
def daily_summary(spark, d):
    e = table(spark, d, "events").withColumns({"day": F.date_format("ts", "yyyy-MM-dd"), "hour": F.hour("ts")})
    return rollups.daily_summary(e, "day", "hour", "value")


@query(f"""SELECT y, m, zone_id, zone, borough, count(*) AS n_trips, {_mean('l_extendedprice')} AS mean_fare_cents, {_mean('l_quantity')} AS mean_distance_cents FROM {TRIPS} WHERE zone_id IS NOT NULL GROUP BY ALL""")
def zone_month_statistics(spark, d):
    t = trips(spark, d).where(F.col("zone_id").isNotNull())
    return t.groupBy("y", "m", "zone_id", "zone", "borough").agg(F.count("*").alias("n_trips"), C.mean_cents("l_extendedprice").alias("mean_fare_cents"), C.mean_cents("l_quantity").alias("mean_distance_cents"))


CODES = {1: "Clear", 2: "Fair", 3: "Cloudy"}


@query(f"""SELECT year(o_orderdate) AS y, l_linenumber AS code, CASE l_linenumber WHEN 1 THEN 'Clear' WHEN 2 THEN 'Fair' WHEN 3 THEN 'Cloudy' ELSE 'Unknown (' || l_linenumber || ')' END AS label, count(*) AS n_trips, {_mean('l_extendedprice')} AS mean_cents FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def condition_impact_summary(spark, d):
    t = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return t.groupBy(F.year("o_orderdate").alias("y"), F.col("l_linenumber").alias("code"), C.labelled("l_linenumber", CODES).alias("label")).agg(F.count("*").alias("n_trips"), C.mean_cents("l_extendedprice").alias("mean_cents"))


@query(f"""SELECT year(o_orderdate) AS y, CASE WHEN l_quantity <= 9 THEN 'good' WHEN l_quantity <= 35.4 THEN 'moderate' WHEN l_quantity <= 55.4 THEN 'unhealthy_sensitive' WHEN l_quantity <= 125.4 THEN 'unhealthy' WHEN l_quantity <= 225.4 THEN 'very_unhealthy' ELSE 'hazardous' END AS band, count(*) AS n_trips, {_mean('l_quantity')} AS mean_cents FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity IS NOT NULL GROUP BY ALL""")
def banded_impact_summary(spark, d):
    t = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).where(F.col("l_quantity").isNotNull())
    return t.groupBy(F.year("o_orderdate").alias("y"), C.bands("l_quantity", C.PM25_BANDS, C.PM25_BEYOND).alias("band")).agg(F.count("*").alias("n_trips"), C.mean_cents("l_quantity").alias("mean_cents"))


@query(f"SELECT y, m, zone_id, zone, borough, count(*) AS n_trips FROM {TRIPS} GROUP BY ALL")
def monthly_zone_demand(spark, d):
    return rollups.count_by(trips(spark, d), "y", "m", "zone_id", "zone", "borough", name="n_trips")


@query(f"SELECT l_linestatus AS condition, count(*) AS n_trips, {_mean('l_quantity')} AS mean_cents FROM lineitem WHERE l_linestatus IS NOT NULL GROUP BY 1")
def avg_measure_by_condition(spark, d):
    t = table(spark, d, "lineitem").where(F.col("l_linestatus").isNotNull())
    return t.groupBy(F.col("l_linestatus").alias("condition")).agg(F.count("*").alias("n_trips"), C.mean_cents("l_quantity").alias("mean_cents"))


@query(f"""WITH c AS (SELECT {HOUR} AS hour, {_mean('value')} AS v FROM events WHERE event_type = 'view' GROUP BY 1),
    t AS (SELECT {HOUR} AS hour, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1)
    SELECT round(corr(v, CAST(coalesce(n, 0) AS DOUBLE)), 3) AS correlation, count(*) AS n_hours, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_trips FROM c LEFT JOIN t USING (hour)""")
def context_demand_correlation(spark, d):
    e = table(spark, d, "events").withColumn("hour", _text_hour())
    context = e.where("event_type = 'view'").groupBy("hour").agg(C.mean_cents("value").alias("v"))
    demand = e.where("event_type = 'click'").groupBy("hour").agg(F.count("*").alias("n"))
    both = context.join(demand, "hour", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return both.agg(F.round(F.corr("v", F.col("n").cast("double")), 3).alias("correlation"), F.count("*").alias("n_hours"), F.sum("n").alias("n_trips"))


@query(f"""WITH z AS (SELECT DISTINCT zone_id FROM {TRIPS}), c AS (SELECT DISTINCT l_linenumber AS code FROM lineitem), n AS (SELECT zone_id, l_linenumber AS code, count(*) AS n FROM {TRIPS} GROUP BY 1, 2),
    g AS (SELECT zone_id, code, coalesce(n, 0) AS n FROM z CROSS JOIN c LEFT JOIN n USING (zone_id, code))
    SELECT zone_id, max(n) - min(n) AS variation, CAST(sum(n) AS BIGINT) AS total, round(stddev_pop(n), 3) AS deviation FROM g GROUP BY 1""")
def zone_condition_variation(spark, d):
    t = trips(spark, d).select("zone_id", F.col("l_linenumber").alias("code"))
    n = t.groupBy("zone_id", "code").agg(F.count("*").alias("n"))
    grid = enrich.zero_filled(t.select("zone_id").distinct(), t.select("code").distinct(), n, ["zone_id", "code"], "n")
    return grid.groupBy("zone_id").agg((F.max("n") - F.min("n")).alias("variation"), F.sum("n").alias("total"), F.round(F.stddev_pop("n"), 3).alias("deviation"))


@query("""SELECT dayname(ts) AS weekday, hour(ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2 QUALIFY dense_rank() OVER (PARTITION BY weekday ORDER BY n DESC) = 1""")
def peak_hour_by_weekday(spark, d):
    peaks = rollups.ranked_peaks(table(spark, d, "events"), F.dayofweek("ts"), F.hour("ts"))
    names = {k + 1: v for k, v in enumerate("Sunday Monday Tuesday Wednesday Thursday Friday Saturday".split())}
    return peaks.select(C.labelled("grp", names).alias("weekday"), "hour", "n")


@query("""WITH t AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS mon, count(*) AS n FROM orders GROUP BY 1)
    SELECT strftime(a.mon, '%Y-%m') AS mon, a.n AS n_trips, a.n - b.n AS change, 100.0::DOUBLE * (a.n - b.n) / b.n AS change_pct FROM t a LEFT JOIN t b ON b.mon = a.mon - INTERVAL 1 MONTH""")
def monthly_trend(spark, d):
    t = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.count("*").alias("n")).select(F.make_date("y", "m", F.lit(1)).alias("mon"), "n")
    before = t.select(F.add_months("mon", 1).alias("mon"), F.col("n").alias("p"))
    both = t.join(before, "mon", "left")
    return both.select(F.date_format("mon", "yyyy-MM").alias("mon"), F.col("n").alias("n_trips"), (F.col("n") - F.col("p")).alias("change"), (F.lit(100.0) * (F.col("n") - F.col("p")) / F.col("p")).alias("change_pct"))


@query(f"SELECT zone, count(*) AS n_trips FROM {TRIPS} GROUP BY 1 ORDER BY n_trips DESC, zone LIMIT 10")
def top_zones(spark, d):
    return rollups.count_by(trips(spark, d), "zone", name="n_trips").orderBy(F.desc("n_trips"), "zone").limit(10)


@query(f"""WITH z AS (SELECT zone, borough, sum({_cents('l_extendedprice')}) AS c, count(*) AS n FROM {TRIPS} GROUP BY 1, 2) SELECT borough, CAST(sum(c) AS DOUBLE) / sum(n) AS mean_cents, CAST(sum(n) AS BIGINT) AS n_trips FROM z GROUP BY 1""")
def weighted_avg_rollup(spark, d):
    z = trips(spark, d).groupBy("zone", "borough").agg(F.sum(C.cents("l_extendedprice")).alias("c"), F.count("*").alias("n"))
    return z.groupBy("borough").agg((F.sum("c").cast("double") / F.sum("n")).alias("mean_cents"), F.sum("n").alias("n_trips"))


# --- joins ----------------------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, pn.n_name AS pickup_zone, pr.r_name AS pickup_borough, dn.n_name AS dropoff_zone, dr.r_name AS dropoff_borough FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON l_suppkey = s_suppkey
    LEFT JOIN nation pn ON c_nationkey = pn.n_nationkey LEFT JOIN region pr ON pn.n_regionkey = pr.r_regionkey LEFT JOIN nation dn ON s_nationkey = dn.n_nationkey LEFT JOIN region dr ON dn.n_regionkey = dr.r_regionkey""")
def enrich_fact(spark, d):
    t = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "l_suppkey", "o_custkey")
    t = enrich.with_role(t, table(spark, d, "customer"), "o_custkey", "c_custkey", {"c_nationkey": "c_nationkey"})
    t = enrich.with_role(t, table(spark, d, "supplier"), "l_suppkey", "s_suppkey", {"s_nationkey": "s_nationkey"})
    z = zones(spark, d)
    t = enrich.with_role(t, z, "c_nationkey", "n_nationkey", {"zone": "pickup_zone", "borough": "pickup_borough"})
    t = enrich.with_role(t, z, "s_nationkey", "n_nationkey", {"zone": "dropoff_zone", "borough": "dropoff_borough"})
    return t.select("l_orderkey", "l_linenumber", "pickup_zone", "pickup_borough", "dropoff_zone", "dropoff_borough")


@query(f"""WITH w AS (SELECT date_trunc('hour', ts) AS h, count(*) % 5 AS condition FROM events WHERE event_type = 'error' GROUP BY 1), a AS (SELECT date_trunc('hour', ts) AS h, {_mean('value')} AS sensor_cents FROM events WHERE event_type = 'view' GROUP BY 1)
    SELECT event_id, condition, sensor_cents, condition IS NOT NULL AS weather_available, sensor_cents IS NOT NULL AS air_quality_available FROM events LEFT JOIN w ON date_trunc('hour', ts) = w.h LEFT JOIN a ON date_trunc('hour', ts) = a.h""")
def enrich_hourly_context(spark, d):
    e = table(spark, d, "events").withColumn("h", C.hour_of("ts"))
    weather = e.where("event_type = 'error'").groupBy("h").agg((F.count("*") % 5).alias("condition"))
    air = e.where("event_type = 'view'").groupBy("h").agg(C.mean_cents("value").alias("sensor_cents"))
    t = enrich.with_context(e, weather, "h", "h", {"condition": "condition"}, "weather_available", "condition")
    t = enrich.with_context(t, air, "h", "h", {"sensor_cents": "sensor_cents"}, "air_quality_available", "sensor_cents")
    return t.select("event_id", "condition", "sensor_cents", "weather_available", "air_quality_available")


@query("""SELECT o_orderkey, concat_ws(',', CASE WHEN c_custkey IS NULL THEN 'reference.customer' END, CASE WHEN p_partkey IS NULL THEN 'reference.part' END) AS failed FROM orders
    LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey <= 100) ON o_custkey = c_custkey LEFT JOIN (SELECT DISTINCT p_partkey FROM part WHERE p_size <= 25) ON o_orderkey % 200 = p_partkey WHERE c_custkey IS NULL OR p_partkey IS NULL""")
def reference_check(spark, d):
    orders = table(spark, d, "orders").withColumn("part_ref", F.col("o_orderkey") % 200)
    refs = [(Reference("reference.customer", "o_custkey", "c_custkey", "no such customer"), table(spark, d, "customer").where("c_custkey <= 100")), (Reference("reference.part", "part_ref", "p_partkey", "no such part"), table(spark, d, "part").where("p_size <= 25"))]
    return rules.check_references(orders, refs)[1].select("o_orderkey", F.array_join("rejected_rules", ",").alias("failed"))


@query("SELECT p_brand, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def inner_reference_join(spark, d):
    t = enrich.with_role(table(spark, d, "lineitem"), table(spark, d, "part"), "l_partkey", "p_partkey", {"p_brand": "p_brand"}, "inner")
    t = enrich.with_role(t, table(spark, d, "supplier"), "l_suppkey", "s_suppkey", {"s_name": "s_name"}, "inner")
    return t.groupBy("p_brand").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events WHERE ts BETWEEN (SELECT min(ts) FROM events WHERE event_type = 'error') AND (SELECT max(ts) FROM events WHERE event_type = 'error')")
def context_window(spark, d):
    e = table(spark, d, "events")
    return enrich.with_bounds(e, e.where("event_type = 'error'"), "ts", "ts").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 400000)")
def affected_rows(spark, d):
    changed = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_orderkey").alias("l_orderkey"))
    return enrich.affected(table(spark, d, "lineitem"), changed, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_quantity")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN NOT l_quantity <= 45 THEN 'cleaned' WHEN NOT l_discount <= 0.08 THEN 'integrated' ELSE 'kept' END AS stage FROM (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity, min(l_discount) AS l_discount FROM lineitem GROUP BY 1, 2)""")
def stage_attribution(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"), F.min("l_discount").alias("dc")).withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return enrich.stage_lost(t, {"cleaned": t.where("q <= 45"), "integrated": t.where("q <= 45 and dc <= 0.08D")}, "id").select("l_orderkey", "l_linenumber", "stage")


# --- projections and filters ----------------------------------------------------------------------------------------

PERIODS = [Period("2024-01-03 00:00:00", "2024-01-05 12:00:00"), Period("2024-01-20 00:00:00", "2024-01-21 00:00:00")]


@query("SELECT event_id, user_id FROM events WHERE (ts >= '2024-01-03' AND ts < '2024-01-05 12:00:00') OR (ts >= '2024-01-20' AND ts < '2024-01-21')")
def period_filter(spark, d):
    return table(spark, d, "events").where(C.in_periods("ts", PERIODS)).select("event_id", "user_id")


@query("SELECT event_id, event_type FROM events WHERE ts >= '2024-01-10' AND ts < '2024-01-15'")
def observation_window(spark, d):
    return C.time_range(table(spark, d, "events"), "ts", "2024-01-10 00:00:00", "2024-01-15 00:00:00").select("event_id", "event_type")


def split_of(ts: str):
    from ..specs import sql_ntz

    return F.when(F.col(ts) < sql_ntz("2024-01-20 00:00:00"), "train").when(F.col(ts) < sql_ntz("2024-01-25 00:00:00"), "validation").otherwise("test")


SPLIT = "CASE WHEN ts < '2024-01-20' THEN 'train' WHEN ts < '2024-01-25' THEN 'validation' ELSE 'test' END"


@query(f"SELECT event_id, {SPLIT} AS split FROM events")
def chronological_split(spark, d):
    return table(spark, d, "events").select("event_id", split_of("ts").alias("split"))


@query(f"""SELECT {SPLIT} AS split, count(*) AS n_rows, CAST(sum({_cents('value')}) AS BIGINT) AS total_cents, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS n_errors, count(DISTINCT user_id) AS n_users, min({HOUR}) AS first_hour, max({HOUR}) AS last_hour FROM events GROUP BY 1""")
def split_summary(spark, d):
    e = table(spark, d, "events").withColumns({"split": split_of("ts"), "h": _text_hour()})
    return e.groupBy("split").agg(F.count("*").alias("n_rows"), F.sum(C.cents("value")).alias("total_cents"), F.count_if(F.col("event_type") == "error").alias("n_errors"), F.count_distinct("user_id").alias("n_users"), F.min("h").alias("first_hour"), F.max("h").alias("last_hour"))


@query("SELECT l_orderkey, l_linenumber, l_quantity = 0 AS is_zero_distance, (l_extendedprice < 0) OR (l_extendedprice - 2000 < 0) AS is_financial_adjustment, false AS has_invalid_distance FROM lineitem")
def trip_flags(spark, d):
    t = table(spark, d, "lineitem").withColumn("total", F.col("l_extendedprice") - 2000)
    return t.withColumns(enrich.trip_flags("l_quantity", "l_extendedprice", "total")).select("l_orderkey", "l_linenumber", "is_zero_distance", "is_financial_adjustment", "has_invalid_distance")


@query("SELECT event_id, hour(ts) AS hour, dayofweek(ts) + 1 AS day_of_week, month(ts) AS month, CAST(dayofweek(ts) IN (0, 6) AS INTEGER) AS is_weekend FROM events")
def temporal_features(spark, d):
    from . import ml

    return ml.temporal(table(spark, d, "events"), "ts").select("event_id", "hour", "day_of_week", "month", "is_weekend")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%H:%M:%S') WHEN event_id % 3 = 1 THEN strftime(ts, '%H:%M') || ':00' ELSE 'n/a' END AS clock FROM events""")
def normalize_clock(spark, d):
    hm = F.date_format("ts", "H:mm")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("0 days "), F.date_format("ts", "HH:mm:ss"))).when(F.col("event_id") % 3 == 1, hm).otherwise("n/a")
    return table(spark, d, "events").withColumns({"raw": raw, "day": F.to_date("ts")}).select("event_id", C.clock("day", "raw").alias("clock"))


@query("SELECT l_orderkey, l_linenumber, TRY_CAST(l_quantity AS INTEGER) AS quantity, l_quantity = trunc(l_quantity) AS is_lossless, l_discount = trunc(l_discount) AS discount_is_lossless FROM lineitem")
def lossless_narrowing(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").try_cast("int").alias("quantity"), contracts.lossless("l_quantity", "int").alias("is_lossless"), contracts.lossless("l_discount", "int").alias("discount_is_lossless"))


CAST_CONTRACT = SchemaContract(1, "csv", {"event_id": "bigint", "k": "int"})


@query("""SELECT event_id, TRY_CAST(nullif(k, '') AS INTEGER) AS k, CASE WHEN k = 'bad' THEN 'k: expected int' END AS reason FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'bad' WHEN event_id % 11 = 0 THEN '' ELSE regexp_extract(props, '(\\d+)', 1) END AS k FROM events)""")
def strict_cast_split(spark, d):
    e = table(spark, d, "events")
    k = F.when(F.col("event_id") % 7 == 0, "bad").when(F.col("event_id") % 11 == 0, "").otherwise(F.regexp_extract("props", r"(\d+)", 1))
    good, bad = contracts.strict_cast(e.select(F.col("event_id").cast("string").alias("event_id"), k.alias("k")), CAST_CONTRACT)
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad.select(F.col("event_id").cast("bigint").alias("event_id"), F.lit(None).cast("int").alias("k"), F.array_join("rejected_reasons", ",").alias("reason")))


@query("SELECT event_id, sha256(concat_ws('||', CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR), event_type, props)) AS record_hash FROM events")
def record_hash(spark, d):
    return table(spark, d, "events").select("event_id", C.text_hash(["event_id", "user_id", "event_type", "props"]).alias("record_hash"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE CAST('0x' || substr(md5('7:' || l_orderkey), 1, 15) AS BIGINT) % 1000000 < 100000")
def hash_sample(spark, d):
    return table(spark, d, "lineitem").where(C.sampled("l_orderkey", 0.1, 7)).select("l_orderkey", "l_linenumber")


@query("SELECT CAST('0x' || substr(md5('7:' || l_orderkey), 1, 15) AS BIGINT) % 16 AS bucket, count(*) AS n FROM lineitem GROUP BY 1")
def hash_bucket(spark, d):
    return table(spark, d, "lineitem").groupBy(C.bucket("l_orderkey", 16, 7).alias("bucket")).agg(F.count("*").alias("n"))


# --- rules and quarantine -------------------------------------------------------------------------------------------

LINE_RULES = [
    rules.predicate("duration.positive", "the trip must last", lambda: F.col("l_shipdate") <= F.col("o_orderdate")),
    rules.between("l_quantity", 0, 45),
    rules.predicate("discount.limit", "discount of at most 0.08", lambda: F.col("l_discount") > F.lit(0.08)),
]
FAILED = """(SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_shipdate <= o_orderdate THEN 'duration.positive' END, CASE WHEN NOT (l_quantity BETWEEN 0 AND 45) THEN 'range.l_quantity' END, CASE WHEN l_discount > 0.08 THEN 'discount.limit' END) AS failed FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _classified(spark, d):
    t = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rules.classify(t, LINE_RULES)


@query(f"SELECT l_orderkey, l_linenumber, failed FROM {FAILED}")
def classify_rows(spark, d):
    good, bad = _classified(spark, d)
    return good.select("l_orderkey", "l_linenumber", F.lit("").alias("failed")).unionByName(bad.select("l_orderkey", "l_linenumber", F.array_join("rejected_rules", ",").alias("failed")))


@query(f"SELECT count(*) AS rejected_records, CAST(coalesce(sum(len(string_split(failed, ','))), 0) AS BIGINT) AS rule_failures FROM {FAILED} WHERE failed <> ''")
def rejection_metrics(spark, d):
    return rules.rejection_metrics(_classified(spark, d)[1])


@query(f"""SELECT 'lines' AS dataset, 'cleaning' AS stage, rule_id, 'invalid_value' AS category, count(*) AS failed_records FROM (SELECT unnest(string_split(failed, ',')) AS rule_id FROM {FAILED} WHERE failed <> '') GROUP BY 3""")
def rule_summary(spark, d):
    return rules.rule_summary(_classified(spark, d)[1], "lines").drop("reason")


@query(f"""SELECT l_orderkey, l_linenumber, NULL::BIGINT AS o_custkey, failed FROM {FAILED} WHERE failed <> '' UNION ALL BY NAME SELECT o_orderkey AS l_orderkey, o_custkey, 'reference.customer' AS failed FROM orders WHERE o_custkey > 1000""")
def combine_rejections(spark, d):
    lines = _classified(spark, d)[1].select("l_orderkey", "l_linenumber", F.array_join("rejected_rules", ",").alias("failed"))
    ref = [(Reference("reference.customer", "o_custkey", "c_custkey", "no such customer"), table(spark, d, "customer").where("c_custkey <= 1000"))]
    orders = rules.check_references(table(spark, d, "orders"), ref)[1].select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.array_join("rejected_rules", ",").alias("failed"))
    return rules.combined([lines, orders]).select("l_orderkey", "l_linenumber", "o_custkey", "failed")


@query("""SELECT CAST(count(*) FILTER (WHERE l_orderkey IS NULL OR l_linenumber IS NULL) AS BIGINT) AS null_key_rows, (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS duplicate_keys FROM lineitem""")
def primary_key_check(spark, d):
    return rules.key_report(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


# --- keys and revisions ---------------------------------------------------------------------------------------------

ORDER = "l_shipdate DESC, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"


def _order():
    return [F.desc("l_shipdate"), *map(F.col, "l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus".split())]


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {ORDER}) = 1")
def latest_revision(spark, d):
    return keys.latest_complete(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], _order())[0].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {ORDER}) = 1 THEN 'kept' ELSE 'duplicate.exact_record' END AS verdict FROM lineitem")
def duplicate_split(spark, d):
    kept, extra = keys.split_duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], _order())
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", F.lit("kept").alias("verdict")).unionByName(extra.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join("rejected_rules", ",").alias("verdict")))


@query("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def drop_duplicates(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").dropDuplicates(["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(DISTINCT l_partkey) > 1)")
def conflicting_revisions(spark, d):
    return keys.split_conflicts(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey")[1].select("l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH i AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_suppkey % 2 = 0), k AS (SELECT l_orderkey, l_linenumber FROM i GROUP BY 1, 2 HAVING count(*) > 1),
    s AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey FROM lineitem WHERE l_suppkey % 3 = 0 GROUP BY 1, 2)
    SELECT * FROM i WHERE (l_orderkey, l_linenumber) NOT IN (SELECT (l_orderkey, l_linenumber) FROM k) AND (l_orderkey, l_linenumber, l_partkey) NOT IN (SELECT (l_orderkey, l_linenumber, l_partkey) FROM s)""")
def novel_records(spark, d):
    lines = table(spark, d, "lineitem")
    own = lines.select("l_orderkey", "l_linenumber", "l_partkey")
    stored = lines.where("l_suppkey % 3 = 0").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey")).withColumns({"_ingestion_timestamp": F.lit(0), "_schema_version": F.lit(1)})
    return keys.split_novel(own.where(lines["l_suppkey"] % 2 == 0), stored, ["l_orderkey", "l_linenumber"])[0]


# --- differences ----------------------------------------------------------------------------------------------------


def _revised(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return o, o.where("o_orderkey % 13 <> 0").withColumns({"o_orderstatus": F.when(F.col("o_orderkey") % 5 == 0, F.lit(None)).otherwise(F.col("o_orderstatus")), "o_totalprice": F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))})


REVISED = "(SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 13 <> 0)"


@query(f"SELECT n.o_orderkey, n.o_orderstatus FROM orders n LEFT JOIN {REVISED} o ON n.o_orderkey = o.o_orderkey WHERE o.o_orderkey IS NULL OR n.o_custkey IS DISTINCT FROM o.o_custkey OR n.o_orderstatus IS DISTINCT FROM o.o_orderstatus OR n.o_totalprice IS DISTINCT FROM o.o_totalprice")
def changed_rows(spark, d):
    new, old = _revised(spark, d)
    return diff.changed_rows(new, old, ["o_orderkey"]).select("o_orderkey", "o_orderstatus")


@query(f"""SELECT o_orderkey, difference FROM (SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'only_left' WHEN n.o_orderkey IS NULL THEN 'only_right' ELSE concat_ws(',', CASE WHEN n.o_orderstatus IS DISTINCT FROM o.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN n.o_totalprice IS DISTINCT FROM o.o_totalprice THEN 'o_totalprice' END) END AS difference FROM orders n FULL JOIN {REVISED} o ON n.o_orderkey = o.o_orderkey) WHERE difference <> ''""")
def dataset_diff(spark, d):
    return diff.table_diff(*_revised(spark, d), ["o_orderkey"])


@query("""SELECT *, 'left' AS side FROM (SELECT o_custkey, o_orderstatus FROM orders EXCEPT ALL SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 4 <> 0) UNION ALL SELECT *, 'right' AS side FROM (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 4 <> 0 EXCEPT ALL SELECT o_custkey, o_orderstatus FROM orders)""")
def bag_difference(spark, d):
    o = table(spark, d, "orders")
    return diff.bag_difference(o.select("o_custkey", "o_orderstatus"), o.where("o_orderkey % 4 <> 0").select("o_custkey", "o_orderstatus"))


@query(f"SELECT y, m, borough, count(*) AS n_trips, {_mean('l_extendedprice')} AS mean_cents FROM {TRIPS} GROUP BY ALL")
def scoped_refresh_equiv(spark, d):
    def build(t):
        return t.groupBy("y", "m", "borough").agg(F.count("*").alias("n_trips"), C.mean_cents("l_extendedprice").alias("mean_cents"))

    t = trips(spark, d)
    late = t.where("l_partkey % 50 = 0")
    return rollups.refresh_groups(build(t.where("l_partkey % 50 <> 0")), t, late, ["y", "m"], build)


# --- learning -------------------------------------------------------------------------------------------------------


@query(f"""WITH e AS (SELECT {HOUR} AS hour, user_id % 25 AS zone FROM events), h AS (SELECT DISTINCT hour FROM e), z AS (SELECT DISTINCT zone FROM e), n AS (SELECT hour, zone, count(*) AS demand FROM e GROUP BY 1, 2)
    SELECT hour, zone, coalesce(demand, 0) AS demand, CASE WHEN hour < '2024-01-20' THEN 'train' WHEN hour < '2024-01-25' THEN 'validation' ELSE 'test' END AS split FROM h CROSS JOIN z LEFT JOIN n USING (hour, zone)""")
def zone_hour_demand(spark, d):
    e = table(spark, d, "events").select(C.hour_of("ts").alias("hour"), (F.col("user_id") % 25).alias("zone"))
    grid = enrich.zero_filled(e.select("hour").distinct(), e.select("zone").distinct(), e.groupBy("hour", "zone").agg(F.count("*").alias("demand")), ["hour", "zone"], "demand")
    return grid.select(_text_hour("hour").alias("hour"), "zone", "demand", split_of("hour").alias("split"))


@query("""WITH v AS (SELECT event_type, CAST(floor(value) AS BIGINT) AS y, user_id % 7 AS p, 3 AS b FROM events) SELECT event_type, count(*) AS n, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg((b - y) * (b - y))), 6) AS baseline_rmse, round(CASE WHEN var_pop(y) > 0 THEN 1 - avg((p - y) * (p - y)) / var_pop(y) END, 6) AS r2 FROM v GROUP BY 1""")
def regression_metrics(spark, d):
    v = table(spark, d, "events").select("event_type", F.floor("value").cast("bigint").alias("y"), (F.col("user_id") % 7).alias("p"), F.lit(3).alias("b"))
    m = rollups.regression_metrics(v, "y", "p", "b", ["event_type"])
    return m.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("rmse", "mae", "baseline_rmse", "r2")))


# --- operations -----------------------------------------------------------------------------------------------------


def _runs(spark, d):
    """Events as a log of runs: the type is the dataset, the user the run, the value the duration."""
    from . import ops

    e = table(spark, d, "events")
    log = e.select(F.col("event_id").cast("string").alias("run_id"), (F.col("event_id") % 100).cast("string").alias("parent_run_id"), F.col("user_id").cast("string").alias("release_id"), F.when(F.col("event_id") % 7 == 0, "consumption").otherwise("dataset_update").alias("operation"), (F.col("event_id") % 50).alias("records_read"), F.col("event_type").alias("dataset_name"), F.when(F.col("event_id") % 10 == 0, "FAILED").otherwise("SUCCESS").alias("status"), F.col("ts").alias("started_at"), C.cents("value").alias("duration_ms"), (F.col("event_id") % 5).alias("records_rejected"), F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(F.col("event_id") % 4).alias("validation_failures"))
    return ops, log


RUNS = f"(SELECT CAST(event_id AS VARCHAR) AS run_id, CAST(event_id % 100 AS VARCHAR) AS parent_run_id, CAST(user_id AS VARCHAR) AS release_id, CASE WHEN event_id % 7 = 0 THEN 'consumption' ELSE 'dataset_update' END AS operation, event_id % 50 AS records_read, event_type AS dataset_name, CASE WHEN event_id % 10 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status, ts AS started_at, {_cents('value')} AS duration_ms, event_id % 5 AS records_rejected, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 4 END AS validation_failures FROM events)"


@query(f"SELECT dataset_name, CAST(coalesce(sum(validation_failures), 0) AS BIGINT) AS validation_failures, CAST(coalesce(sum(records_rejected), 0) AS BIGINT) AS records_rejected, count(*) AS n_runs FROM {RUNS} GROUP BY 1")
def ops_failures_by_group(spark, d):
    ops, log = _runs(spark, d)
    return ops.view(spark, "failures_by_dataset", log)


@query(f"SELECT dataset_name, CAST(sum(duration_ms) AS DOUBLE) / count(*) AS mean_ms, max(duration_ms) AS max_ms, min(duration_ms) AS min_ms, count(*) AS n_runs FROM {RUNS} WHERE status = 'SUCCESS' GROUP BY 1")
def ops_time_by_group(spark, d):
    ops, log = _runs(spark, d)
    return ops.view(spark, "time_by_dataset", log)


@query(f"SELECT run_id, parent_run_id, release_id, started_at, dataset_name, records_read, records_rejected, validation_failures, status FROM {RUNS} WHERE operation = 'dataset_update' AND status = 'SUCCESS'")
def ops_rejects_by_run(spark, d):
    ops, log = _runs(spark, d)
    return ops.view(spark, "rejects_by_run", log)


@query(f"SELECT strftime(started_at, '%Y-%m-%d') AS day, dataset_name, CAST(sum(duration_ms) AS DOUBLE) / count(*) AS mean_ms, count(*) AS n_runs FROM {RUNS} WHERE status = 'SUCCESS' GROUP BY ALL")
def ops_trend(spark, d):
    ops, log = _runs(spark, d)
    return ops.view(spark, "time_trend", log)


@query("SELECT dataset_name, old_version, new_version, change_type, n_columns FROM (VALUES ('air', 1, 2, 'ADD', 1), ('weather', 1, 2, 'ADD', 1), ('trips', 1, 2, 'TYPE_CHANGE', 1)) t(dataset_name, old_version, new_version, change_type, n_columns)")
def ops_schema_history(spark, d):
    from . import ops

    a = SchemaContract(1, "csv", {"id": "int", "v": "double"})
    plus, other = SchemaContract(2, "csv", {"id": "int", "v": "double", "w": "double"}), SchemaContract(2, "csv", {"id": "int", "v": "string"})
    events = [ops.schema_event(n, a, b) for n, b in (("air", plus), ("weather", plus), ("trips", other))]
    return ops.view(spark, "schema_history", ops.events_frame(spark, events))
