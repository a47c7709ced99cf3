"""The mobility warehouse: its four datasets, their contracts by version, and how they are joined."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from ..operators import cleaners
from ..specs import DatasetSpec, Period, Reference, SchemaContract
from .medallion import Medallion
from .release import Warehouse

#: The columns of the published files, with their types.
TRIPS = "VendorID int, tpep_pickup_datetime timestamp_ntz, tpep_dropoff_datetime timestamp_ntz, passenger_count bigint, trip_distance double, RatecodeID bigint, store_and_fwd_flag string, PULocationID int, DOLocationID int, payment_type bigint, fare_amount double, extra double, mta_tax double, tip_amount double, tolls_amount double, improvement_surcharge double, total_amount double, congestion_surcharge double, Airport_fee double"
ZONES = "LocationID int, Borough string, Zone string, service_zone string"
WEATHER = "year int, month int, day int, hour int, temp double, temp_source string, rhum double, rhum_source string, prcp double, prcp_source string, snwd double, snwd_source string, wdir double, wdir_source string, wspd double, wspd_source string, wpgt double, wpgt_source string, pres double, pres_source string, cldc double, cldc_source string, coco int, coco_source string"
AIR = "State Code string, County Code string, Site Num string, Parameter Code string, POC int, Latitude double, Longitude double, Datum string, Parameter Name string, Date Local date, Time Local string, Date GMT date, Time GMT string, Sample Measurement double, Units of Measure string, MDL double, Uncertainty double, Qualifier string, Method Type string, Method Code string, Method Name string, State Name string, County Name string, Date of Last Change date"
TRIP_NAMES = {"VendorID": "vendor_id", "tpep_pickup_datetime": "pickup_timestamp", "tpep_dropoff_datetime": "dropoff_timestamp", "RatecodeID": "rate_code_id", "PULocationID": "pickup_location_id", "DOLocationID": "dropoff_location_id", "Airport_fee": "airport_fee"}


def columns(text: str, **more: str) -> dict[str, str]:
    return dict(c.rsplit(" ", 1) for c in text.split(", ")) | more


def datasets(source: str, periods: Iterable[Period]) -> dict[str, DatasetSpec]:
    """The datasets below a folder: trips as Parquet, the others as CSV; weather and air have a second version with one more column."""
    periods = list(periods)
    hour = ("year", "month", "day", "hour")
    sensor = ("state_code", "county_code", "site_num", "parameter_code", "poc", "date_local", "time_local")
    v = SchemaContract
    return {
        s.name: s
        for s in (
            DatasetSpec("trips", {1: v(1, "parquet", columns(TRIPS), TRIP_NAMES)}, 1, f"{source}/trips", ("_record_hash",), clean=lambda df: cleaners.trips(df, periods), conflicts=False),
            DatasetSpec("zones", {1: v(1, "csv", columns(ZONES), {"LocationID": "location_id"})}, 1, f"{source}/zones", ("location_id",), clean=cleaners.zones),
            DatasetSpec("weather", {1: v(1, "csv", columns(WEATHER)), 2: v(2, "csv", columns(WEATHER, humidity="double"))}, 1, f"{source}/weather", hour, clean=cleaners.weather),
            DatasetSpec("air_quality", {1: v(1, "csv", columns(AIR)), 2: v(2, "csv", columns(AIR, aqi="double"))}, 1, f"{source}/air_quality", sensor, partitions=("date_local",), clean=cleaners.air_quality),
        )
    }


def integrate(tables: dict[str, DataFrame]) -> DataFrame:
    return cleaners.integrated(tables["trips"], tables["zones"], tables["weather"], tables["air_quality"])


REFERENCES = {
    Reference("reference.pickup_zone", "pickup_location_id", "location_id", "the pickup zone does not exist"): "zones",
    Reference("reference.dropoff_zone", "dropoff_location_id", "location_id", "the dropoff zone does not exist"): "zones",
}
NORMAL_KEYS = {"trips": ["trip_id"], "zones": ["location_id"], "weather": ["event_hour"], "air_quality": ["event_hour"]}
CONTEXT_KEYS = {"zones": {"pickup_location_id": "location_id", "dropoff_location_id": "location_id"}, "weather": {"pickup_hour": "event_hour"}, "air_quality": {"pickup_hour": "event_hour"}}


def warehouse(spark: SparkSession, root: str, source: str, periods: Iterable[Period]) -> Medallion:
    w = Warehouse(spark, root, datasets(source, periods), "trips", integrate, NORMAL_KEYS, CONTEXT_KEYS)
    return Medallion(w, REFERENCES)
