"""Demand by zone and hour: the zero-filled grid, features, a random forest, its metrics and run folder."""

from __future__ import annotations

import json
import math
import os
import time
from pathlib import Path

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import in_periods
from ..operators.enrich import zero_filled
from ..operators.rollups import regression_metrics
from ..specs import Period, sql_ntz

NUMERIC = ["temperature_c", "precipitation_mm", "wind_speed_kmh", "pm25_avg_ug_m3"]
CATEGORICAL = ["pickup_location_id", "weather_condition_code", "hour", "day_of_week", "month"]
BINARY = ["is_weekend", "weather_flag", "air_flag"]
CALENDAR = "hour({ts}) AS hour, dayofweek({ts}) AS day_of_week, month({ts}) AS month, cast(dayofweek({ts}) IN (1, 7) AS int) AS is_weekend"


def temporal(df: DataFrame, ts: str) -> DataFrame:
    """Adds hour, day of week (1 is Sunday), month and weekend flag."""
    return SQLTransformer(statement=f"SELECT *, {CALENDAR.format(ts=ts)} FROM __THIS__").transform(df)


def demand_grid(trips: DataFrame, window: Period, boundaries: tuple[str, str], hour: str = "pickup_hour", zone: str = "pickup_location_id", context: list[str] | None = None, zone_columns: list[str] | None = None) -> DataFrame:
    """Demand for every observed hour and zone of the window, 0 where there was none, with the hour's context, the zone's names and the split."""
    seen = trips.where(in_periods(hour, [window]))
    zone_columns = [c for c in (zone_columns if zone_columns is not None else ["pickup_zone", "pickup_borough"]) if c in trips.columns]
    context = [c for c in (context if context is not None else [*NUMERIC, "weather_condition_code", "weather_available", "air_quality_available"]) if c in trips.columns]
    hours = seen.groupBy(hour).agg(*(F.max(c).alias(c) for c in context))
    zones = seen.where(F.col(zone).isNotNull()).groupBy(zone).agg(*(F.max(c).alias(c) for c in zone_columns))
    grid = zero_filled(hours, zones, seen.groupBy(hour, zone).agg(F.count(F.lit(1)).alias("demand")), [hour, zone], "demand")
    a, b = map(sql_ntz, boundaries)
    at = F.col(hour).cast("timestamp_ntz")
    return grid.withColumn("split", F.when(at < a, "train").when(at < b, "validation").otherwise("test"))


def split_report(grid: DataFrame, hour: str = "pickup_hour") -> DataFrame:
    order = F.when(F.col("split") == "train", 0).when(F.col("split") == "validation", 1).otherwise(2)
    return grid.groupBy("split").agg(F.count("*").alias("n_rows"), F.sum("demand").alias("trips"), F.count_if(F.col("demand") == 0).alias("zero_rows"), F.min(hour).alias("first_hour"), F.max(hour).alias("last_hour")).orderBy(order)


def validate(grid: DataFrame, keys: tuple[str, str] = ("pickup_hour", "pickup_location_id"), label: str = "demand") -> DataFrame:
    """The grid itself; raises ValueError for a bad label, null or repeated keys, or splits that are missing or overlap."""
    y = F.col(label).cast("double")
    bad = y.isNull() | F.isnan(y) | (y < 0) | (y == math.inf) | F.col(keys[0]).isNull() | F.col(keys[1]).isNull()
    n_bad, n, n_keys = grid.agg(F.count_if(bad), F.count("*"), F.count_distinct(*keys)).first()
    spans = {r["split"]: (r["a"], r["b"]) for r in grid.groupBy("split").agg(F.min(keys[0]).alias("a"), F.max(keys[0]).alias("b")).collect()}
    if n_bad or n != n_keys:
        raise ValueError(f"{n_bad} bad rows, {n - n_keys} repeated keys")
    if set(spans) != {"train", "validation", "test"} or not spans["train"][1] < spans["validation"][0] <= spans["validation"][1] < spans["test"][0]:
        raise ValueError(f"splits are not chronological: {sorted(spans)}")
    return grid


def feature_pipeline(hour: str = "pickup_hour", numeric: list[str] = NUMERIC, categorical: list[str] = CATEGORICAL) -> Pipeline:
    """Calendar, medians for missing numbers, scaling, one-hot codes with a place for unseen ones, one vector."""
    text = [f"cast({c} AS string) AS {c}_text" for c in categorical if c not in ("hour", "day_of_week", "month")]
    numbers = [f"cast({c} AS double) AS {c}_num" for c in numeric]
    flags = ["cast(coalesce(weather_available, false) AS int) AS weather_flag", "cast(coalesce(air_quality_available, false) AS int) AS air_flag"]
    calendar = SQLTransformer(statement=f"SELECT *, {CALENDAR.format(ts=hour)}, {', '.join([*text, *numbers, *flags])} FROM __THIS__")
    codes = [c if c in ("hour", "day_of_week", "month") else f"{c}_text" for c in categorical]
    filled = [f"{c}_filled" for c in numeric]
    return Pipeline(stages=[
        calendar,
        Imputer(strategy="median", inputCols=[f"{c}_num" for c in numeric], outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="numbers", handleInvalid="error"),
        StandardScaler(inputCol="numbers", outputCol="scaled", withMean=False),
        StringIndexer(inputCols=codes, outputCols=[f"{c}_i" for c in categorical], handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=[f"{c}_i" for c in categorical], outputCols=[f"{c}_v" for c in categorical], handleInvalid="keep", dropLast=False),
        VectorAssembler(inputCols=["scaled", *BINARY, *(f"{c}_v" for c in categorical)], outputCol="features", handleInvalid="error"),
    ])


def fit_features(grid: DataFrame, pipeline: Pipeline | None = None) -> PipelineModel:
    """Fitted on the training rows alone; raises ValueError if there are none."""
    train = grid.where("split = 'train'")
    if train.isEmpty():
        raise ValueError("no training rows")
    return (pipeline or feature_pipeline()).fit(train)


def train(grid: DataFrame, trees: int = 20, depth: int = 8, bins: int = 32, seed: int = 2221, keys: tuple[str, str] = ("pickup_hour", "pickup_location_id"), partitions: int | None = None) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """(model, predictions with the mean baseline, metrics by split). Rows are dealt and ordered by key first, so that a run can be repeated."""
    n = partitions or int(grid.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = validate(grid, keys).withColumn("demand", F.col("demand").cast("double")).repartition(n, *keys).sortWithinPartitions(*keys)
    features = fit_features(rows)
    forest = RandomForestRegressor(featuresCol="features", labelCol="demand", numTrees=trees, maxDepth=depth, maxBins=bins, seed=seed)
    model = PipelineModel(stages=[*features.stages, forest.fit(features.transform(rows.where("split = 'train'")))])
    mean = rows.where("split = 'train'").agg(F.avg("demand")).first()[0]
    out = model.transform(rows).select(*keys, "demand", "split", "prediction").withColumn("baseline", F.lit(mean))
    return model, out, regression_metrics(out, "demand", "prediction", "baseline", ["split"])


def run_training(grid: DataFrame, folder: str, source_version: int | None = None, **options) -> dict:
    """A run in a folder of its own, which must not exist: model, predictions, metrics; its status says how it ended."""
    from ..sources.files import save_json

    path, started = Path(folder), time.time()
    path.mkdir(parents=True)
    state = {"status": "running", "source_version": source_version, "options": options}
    save_json(path / "run.json", state)
    try:
        model, predictions, metrics = train(grid, **options)
        model.write().save(os.fspath(path / "model"))
        predictions.write.parquet(os.fspath(path / "predictions"))
        state |= {"metrics": [r.asDict() for r in metrics.collect()], "seconds": round(time.time() - started, 3), "status": "complete"}
    except Exception as e:
        state |= {"status": "failed", "error": f"{type(e).__name__}: {e}"}
        raise
    finally:
        save_json(path / "run.json", json.loads(json.dumps(state, default=str)))
    return state


def load(folder: str) -> PipelineModel:
    return PipelineModel.load(os.fspath(Path(folder) / "model"))
