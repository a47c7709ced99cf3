"""Aggregates and products, written once over named roles so that any fact can play them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import mean_cents, merged_version_set, version_set


def count_by(df: DataFrame, *keys: str | Column, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def mean_by(df: DataFrame, key: str | Column, amount: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(mean_cents(amount).alias(name))


def with_versions(df: DataFrame, keys: list[str], scalars: list[str] = (), arrays: list[str] = ()) -> DataFrame:
    """Sorted version sets by group; no keys: one row for all. Missing lineage columns are an error."""
    if missing := [c for c in (*scalars, *arrays) if c not in df.columns]:
        raise ValueError(f"lineage columns are missing: {missing}")
    aggs = [version_set(c).alias(f"{c}s") for c in scalars] + [merged_version_set(c).alias(c) for c in arrays]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def hourly_sensors(df: DataFrame, hour: str, value: str, site: list[str]) -> DataFrame:
    """Mean, least and greatest value, observations and sites of an hour (sites with a null in their key do not count)."""
    return df.groupBy(hour).agg(mean_cents(value).alias("mean_cents"), F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.count("*").alias("n_observations"), F.count_distinct(*site).alias("n_sites"))


def peak_hour(df: DataFrame, day: str, hour: str) -> DataFrame:
    """The hour with the most rows of each day, the earliest of equals, and its count; two hash aggregations, no window."""
    per_hour = df.groupBy(day, hour).agg(F.count("*").alias("n"))
    best = F.max_by(F.struct(hour, "n"), F.struct("n", -F.col(hour)))
    return per_hour.groupBy(day).agg(best.alias("_b")).select(day, F.col(f"_b.{hour}").alias("peak_hour"), F.col("_b.n").alias("peak_count"))


def daily_summary(df: DataFrame, day: str, hour: str, amount: str) -> DataFrame:
    """Count, total and mean amount of each day, with its peak hour: one aggregation by hour feeds both."""
    from ..functions.columns import cents

    per_hour = df.groupBy(day, hour).agg(F.count("*").alias("n"), F.sum(cents(amount)).alias("c"), F.count(amount).alias("m"))
    best = F.max_by(F.struct(hour, "n"), F.struct("n", -F.col(hour)))
    days = per_hour.groupBy(day).agg(F.sum("n").alias("n_trips"), F.sum("c").alias("total_cents"), (F.sum("c").cast("double") / F.sum("m")).alias("mean_cents"), best.alias("_b"))
    return days.select(day, "n_trips", "total_cents", "mean_cents", F.col(f"_b.{hour}").alias("peak_hour"), F.col("_b.n").alias("peak_count"))


def ranked_peaks(df: DataFrame, group: str | Column, hour: str | Column) -> DataFrame:
    """Hours with the most rows of each group, all equals kept."""
    n = df.groupBy(F.col(group).alias("grp") if isinstance(group, str) else group.alias("grp"), F.col(hour).alias("hour") if isinstance(hour, str) else hour.alias("hour")).agg(F.count("*").alias("n"))
    return n.withColumn("r", F.dense_rank().over(Window.partitionBy("grp").orderBy(F.desc("n")))).where("r = 1").drop("r")


def refresh_groups(current: DataFrame, source: DataFrame, changed: DataFrame, scope: list[str], build) -> DataFrame:
    """An aggregate after a change: the groups of the changed scopes computed anew from all their rows, the others as they are."""
    scopes = changed.select(*scope).distinct()
    return current.join(scopes, scope, "left_anti").unionByName(build(source.join(scopes, scope, "left_semi")))


def regression_metrics(df: DataFrame, label: str, prediction: str, baseline: str, keys: list[str] = ()) -> DataFrame:
    """Errors of a prediction and a baseline in one pass; r2 is null where the label does not vary."""
    err, base = F.col(prediction) - F.col(label), F.col(baseline) - F.col(label)
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"), F.avg(base * base).alias("baseline_mse"), F.avg(F.abs(base)).alias("baseline_mae"), F.var_pop(label).alias("_v"))
    return out.select(*keys, "n", F.sqrt("mse").alias("rmse"), "mae", F.sqrt("baseline_mse").alias("baseline_rmse"), "baseline_mae", F.when(F.col("_v") > 0, 1 - F.col("mse") / F.col("_v")).alias("r2"))
