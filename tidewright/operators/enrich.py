"""Joins that widen a fact: role-playing dimensions, context by the hour, references."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_role(fact: DataFrame, dim: DataFrame, key: str, dim_key: str, columns: Mapping[str, str], how: str = "left") -> DataFrame:
    """Joins one dimension in one role: its columns come under the role's names. Unmatched facts stay, with nulls.

    No side is forced: Spark broadcasts a dimension under its size threshold and shuffles a larger one.
    """
    side = dim.select(F.col(dim_key).alias("_role_key"), *(F.col(a).alias(b) for a, b in columns.items()))
    return fact.join(side, F.col(key) == F.col("_role_key"), how).drop("_role_key")


def with_context(fact: DataFrame, context: DataFrame, hour: str, context_hour: str, columns: Mapping[str, str], flag: str, marker: str) -> DataFrame:
    """Joins measures of the fact's hour; ``flag`` says whether the marker measure is there."""
    return with_role(fact, context, hour, context_hour, columns).withColumn(flag, F.col(marker).isNotNull())


def affected(rows: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is among the changed ones; nothing is collected."""
    return rows.join(changed.select(*keys).distinct(), keys, "left_semi")


def with_bounds(context: DataFrame, fact: DataFrame, context_ts: str, fact_ts: str) -> DataFrame:
    """Context rows between the fact's first and last time, both included; an empty fact leaves none.

    The bounds are a one-row side of the plan, not a trip to the driver.
    """
    bounds = fact.agg(F.min(fact_ts).alias("_first"), F.max(fact_ts).alias("_last"))
    return context.join(F.broadcast(bounds), F.col(context_ts).between(F.col("_first"), F.col("_last"))).drop("_first", "_last")


def zero_filled(rows: DataFrame, columns: DataFrame, counts: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """Every combination of two dimensions with its measure, 0 where there is none."""
    return rows.crossJoin(columns).join(counts, keys, "left").withColumn(measure, F.coalesce(F.col(measure), F.lit(0)))


def stage_lost(ids: DataFrame, stages: Mapping[str, DataFrame], key: str) -> DataFrame:
    """For each id the first stage in which it is missing, ``kept`` if in none."""
    out, lost = ids, F.lit(None).cast("string")
    for name, stage in stages.items():
        out = out.join(stage.select(F.col(key).alias(f"_{name}")).distinct(), F.col(key) == F.col(f"_{name}"), "left")
        lost = F.coalesce(lost, F.when(F.col(f"_{name}").isNull(), F.lit(name)))
    return out.select(*(F.col(c) for c in ids.columns), F.coalesce(lost, F.lit("kept")).alias("stage"))


def trip_flags(distance: str, fare: str, total: str) -> dict[str, Column]:
    """Flags of a trip; null amounts leave the adjustment unknown."""
    return {"is_zero_distance": F.col(distance) == 0, "is_financial_adjustment": (F.col(fare) < 0) | (F.col(total) < 0), "has_invalid_distance": F.lit(False)}
