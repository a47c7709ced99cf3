"""Comparison of tables: changed rows, full outer differences with tolerance, bag differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


def changed_rows(new: DataFrame, old: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """Rows of ``new`` that are not in ``old`` or differ there in a column, nulls equal to nulls. A null key is always new."""
    columns = columns if columns is not None else [c for c in new.columns if c not in keys and c in old.columns]
    old = old.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(F.col(c).alias(f"_o_{c}") for c in columns), F.lit(True).alias("_there"))
    differs = reduce(lambda a, c: a | ~F.col(c).eqNullSafe(F.col(f"_o_{c}")), columns, F.lit(False))
    both = new.join(old, [new[k] == F.col(f"_k_{k}") for k in keys], "left")
    return both.where(F.col("_there").isNull() | differs).select(*(new[c] for c in new.columns))


def near(a: Column, b: Column, tolerance: float) -> Column:
    """Equal, both null, both NaN, or within the tolerance, absolute up to 1 and relative beyond."""
    scale = F.greatest(F.lit(1.0), F.abs(a), F.abs(b))
    return a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= tolerance * scale, F.lit(False))


def table_diff(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Keys whose rows differ: only_left, only_right, or the names of the differing columns, comma-joined."""
    columns = [c for c in left.columns if c not in keys]
    kinds = dict(left.dtypes)
    a = left.select(*keys, F.struct(*columns).alias("_a"))
    b = right.select(*keys, F.struct(*columns).alias("_b"))
    differing = F.array_compact(F.array(*(F.when(~(near(F.col(f"_a.{c}"), F.col(f"_b.{c}"), tolerance) if kinds[c] in NUMERIC else F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}"))), F.lit(c)) for c in columns)))
    kind = F.when(F.col("_b").isNull(), "only_left").when(F.col("_a").isNull(), "only_right").otherwise(F.array_join(differing, ","))
    return a.join(b, keys, "full").select(*keys, kind.alias("difference")).where("difference <> ''")


def bag_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with the side; as often as they are in excess."""
    right = right.select(*left.columns)
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def same_bag(left: DataFrame, right: DataFrame) -> bool:
    return bag_difference(left, right).isEmpty()
