"""Revisions, duplicates, conflicts and novelty by business key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import content_hash
from .rules import classify, reject_all, required


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def by_ingestion(df: DataFrame) -> list[Column]:
    """Latest ingestion first, then the later contract; the record hash settles ties."""
    return [F.col("_ingestion_timestamp").desc_nulls_last(), F.col("_schema_version").desc(), *([F.col("_record_hash").asc()] if "_record_hash" in df.columns else [])]


def latest_complete(df: DataFrame, keys: list[str], order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(latest row per key, rejected rows with a null in the key)."""
    whole, rejected = classify(df, [required(k) for k in keys])
    return latest(whole, keys, order), rejected


def split_duplicates(df: DataFrame, keys: list[str], order: list[Column], rule_id: str = "duplicate.exact_record") -> tuple[DataFrame, DataFrame]:
    """(first row per key, quarantined others). The order is the caller's, so that the survivor does not depend on chance."""
    numbered = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    extra = reject_all(numbered.where("_n > 1").drop("_n"), rule_id, "the record occurs more than once", "duplicate", "deduplication")
    return numbered.where("_n = 1").drop("_n"), extra


def conflicting_keys(df: DataFrame, keys: list[str], hash_col: str) -> DataFrame:
    """Keys with more than one content."""
    return df.groupBy(*keys).agg(F.min(hash_col).alias("_a"), F.max(hash_col).alias("_b")).where("_a <> _b").select(*keys)


def split_conflicts(df: DataFrame, keys: list[str], hash_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows of keys with one content, rows of keys with several)."""
    bad = conflicting_keys(df, keys, hash_col)
    return df.join(bad, keys, "left_anti"), df.join(bad, keys, "left_semi")


def split_novel(incoming: DataFrame, stored: DataFrame | None, keys: list[str], conflicts: bool = True) -> tuple[DataFrame, DataFrame]:
    """(novel rows, quarantined rows) of a batch against the latest stored revisions.

    Within the batch equal records are kept once; keys with differing records are quarantined if ``conflicts``; records
    equal to the latest stored revision of their key are known. A return to an older content is novel.
    """
    own = [c for c in incoming.columns if not c.startswith("_")]
    hashed = incoming.withColumn("_content", content_hash(own))
    once, repeated = split_duplicates(hashed, ["_content"], [F.col(f"`{c}`") for c in own])
    out = [repeated]
    if conflicts:
        once, clash = split_conflicts(once, keys, "_content")
        out.append(reject_all(clash, "duplicate.conflicting_revision", "the key has several contents in one release", "duplicate", "deduplication"))
    if stored is not None:
        # a column that the stored table does not have yet counts as null there
        kinds = {f.name: f.dataType for f in incoming.schema}
        # of the history only the batch's keys are ranked, null keys included
        asked = once.select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys))).distinct()
        same = reduce(lambda a, b: a & b, (stored[k].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)))
        now = latest(stored.join(asked, same, "left_semi"), keys, by_ingestion(stored))
        now = now.select(*(F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in stored.columns else F.lit(None).cast(kinds[c]).alias(c) for c in own)).select(content_hash(own).alias("_content"))
        known = once.join(now, "_content", "left_semi")
        out.append(reject_all(known, "duplicate.existing_record", "the stored revision is the same", "duplicate", "deduplication"))
        once = once.join(now, "_content", "left_anti")
    rejected = out[0]
    for f in out[1:]:
        rejected = rejected.unionByName(f, allowMissingColumns=True)
    return once.drop("_content").select(*incoming.columns), rejected.drop("_content")
