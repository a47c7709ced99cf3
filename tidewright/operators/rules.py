"""Validation rules and quarantine: each predicate is evaluated once, as one array of failures."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..specs import Reference, Rule

FAILURE = "struct<rule_id:string,category:string,reason:string>"
REJECTED = ("rejected_rules", "rejected_categories", "rejected_reasons")


def required(column: str) -> Rule:
    return Rule(f"required.{column}", f"{column} is required", "incomplete", lambda: F.col(column).isNull())


def non_empty(column: str) -> Rule:
    return Rule(f"required.{column}", f"{column} must not be empty", "incomplete", lambda: F.col(column).isNull() | (F.trim(F.col(column)) == ""))


def between(column: str, low: float, high: float) -> Rule:
    """Invalid where not null and outside the closed range; NaN lies outside."""
    return Rule(f"range.{column}", f"{column} must be between {low} and {high}", "invalid_value", lambda: ~F.col(column).between(low, high))


def at_least(column: str, low: float) -> Rule:
    return Rule(f"minimum.{column}", f"{column} must be at least {low}", "invalid_value", lambda: F.col(column) < low)


def predicate(rule_id: str, message: str, invalid: Callable[[], Column], category: str = "invalid_value") -> Rule:
    return Rule(rule_id, message, category, invalid)


def from_message(message: str, invalid: Callable[[], Column]) -> Rule:
    """A rule known only by its message: its id is the message's words joined by dots."""
    return Rule(re.sub(r"[^a-z0-9]+", ".", message.lower()).strip("."), message, "dataset_specific", invalid)


def registered(name: str, by_dataset: dict[str, Iterable[Rule]], extra: Iterable[Rule] = ()) -> tuple[Rule, ...]:
    """The rules for all datasets (under ``*``), the dataset's own, and extra ones, in this order."""
    return (*by_dataset.get("*", ()), *by_dataset.get(name, ()), *extra)


def quarantine_columns(df: DataFrame, tests: list[tuple[str, str, str, Column]]) -> DataFrame:
    """Adds ``_failures`` and the three parallel arrays drawn from it. tests: (id, reason, category, predicate)."""
    every = [F.when(p, F.struct(F.lit(i).alias("rule_id"), F.lit(c).alias("category"), F.lit(m).alias("reason"))) for i, m, c, p in tests]
    failures = F.array_compact(F.array(*every)) if every else F.array().cast(f"array<{FAILURE}>")
    return df.withColumn("_failures", failures).withColumns({out: F.col(f"_failures.{k}") for out, k in zip(REJECTED, ("rule_id", "category", "reason"))})


def classify(df: DataFrame, rules: Iterable[Rule], stage: str = "cleaning") -> tuple[DataFrame, DataFrame]:
    """(accepted rows as they were, rejected rows with the rules they break, stage and time). A null predicate passes."""
    marked = quarantine_columns(df, [(r.rule_id, r.message, r.category, r.invalid()) for r in rules])
    accepted = marked.where(F.size("_failures") == 0).select(*(F.col(f"`{c}`") for c in df.columns))
    return accepted, _rejected(marked.where(F.size("_failures") > 0), stage)


def _rejected(marked: DataFrame, stage: str) -> DataFrame:
    return marked.drop("_failures").withColumns({"rejected_stage": F.lit(stage), "_rejected_at": F.current_timestamp()})


def reject_all(df: DataFrame, rule_id: str, message: str, category: str, stage: str) -> DataFrame:
    return _rejected(quarantine_columns(df, [(rule_id, message, category, F.lit(True))]), stage)


def check_references(df: DataFrame, references: Iterable[tuple[Reference, DataFrame]], stage: str = "reference") -> tuple[DataFrame, DataFrame]:
    """(rows whose references all exist, rejected rows with each that does not). A null reference is no violation.

    The dimensions' keys are made distinct and joined; Spark broadcasts them if they are small enough.
    """
    out, tests = df, []
    for k, (ref, dim) in enumerate(references):
        keys = dim.select(F.col(ref.key).alias(f"_key{k}")).where(F.col(f"_key{k}").isNotNull()).distinct()
        out = out.join(keys, F.col(ref.column) == F.col(f"_key{k}"), "left")
        tests.append((ref.rule_id, ref.message, "missing_reference", F.col(ref.column).isNotNull() & F.col(f"_key{k}").isNull()))
    marked = quarantine_columns(out, tests)
    plain = [c for c in marked.columns if not re.fullmatch(r"_key\d+", c)]
    marked = marked.select(*(F.col(f"`{c}`") for c in plain))
    return marked.where(F.size("_failures") == 0).select(*(F.col(f"`{c}`") for c in df.columns)), _rejected(marked.where(F.size("_failures") > 0), stage)


def combined(frames: list[DataFrame]) -> DataFrame | None:
    """Rejections of several stages as one frame, or None."""
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def rule_summary(rejected: DataFrame, dataset: str) -> DataFrame:
    """Failures and failed records by dataset, stage, rule, category and reason."""
    zipped = F.arrays_zip(*(F.col(c) for c in REJECTED))
    each = rejected.select(F.col("rejected_stage").alias("stage"), F.inline(zipped)).toDF("stage", "rule_id", "category", "reason")
    return each.groupBy(F.lit(dataset).alias("dataset"), "stage", "rule_id", "category", "reason").agg(F.count("*").alias("failed_records"))


def rejection_metrics(rejected: DataFrame) -> DataFrame:
    return rejected.agg(F.count("*").alias("rejected_records"), F.coalesce(F.sum(F.size("rejected_rules")), F.lit(0)).cast("bigint").alias("rule_failures"))


def key_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows with a null in the key, keys that occur more than once."""
    null_key = F.exists(F.array(*(F.col(k).isNull() for k in keys)), lambda x: x)
    counted = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counted.agg(F.coalesce(F.sum(F.when(null_key, F.col("n"))), F.lit(0)).cast("bigint").alias("null_key_rows"), F.count_if(~null_key & (F.col("n") > 1)).alias("duplicate_keys"))


def require_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """The frame itself; raises ValueError if the key has nulls or repeats."""
    r = key_report(df, keys).first()
    if r["null_key_rows"] or r["duplicate_keys"]:
        raise ValueError(f"key {keys}: {r['null_key_rows']} rows with a null, {r['duplicate_keys']} repeated keys")
    return df
