"""Contract checks, strict casts and safe names for what comes in; lineage for what goes on."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import content_hash, snake, text_hash
from ..operators.rules import quarantine_columns
from ..specs import ContractError, SchemaContract

LINEAGE = ("_dataset_name", "_schema_version", "_source_file", "_source_file_size", "_source_modified_time", "_ingestion_run_id", "_ingestion_timestamp", "_record_hash")


def check_columns(columns: Iterable[str], contract: SchemaContract) -> None:
    """The columns must be those of the contract, in any order."""
    have, want = set(columns), set(contract.columns)
    if have != want:
        missing, unexpected = sorted(want - have), sorted(have - want)
        raise ContractError(f"columns differ from the contract: missing {missing}, unexpected {unexpected}", change_type="UNSUPPORTED_COLUMNS", missing=missing, unexpected=unexpected)


def check_types(df: DataFrame, contract: SchemaContract) -> None:
    """The physical types must be those of the contract."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    changed = {c: {"expected": t, "found": have[c]} for c, t in contract.columns.items() if have.get(c) != t}
    if changed:
        raise ContractError(f"types differ from the contract: {changed}", change_type="UNSUPPORTED_TYPE_CHANGE", columns=changed)


def read_files(spark: SparkSession, paths: list[str], contract: SchemaContract) -> DataFrame:
    """The files under the contract, checked, with the file's path, size and time beside each row.

    CSV comes as text under the declared header; a differing header is an error. Parquet must have the declared types.
    """
    meta = [F.col("_metadata.file_path").alias("_source_file"), F.col("_metadata.file_size").alias("_source_file_size"), F.col("_metadata.file_modification_time").alias("_source_modified_time")]
    if contract.format == "parquet":
        frames = []
        for p in paths:
            df = spark.read.parquet(p)
            check_columns(df.columns, contract)
            check_types(df, contract)
            frames.append(df.select(*(F.col(f"`{c}`") for c in contract.columns), *meta))
        return union_all(frames)
    frames = []
    for p in paths:
        options = {"header": "true", **contract.options, "inferSchema": "false"}
        header = spark.read.options(**options).csv(p)
        check_columns(header.columns, contract)
        frames.append(spark.read.options(**options).schema(contract.struct(as_text=True) if header.columns == list(contract.columns) else header.schema).csv(p).select(*(F.col(f"`{c}`") for c in contract.columns), *meta))
    return union_all(frames)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name; columns that a frame lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def strict_cast(df: DataFrame, contract: SchemaContract) -> tuple[DataFrame, DataFrame]:
    """(rows with the declared types, quarantined rows). A blank text becomes null; any other text that does not cast rejects the row."""
    typed = {c: t for c, t in contract.columns.items() if t != "string"}
    bad = [(f"type.{c}", f"{c}: expected {t}", "invalid_type", F.expr(f"try_cast(nullif(trim(`{c}`), '') as {t})").isNull() & (F.trim(f"`{c}`") != "")) for c, t in typed.items()]
    marked = quarantine_columns(df, bad)
    accepted = marked.where(F.size("_failures") == 0).select(*(F.expr(f"try_cast(nullif(trim(`{c}`), '') as {typed[c]})").alias(c) if c in typed else F.col(f"`{c}`") for c in df.columns))
    return accepted, marked.where(F.size("_failures") > 0)


def safe_names(columns: list[str], rename: dict[str, str] | None = None) -> list[str]:
    """The given names, else snake case; names that begin with an underscore stay; later equals get _2, _3, ..."""
    rename, out = rename or {}, []
    for c in columns:
        base = rename.get(c) or (c if c.startswith("_") else snake(c))
        name, k = base, 1
        while name in out:
            k += 1
            name = f"{base}_{k}"
        out.append(name)
    return out


def renamed(df: DataFrame, rename: dict[str, str] | None = None) -> DataFrame:
    return df.toDF(*safe_names(df.columns, dict(rename or {})))


def with_lineage(df: DataFrame, dataset: str, version: int, run_id: str, null_safe: bool = True) -> DataFrame:
    """Adds the lineage columns; the record hash covers all columns whose names do not begin with an underscore."""
    own = [c for c in df.columns if not c.startswith("_")]
    made = {"_dataset_name": F.lit(dataset), "_schema_version": F.lit(version), "_ingestion_run_id": F.lit(run_id), "_ingestion_timestamp": F.current_timestamp(), "_record_hash": content_hash(own) if null_safe else text_hash(own)}
    for c, t in (("_source_file", "string"), ("_source_file_size", "bigint"), ("_source_modified_time", "timestamp")):
        if c not in df.columns:
            made[c] = F.lit(None).cast(t)
    return df.withColumns(made).select(*own, *LINEAGE)


def aligned(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns in the given order, those that are missing as typed nulls; further ones stay at the end."""
    return df.select(*(F.col(f"`{c}`") if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()), *(F.col(f"`{c}`") for c in df.columns if c not in columns))


def narrowed(df: DataFrame, stored: dict[str, str]) -> DataFrame:
    """Casts to the types a stored table has, where no value loses anything, and keeps the row's original as JSON.

    Raises ValueError naming the columns with a value that would change.
    """
    changed = {f.name: stored[f.name] for f in df.schema if f.name in stored and f.dataType.simpleString() != stored[f.name]}
    if not changed:
        return df
    lossy = df.agg(*(F.count_if(~lossless(c, t)).alias(c) for c, t in changed.items())).first().asDict()
    if bad := [c for c, n in lossy.items() if n]:
        raise ValueError(f"values of {bad} do not fit the stored types")
    return df.withColumn("_source_payload", F.to_json(F.struct(*df.columns))).withColumns({c: F.col(f"`{c}`").try_cast(t) for c, t in changed.items()})


def lossless(column: str, kind: str):
    """Whether a value survives the cast to a narrower type and back; nulls do."""
    c = F.col(f"`{column}`")
    return c.isNull() | F.coalesce(c.try_cast(kind).cast("string").try_cast("double") == c.cast("double"), c.try_cast(kind).cast("string") == c.cast("string"), F.lit(False))
