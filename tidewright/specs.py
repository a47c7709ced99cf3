"""Declarations that the engine compiles to plans: contracts, datasets, rules, periods, products."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The only types a source column may have.
SOURCE_TYPES = ("bigint", "boolean", "date", "double", "int", "string", "timestamp", "timestamp_ntz")


class ContractError(ValueError):
    """A source does not fit its contract; ``details`` says how."""

    def __init__(self, message: str, **details):
        super().__init__(message)
        self.details = details


@dataclass(frozen=True)
class SchemaContract:
    """One version of a source's columns, how its files are read, and how its columns are renamed."""

    version: int
    format: str
    columns: Mapping[str, str]
    rename: Mapping[str, str] = field(default_factory=dict)
    options: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.format not in ("csv", "parquet"):
            raise ContractError(f"unknown format {self.format!r}", format=self.format)
        odd = {c: t for c, t in self.columns.items() if t not in SOURCE_TYPES}
        if odd or not self.columns:
            raise ContractError(f"columns without an accepted type: {odd}", columns=odd)
        if str(self.options.get("inferSchema", "false")).lower() != "false":
            raise ContractError("a contract declares its types; inferSchema is not accepted", option="inferSchema")
        if unknown := set(self.rename) - set(self.columns):
            raise ContractError(f"renamed columns that are not declared: {sorted(unknown)}", columns=sorted(unknown))

    def struct(self, as_text: bool = False) -> T.StructType:
        return T._parse_datatype_string(", ".join(f"`{c}` {'string' if as_text else t}" for c, t in self.columns.items()))

    def diff(self, later: SchemaContract) -> dict[str, list[str]]:
        """What a later version adds, removes and types anew; compatible if it only adds."""
        both = self.columns.keys() & later.columns.keys()
        return {"added": [c for c in later.columns if c not in self.columns], "removed": [c for c in self.columns if c not in later.columns], "retyped": sorted(c for c in both if self.columns[c] != later.columns[c])}


@dataclass(frozen=True)
class Rule:
    """A row is invalid where the predicate is true; a null predicate passes."""

    rule_id: str
    message: str
    category: str
    invalid: Callable[[], Column]


@dataclass(frozen=True)
class Reference:
    """A column whose values, where not null, must occur among a dimension's keys."""

    rule_id: str
    column: str
    key: str
    message: str


@dataclass(frozen=True)
class Period:
    """A half-open stretch of local time."""

    start: str
    end: str


@dataclass(frozen=True)
class DatasetSpec:
    """A dataset: its contract versions, which is current, its keys, rules and layout."""

    name: str
    contracts: Mapping[int, SchemaContract]
    current: int
    source: str
    business_key: tuple[str, ...]
    rules: tuple[Rule, ...] = ()
    partitions: tuple[str, ...] = ()
    clean: Callable[[DataFrame], DataFrame] | None = None
    conflicts: bool = True

    def __post_init__(self):
        if self.current not in self.contracts:
            raise ContractError(f"{self.name}: no contract of version {self.current}", version=self.current)
        if not re.fullmatch(r"[a-z][a-z0-9_]*", self.name):
            raise ContractError(f"{self.name!r} is no dataset name", name=self.name)

    def contract(self, version: int | None = None) -> SchemaContract:
        version = self.current if version is None else version
        if version not in self.contracts:
            raise ContractError(f"{self.name}: no contract of version {version}", version=version)
        return self.contracts[version]


@dataclass(frozen=True)
class ProductSpec:
    """A materialised aggregate: how it is built, one row per what, refreshed by which keys, from which columns."""

    name: str
    build: Callable[[DataFrame], DataFrame]
    grain: tuple[str, ...]
    scope: tuple[str, ...]
    inputs: tuple[str, ...]
    title: str = ""


def sql_ntz(text: str) -> Column:
    return F.expr(f"timestamp_ntz'{text}'")
