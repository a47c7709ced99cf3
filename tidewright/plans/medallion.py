"""The batch pipeline: files to raw, normal, integrated, aggregates and products; and a viewer of its tables."""

from __future__ import annotations

import argparse
import uuid
from collections.abc import Callable, Mapping
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from ..operators.rules import check_references
from ..sources.contracts import read_files, renamed, strict_cast, with_lineage
from ..sources.files import Registry, discover
from ..sources.snapshot import SnapshotTable
from ..specs import DatasetSpec, Reference
from . import ops
from .products import AGGREGATES, PRODUCTS, build
from .release import Warehouse


class Medallion:
    """Runs the layers of a warehouse; layers below are only rebuilt if rows came in."""

    def __init__(self, warehouse: Warehouse, references: Mapping[Reference, str] | None = None):
        self.w, self.references = warehouse, dict(references or {})
        self.rejected: dict[str, SnapshotTable] = {}

    def ingest(self, spec: DatasetSpec, sample: int | None = None) -> int:
        """Reads new and changed files. A sample replaces the raw table and leaves the registry as it was. Returns the accepted rows."""
        registry = Registry(str(self.w.root / "_registry" / f"{spec.name}.json"))
        states = registry.pending(discover(spec.source, spec.contract().format))
        if not states:
            return 0
        contract = spec.contract()
        rows = read_files(self.w.spark, [s.path for s in states], contract)
        rows = rows.limit(sample) if sample else rows
        good, bad = strict_cast(rows, contract) if contract.format == "csv" else (rows, None)
        run = str(uuid.uuid4())
        started, raw = datetime.now(UTC), self.w.table("raw", spec.name)
        out = with_lineage(renamed(good, dict(contract.rename)), spec.name, contract.version, run)
        before = raw.info().rows if raw.exists() and not sample else 0
        raw.overwrite(out) if sample else raw.append(out)
        if bad is not None:
            self.w.table("rejected/consumption", spec.name).append(bad.drop("_failures"))
        if not sample:
            registry.record(states)
        n = raw.info().rows - before
        ops.record(self.w.table("monitoring", "pipeline_runs"), self.w.spark, [ops.run_row("consumption", "SUCCESS", spec.name, run, started, records_written=n, files_read=len(states), schema_version=contract.version)])
        return n

    def normal(self) -> None:
        for spec in self.w.specs.values():
            good, bad = spec.clean(self.w.table("raw", spec.name).read())
            self.w.table("normal", spec.name).overwrite(good)
            if bad is not None:
                self.w.table("rejected/cleaning", spec.name).overwrite(bad.drop("_failures"))

    def integrated(self) -> None:
        tables = {d: self.w.table("normal", d).read() for d in self.w.specs}
        fact = tables[self.w.fact]
        good, bad = check_references(fact, [(r, tables[d]) for r, d in self.references.items()])
        if self.references:
            self.w.table("rejected/reference", self.w.fact).overwrite(bad.drop("_failures"))
        self.w.table("integrated", self.w.fact).overwrite(self.w.integrate({**tables, self.w.fact: good}))

    def derived(self) -> None:
        source, catalog = self.w.table("integrated", self.w.fact), self.w.table("analysis", "product_catalog")
        for layer, specs in (("aggregate", AGGREGATES), ("product", PRODUCTS)):
            for name, spec in specs.items():
                build(spec, source, self.w.table(layer, name), catalog if layer == "product" else None)

    def steps(self) -> dict[str, Callable[[], object]]:
        return {"raw": lambda: sum(self.ingest(s) for s in self.w.specs.values()), "normal": self.normal, "integrated": self.integrated, "derived": self.derived}

    def run(self) -> int:
        """All layers; without new rows only the first. Returns the new rows."""
        new = self.steps()["raw"]()
        if new:
            self.normal()
            self.integrated()
            self.derived()
        return new


def view(spark: SparkSession, table: SnapshotTable | str, columns: list[str] | None = None, version: int | None = None) -> DataFrame:
    """A table, or some of its columns; unknown ones are an error that names them."""
    df = (SnapshotTable(spark, table) if isinstance(table, str) else table).read(version)
    if missing := [c for c in columns or [] if c not in df.columns]:
        raise ValueError(f"no such columns: {missing}")
    return df.select(*columns) if columns else df


def main(argv: list[str] | None = None) -> None:
    """``python -m tidewright.plans.medallion PATH [--columns a,b] [--version N] [--count] [--rows N]`` shows a table."""
    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("path")
    p.add_argument("--columns")
    p.add_argument("--version", type=int)
    p.add_argument("--rows", type=int, default=20)
    p.add_argument("--count", action="store_true")
    a = p.parse_args(argv)
    df = view(SparkSession.builder.getOrCreate(), a.path, a.columns.split(",") if a.columns else None, a.version)
    df.printSchema()
    df.show(a.rows, truncate=False)
    if a.count:
        print(df.count())


if __name__ == "__main__":
    main()
