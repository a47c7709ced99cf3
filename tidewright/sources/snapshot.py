"""Snapshot tables on Parquet: immutable data folders and a log of versions.

A commit writes its rows to a new folder and publishes a log entry by creating the next version's file exclusively, so
readers see whole versions and of two writers one fails. A version lists its folders; old versions stay readable. An
entry may carry a transaction id: the same transaction is applied once. Row changes rewrite only the folders that hold
matching rows.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .contracts import aligned, narrowed


class CommitConflict(RuntimeError):
    """Another writer published the version first."""


@dataclass(frozen=True)
class Version:
    version: int
    committed_at: float
    operation: str
    folders: tuple[str, ...]
    schema: T.StructType
    rows: int
    bytes: int
    files: int
    txns: frozenset[str]
    partitions: tuple[str, ...]


class SnapshotTable:
    """A table at a path of a file system that the driver and the executors share."""

    def __init__(self, spark: SparkSession, path: str, partitions: tuple[str, ...] = ()):
        self.spark, self.path, self.partitions = spark, Path(path), tuple(partitions)

    # --- reading

    def versions(self) -> list[int]:
        log = self.path / "_log"
        return sorted(int(p.stem) for p in log.glob("[0-9]*.json")) if log.is_dir() else []

    def exists(self) -> bool:
        return bool(self.versions())

    def info(self, version: int | None = None) -> Version:
        known = self.versions()
        if not known or version is not None and version not in known:
            raise FileNotFoundError(f"{self.path}: no version {'at all' if version is None else version}")
        e = json.loads((self.path / "_log" / f"{known[-1] if version is None else version:08d}.json").read_text())
        return Version(e["version"], e["committed_at"], e["operation"], tuple(e["folders"]), T.StructType.fromJson(e["schema"]), e["rows"], e["bytes"], e["files"], frozenset(e["txns"]), tuple(e["partitions"]))

    def read(self, version: int | None = None) -> DataFrame:
        """The latest version or the given one. Folders of an older schema show added columns as nulls."""
        return self._of(self.info(version), None)

    def history(self) -> list[Version]:
        return [self.info(v) for v in reversed(self.versions())]

    def _of(self, v: Version, folders: tuple[str, ...] | None) -> DataFrame:
        folders = v.folders if folders is None else folders
        if not folders:
            return self.spark.createDataFrame([], v.schema)
        return self.spark.read.schema(v.schema).parquet(*(str(self.path / f) for f in folders)).select(*v.schema.names)

    # --- writing

    def append(self, df: DataFrame, txn: str | None = None, evolve: bool = True) -> int | None:
        """Adds rows; with ``evolve`` new columns join the schema. A transaction that was applied before: None, and nothing is written."""
        if not self.exists():
            return self._commit("append", [], df, txn)
        old = self.info()
        if txn and txn in old.txns:
            return None
        if not evolve and set(df.columns) - set(old.schema.names):
            raise ValueError(f"columns {sorted(set(df.columns) - set(old.schema.names))} are new")
        return self._commit("append", list(old.folders), df, txn, old)

    def overwrite(self, df: DataFrame, txn: str | None = None) -> int | None:
        old = self.info() if self.exists() else None
        if old and txn and txn in old.txns:
            return None
        return self._commit("overwrite", [], df, txn, None, old)

    def replace_where(self, df: DataFrame, where: Column | str, txn: str | None = None) -> int | None:
        """Replaces the rows that match; a group that ``df`` no longer has is gone. Folders without a match stay as they are."""
        old = self.info()
        if txn and txn in old.txns:
            return None
        where = F.expr(where) if isinstance(where, str) else where
        touched = self._touched(old, lambda f: f.where(where))
        rest = self._of(old, touched).where(~F.coalesce(where, F.lit(False)))
        new = rest.unionByName(df, allowMissingColumns=True) if touched else df
        return self._commit("replace_where", [f for f in old.folders if f not in touched], new, txn, old)

    def merge(self, df: DataFrame, keys: list[str], update: bool = True, txn: str | None = None) -> int | None:
        """Upserts by key, nulls equal to nulls; without ``update`` rows of known keys are left alone. Keys of ``df`` must be unique."""
        if not self.exists():
            return self._commit("merge", [], df, txn)
        old = self.info()
        if txn and txn in old.txns:
            return None
        new = df.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)))
        same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)))
        if not update:
            known = self.read().select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)))
            fresh = df.join(known, same, "left_anti")
            return self._commit("merge", list(old.folders), fresh, txn, old)
        touched = self._touched(old, lambda f: f.join(new, same, "left_semi"))
        rest = self._of(old, touched).join(new, same, "left_anti")
        return self._commit("merge", [f for f in old.folders if f not in touched], rest.unionByName(df, allowMissingColumns=True) if touched else df, txn, old)

    def replace_scopes(self, df: DataFrame, scopes: DataFrame, keys: list[str], txn: str | None = None) -> int | None:
        """Replaces the rows whose keys are among the scopes, nulls equal to nulls; folders without such a row stay as they are."""
        old = self.info()
        if txn and txn in old.txns:
            return None
        asked = scopes.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).distinct()
        same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)))
        touched = self._touched(old, lambda f: f.join(asked, same, "left_semi"))
        rest = self._of(old, touched).join(asked, same, "left_anti") if touched else None
        return self._commit("replace_scopes", [f for f in old.folders if f not in touched], rest.unionByName(df, allowMissingColumns=True) if touched else df, txn, old)

    def compact(self) -> int | None:
        """The same rows in one folder, as a new version; a table of one folder is left as it is."""
        old = self.info()
        return self._commit("compact", [], self.read(), None, old) if len(old.folders) > 1 else None

    def append_fitting(self, df: DataFrame, txn: str | None = None) -> int | None:
        """Appends rows of changed types if every value fits the stored ones; the original goes along as JSON."""
        stored = {f.name: f.dataType.simpleString() for f in self.info().schema}
        return self.append(narrowed(df, stored), txn)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Drops the log of all but the newest versions and the folders that none of them lists."""
        import shutil

        gone = self.versions()[:-keep] if keep else []
        live = {f for v in self.versions()[-keep:] for f in self.info(v).folders}
        for v in gone:
            (self.path / "_log" / f"{v:08d}.json").unlink()
        dead = [p.name for p in (self.path / "data").iterdir() if f"data/{p.name}" not in live]
        for name in dead:
            shutil.rmtree(self.path / "data" / name)
        return dead

    def _touched(self, old: Version, matching) -> tuple[str, ...]:
        """Folders with a matching row: one reader and one job over all of them."""
        if not old.folders:
            return ()
        rows = self.spark.read.schema(old.schema).parquet(*(str(self.path / f) for f in old.folders))
        found = matching(rows.select(*old.schema.names, F.col("_metadata.file_path").alias("_file")))
        names = found.select(F.regexp_extract("_file", r"/(data/[0-9a-f]{32})/", 1).alias("folder")).distinct()
        return tuple(sorted(r["folder"] for r in names.collect()))

    def _commit(self, operation: str, keep: list[str], df: DataFrame, txn: str | None, old: Version | None = None, before: Version | None = None) -> int:
        before = old or before
        if old:
            extra = [f for f in df.schema.fields if f.name not in old.schema.names]
            schema = T.StructType([*old.schema.fields, *(T.StructField(f.name, f.dataType, True) for f in extra)])
            df = aligned(df, {f.name: f.dataType.simpleString() for f in schema.fields})
            df = df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if df.schema[f.name].dataType.simpleString() != f.dataType.simpleString() else F.col(f"`{f.name}`") for f in schema.fields))
        else:
            schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
        folder = f"data/{uuid.uuid4().hex}"
        seen = _observed(df, self.path / folder, self.partitions)
        files = [p for p in (self.path / folder).rglob("*.parquet")]
        folders = [*keep, *([folder] if files else [])]
        known = {f: self._stats(f) for f in keep}
        entry = {
            "version": before.version + 1 if before else 0,
            "committed_at": time.time(),
            "operation": operation,
            "folders": folders,
            "schema": schema.jsonValue(),
            "rows": seen + sum(k["rows"] for k in known.values()),
            "bytes": sum(p.stat().st_size for p in files) + sum(k["bytes"] for k in known.values()),
            "files": len(files) + sum(k["files"] for k in known.values()),
            "txns": sorted({*(before.txns if before else ()), *([txn] if txn else [])}),
            "partitions": list(self.partitions),
        }
        if files:
            (self.path / folder / "_stats.json").write_text(json.dumps({"rows": seen, "bytes": sum(p.stat().st_size for p in files), "files": len(files)}))
        return self._publish(entry)

    def _stats(self, folder: str) -> dict:
        return json.loads((self.path / folder / "_stats.json").read_text())

    def _publish(self, entry: dict) -> int:
        log = self.path / "_log"
        log.mkdir(parents=True, exist_ok=True)
        tmp = log / f".{uuid.uuid4().hex}"
        tmp.write_text(json.dumps(entry))
        try:
            os.link(tmp, log / f"{entry['version']:08d}.json")  # fails if the version is there
        except FileExistsError:
            raise CommitConflict(f"{self.path}: version {entry['version']} was committed by another writer") from None
        finally:
            tmp.unlink()
        return entry["version"]


def _observed(df: DataFrame, folder: Path, partitions: tuple[str, ...]) -> int:
    """Writes and counts in one job."""
    from pyspark.sql import Observation

    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("n")).write
    (writer.partitionBy(*partitions) if partitions else writer).parquet(str(folder))
    return int(seen.get["n"])
