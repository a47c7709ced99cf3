"""Releases: immutable files with a manifest, applied once, resumable between stages, under a single-writer lock."""

from __future__ import annotations

import fcntl
import json
import re
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.diff import changed_rows
from ..operators.enrich import affected
from ..operators.keys import split_novel
from ..operators.rules import rejection_metrics
from ..sources.contracts import read_files, renamed, strict_cast, with_lineage
from ..sources.files import load_json, save_json, sha256
from ..sources.snapshot import SnapshotTable
from ..specs import DatasetSpec
from .products import AGGREGATES, PRODUCTS, affected_products, build


class ReleaseError(ValueError):
    """A manifest or a release that cannot be applied."""


@dataclass(frozen=True)
class ReleaseFile:
    dataset: str
    path: str
    schema_version: int
    records: int
    sha256: str


@dataclass(frozen=True)
class Manifest:
    release_id: str
    files: tuple[ReleaseFile, ...]
    fingerprint: str


def load_manifest(path: str, specs: dict[str, DatasetSpec]) -> Manifest:
    """A manifest whose id, datasets, versions, places and checksums hold."""
    p = Path(path)
    m = json.loads(p.read_text())
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]{0,63}", str(m.get("release_id", ""))):
        raise ReleaseError(f"bad release id {m.get('release_id')!r}")
    files, seen = [], set()
    for f in m.get("files", []):
        if f["dataset"] in seen or f["dataset"] not in specs:
            raise ReleaseError(f"dataset {f['dataset']!r} is unknown or named twice")
        seen.add(f["dataset"])
        specs[f["dataset"]].contract(f["schema_version"])
        place = (p.parent / f["path"]).resolve()
        if not place.is_relative_to(p.parent.resolve()):
            raise ReleaseError(f"{f['path']} lies outside the release")
        if sha256(place) != f["sha256"]:
            raise ReleaseError(f"{f['path']} is not the file that the manifest describes")
        files.append(ReleaseFile(f["dataset"], str(place), f["schema_version"], f["records"], f["sha256"]))
    if not files:
        raise ReleaseError("a release without files")
    return Manifest(m["release_id"], tuple(files), sha256(p))


def write_manifest(folder: str, release_id: str, files: list[dict]) -> str:
    """files: dataset, path (within the folder), schema_version, records; the checksums are taken here."""
    full = [f | {"sha256": sha256(Path(folder) / f["path"])} for f in files]
    save_json(Path(folder) / "manifest.json", {"release_id": release_id, "files": full})
    return str(Path(folder) / "manifest.json")


@contextmanager
def single_writer(path: str):
    """Holds the lock of a warehouse; another process that holds it is an error at once."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError:
            raise ReleaseError(f"another writer holds {path}") from None
        try:
            yield
        finally:
            fcntl.flock(f, fcntl.LOCK_UN)


class ReleaseState:
    """Which steps of a release are done, in a JSON file; a release with another manifest under the same id is refused."""

    def __init__(self, path: str, manifest: Manifest):
        self.path = Path(path)
        self.data = load_json(path, {"release_id": manifest.release_id, "fingerprint": manifest.fingerprint, "status": "running", "done": {}})
        if self.data["fingerprint"] != manifest.fingerprint:
            raise ReleaseError(f"release {manifest.release_id} was begun with another manifest")

    @property
    def complete(self) -> bool:
        return self.data["status"] == "complete"

    def step(self, name: str, work: Callable[[], dict | int | None]):
        """Runs a step unless it is done; its result is kept."""
        if name not in self.data["done"]:
            self.data["done"][name] = work()
            self.save("running")
        return self.data["done"][name]

    def save(self, status: str, error: str | None = None) -> None:
        self.data |= {"status": status, "error": error}
        save_json(self.path, self.data)


class Warehouse:
    """The tables of a warehouse under one folder, and how a release moves through them.

    specs: the datasets, each with its cleaner (raw rows -> (valid rows, rejected rows)). integrate: joins the normal
    tables to the fact. fact: the dataset whose key identifies the fact's rows.
    """

    def __init__(self, spark: SparkSession, root: str, specs: dict[str, DatasetSpec], fact: str, integrate: Callable[[dict[str, DataFrame]], DataFrame], normal_keys: dict[str, list[str]], context_keys: dict[str, dict[str, str]]):
        self.spark, self.root, self.specs, self.fact, self.integrate = spark, Path(root), specs, fact, integrate
        self.normal_keys, self.context_keys = normal_keys, context_keys

    def table(self, layer: str, name: str, partitions: tuple[str, ...] = ()) -> SnapshotTable:
        return SnapshotTable(self.spark, str(self.root / layer / name), partitions)

    def manifests(self, folder: str) -> list[str]:
        """The manifests of the releases below a folder, by name; those of releases that were begun and not completed come first."""
        begun = {p.stem for p in (self.root / "_releases").glob("*.json") if load_json(p)["status"] != "complete"}
        return sorted(map(str, Path(folder).glob("*/manifest.json")), key=lambda p: (load_json(p)["release_id"] not in begun, p))

    def apply_all(self, folder: str) -> list[dict]:
        """Applies all releases below a folder, one after the other; completed ones write nothing."""
        return [self.apply(p) for p in self.manifests(folder)]

    def _reject(self, kind: str, dataset: str, rows: DataFrame, txn: str) -> None:
        """Quarantines rows; where there are none, no version is added."""
        if not rows.isEmpty():
            self.table(f"rejected/{kind}", dataset).append(rows.drop("_failures"), txn)

    def apply(self, manifest_path: str) -> dict:
        """Applies a release; an interrupted one goes on where it stopped, a completed one writes nothing."""
        manifest = load_manifest(manifest_path, self.specs)
        with single_writer(str(self.root / "_lock")):
            pending = [p for p in (self.root / "_releases").glob("*.json") if load_json(p)["status"] != "complete" and p.stem != manifest.release_id]
            if pending:
                raise ReleaseError(f"release {pending[0].stem} is not complete yet")
            state = ReleaseState(str(self.root / "_releases" / f"{manifest.release_id}.json"), manifest)
            if state.complete:
                return state.data
            try:
                self._apply(manifest, state)
                state.save("complete")
            except Exception as e:
                state.save("failed", f"{type(e).__name__}: {e}")
                raise
        return state.data

    def _apply(self, m: Manifest, state: ReleaseState) -> None:
        txn = f"release/{m.release_id}"
        base = state.step("base", lambda: {f"{layer}/{n}": t.info().version for layer, n in [("integrated", self.fact), *(("normal", d) for d in self.specs), *(("product", p) for p in PRODUCTS)] if (t := self.table(layer, n)).exists()})
        for f in m.files:
            state.step(f"raw/{f.dataset}", lambda f=f: self._ingest(f, m, txn))
        for f in m.files:
            state.step(f"normal/{f.dataset}", lambda f=f: self._clean(f, m, txn))
        changed = state.step("integrated", lambda: self._integrate(base, txn, m.release_id))
        if changed is None:
            return
        table = self.table("integrated", self.fact)
        now = table.read()
        before = table.read(base[f"integrated/{self.fact}"]) if f"integrated/{self.fact}" in base else now.limit(0)
        key = self.normal_keys[self.fact][0]
        changed_keys = self.table("stage", f"{m.release_id}-changed")
        if changed_keys.exists():
            now, before = (affected(x, changed_keys.read(), [key]) for x in (now, before))
        for layer, specs in (("aggregate", AGGREGATES), ("product", PRODUCTS)):
            moved = affected_products(before, now, key, specs.values())
            for name, rows in moved.items():
                catalog = self.table("analysis", "product_catalog") if layer == "product" else None
                state.step(f"{layer}/{name}", lambda layer=layer, name=name, rows=rows, catalog=catalog, specs=specs: build(specs[name], table, self.table(layer, name), catalog, None, rows, f"{txn}/{name}"))

    def _ingest(self, f: ReleaseFile, m: Manifest, txn: str) -> dict:
        """File -> typed rows -> rows that are new, appended to the raw table; the others are quarantined."""
        spec = self.specs[f.dataset]
        contract = spec.contract(f.schema_version)
        rows = read_files(self.spark, [f.path], contract)
        good, bad = strict_cast(rows, contract) if contract.format == "csv" else (rows, None)
        stage = self.table("stage", f"{m.release_id}-{f.dataset}")
        parsed = with_lineage(renamed(good, dict(contract.rename)), f.dataset, f.schema_version, m.release_id)
        stage.overwrite(parsed)  # cuts the plan: what follows uses the rows several times
        n_bad = 0
        if bad is not None:
            out = self.table("rejected/consumption", f.dataset)
            n_bad = rejection_metrics(bad).first()["rejected_records"]
            if n_bad:
                out.append(bad.drop("_failures"), f"{txn}/{f.dataset}")
        accepted = stage.info().rows
        if accepted + n_bad != f.records:
            raise ReleaseError(f"{f.dataset}: {accepted} accepted and {n_bad} rejected rows, the manifest has {f.records}")
        raw = self.table("raw", f.dataset)
        keys = list(spec.business_key)
        novel, repeated = split_novel(stage.read(), raw.read() if raw.exists() else None, keys, spec.conflicts)
        self._reject("deduplication", f.dataset, repeated, f"{txn}/{f.dataset}")
        before = raw.info().rows if raw.exists() else 0
        raw.append(novel, f"{txn}/{f.dataset}")
        return {"accepted": accepted, "rejected": n_bad, "novel": raw.info().rows - before}

    def _clean(self, f: ReleaseFile, m: Manifest, txn: str) -> dict | None:
        """Cleans all revisions of the keys that the release touched and upserts what differs."""
        spec, raw, normal = self.specs[f.dataset], self.table("raw", f.dataset), self.table("normal", f.dataset)
        rows = raw.read()
        touched = rows.where(F.col("_ingestion_run_id") == m.release_id)
        if touched.isEmpty():
            return None
        scope = list(spec.partitions) or list(spec.business_key)
        good, bad = spec.clean(affected(rows, touched, scope))
        if bad is not None:
            self._reject("cleaning", f.dataset, bad, f"{txn}/{f.dataset}")
        keys = self.normal_keys[f.dataset]
        fresh = changed_rows(good, normal.read(), keys) if normal.exists() and set(good.columns) <= set(normal.info().schema.names) else good
        return {"version": normal.merge(fresh, keys, txn=f"{txn}/{f.dataset}")}

    def _integrate(self, base: dict, txn: str, release: str) -> dict | None:
        """Joins anew only the facts that are new or whose context changed, and upserts those that differ."""
        normals = {d: self.table("normal", d) for d in self.specs}
        if not all(t.exists() for t in normals.values()):
            return None
        now = {d: t.read() for d, t in normals.items()}
        fact_key = self.normal_keys[self.fact]
        target = self.table("integrated", self.fact)
        if not target.exists():
            return {"version": target.merge(self.integrate(now), fact_key, txn=f"{txn}/integrated")}
        ids = None
        for d in self.specs:
            old = normals[d].read(base[f"normal/{d}"]) if f"normal/{d}" in base else now[d].limit(0)
            keys = self.normal_keys[d]
            moved = changed_rows(now[d], old, keys) if set(now[d].columns) == set(old.columns) else now[d]
            for fact_col, ctx_col in ([(k, k) for k in keys] if d == self.fact else self.context_keys[d].items()):
                hit = affected(now[self.fact], moved.select(F.col(ctx_col).alias(fact_col)), [fact_col]).select(*fact_key)
                ids = hit if ids is None else ids.unionByName(hit)
        again = affected(now[self.fact], ids, fact_key)
        wide = self.integrate({**now, self.fact: again})
        fresh = changed_rows(wide, target.read(), fact_key) if set(wide.columns) == set(target.info().schema.names) else wide
        if fresh.isEmpty():
            return None
        self.table("stage", f"{release}-changed").overwrite(fresh.select(*fact_key))  # what products are refreshed from
        return {"version": target.merge(fresh, fact_key, txn=f"{txn}/integrated")}


def verify(before: DataFrame, incremental: DataFrame, rebuilt: DataFrame, keys: list[str]) -> dict:
    """After a release: no key twice, none lost, and the same rows as a full rebuild."""
    from ..operators.diff import bag_difference
    from ..operators.rules import key_report

    report = key_report(incremental, keys).first().asDict()
    report["lost"] = before.select(*keys).join(incremental.select(*keys), keys, "left_anti").count()
    report["differences"] = bag_difference(incremental, rebuilt).count()
    return report


def sample_release(fact: DataFrame, key: str, share: float, days: int, timestamps: list[str], seed: int = 0) -> DataFrame:
    """A repeatable sample of a fact, moved on by some days: made-up data for the next release."""
    from ..functions.columns import sampled

    shifted = {c: F.col(c) + F.make_dt_interval(F.lit(days)) for c in timestamps}
    return fact.where(sampled(key, share, seed)).withColumns(shifted)


def hour_spine(spark: SparkSession, start: str, hours: int) -> DataFrame:
    return spark.range(hours).select((F.expr(f"timestamp_ntz'{start}'") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("event_hour"))

