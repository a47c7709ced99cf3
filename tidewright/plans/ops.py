"""Operations: the run log, schema events, and the views over them."""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..specs import SchemaContract

log = logging.getLogger(__name__)
RUNS = "run_id string, parent_run_id string, release_id string, dataset_name string, layer string, operation string, status string, started_at timestamp, finished_at timestamp, duration_ms bigint, records_read bigint, records_written bigint, records_rejected bigint, validation_failures bigint, files_read int, schema_version int, table_version bigint, application_id string, error_type string, error_message string, details_json string"
EVENTS = "event_id string, dataset_name string, old_version int, new_version int, change_type string, added string, removed string, retyped string, n_columns int, compatible boolean, run_id string, observed_at timestamp"
VIEWS = {
    "failures_by_dataset": "SELECT dataset_name, coalesce(sum(validation_failures), 0) AS validation_failures, coalesce(sum(records_rejected), 0) AS records_rejected, count(*) AS n_runs FROM {log} GROUP BY dataset_name",
    "time_by_dataset": "SELECT dataset_name, cast(sum(duration_ms) AS double) / count(*) AS mean_ms, max(duration_ms) AS max_ms, min(duration_ms) AS min_ms, count(*) AS n_runs FROM {log} WHERE status = 'SUCCESS' GROUP BY dataset_name",
    # runs without rejects stay, so that a share can be taken
    "rejects_by_run": "SELECT run_id, parent_run_id, release_id, started_at, dataset_name, records_read, records_rejected, validation_failures, status FROM {log} WHERE operation = 'dataset_update' AND status = 'SUCCESS' ORDER BY started_at, dataset_name",
    "time_trend": "SELECT date_format(started_at, 'yyyy-MM-dd') AS day, dataset_name, cast(sum(duration_ms) AS double) / count(*) AS mean_ms, count(*) AS n_runs FROM {log} WHERE status = 'SUCCESS' GROUP BY 1, 2",
    "schema_history": "SELECT dataset_name, old_version, new_version, change_type, n_columns FROM {log}",
}


def view(spark: SparkSession, name: str, frame: DataFrame) -> DataFrame:
    """One of the monitoring views over a run log or an event log."""
    return spark.sql(VIEWS[name], log=frame)


def run_row(operation: str, status: str, dataset: str | None = None, run_id: str | None = None, started: datetime | None = None, **more) -> dict:
    """A row of the run log; what is not given is null."""
    names = [f.split(" ")[0] for f in RUNS.split(", ")]
    if unknown := set(more) - set(names) - {"details"}:
        raise ValueError(f"no such fields of a run: {sorted(unknown)}")
    now = datetime.now(UTC)
    row = dict.fromkeys(names) | {"run_id": run_id or str(uuid.uuid4()), "operation": operation, "status": status, "dataset_name": dataset, "started_at": started or now, "finished_at": now}
    row["duration_ms"] = int((row["finished_at"] - row["started_at"]).total_seconds() * 1000)
    row["details_json"] = json.dumps(more.pop("details"), sort_keys=True) if "details" in more else None
    return row | more


def child_id(parent: str, dataset: str, stage: str) -> str:
    """The same id for the same part of a run, however often it is attempted."""
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"{parent}/{dataset}/{stage}"))


def runs_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r[f.split(" ")[0]] for f in RUNS.split(", ")) for r in rows], RUNS)


def release_rows(release: str, parts: list[dict], status: str, started: datetime) -> list[dict]:
    """A parent row with the totals of its parts, and the parts; skipped parts do not count."""
    parent = run_row("release", status, run_id=child_id(release, "*", "release"), started=started, release_id=release)
    counted = [p for p in parts if p["status"] != "SKIPPED"]
    for k in ("records_read", "records_written", "records_rejected", "validation_failures"):
        parent[k] = sum(p.get(k) or 0 for p in counted)
    return [parent, *({**p, "parent_run_id": parent["run_id"], "release_id": release} for p in parts)]


def schema_event(dataset: str, old: SchemaContract, new: SchemaContract, run_id: str | None = None) -> dict:
    """What changes between two versions; once per dataset and version, as the id follows from them."""
    d = old.diff(new)
    kind = "TYPE_CHANGE" if d["retyped"] else "REMOVE" if d["removed"] else "ADD" if d["added"] else "NONE"
    return {"event_id": child_id(dataset, str(old.version), str(new.version)), "dataset_name": dataset, "old_version": old.version, "new_version": new.version, "change_type": kind, "added": ",".join(d["added"]), "removed": ",".join(d["removed"]), "retyped": ",".join(d["retyped"]), "n_columns": sum(map(len, d.values())), "compatible": not d["removed"] and not d["retyped"], "run_id": run_id, "observed_at": datetime.now(UTC)}


def events_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r[f.split(" ")[0]] for f in EVENTS.split(", ")) for r in rows], EVENTS)


def best_effort(fn: Callable) -> Callable:
    """Monitoring must not fail the work it watches: errors are logged."""

    @wraps(fn)
    def call(*a, **k):
        try:
            return fn(*a, **k)
        except Exception:
            log.exception("monitoring failed in %s", fn.__name__)
            return None

    return call


@best_effort
def record(table, spark: SparkSession, rows: list[dict], txn: str | None = None) -> int | None:
    """Appends rows to the run log, a snapshot table; the same transaction is applied once."""
    return table.append(runs_frame(spark, rows), txn=txn)


@best_effort
def record_schema_change(table, spark: SparkSession, dataset: str, old: SchemaContract, new: SchemaContract, run_id: str | None = None) -> int | None:
    """Adds the event of a new contract version; a known one is left as it is."""
    return table.merge(events_frame(spark, [schema_event(dataset, old, new, run_id)]), ["event_id"], update=False)
