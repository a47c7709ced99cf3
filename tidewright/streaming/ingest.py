"""File ingestion on Structured Streaming, and event-time windows.

New files of a folder are read once: the checkpoint remembers them, and each micro-batch is committed to a snapshot
table under its batch id, so that a batch that is replayed after a crash adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.contracts import check_columns, strict_cast, with_lineage
from ..sources.contracts import renamed as rename_columns
from ..sources.snapshot import SnapshotTable
from ..specs import DatasetSpec


def ingest(spark: SparkSession, spec: DatasetSpec, folder: str, raw: SnapshotTable, rejected: SnapshotTable, checkpoint: str, version: int | None = None, run_id: str = "stream", available_now: bool = True) -> dict:
    """Reads the files that are new in ``folder`` into the raw table; rows that do not cast go to the rejected table.

    Returns the rows that were accepted and rejected. A changed file under an old name is not seen by a stream; the
    registry in ``sources.files`` is for folders in which that happens.
    """
    contract = spec.contract(version)
    reader = spark.readStream.format(contract.format).schema(contract.struct(as_text=contract.format == "csv")).option("pathGlobFilter", f"*.{contract.format}")
    if contract.format == "csv":
        reader = reader.option("header", "true").option("enforceSchema", "false").options(**contract.options)
    source = reader.load(folder).select("*", F.col("_metadata.file_path").alias("_source_file"), F.col("_metadata.file_size").alias("_source_file_size"), F.col("_metadata.file_modification_time").alias("_source_modified_time"))
    counts = {"accepted": 0, "rejected": 0}

    def commit(batch: DataFrame, batch_id: int) -> None:
        check_columns([c for c in batch.columns if not c.startswith("_")], contract)
        good, bad = strict_cast(batch, contract) if contract.format == "csv" else (batch, None)
        rows = with_lineage(rename_columns(good, dict(contract.rename)), spec.name, contract.version, f"{run_id}-{batch_id}")
        for name, table, df in (("accepted", raw, rows), ("rejected", rejected, bad)):
            if df is not None:
                before = table.info().rows if table.exists() else 0
                if table.append(df.drop("_failures"), txn=f"{spec.name}/{checkpoint}/{batch_id}/{name}") is not None:
                    counts[name] += table.info().rows - before

    writer = source.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if available_now else writer).start()
    query.awaitTermination()
    return counts


def windowed(events: DataFrame, ts: str, keys: list[str], size: str, slide: str | None = None, late: str = "1 hour", value: str | None = None) -> DataFrame:
    """Counts (and sums) by tumbling or sliding window, for batches and streams alike; rows later than ``late`` are dropped by streams."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    aggs = [F.count("*").alias("n"), *([F.sum(value).alias("total")] if value else [])]
    return rows.groupBy(w.alias("w"), *keys).agg(*aggs).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", *(["total"] if value else []))


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of a key: rows no further apart than the gap."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def drain(stream: DataFrame, table: SnapshotTable, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda x: x, mode: str = "append") -> None:
    """Runs a stream over what is there and adds each batch to a table once."""
    def commit(batch: DataFrame, batch_id: int) -> None:
        table.append(transform(batch), txn=f"{checkpoint}/{batch_id}")

    stream.writeStream.outputMode(mode).foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
