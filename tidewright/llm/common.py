"""Helpers that the corpus operators share: rows in bounded slices, tables in the shared folder, worker code paths."""

from __future__ import annotations

import atexit
import gc
import os
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: what lies between ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SLICE_BYTES = 4 << 20
_ROOT = str(Path(__file__).resolve().parents[2])
_fallback: list[str] = []


#: Bytes of one Arrow batch to a worker: the whole batch lies in the executor and the worker before it is sliced.
BATCH_BYTES = 4 << 20
#: What a worker keeps for an operator between tasks, by module: how to let go of it.
RELEASES: dict[str, Callable[[], None]] = {}
_owner = [""]


def take_over(owner: str) -> None:
    """Called in a worker by the operator that runs: what other operators have kept there goes."""
    if _owner[0] != owner:
        for name, release in RELEASES.items():
            if name != owner:
                release()
        gc.collect()
        _owner[0] = owner


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package when only the driver's sys.path holds it, and bounds their batches by bytes.

    The bound is set for the session, and only lowered: a frame is run after its operator has returned, so it can't be
    put back here. It changes no result.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *parts])


def map_rows(df: DataFrame, columns: list[str], fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Applies ``fn`` to slices of about ``slice_bytes`` of ``columns``; one row is the least a slice can hold.

    A worker holds one Arrow batch (BATCH_BYTES, or one row that is longer) and what ``fn`` makes of a slice.
    """
    ship(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over(fn.__module__)
        for batch in batches:
            for part in slices(batch, slice_bytes):
                out = fn(part)
                if out is None:
                    continue
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.select(*columns).mapInArrow(run, schema)


def free_name(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column of the frame has."""
    while name in df.columns:
        name = f"_{name}"
    return name


def add_columns(df: DataFrame, column: str, fn: Callable[[list], list[pa.Array]], fields: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """All rows and columns of ``df`` in place, with what ``fn`` makes of ``column``'s values as further columns."""
    ship(df.sparkSession)
    at, names = df.columns.index(column), [f.split(" ")[0] for f in fields.split(", ")]
    schema = T.StructType([*df.schema.fields, *T._parse_datatype_string(fields).fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over(fn.__module__)
        for batch in batches:
            for part in slices(batch, slice_bytes):
                yield pa.RecordBatch.from_arrays([*part.columns, *fn(part.column(at).to_pylist())], [*part.schema.names, *names])

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, slice_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    n = batch.num_rows
    if not n:
        return
    sizes = [64] * n
    for col in batch.columns:
        if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) or pa.types.is_binary(col.type):
            sizes = [a + (b or 0) for a, b in zip(sizes, pc.binary_length(col).to_pylist())]
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > slice_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    yield batch.slice(start, n - start)


#: Cells of ids that are broadcast, at most so many rows.
CELLS = 1 << 18


def may_hold(rows: DataFrame, ids: DataFrame, id_col: str, wanted: bool = True) -> DataFrame:
    """The rows whose id falls into a cell of ``ids`` (or, if not wanted, the others): all columns, no shuffle of rows.

    Spares a join by id the other rows while ids are few; where they fill all cells, it spares nothing and loses nothing.
    """
    name = free_name(rows, "_cell")
    cells = ids.select(F.pmod(F.xxhash64(id_col), F.lit(CELLS)).alias(name)).distinct()
    marked = rows.withColumn(name, F.pmod(F.xxhash64(id_col), F.lit(CELLS)))
    return marked.join(F.broadcast(cells), name, "left_semi" if wanted else "left_anti").drop(name)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a local session gets one of its own; a cluster is an error."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _fallback:
        _fallback.append(tempfile.mkdtemp(prefix="tidewright-"))
        atexit.register(shutil.rmtree, _fallback[0], ignore_errors=True)
    return "file://" + _fallback[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet to the shared folder and reads it back.

    The files outlive any executor. They go when the process ends or ``drop_written`` is called.
    """
    return _write(df, name)[0]


def _write(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidewright/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _paths[path] = spark
    return spark.read.schema(df.schema).parquet(path), path


_paths: dict[str, SparkSession] = {}


class Scratch:
    """The written tables of one run of an operator, so that each can go as soon as its last reader is written."""

    def __init__(self) -> None:
        self.paths: dict[str, str] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        out, self.paths[name] = _write(df, name)
        return out

    def drop(self, *names: str) -> None:
        """Deletes these tables, and the shuffle files of ended jobs."""
        paths = [self.paths.pop(n) for n in names]
        spark = _paths[paths[0]]
        for path in paths:
            _delete(path)
        let_go(spark)


def let_go(spark: SparkSession) -> None:
    """Shuffle files of ended jobs go with the driver's garbage, so that is collected: twice, as listeners may lag behind."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def _delete(path: str) -> None:
    spark = _paths.pop(path)
    jvm = spark.sparkContext._jvm
    if jvm is not None:  # else the session has ended; its folder is gone or is cleaned by the cluster
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written_tables() -> list[str]:
    """The paths of the tables that ``written`` has left, oldest first."""
    return list(_paths)


def drop_written(keep: int = 0, before: list[str] | None = None) -> None:
    """Deletes the tables of ``written``, the newest ``keep`` and those in ``before`` excepted."""
    paths = [p for p in _paths if p not in (before or ())]
    for path in paths[: len(paths) - keep]:
        _delete(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
