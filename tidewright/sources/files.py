"""Files on the driver's side: discovery, the registry of what has been read, checksums, small state and report files."""

from __future__ import annotations

import csv
import hashlib
import json
import os
import shutil
from collections.abc import Iterable
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame

CHECKSUM_LIMIT = 10 << 20


@dataclass(frozen=True)
class FileState:
    path: str
    size: int
    mtime_ns: int
    checksum: str | None = None


def discover(source: str, kind: str) -> list[str]:
    """Files of a glob, of a folder (those with the format's suffix), or a single file; sorted. None: FileNotFoundError."""
    p = Path(source)
    if any(c in source for c in "*?["):
        found = [f for f in Path(p.anchor or ".").glob(str(p.relative_to(p.anchor) if p.anchor else p)) if f.is_file()]
    elif p.is_dir():
        found = [f for f in p.iterdir() if f.suffix == f".{kind}"]
    else:
        found = [p] if p.is_file() else []
    if not found:
        raise FileNotFoundError(f"no {kind} file at {source}")
    return sorted(map(str, found))


def state_of(path: str, checksum_limit: int = CHECKSUM_LIMIT) -> FileState:
    """A file's size and time, and its SHA-256 if it is not larger than the limit."""
    st = os.stat(path)
    return FileState(path, st.st_size, st.st_mtime_ns, sha256(path) if st.st_size <= checksum_limit else None)


def sha256(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


class Registry:
    """Which files have been read, in a JSON file; written after the data are."""

    def __init__(self, path: str):
        self.path = Path(path)
        self.seen = {k: FileState(**v) for k, v in load_json(path, {}).items()}

    def pending(self, paths: Iterable[str]) -> list[FileState]:
        """Unknown files, and known ones whose size, time or (where both are known) checksum differs."""
        out = []
        for p in paths:
            now, old = state_of(p), self.seen.get(p)
            if old is None or old.size != now.size or (old.mtime_ns != now.mtime_ns and not (old.checksum and old.checksum == now.checksum)) or (old.checksum and now.checksum and old.checksum != now.checksum):
                out.append(now)
        return out

    def record(self, states: Iterable[FileState]) -> None:
        self.seen |= {s.path: s for s in states}
        save_json(self.path, {k: asdict(v) for k, v in sorted(self.seen.items())})


def load_json(path: str | Path, default=None):
    try:
        return json.loads(Path(path).read_text())
    except FileNotFoundError:
        if default is None:
            raise
        return default


def save_json(path: str | Path, value) -> None:
    """Readers see the old file or the new one, never a part."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    tmp = path.with_name(f".{path.name}.{os.getpid()}")
    tmp.write_text(json.dumps(value, indent=2, sort_keys=True, default=str))
    os.replace(tmp, path)


def save_csv(path: str | Path, rows: list[dict]) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="") as f:
        out = csv.DictWriter(f, list(rows[0]) if rows else [])
        out.writeheader()
        out.writerows(rows)


def write_single(df: DataFrame, path: str, kind: str = "parquet") -> str:
    """A small frame as one file of the given name."""
    folder = f"{path}.parts"
    writer = df.coalesce(1).write.mode("overwrite")
    (writer.option("header", "true").csv if kind == "csv" else writer.parquet)(folder)
    part = next(Path(folder).glob(f"part-*.{kind}"))
    os.replace(part, path)
    shutil.rmtree(folder)
    return path
