"""A versioned store of tables: each save writes a new directory, then swaps a pointer; readers never wait.

Writers take turns, among threads and processes alike: a save removes old versions, and must not meet another's half-written one.
"""

from __future__ import annotations

import fcntl
import json
import os
import shutil
import threading
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SCHEMA_VERSION = 1


class Gate:
    """A lock over threads and processes; its holder may take it again."""

    def __init__(self, path: Path):
        self.path, self._threads, self._depth, self._file = path, threading.RLock(), 0, None

    def __enter__(self) -> Gate:
        self._threads.acquire()
        try:
            if not self._depth:
                self.path.parent.mkdir(parents=True, exist_ok=True)
                self._file = open(self.path, "a")  # noqa: SIM115  closed on leaving
                fcntl.flock(self._file, fcntl.LOCK_EX)
            self._depth += 1
        except BaseException:
            self._threads.release()
            raise
        return self

    def __exit__(self, *_) -> None:
        self._depth -= 1
        if not self._depth:
            self._file.close()
        self._threads.release()


_GATES: dict[Path, Gate] = {}
_NAMING = threading.Lock()


def gate(path: Path) -> Gate:
    """The one gate of a path in this process."""
    with _NAMING:
        return _GATES.setdefault(path, Gate(path))


def _read(path: Path) -> dict:
    try:
        return json.loads(path.read_text())
    except (FileNotFoundError, ValueError):
        return {}


def _replace(path: Path, value: dict) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.parent / f".{uuid.uuid4().hex}"
    part.write_text(json.dumps(value))
    os.replace(part, path)


def clear(directory: str | Path) -> None:
    """Remove all that a store holds but its locks, on which others may wait."""
    for item in Path(directory).iterdir() if Path(directory).is_dir() else ():
        if item.is_dir():
            shutil.rmtree(item, ignore_errors=True)
        elif item.suffix != ".lock":
            item.unlink(missing_ok=True)


class Store:
    def __init__(self, spark: SparkSession, directory: str | Path):
        self.spark, self.directory = spark, Path(directory)

    @property
    def writing(self) -> Gate:
        """Held over all that depends on the current version and replaces it."""
        return gate(self.directory.resolve() / "writer.lock")

    @property
    def _pointer(self) -> Path:
        return self.directory / "current.json"

    def meta(self) -> dict:
        """What the current version says of itself; empty when there is none."""
        return _read(self._pointer)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory.resolve().as_uri()}/{self.meta()['version']}/{name}")

    def has(self, name: str) -> bool:
        return name in self.meta().get("tables", [])

    def save(self, tables: dict[str, DataFrame], **meta) -> None:
        """All tables, then the pointer in one rename. The version before the last goes."""
        with self.writing:
            version, old = uuid.uuid4().hex, self.meta().get("version")
            for name, df in tables.items():
                df.write.parquet(f"{self.directory.resolve().as_uri()}/{version}/{name}")
            self.note(version=version, previous=old, tables=sorted(tables), schema=SCHEMA_VERSION, **meta)
            for d in self.directory.iterdir():
                if d.is_dir() and d.name not in (version, old):
                    shutil.rmtree(d, ignore_errors=True)

    def note(self, **meta) -> None:
        """Add to what the store says of itself."""
        with self.writing:
            _replace(self._pointer, self.meta() | meta)

    def clear(self) -> None:
        with self.writing:
            clear(self.directory)

    # The watcher's lease lies beside the pointer, under a lock of its own, so that no reconcile delays a heartbeat.

    @property
    def leasing(self) -> Gate:
        return gate(self.directory.resolve() / "watch.lock")

    def watcher(self) -> dict:
        """pid, token and beat (epoch seconds) of the process that watches; empty when none does."""
        return _read(self.directory / "watch.json")

    def set_watcher(self, watcher: dict) -> None:
        _replace(self.directory / "watch.json", watcher)
