"""Watching a tree: a file stream wakes a full reconcile; a lease keeps one watcher."""

from __future__ import annotations

import os
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from inkwell.config import Config
from inkwell.errors import InkwellError
from inkwell.tree import Tree

HEARTBEAT_S, STALE_S, DEBOUNCE_MS = 5, 15, 200


def lease(tree: Tree, force: bool = False) -> str:
    """Take the lease, unless another watcher's heartbeat is fresh; the token that shows whose it is."""
    with tree.store.leasing:
        held = tree.store.watcher()
        if not force and held and time.time() - held["beat"] < STALE_S:
            raise InkwellError("WATCH_ACTIVE", f"a watcher (pid {held['pid']}) is active; use force to take over")
        token = uuid.uuid4().hex
        tree.store.set_watcher({"pid": os.getpid(), "token": token, "beat": time.time()})
        return token


def beat(tree: Tree, token: str) -> bool:
    """Renew the lease; False if another watcher has taken it over."""
    with tree.store.leasing:
        held = tree.store.watcher()
        if held.get("token") != token:
            return False
        tree.store.set_watcher(held | {"beat": time.time()})
        return True


def release(tree: Tree, token: str) -> None:
    with tree.store.leasing:
        if tree.store.watcher().get("token") == token:
            tree.store.set_watcher({})


def watch(cfg: Config, spark: SparkSession, emit: Callable[[dict], None] = print, *, force: bool = False, seconds: float | None = None):
    """Reconcile at each change until stopped, taken over, or for so many seconds. Errors are told, and don't stop it.

    New and newly dated files come through Spark's file stream. It never reports deletions or edits that keep a name,
    so each wake-up, and each heartbeat without one, lists the tree again: a listing that differs in nothing is cheap.
    The heartbeat has a thread of its own, so a long reconcile keeps the lease.
    """
    tree = Tree(cfg, spark)
    token, over, stream = lease(tree, force), threading.Event(), None

    def keep() -> None:
        while not over.wait(HEARTBEAT_S):
            if not beat(tree, token):
                emit({"event": "lease-lost"})
                over.set()

    def reconcile() -> None:
        # The stream's thread and this function's take turns, so that each change is told once.
        with tree.store.writing:
            before = tree.store.meta().get("version")
            try:
                tree.open()
                meta = tree.store.meta()
                if meta.get("version") != before:
                    emit({"event": "reconciled", "parsed": meta.get("parsed"), "total": meta.get("total"), "warnings": tree.warnings})
            except Exception as e:  # noqa: BLE001  told, not raised: the next change may mend it
                emit({"event": "reconcile-error", "message": str(e)})

    beats = threading.Thread(target=keep, daemon=True)
    beats.start()
    try:
        tree.open()
        emit({"event": "started", "total": tree.store.meta().get("total")})
        files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        files = files.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(cfg.base.as_uri()).select("path")
        stream = files.writeStream.trigger(processingTime=f"{DEBOUNCE_MS} milliseconds").foreachBatch(lambda batch, _: reconcile()).start()
        began = time.time()
        while not over.is_set() and (seconds is None or time.time() - began < seconds):
            left = HEARTBEAT_S if seconds is None else min(HEARTBEAT_S, began + seconds - time.time())
            if not over.wait(max(0.0, left)):
                reconcile()
    except KeyboardInterrupt:
        pass
    finally:
        over.set()
        if stream is not None:
            stream.stop()
        beats.join()
        release(tree, token)
