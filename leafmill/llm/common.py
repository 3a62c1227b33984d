"""Helpers that the training-data operators share: written tables, shipped files and the state of Python workers."""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

from leafmill.sources.staged import new_path, written

__all__ = ["new_path", "shipped_file", "worker_state", "written"]

_held: dict[str, Any] = {}


def shipped_file(spark: SparkSession, path: str):
    """A broadcast of ``(digest, content)`` of one vocabulary file, which is a few MB whatever the data."""
    with open(path, "rb") as f:
        content = f.read()
    return spark.sparkContext.broadcast((hashlib.sha256(content).hexdigest(), content))


def worker_state(owner: str, key: Any, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between tasks, one thing at a time.

    Asking for another owner or key drops what was held, so that nothing of one operator stays in the
    memory of workers that go on with the next. Results never depend on it.
    """
    if _held.get("for") != (owner, key):
        _held.clear()
        gc.unfreeze()
        gc.collect()
        _held.update({"for": (owner, key), "state": make()})
    return _held["state"]
