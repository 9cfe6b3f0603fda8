"""Helpers the operators of this package share."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def worker_state(name: str, make: Callable[[], Any]) -> Any:
    """A value kept for the life of a Python worker, so that tasks run one after another share it."""
    box = sys.modules.setdefault("_corpus_worker_state", types.ModuleType("_corpus_worker_state"))
    if not hasattr(box, name):
        setattr(box, name, make())
    return getattr(box, name)


def give_back() -> None:
    """Return the memory a task has freed to the system: a worker that waits for its next task would keep it."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library
