"""Where operators put what must outlive an executor, the size of what Python workers get at once, and what they hold between tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import SparkSession

from ..sources.shared import discard, place, shared_dir, stash

__all__ = ["discard", "lean", "place", "shared_dir", "slim_batches", "stash"]

#: The session's bounds on Arrow batches.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def slim_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a Python worker's memory doesn't follow the length of texts.

    Spark takes these bounds from the session when a plan runs, so the
    operators lower them there (smaller ones stay) and never set them back.
    """
    for key, most in BATCH.items():
        now = spark.conf.get(key).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


#: Fixed values of malloc.h: arrays from 1 MB on are mapped one by one, so that they go back to the system when they are freed.
M_MMAP_THRESHOLD, MAPPED = -3, 1 << 20


def lean(rows: Callable) -> Callable:
    """rows, for mapInArrow, in a worker that gives freed memory back: Spark keeps its workers, so what one stage's holds in free lists stands beside the executor's heap in all later ones."""

    def run(batches):
        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(M_MMAP_THRESHOLD, MAPPED)
        try:
            yield from rows(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return run
