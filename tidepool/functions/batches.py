"""Whole contents in Python workers: small Arrow batches, and values that are read where they lie."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of contents after which an Arrow batch is closed. A batch of 10,000 rows, as otherwise, may hold 64 MB, and a task
#: holds some batches, what is made of them, and both forms of each.
BATCH = "4m"


def bounded() -> None:
    """Sets the session's bytes for an Arrow batch; a longer value is alone in its batch."""
    SparkSession.active().conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def buffers(values: pa.Array) -> Iterator[pa.Buffer | None]:
    """The values' bytes without copies; None for null."""
    return (x.as_buffer() for x in values)


def trim() -> None:
    """Gives freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
