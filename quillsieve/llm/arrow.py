"""Small helpers for functions that run on Arrow batches inside tasks."""

from __future__ import annotations

import ctypes
import ctypes.util
import sys
import types
from collections.abc import Callable, Iterator
from functools import cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

#: Code points of text that are worked on at once; a longer text is a slice of its own.
SLICE_CHARS = 2_000_000
SLICE_ROWS = 2_000


def worker_memo(name: str) -> dict:
    """A dict that lives as long as the Python worker, so tasks that follow each other in it share what they know.

    Only for values that can be made again at any time. Whoever fills it bounds it.
    """
    box = sys.modules.setdefault("_quillsieve_worker_memo", types.ModuleType("_quillsieve_worker_memo"))
    return vars(box).setdefault(name, {})


@cache
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(ctypes.util.find_library("c") or None), "malloc_trim", None)


def give_back() -> None:
    """Hands memory that a task no longer uses back to the system: workers live on beside those of later stages."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


def slices(batch: pa.RecordBatch, text_at: int = 1, most: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch with bounded text, each with its texts as strings (null as the empty text)."""
    column = batch.column(text_at)
    ends = pa.compute.cumulative_sum(pa.compute.fill_null(pa.compute.binary_length(column), 0).cast("int64"))
    start, n, done = 0, batch.num_rows, 0
    sizes = ends.to_pylist()
    while start < n:
        stop = start + 1
        while stop < n and stop - start < SLICE_ROWS and sizes[stop] - done <= most:
            stop += 1
        part = batch.slice(start, stop - start)
        yield part, [t or "" for t in part.column(text_at).to_pylist()]
        done, start = sizes[stop - 1], stop


def map_texts(df: DataFrame, columns: list, work: Callable[[], Callable[..., dict[str, Any]]], schema: str) -> DataFrame:
    """``columns`` (an id, then a text, then others) through a function of (texts, part) that gives output columns.

    ``work`` is called once per task and returns that function; the id column is passed on under its own name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = work()
        for batch in batches:
            for part, texts in slices(batch):
                yield pa.RecordBatch.from_pydict({batch.schema.names[0]: part.column(0)} | step(texts, part))
        give_back()

    return df.select(*columns).mapInArrow(run, schema)
