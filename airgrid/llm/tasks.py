"""Helpers that run inside tasks: objects a worker keeps between tasks, slices of batches, bounded memos."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from airgrid.session import scratch_path

_KEPT = "_kept_by_this_worker"


def kept(key: tuple, build: Callable):
    """What ``build`` makes, made once per worker process.

    Functions travel with the tasks, so their own module variables do not last; this place does.
    """
    place = sys.modules.setdefault(_KEPT, types.ModuleType(_KEPT))
    found = place.__dict__.setdefault("objects", {})
    if key not in found:
        found[key] = build()
    return found[key]


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds about ``most_bytes`` in each; a longer value stands alone."""
    for batch in batches:
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64())).to_numpy()
        begin = 0
        while begin < batch.num_rows:
            done = int(ends[begin - 1]) if begin else 0
            end = max(begin + 1, int(ends.searchsorted(done + most_bytes, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder, and read from there by all that follows."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Memo(dict):
    """A dict that starts anew when full: its size bounds memory and never changes a result."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def make_room(self, new: int) -> bool:
        """Whether all had to be forgotten for ``new`` entries."""
        full = len(self) + new > self.most
        if full:
            self.clear()
        return full
