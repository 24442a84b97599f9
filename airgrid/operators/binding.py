"""Columns worked out once, and joins to tables that may be small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.session import materialise

BROADCAST_CELLS = 2_000_000  # about 16 MB of doubles


def with_bound(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` for long formulas.

    A projected expression is copied into every filter and join key built on it.
    A generator's output is not, so a one-row ``inline`` keeps the formula in
    one place and inside whole-stage codegen.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))


def if_small(small: DataFrame, weight: Column | None = None) -> DataFrame:
    """``small`` marked for broadcast if it is counted to be small enough, else as it is.

    A table with one row per group is often tiny beside the table it is joined
    to, but the planner cannot tell and would shuffle the large one on a handful
    of group keys.  The table is written once and its cells counted; past the
    limit the join stays an ordinary shuffled one, whose skewed partitions AQE
    splits.  ``weight`` is the number of cells of a row when rows hold arrays.
    """
    kept = materialise(small)
    per_row = weight if weight is not None else F.lit(len(small.columns))
    cells = kept.agg(F.sum(per_row)).first()[0] or 0
    return F.broadcast(kept) if cells <= BROADCAST_CELLS else kept
