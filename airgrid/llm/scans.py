"""Running sums within a key over rows sorted by key, however many rows a key has.

Rows lie in sorted ranges.  Each range is sorted, summed by itself and written in one pass; the driver carries the sum of a
key that goes on into the next range (two rows a range), and what a range is carried is added where its rows are read.  A
key may span many ranges, so no task holds more than its range, and nothing is shuffled after the sort.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.llm.tasks import stored

LED, FIRST, LAST, ENDS = 1, 2, 4, 8  # marks of a row: has the key its range begins with; first, last of its range; last of its key there


def in_order(df: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """``df`` in ranges of ``key``, then ``order``, each range sorted; ``key`` must not be null."""
    by = [F.col(key), *[F.col(c) if isinstance(c, str) else c for c in order]]
    return df.repartitionByRange(*by).sortWithinPartitions(*by)


def wrapped(a: Column, b: Column, one_more: int = 0) -> Column:
    """``a + b + one_more`` in 64 bits that wrap around, where a plain sum is an error; a - b is ``wrapped(a, ~b, 1)``."""
    low = a.bitwiseAND(0xFFFFFFFF) + b.bitwiseAND(0xFFFFFFFF) + F.lit(one_more)
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(0xFFFFFFFF))


def _running(keys: np.ndarray, values: np.ndarray, carry: tuple[int, int]) -> np.ndarray:
    """Sums of ``values`` within runs of equal keys, wrapping at 64 bits; ``carry`` is (key, sum) of the rows before."""
    total = np.cumsum(values)
    starts = np.maximum.accumulate(np.where(np.r_[True, keys[1:] != keys[:-1]], np.arange(len(keys)), 0))
    out = total - (total - values)[starts]
    return out + np.where(starts == 0, carry[1], 0) if keys[0] == carry[0] else out


def with_sums(ordered: DataFrame, key: str, sums: dict[str, Column | Callable[[pa.RecordBatch], np.ndarray]], last: str | None = None,
              write: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``ordered``, sorted as by ``in_order``, with running sums within ``key``: this row and those before it.

    Sums are 64-bit and wrap around.  What is summed up is worked out row by row from the sorted rows: a column, or a function
    of a batch, whose values are kept as ``_`` and the sum's name.  ``last`` names a column that tells whether a row is its
    key's last one.  The result is written once: as Parquet, whose ranges are read in any order, or by ``write``, which keeps
    them in order (``materialise``) so that they can be summed again.
    """
    names, worked = list(sums), {n: f for n, f in sums.items() if callable(f)}
    kept = ordered.columns
    given_out = [*kept, *[f"_{n}" for n in worked]]
    columns = [c.cast("bigint").alias(n) for n, c in sums.items() if n not in worked]
    rows = ordered.select(*kept, *columns).withColumn("_range", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, before, waiting = None, (None, [0] * len(names)), None

        def done(batch: pa.RecordBatch, keys: np.ndarray, now: list[np.ndarray], begins: bool, following: int | None) -> pa.RecordBatch:
            marks = np.where(keys == first, LED, 0) + np.where(np.r_[keys[1:] != keys[:-1], following is None or following != keys[-1]], ENDS, 0)
            marks[0] += FIRST * begins
            marks[-1] += LAST * (following is None)
            columns = [*[batch.column(c) for c in given_out], *map(pa.array, now), batch.column("_range"), pa.array(marks.astype(np.int8))]
            return pa.RecordBatch.from_arrays(columns, [*given_out, *names, "_range", "_mark"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy()
            begins, first = first is None, keys[0] if first is None else first
            for n, f in worked.items():
                batch = batch.append_column(f"_{n}", pa.array(f(batch), pa.int64()))
            now = [_running(keys, batch.column(f"_{n}" if n in worked else n).to_numpy(), (before[0], s)) for n, s in zip(names, before[1])]
            before = keys[-1], [x[-1] for x in now]
            if waiting:
                yield done(*waiting, keys[0])
            waiting = batch, keys, now, begins
        if waiting:
            yield done(*waiting, None)

    schema = ", ".join([f"`{c}` {t}" for c, t in ordered.dtypes] + [f"`{n}` bigint" for n in [*given_out[len(kept):], *names]])
    alone = rows.mapInArrow(run, f"{schema}, _range int, _mark tinyint")
    alone = write(alone) if write else stored(alone, "sums")

    edge = F.col("_mark").cast("int")
    edges = alone.filter(edge.bitwiseAND(FIRST | LAST) > 0).select("_range", edge.alias("_mark"), F.col(key).alias("_key"), *names).collect()
    firsts, ends = ({r["_range"]: r for r in edges if r["_mark"] & at} for at in (FIRST, LAST))
    ranges = sorted(ends)
    carried, before = [], (None, [0] * len(names))
    for r, after in zip(ranges, [*ranges[1:], None]):
        given = before[1] if firsts[r]["_key"] == before[0] else [0] * len(names)
        carried.append((r, after is not None and firsts[after]["_key"] == ends[r]["_key"], *given))
        # a range of one key alone adds to what it was given
        own, led = ends[r], ends[r]["_mark"] & LED
        before = own["_key"], [(own[n] + s + (1 << 63)) % (1 << 64) - (1 << 63) if led else own[n] for n, s in zip(names, given)]
    given = [f"_given{k}" for k in range(len(names))]
    kinds = pa.schema([("_range", pa.int32()), ("_goes_on", pa.bool_()), *[(g, pa.int64()) for g in given]])
    table = pa.Table.from_arrays([pa.array([c[k] for c in carried], f.type) for k, f in enumerate(kinds)], schema=kinds)
    joined = alone.join(F.broadcast(alone.sparkSession.createDataFrame(table)), "_range")
    summed = [F.when(edge.bitwiseAND(LED) > 0, wrapped(F.col(n), F.col(g))).otherwise(F.col(n)).alias(n) for n, g in zip(names, given)]
    is_last = (edge.bitwiseAND(ENDS) > 0) & ~((edge.bitwiseAND(LAST) > 0) & F.col("_goes_on"))
    return joined.select(*given_out, *summed, *([is_last.alias(last)] if last else []))
