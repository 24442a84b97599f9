"""Training features and grid-wide scoring."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.operators import features


def score_grid(grid: DataFrame, inputs: Sequence[str], predict: Callable[[DataFrame], DataFrame],
               keys: Sequence[str] = ("time", "y", "x"), outputs: Sequence[str] | None = None) -> DataFrame:
    """Predict every complete cell of every day in one job; the other cells stay, without predictions.

    Whole and incomplete rows part ways on a filter and are stacked again, so
    the grid is not joined to its own predictions.
    """
    encoded = features.one_hot_month(grid) if any(c in features.MONTHS for c in inputs) else grid
    complete = [F.col(c).isNotNull() for c in inputs]
    whole = complete[0]
    for test in complete[1:]:
        whole = whole & test
    scored = predict(encoded.filter(whole).select(*keys, *inputs))
    names = list(outputs) if outputs else [c for c in scored.columns if c not in keys and c not in inputs]
    rest = encoded.filter(~whole).select(*keys, *[F.lit(None).cast("double").alias(n) for n in names])
    return scored.select(*keys, *names).unionByName(rest)
