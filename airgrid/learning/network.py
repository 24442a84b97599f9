"""A multi-layer perceptron trained data-parallel."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.learning.base import Supervised, feature_means, summed
from airgrid.learning.forest import matrix, training_rows
from airgrid.learning.growing import mixed
from airgrid.session import materialise

BATCHES = 256  # parts that rows are dealt into; a step takes one or several
LOCAL_BYTES = 128 << 20  # of inputs and labels that one task trains on; of those of all networks side by side, twice as many
AT_ONCE = 1024  # rows of a gradient that are worked out together
PACKED_ROWS = 1 << 18  # that are cut by batch at a time
PART_ROWS = 8192  # of a batch, times networks, that are worth a task
LAST = (1 << 63) - 1


def unpack(flat: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights and offsets of each layer, as views of one vector."""
    out, at = [], 0
    for a, b in zip(layers, layers[1:]):
        out.append((flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


def forward(z: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Outputs of every layer, rectified but for the last."""
    outputs = [z]
    for k, (w, b) in enumerate(parts):
        z = z @ w
        z += b
        if k < len(parts) - 1:
            np.maximum(z, 0.0, out=z)
        outputs.append(z)
    return outputs


def gradient_sum(z: np.ndarray, y: np.ndarray, flat: np.ndarray, layers: list[int]) -> np.ndarray:
    """Gradient of half the squared error, summed over the rows; ``AT_ONCE`` rows at a time stay in the processor's cache."""
    parts, total = unpack(flat, layers), np.zeros(len(flat))
    grads = unpack(total, layers)
    for a in range(0, len(z), AT_ONCE):
        outputs = forward(z[a:a + AT_ONCE], parts)
        delta = (outputs[-1][:, 0] - y[a:a + AT_ONCE])[:, None]
        for k in range(len(parts) - 1, -1, -1):
            (w, _), (pull, offset) = parts[k], grads[k]
            pull += outputs[k].T @ delta
            offset += delta.sum(axis=0)
            if k:
                delta = delta @ w.T
                delta *= outputs[k] > 0
    return total


def decay(flat: np.ndarray, layers: list[int]) -> np.ndarray:
    """The weights that the penalty pulls at: all but the offsets."""
    out = np.zeros_like(flat)
    for (w, _), (kept, _) in zip(unpack(flat, layers), unpack(out, layers)):
        kept[...] = w
    return out


@dataclass(frozen=True)
class Task:
    """One network to train: on the rows outside ``fold`` with an id of at most ``upto``."""

    number: int
    fold: int
    upto: int
    layers: tuple[int, ...]
    alpha: float
    step: float
    patience: int
    epochs: int
    per_epoch: int  # steps, a power of two
    seed: int


class Adam:
    """The weights of one task on their way, and when to stop."""

    def __init__(self, task: Task):
        self.task = task
        draw, parts = np.random.default_rng(task.seed), []
        for a, b in zip(task.layers, task.layers[1:]):
            bound = np.sqrt(6.0 / (a + b))
            parts.append(draw.uniform(-bound, bound, a * b + b))
        self.flat = np.concatenate(parts)
        self.first, self.second, self.steps = np.zeros_like(self.flat), np.zeros_like(self.flat), 0
        self.best, self.best_flat, self.waited, self.epochs = np.inf, self.flat, 0, 0

    def take(self, gradient: np.ndarray, n: float) -> None:
        if not n:
            return
        g = (gradient + self.task.alpha * decay(self.flat, list(self.task.layers))) / n
        self.steps += 1
        self.first = 0.9 * self.first + 0.1 * g
        self.second = 0.999 * self.second + 0.001 * g * g
        self.flat = self.flat - self.task.step * (self.first / (1 - 0.9**self.steps)) / (np.sqrt(self.second / (1 - 0.999**self.steps)) + 1e-8)

    def over(self, loss: float) -> bool:
        """Whether the loss on the rows put aside has stopped falling; called once an epoch."""
        self.epochs += 1
        if loss < self.best - 1e-4:
            self.best, self.best_flat, self.waited = loss, self.flat, 0
        else:
            self.waited += 1
        return self.waited > self.task.patience or self.epochs >= self.task.epochs


def scaled(x: np.ndarray, y: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and label by their means and deviations (``stats``: two rows, the label last)."""
    return (x - stats[0, :-1]) / stats[1, :-1], (y - stats[0, -1]) / stats[1, -1]


def statistics(rows: DataFrame, tasks: Sequence[Task], center: np.ndarray) -> np.ndarray:
    """(task, 2, features + 1): means and deviations of what each task learns from, in one pass; and their number of rows."""
    size = len(center) + 1

    def partial(batches: Iterator[pd.DataFrame]) -> np.ndarray:
        total = np.zeros((len(tasks), 2 * size + 1))
        for pdf in batches:
            if pdf.empty:
                continue
            z = np.column_stack([np.stack(pdf["x"].to_numpy()) - center, pdf["y"].to_numpy()])
            fold, ids = pdf["fold"].to_numpy(), pdf["id"].to_numpy()
            for k, task in enumerate(tasks):
                mine = z[(fold != task.fold) & (ids <= task.upto)]
                total[k] += np.concatenate([mine.sum(axis=0), (mine * mine).sum(axis=0), [len(mine)]])
        return total.ravel()

    total = summed(rows, partial).reshape(len(tasks), -1)
    n = np.maximum(total[:, -1:], 1)
    mean = total[:, :size] / n
    spread = np.sqrt(np.maximum(total[:, size:-1] / n - mean * mean, 0))
    spread[spread <= 1e-12] = 1.0
    mean[:, :-1] += center
    return np.stack([mean, spread], axis=1), total[:, -1]


def train_here(task: Task, stats: np.ndarray, x: np.ndarray, y: np.ndarray, batch: np.ndarray) -> np.ndarray:
    """All steps of a task over rows sorted by batch; batch -1 is the part put aside."""
    z, t = scaled(x, y, stats)
    state, layers = Adam(task), list(task.layers)
    ends = np.searchsorted(batch, np.arange(0, BATCHES + 1, BATCHES // task.per_epoch))
    aside = slice(0, ends[0])
    while True:
        for a, b in zip(ends, ends[1:]):
            state.take(gradient_sum(z[a:b], t[a:b], state.flat, layers), b - a)
        error = forward(z[aside], unpack(state.flat, layers))[-1][:, 0] - t[aside]
        if state.over(float(error @ error) / max(len(error), 1)):
            return state.best_flat


def train_small(rows: DataFrame, tasks: Sequence[Task], stats: np.ndarray) -> list[np.ndarray]:
    """One task of Spark a network: for tables within ``LOCAL_BYTES``."""
    sent = rows.sparkSession.sparkContext.broadcast((list(tasks), stats))
    wanted = F.array(*[F.struct(F.lit(t.number).alias("task"), F.lit(t.fold).alias("_fold"), F.lit(t.upto).cast("bigint").alias("_upto")) for t in tasks])
    spread = rows.select("*", F.explode(wanted).alias("t")).filter((F.col("fold") != F.col("t._fold")) & (F.col("id") <= F.col("t._upto")))

    def train(table: pa.Table) -> pa.Table:
        work, scales = sent.value
        task = work[table.column("task")[0].as_py()]
        ids, y, batch = (table.column(c).to_numpy() for c in ("id", "y", "batch"))
        x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        order = np.lexsort((y, ids, batch))
        flat = train_here(task, scales[task.number], x[order], y[order], batch[order])
        return pa.table({"task": pa.array([task.number], pa.int32()), "flat": pa.array([flat.tobytes()], pa.binary())})

    grouped = spread.select(F.col("t.task").alias("task"), "id", "y", "batch", "x").groupBy("task").applyInArrow(train, "task int, flat binary")
    found = {r["task"]: np.frombuffer(bytes(r["flat"])) for r in grouped.collect()}
    return [found.get(t.number, Adam(t).flat) for t in tasks]


def dealt(rows: DataFrame, n_rows: int, n_tasks: int) -> tuple[RDD, int]:
    """Rows packed by batch, and how many partitions a batch has: those of batch b begin at (b + 1) times that, so the part put aside comes first."""
    context = rows.sparkSession.sparkContext
    parts = int(np.clip(np.ceil(n_rows / (BATCHES + 1) * n_tasks / PART_ROWS), 1, max(1, context.defaultParallelism)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, y, fold, at = (batch.column(c).to_numpy() for c in ("id", "y", "fold", "batch"))
            x, place = matrix(batch.column("x")), (at.astype(np.int64) + 1) * parts + (mixed(ids, 7) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(place[order]) != 0])
            cut = [[c[order[a:b]].tobytes() for a, b in zip(starts, [*starts[1:], len(order)])] for c in (x, y, fold.astype(np.int32), ids)]
            yield pa.RecordBatch.from_arrays([pa.array(place[order[starts]]), *[pa.array(c, pa.binary()) for c in cut]], ["place", "x", "y", "fold", "id"])

    def joined(blocks: Iterator) -> Iterator[tuple[np.ndarray, ...]]:
        kept = [b for _, b in blocks]
        if kept:
            yield tuple(np.frombuffer(b"".join(c), kind) for c, kind in zip(zip(*kept), (np.float64, np.float64, np.int32, np.int64)))

    wide = rows.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(max(int(wide), PACKED_ROWS)))  # else a block is some tens of rows
    try:
        packed = rows.select("id", "fold", "y", "batch", "x").mapInArrow(pack, "place bigint, x binary, y binary, fold binary, id binary").rdd
    finally:
        rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", wide)
    keyed = packed.map(lambda r: (r["place"], (bytes(r["x"]), bytes(r["y"]), bytes(r["fold"]), bytes(r["id"]))))
    return keyed.partitionBy((BATCHES + 1) * parts, int).mapPartitions(joined, True).persist(StorageLevel.MEMORY_AND_DISK), parts


def train_large(rows: DataFrame, tasks: Sequence[Task], stats: np.ndarray, n_rows: int) -> list[np.ndarray]:
    """A Spark job a step for all tasks together, over the step's rows alone; gradients are added up, never weights averaged.

    Rows are dealt once to the batches' own partitions and kept there, so that a job is a few tasks without a plan or a shuffle.
    """
    table, parts = dealt(rows, n_rows, len(tasks))
    context = rows.sparkSession.sparkContext
    sent = context.broadcast(stats)
    states = {t.number: Adam(t) for t in tasks}
    running = list(tasks)

    def told(begin: int, count: int, value: Callable, now: Sequence[Task]) -> list[np.ndarray]:
        """For each task the sum over ``count`` batches from ``begin`` on, with the number of rows after it."""
        flats = {t.number: states[t.number].flat for t in now}

        def add(blocks: Iterator[tuple[np.ndarray, ...]]) -> Iterator[list[np.ndarray]]:
            for x, y, fold, ids in blocks:
                x, out = x.reshape(len(y), -1), []
                for task in now:
                    mine = (fold != task.fold) & (ids <= task.upto)
                    z, t = scaled(x, y, sent.value[task.number]) if mine.all() else scaled(x[mine], y[mine], sent.value[task.number])
                    out.append(np.append(value(z, t, flats[task.number], list(task.layers)), len(t)))
                yield out

        found = context.runJob(table, add, range((begin + 1) * parts, (begin + 1 + count) * parts))
        return [sum(f[k] for f in found) if found else np.zeros(2) for k in range(len(now))]

    def lost(z: np.ndarray, t: np.ndarray, flat: np.ndarray, layers: list[int]) -> np.ndarray:
        error = forward(z, unpack(flat, layers))[-1][:, 0] - t
        return np.array([error @ error])

    while running:
        group = BATCHES // max(t.per_epoch for t in running)
        waiting = {t.number: 0.0 for t in running}
        for begin in range(0, BATCHES, group):
            for task, sums in zip(running, told(begin, group, gradient_sum, running)):
                waiting[task.number] = waiting[task.number] + sums
                if (begin + group) % (BATCHES // task.per_epoch) == 0:
                    states[task.number].take(waiting[task.number][:-1], waiting[task.number][-1])
                    waiting[task.number] = 0.0
        losses = told(-1, 1, lost, running)
        running = [t for t, (loss, n) in zip(running, losses) if not states[t.number].over(loss / max(n, 1))]
    table.unpersist()
    return [states[t.number].best_flat for t in tasks]


class PerceptronModel(Model, Supervised, DefaultParamsReadable, DefaultParamsWritable):
    layers = Param(Params._dummy(), "layers", "sizes from input to output", TypeConverters.toListInt)
    weights = Param(Params._dummy(), "weights", "all weights in one vector", TypeConverters.toListFloat)
    middle = Param(Params._dummy(), "middle", "input means", TypeConverters.toListFloat)
    scale = Param(Params._dummy(), "scale", "input deviations", TypeConverters.toListFloat)
    label = Param(Params._dummy(), "label", "label mean and deviation", TypeConverters.toListFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        layers = list(self.getOrDefault(self.layers))
        parts = unpack(np.array(self.getOrDefault(self.weights)), layers)
        middle, scale = np.array(self.getOrDefault(self.middle)), np.array(self.getOrDefault(self.scale))
        label_mean, label_scale = self.getOrDefault(self.label)

        @F.pandas_udf("double")
        def predict(x: pd.Series) -> pd.Series:
            if x.empty:
                return pd.Series([], dtype="float64")
            z = (np.stack(x.to_numpy()) - middle) / scale
            return pd.Series(forward(z, parts)[-1][:, 0] * label_scale + label_mean)

        return dataset.withColumn(self.getPredictionCol(), predict(vector_to_array(F.col(self.getFeaturesCol()))))


class Perceptron(Estimator, Supervised, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Rectified hidden layers, squared loss, early stopping on a tenth of the rows; ``maxIter`` is only a backstop.

    Mini-batches are dealt by the hash of a row, and a step takes the gradient summed over a whole batch, so the weights do
    not depend on how the rows are partitioned.  ``batchSize`` rows make a step, up to ``BATCHES`` steps an epoch.
    """

    hidden = Param(Params._dummy(), "hidden", "hidden layer sizes", TypeConverters.toListInt)
    maxIter = Param(Params._dummy(), "maxIter", "most epochs", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "Adam step", TypeConverters.toFloat)
    batchSize = Param(Params._dummy(), "batchSize", "rows per step", TypeConverters.toInt)
    alpha = Param(Params._dummy(), "alpha", "L2 penalty", TypeConverters.toFloat)
    patience = Param(Params._dummy(), "patience", "epochs without gain before stopping", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", hidden=(100,), maxIter=50_000,
                 stepSize=1e-3, batchSize=200, alpha=1e-4, patience=10, seed=42) -> None:
        super().__init__()
        self._setDefault(hidden=[100], maxIter=50_000, stepSize=1e-3, batchSize=200, alpha=1e-4, patience=10, seed=42)
        self._set(**{k: list(v) if isinstance(v, tuple) else v for k, v in self._input_kwargs.items()})

    def trained(self, dataset: DataFrame, asked: Sequence[tuple[int, int, dict]], fold: str | None = None, row_id: str | None = None):
        """Tasks, weights, scales and rows for each (fold held out, largest id, parameters)."""
        key = F.xxhash64("x", "y", F.lit(self.getSeed()))
        rows = training_rows(dataset, self.getFeaturesCol(), self.getLabelCol(), fold, row_id)
        batch = F.when(F.pmod(key, F.lit(10)) == 0, -1).otherwise(F.pmod(F.shiftright(key, 8), F.lit(BATCHES))).cast("int")
        rows = rows.withColumn("batch", batch).persist(StorageLevel.MEMORY_AND_DISK)
        center = feature_means(rows)
        base = {p.name: v for p, v in self.extractParamMap().items()}
        tasks = []
        for k, (held, upto, point) in enumerate(asked):
            at = base | point
            tasks.append(Task(k, held, upto, (len(center), *at["hidden"], 1), at["alpha"], at["stepSize"], at["patience"], at["maxIter"], at["batchSize"], at["seed"]))
        stats, sizes = statistics(rows, tasks, center)
        tasks = [replace(t, per_epoch=1 << int(np.clip(np.ceil(np.log2(max(n / t.per_epoch, 1))), 0, np.log2(BATCHES)))) for t, n in zip(tasks, sizes)]
        n_rows = rows.count()
        size = n_rows * (len(center) + 1) * 8
        small = size <= LOCAL_BYTES and size * len(tasks) <= 2 * LOCAL_BYTES
        flats = train_small(rows, tasks, stats) if small else train_large(rows, tasks, stats, n_rows)
        return tasks, flats, stats, rows

    def _fit(self, dataset: DataFrame) -> PerceptronModel:
        tasks, flats, stats, rows = self.trained(dataset, [(-1, LAST, {})])
        rows.unpersist()
        model = self._copyValues(PerceptronModel())
        model._set(layers=list(tasks[0].layers), weights=flats[0].tolist(), middle=stats[0, 0, :-1].tolist(), scale=stats[0, 1, :-1].tolist(),
                   label=[float(stats[0, 0, -1]), float(stats[0, 1, -1])])
        return model

    def scores(self, found, training: bool = False) -> DataFrame:
        """(task, held, stage, r2, mae, rmse, n) of trained tasks on the rows they hold out and, if asked, on those they learned from."""
        tasks, flats, stats, rows = found
        sent = rows.sparkSession.sparkContext.broadcast((tasks, flats, stats))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            work, weights, scales = sent.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, y, fold = (batch.column(c).to_numpy() for c in ("id", "y", "fold"))
                x = matrix(batch.column("x"))
                for task, flat in zip(work, weights):
                    held = fold == task.fold
                    mine = np.flatnonzero(held | (training & (ids <= task.upto)))
                    if len(mine):
                        z, _ = scaled(x[mine], y[mine], scales[task.number])
                        p = forward(z, unpack(flat, list(task.layers)))[-1][:, 0] * scales[task.number][1, -1] + scales[task.number][0, -1]
                        for side in (True, False):
                            t, error = y[mine][held[mine] == side], (y[mine] - p)[held[mine] == side]
                            if len(t):
                                sums = len(t), float(t.sum()), float(t @ t), float(np.abs(error).sum()), float(error @ error)
                                yield pa.RecordBatch.from_pylist([dict(zip(("task", "held", "n", "y", "yy", "ae", "ee"), (task.number, side, *sums)))])

        told = rows.select("id", "y", "fold", "x").mapInArrow(run, "task bigint, held boolean, n bigint, y double, yy double, ae double, ee double")
        added = told.groupBy(F.col("task").cast("int").alias("task"), "held").agg(*[F.sum(c).alias(c) for c in ("n", "y", "yy", "ae", "ee")])
        spread = F.col("yy") - F.col("y") * F.col("y") / F.col("n")
        scored = materialise(added.select("task", "held", F.lit(0).alias("stage"), (1 - F.col("ee") / F.when(spread > 0, spread)).alias("r2"),
                                          (F.col("ae") / F.col("n")).alias("mae"), F.sqrt(F.col("ee") / F.col("n")).alias("rmse"), "n"))
        rows.unpersist()
        return scored

    def staged_scores(self, dataset: DataFrame, fold: str, n_folds: int, points: Sequence[dict]) -> DataFrame:
        """(point, fold, r2, mae, rmse, n) of every point and fold, all trained side by side."""
        found = self.trained(dataset, [(f, LAST, p) for p in points for f in range(n_folds)], fold)
        return self.scores(found).select(F.floor(F.col("task") / n_folds).cast("int").alias("point"), (F.col("task") % n_folds).cast("int").alias("fold"),
                                         "r2", "mae", "rmse", "n")

    def curve(self, dataset: DataFrame, fold: str, row_id: str, tasks: Sequence[tuple[int, int]]) -> DataFrame:
        """(task, held, r2, n) for tasks (fold, largest row_id to learn from)."""
        return self.scores(self.trained(dataset, [(f, upto, {}) for f, upto in tasks], fold, row_id), True)
