"""Boosted trees on gradient and hessian sums, and AdaBoost.R2, over coded rows.

Rounds follow each other, but folds and settings do not: they are jobs that go through their rounds together.  Up to
``LOCAL_ROWS`` rows a job's rounds run in one task, over cells of rows with equal codes; larger tables take one Spark job a
level for all jobs, with the rows where they are, and keep what the rounds so far make of each row in a column.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasMaxIter, HasSeed, HasStepSize
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.learning import forest
from airgrid.learning import cells as by_cell
from airgrid.learning.base import Supervised, summed
from airgrid.learning.cells import batch_arrays, cell_table, equal_lengths, gathered, scores_by_cell, summed_draws, told_of
from airgrid.learning.forest import (CODED, TABLE, ForestModel, Job, by_cells, coded, codes_of, counted, feature_cuts, packed, scores_of_stages, state_of, subtrees,
                                     training_rows, tree_of, tree_row)
from airgrid.learning.growing import Growth, Tree, cell_sums, cells_of, grow, keys_of, mixed, root_path, uniform
from airgrid.session import materialise, scratch_path

ROUNDS_PER_WRITE = 25  # in between, rows are led through the rounds since the last writing
DRAWS_BYTES = 256 << 20  # of sums of a job's rounds that a task holds
BLOCK = "cell binary, fold binary, y binary, state binary"
PREDICTED = "task int, id bigint, y double, copies bigint, predictions array<double>"


@dataclass(frozen=True)
class Boost:
    """Rounds and what each of them sees; ``growth.l2`` is added to the hessian of a leaf."""

    growth: Growth
    rounds: int = 100
    step: float = 0.1
    row_share: float = 1.0
    column_share: float = 1.0

    def columns(self, k: int, n_features: int) -> np.ndarray:
        """The features of one round's tree."""
        wanted = max(1, int(self.column_share * n_features))
        draws = mixed(np.arange(n_features), self.growth.seed * 7 + k)
        return draws.argsort().argsort() < wanted

    def drawn(self, ids: np.ndarray, k: int) -> np.ndarray:
        if self.row_share >= 1:
            return np.ones(len(ids))
        return (uniform(ids, self.growth.seed * 1_000_003 + k) < self.row_share).astype(float)


def boosted_rounds(boost: Boost, ids: np.ndarray, y: np.ndarray, held: np.ndarray, cells: np.ndarray, which: np.ndarray, cuts: list[np.ndarray]) -> Iterator[tuple[Tree, np.ndarray]]:
    """Each round's tree and the predictions of the cells after it.

    With squared loss a row's hessian is one and its gradient the residual, so a cell's sums follow from its rows' count and labels.
    """
    mine = np.flatnonzero(~held)
    so_far = np.full(len(cells), y[mine].mean() if len(mine) else 0.0)
    n, _, labels = cell_sums(which[mine], len(cells), np.ones(len(mine)), y[mine])
    for k in range(boost.rounds):
        if boost.row_share < 1:
            n, _, labels = cell_sums(which[mine], len(cells), boost.drawn(ids[mine], k), y[mine])
        sums = np.stack([n, n, labels - n * so_far])
        tree = grow(cells, sums, boost.growth, cuts, root_path(boost.growth.seed, k), columns=boost.columns(k, cells.shape[1]))
        so_far = so_far + boost.step * tree.value[tree.descend(cells)]
        yield tree, so_far


def boosted_cells(boost: Boost, base: np.ndarray, drawn: Iterator[np.ndarray] | None, cells: np.ndarray, cuts: list[np.ndarray]) -> Iterator[tuple[Tree, np.ndarray]]:
    """``boosted_rounds`` from the sums of the cells: over all rows of the job, and of those drawn for each round if not all are."""
    so_far = np.full(len(cells), base[2].sum() / base[0].sum() if base[0].any() else 0.0)
    for k in range(boost.rounds):
        n, _, labels = base if drawn is None else next(drawn)
        sums = np.stack([n, n, labels - n * so_far])
        tree = grow(cells, sums, boost.growth, cuts, root_path(boost.growth.seed, k), columns=boost.columns(k, cells.shape[1]))
        so_far = so_far + boost.step * tree.value[tree.descend(cells)]
        yield tree, so_far


def draws_by_cell(n_rows: int, n_cells: int, boosts: Sequence[Boost]) -> int:
    """How many draws of rows the rounds are fitted from as sums per cell; 0 if they are not."""
    draws = max(b.rounds for b in boosts) if boosts[0].row_share < 1 else 1
    alike = len({(b.row_share, b.growth.seed) for b in boosts}) == 1  # then all see the same rows in a round
    return draws if alike and 24 * n_cells * draws <= DRAWS_BYTES and by_cells(n_rows, n_cells, draws + (draws > 1)) else 0


def rounds_by_cells(table: DataFrame, jobs: Sequence[Job], boost: Boost, n_draws: int, cuts: list[np.ndarray], use, schema: str) -> DataFrame:
    """What ``use`` makes of each job, its cells, their sums and those of every draw (None: a round sees all rows)."""
    share = boost.row_share < 1
    sums = cell_table(table, jobs, {j.number: [-1, *range(n_draws)] if share else [-1] for j in jobs}, boost.drawn)
    sent = table.sparkSession.sparkContext.broadcast({j.number: j for j in jobs})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, draws in groupby(summed_draws(batches, len(cuts)), key=lambda d: d[0]):
            _, _, cells, base = next(draws)
            yield from use(sent.value[number], cells, base, (s for *_, s in draws) if share else None)

    return sums.mapInArrow(run, schema)


def same_under(boost: Boost, trees: Sequence[Tree], stricter: Boost) -> bool:
    """Whether stricter limits on nodes would have made the same trees: all chosen splits keep to them."""
    least_leaf = min((t.n[np.r_[t.left[t.feature >= 0], t.left[t.feature >= 0] + 1]].min() for t in trees if (t.feature >= 0).any()), default=1 << 62)
    least_split = min((t.n[t.feature >= 0].min() for t in trees if (t.feature >= 0).any()), default=1 << 62)
    a, b = boost.growth, stricter.growth
    return (replace(boost, growth=a) == replace(stricter, growth=replace(b, min_leaf=a.min_leaf, min_split=a.min_split))
            and a.min_leaf <= b.min_leaf <= least_leaf and a.min_split <= max(b.min_split, 2 * b.min_leaf) <= least_split)


class AdaRounds:
    """AdaBoost.R2 with linear loss over the rows of one job."""

    def __init__(self, growth: Growth, rounds: int, rate: float):
        self.growth, self.rounds, self.rate = growth, rounds, rate

    def next_weights(self, weights: np.ndarray, errors: np.ndarray, worst: float, beta: float) -> np.ndarray:
        return weights * beta ** ((1.0 - errors / worst) * self.rate)

    def verdict(self, worst: float, lost: float, weight: float, first: bool) -> tuple[float | None, float, bool]:
        """What a tree says (None: it is left out), its beta, and whether the rounds end with it."""
        if not worst:
            return 1.0, 0.0, True
        loss = lost / worst / weight
        if loss >= 0.5:
            return (1.0 if first else None), 0.0, True
        beta = loss / (1.0 - loss)
        return float(self.rate * np.log(1.0 / beta)), beta, False

    def run(self, y: np.ndarray, held: np.ndarray, cells: np.ndarray, which: np.ndarray, cuts: list[np.ndarray]) -> Iterator[tuple[Tree, float, np.ndarray]]:
        """Trees, their says and the values of the cells."""
        mine = np.flatnonzero(~held)
        weights, first = np.ones(len(mine)), True
        for k in range(self.rounds):
            tree = grow(cells, cell_sums(which[mine], len(cells), weights, y[mine]), self.growth, cuts, root_path(self.growth.seed, k))
            value = tree.value[tree.descend(cells)]
            errors = np.abs(value[which[mine]] - y[mine])
            worst = errors.max(initial=0.0)
            say, beta, over = self.verdict(worst, float(weights @ errors), weights.sum(), first)
            if say is not None:
                yield tree, say, value
            if over:
                return
            weights, first = self.next_weights(weights, errors, worst, beta), False


def weighted_median(values: np.ndarray, says: np.ndarray) -> np.ndarray:
    """Along the last axis: the least value whose share with all lesser ones reaches half of the say."""
    order = np.argsort(values, axis=1, kind="stable")
    reached = np.cumsum(says[order], axis=1) >= 0.5 * says.sum()
    return np.take_along_axis(values, np.take_along_axis(order, reached.argmax(axis=1)[:, None], 1), 1)[:, 0]


class _Rounds:
    """The rounds of several jobs over a table too large for a task: a Spark job a level, one more a round for AdaBoost."""

    def __init__(self, table: DataFrame, jobs: Sequence[Job], cuts: list[np.ndarray], start: Sequence[float]):
        self.table, self.jobs, self.cuts = table, list(jobs), cuts
        first = np.array(start, float).tobytes()
        self.table = table.withColumn("state", F.lit(bytearray(first)))
        self.since: list[dict[int, tuple]] = []  # for each round since the last writing: job -> what changes its rows' state

    def moved(self, change) -> None:
        """Write the rows with the state that the rounds since the last writing leave them in."""
        since, jobs = list(self.since), self.jobs

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                _, _, y, codes = batch_arrays(batch)
                state = state_of(batch).copy()
                for k, job in enumerate(jobs):
                    state[:, k] = change(state[:, k], y, codes, [r[job.number] for r in since if job.number in r])
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "fold", "y", "codes")], pa.array([r.tobytes() for r in state], pa.binary())],
                                                 ["id", "fold", "y", "codes", "state"])

        self.table = materialise(self.table.mapInArrow(run, f"{CODED}, state binary"))
        self.since = []


def add_trees(so_far: np.ndarray, y: np.ndarray, codes: np.ndarray, rounds: list[tuple]) -> np.ndarray:
    for tree, step in rounds:
        so_far = so_far + step * tree.value[tree.descend(codes)]
    return so_far


def boost_large(table: DataFrame, jobs: Sequence[Job], boosts: Sequence[Boost], cuts: list[np.ndarray], starts: Sequence[float],
                at_stage) -> list[list[Tree]]:
    """The trees of every job; ``at_stage(round, table)`` is called with the rows' predictions in ``state`` when it asks for that round."""
    work = _Rounds(table, jobs, cuts, starts)
    trees: list[list[Tree]] = [[] for _ in jobs]
    for k in range(max(b.rounds for b in boosts)):
        running = [n for n, b in enumerate(boosts) if k < b.rounds]
        since = list(work.since)

        def view(job: Job, growth: Growth, ids, y, codes, states, k=k, since=since):
            so_far = add_trees(states[:, job.number], y, codes, [r[job.number] for r in since if job.number in r])
            return boosts[job.number].drawn(ids, k), y - so_far

        now = [replace(jobs[n], number=n, trees=(k, k + 1)) for n in running]
        grown = forest.upper_levels(work.table, now, {n: boosts[n].growth for n in running}, cuts, 0, view, {n: boosts[n].columns(k, len(cuts)) for n in running})
        work.since.append({n: (grown[n][0], boosts[n].step) for n in running})
        for n in running:
            trees[n].append(grown[n][0])
        if at_stage.asks(k + 1) or len(work.since) == ROUNDS_PER_WRITE:
            work.moved(add_trees)
        if at_stage.asks(k + 1):
            at_stage(k + 1, work.table)
    return trees


def reweigh(weights: np.ndarray, y: np.ndarray, codes: np.ndarray, rounds: list[tuple]) -> np.ndarray:
    for tree, ada, worst, beta in rounds:
        weights = ada.next_weights(weights, np.abs(tree.value[tree.descend(codes)] - y), worst, beta)
    return weights


def ada_large(table: DataFrame, jobs: Sequence[Job], adas: Sequence[AdaRounds], cuts: list[np.ndarray]) -> list[list[tuple[Tree, float]]]:
    """Trees and says of every job, each round from one aggregate of errors besides the levels of its tree."""
    work = _Rounds(table, jobs, cuts, [1.0] * len(jobs))
    out: list[list[tuple[Tree, float]]] = [[] for _ in jobs]
    running = list(range(len(jobs)))
    for k in range(max(a.rounds for a in adas)):
        running = [n for n in running if k < adas[n].rounds]
        if not running:
            break
        since = list(work.since)

        def view(job: Job, growth: Growth, ids, y, codes, states, since=since):
            return reweigh(states[:, job.number], y, codes, [r[job.number] for r in since if job.number in r]), y

        now = [replace(jobs[n], number=n, trees=(k, k + 1)) for n in running]
        grown = forest.upper_levels(work.table, now, {n: adas[n].growth for n in running}, cuts, 0, view)
        sent = {n: grown[n][0] for n in running}

        def errors(batches: Iterator[pa.RecordBatch], now=now, sent=sent, view=view) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, fold, y, codes = batch_arrays(batch)
                states = state_of(batch)
                for job in now:
                    mine = np.flatnonzero(fold != job.fold)
                    if len(mine):
                        tree = sent[job.number]
                        weights, _ = view(job, None, ids[mine], y[mine], codes[mine], states[mine])
                        error = np.abs(tree.value[tree.descend(codes[mine])] - y[mine])
                        yield pa.RecordBatch.from_pylist([{"n": job.number, "worst": float(error.max()), "lost": float(weights @ error), "weight": float(weights.sum())}])

        told = work.table.mapInArrow(errors, "n bigint, worst double, lost double, weight double").groupBy("n").agg(
            F.max("worst").alias("worst"), F.sum("lost").alias("lost"), F.sum("weight").alias("weight"))
        changes, going = {}, []
        for r in told.collect():  # a row a job
            n = r["n"]
            say, beta, over = adas[n].verdict(r["worst"], r["lost"], r["weight"], not out[n])
            if say is not None:
                out[n].append((grown[n][0], say))
            if not over:
                going.append(n)
                changes[n] = (grown[n][0], adas[n], r["worst"], beta)
        running = sorted(going)
        work.since.append(changes)
        if len(work.since) == ROUNDS_PER_WRITE:
            work.moved(reweigh)
    return out


class _Blocks:
    """Rows packed many to one, each with the number of its cell and the logarithm of its weight in every job."""

    def __init__(self, table: DataFrame, jobs: Sequence[Job], n_features: int):
        self.spark, self.jobs = table.sparkSession, list(jobs)
        codes = table.select("codes").distinct().toArrow().column("codes").combine_chunks()
        self.cells, _ = cells_of(equal_lengths(codes) if len(codes) else np.zeros((0, n_features), np.uint8))
        sent, n_jobs = self.spark.sparkContext.broadcast(keys_of(self.cells)), len(self.jobs)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, fold, y, codes in gathered(batches):
                cell = np.searchsorted(sent.value, keys_of(codes)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in (cell, fold.astype(np.int32), y, np.zeros((n_jobs, len(y))))],
                                                 ["cell", "fold", "y", "state"])

        self.rows = self.written(table.mapInArrow(pack, BLOCK))
        self.since: list[dict[int, tuple]] = []  # for each round since the last writing: job -> values of the cells, their factor and its slope

    def written(self, blocks: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, "blocks")
        blocks.write.parquet(path)
        return self.spark.read.schema(BLOCK).parquet(path)

    def opened(self):
        """A function of a packed row: cells, labels, and for each job its rows and the logarithms of their weights."""
        since, n_jobs, folds = list(self.since), len(self.jobs), [j.fold for j in self.jobs]

        def rows_of(cell: bytes, fold: bytes, y: bytes, state: bytes):
            cell, fold, y = np.frombuffer(cell, np.int32), np.frombuffer(fold, np.int32), np.frombuffer(y)
            state = np.frombuffer(state).reshape(n_jobs, -1).copy()
            for changes in since:
                for k, (values, factor, slope) in changes.items():
                    state[k] += factor - slope * np.abs(values[cell] - y)
            return cell, y, [fold != f for f in folds], state

        return rows_of

    def add(self, running: Sequence[int], size: int, value) -> np.ndarray:
        """Sums over the rows of what ``value(job, cells, labels, weights)`` makes of each block, a row a running job."""
        rows_of = self.opened()

        def partial(batches: Iterator[pd.DataFrame]) -> np.ndarray:
            total = np.zeros((len(running), size))
            for pdf in batches:
                for block in zip(*[pdf[c] for c in ("cell", "fold", "y", "state")]):
                    cell, y, mine, state = rows_of(*block)
                    for at, k in enumerate(running):
                        total[at] += value(k, cell[mine[k]], y[mine[k]], np.exp(state[k][mine[k]]))
            return total.ravel()

        return summed(self.rows, partial).reshape(len(running), size)

    def moved(self) -> None:
        """Write the rows with the weights that the rounds since the last writing leave them with."""
        rows_of = self.opened()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in batch.to_pylist():
                    state = rows_of(*block.values())[-1]
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in (block["cell"], block["fold"], block["y"], state.tobytes())],
                                                     ["cell", "fold", "y", "state"])

        self.rows, self.since = self.written(self.rows.mapInArrow(run, BLOCK)), []

    def ranges(self) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest label of every cell among the rows of each job."""
        rows_of, n_cells, n_jobs = self.opened(), len(self.cells), len(self.jobs)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, high = np.full((n_jobs, n_cells), np.inf), np.full((n_jobs, n_cells), -np.inf)
            for batch in batches:
                for block in batch.to_pylist():
                    cell, y, mine, _ = rows_of(*block.values())
                    for k, m in enumerate(mine):
                        np.minimum.at(low[k], cell[m], y[m])
                        np.maximum.at(high[k], cell[m], y[m])
            k, c = np.nonzero(low <= high)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(low[k, c]), pa.array(high[k, c])], ["k", "c", "low", "high"])

        found = self.rows.mapInArrow(run, "k int, c int, low double, high double").groupBy("k", "c").agg(F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
        low, high = np.full((n_jobs, n_cells), np.nan), np.full((n_jobs, n_cells), np.nan)
        at = found.column("k").to_numpy(), found.column("c").to_numpy()
        low[at], high[at] = found.column("low").to_numpy(), found.column("high").to_numpy()
        return low, high


def ada_by_cells(table: DataFrame, jobs: Sequence[Job], adas: Sequence[AdaRounds], cuts: list[np.ndarray]) -> tuple[np.ndarray, list[list[tuple[Tree, float]]]]:
    """Cells, and trees and says of every job: a round adds up the weights of the cells, for its trees, and then their errors."""
    work = _Blocks(table, jobs, len(cuts))
    cells, (low, high) = work.cells, work.ranges()
    out: list[list[tuple[Tree, float]]] = [[] for _ in jobs]
    running = list(range(len(jobs)))
    for k in range(max(a.rounds for a in adas)):
        running = [n for n in running if k < adas[n].rounds]
        if not running:
            break

        def weigh(_, cell, y, w, size=len(cells)) -> np.ndarray:
            return np.concatenate([np.bincount(cell, w > 0, size), np.bincount(cell, w, size), np.bincount(cell, w * y, size)])

        sums = dict(zip(running, work.add(running, 3 * len(cells), weigh)))
        trees = {n: grow(cells, sums[n].reshape(3, -1), adas[n].growth, cuts, root_path(adas[n].growth.seed, k)) for n in running}
        values = {n: tree.value[tree.descend(cells)] for n, tree in trees.items()}
        lost = dict(zip(running, work.add(running, 1, lambda n, cell, y, w: np.array([w @ np.abs(values[n][cell] - y)]))[:, 0]))
        changes, going = {}, []
        for n in running:
            gap = np.maximum(np.abs(values[n] - low[n]), np.abs(values[n] - high[n]))
            worst = float(np.nanmax(gap)) if len(gap) and not np.isnan(gap).all() else 0.0
            say, beta, over = adas[n].verdict(worst, float(lost[n]), float(sums[n].reshape(3, -1)[1].sum()), not out[n])
            if say is not None:
                out[n].append((trees[n], say))
            if not over:
                going.append(n)
                factor = adas[n].rate * np.log(beta)
                changes[n] = (values[n], factor, factor / worst)
        running = going
        work.since.append(changes)
        if len(work.since) == ROUNDS_PER_WRITE or 8 * len(cells) * len(jobs) * len(work.since) > by_cell.SENT_BYTES:
            work.moved()
    return cells, out


def ada_takes_cells(n_rows: int, n_cells: int, jobs: Sequence[Job]) -> bool:
    """Whether the driver can hold the sums per cell of all jobs."""
    return n_rows > forest.LOCAL_ROWS and 24 * n_cells * len(jobs) <= forest.SUMS_BYTES


class _Stages:
    """Predictions of the rows held out, put aside whenever a stage of rounds is reached."""

    def __init__(self, jobs: Sequence[Job], stages: Sequence[int]):
        self.jobs, self.stages, self.found = list(jobs), set(stages), None

    def asks(self, k: int) -> bool:
        return k in self.stages

    def __call__(self, k: int, table: DataFrame) -> None:
        jobs = self.jobs

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, fold, y, _ = batch_arrays(batch)
                states = state_of(batch)
                for n, job in enumerate(jobs):
                    held = np.flatnonzero(fold == job.fold)
                    if len(held):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), job.task, np.int32)), pa.array(y[held]), pa.array(states[held, n])], ["task", "y", "p"])

        rows = table.mapInArrow(run, "task int, y double, p double").withColumn("copies", F.lit(1))
        part = materialise(scores_of_stages(rows, ["task"], ["p"]).withColumn("rounds", F.lit(k)).drop("stage"))
        self.found = part if self.found is None else self.found.unionByName(part)


def held_predictions(job: Job, ids, y, held, which, cell_predictions: np.ndarray, task: int) -> pa.RecordBatch:
    """``PREDICTED`` rows of those held out: one per distinct row, with all its stages."""
    scored = np.flatnonzero(held)
    _, first, copies = np.unique(ids[scored], return_index=True, return_counts=True)
    scored = scored[first]
    flat = cell_predictions[:, which[scored]].T
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(scored) + 1) * flat.shape[1], pa.int32()), pa.array(np.ascontiguousarray(flat).ravel()))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(scored), task, np.int32)), pa.array(ids[scored]), pa.array(y[scored]), pa.array(copies), lists],
                                      ["task", "id", "y", "copies", "predictions"])


def stage_scores(told: DataFrame, stages: Sequence[int]) -> DataFrame:
    """(task, rounds, r2, mae, rmse, n)."""
    wide = told.select("task", "y", "copies", *[F.col("predictions")[k].alias(f"p{k}") for k in range(len(stages))])
    rounds = F.element_at(F.array(*map(F.lit, stages)), F.col("stage") + 1).alias("rounds")
    return scores_of_stages(wide, ["task"], [f"p{k}" for k in range(len(stages))]).select("task", rounds, "r2", "mae", "rmse", "n")


def staged_by_cell(table: DataFrame, predicted: DataFrame, tasks: Sequence[tuple[int, int]], stages: Sequence[int], n_features: int) -> DataFrame:
    """(task, rounds, r2, mae, rmse, n) of the rows that each (task, fold) holds out."""
    found = scores_by_cell(table, predicted, {t: (f, -1, False) for t, f in tasks}, n_features)
    rounds = F.element_at(F.array(*map(F.lit, stages)), F.col("place") + 1).alias("rounds")
    return found.select("task", rounds, "r2", "mae", "rmse", "n")


class BoostedModel(ForestModel):
    """A start value plus shrunken trees."""


class BoostedTrees(Estimator, Supervised, HasSeed, HasMaxIter, HasStepSize, DefaultParamsReadable, DefaultParamsWritable):
    """Trees on the residuals of those before; leaves are gradient over hessian plus ``l2``.

    ``rowShare`` of the rows are drawn for a round by hash, ``columnShare`` of the features for its tree.
    """

    maxDepth = Param(Params._dummy(), "maxDepth", "deepest level", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "fewest rows in a leaf", TypeConverters.toInt)
    minSplit = Param(Params._dummy(), "minSplit", "fewest rows of a node that is split", TypeConverters.toInt)
    l2 = Param(Params._dummy(), "l2", "penalty on leaf values", TypeConverters.toFloat)
    rowShare = Param(Params._dummy(), "rowShare", "share of rows of a round", TypeConverters.toFloat)
    columnShare = Param(Params._dummy(), "columnShare", "share of features of a tree", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", maxIter=100, stepSize=0.1, maxDepth=3, minInstancesPerNode=1,
                 minSplit=2, l2=0.0, rowShare=1.0, columnShare=1.0, seed=42) -> None:
        super().__init__()
        self._setDefault(maxIter=100, stepSize=0.1, maxDepth=3, minInstancesPerNode=1, minSplit=2, l2=0.0, rowShare=1.0, columnShare=1.0, seed=42)
        self._set(**self._input_kwargs)

    def boost(self, point: dict) -> Boost:
        at = {p.name: v for p, v in self.extractParamMap().items()} | point
        growth = Growth(max_depth=at["maxDepth"], min_leaf=at["minInstancesPerNode"], min_split=max(2, at["minSplit"]), l2=at["l2"], seed=at["seed"])
        return Boost(growth, at["maxIter"], at["stepSize"], at["rowShare"], at["columnShare"])

    def _fit(self, dataset: DataFrame) -> BoostedModel:
        rows = training_rows(dataset, self.getFeaturesCol(), self.getLabelCol())
        cuts, boost = feature_cuts(rows), self.boost({})
        table = coded(rows, cuts)
        about = table.agg(F.count("*").alias("n"), F.avg("y").alias("mean")).first()
        path, spark = scratch_path(dataset.sparkSession, "trees"), dataset.sparkSession
        if n_draws := draws_by_cell(about["n"], counted(table)[1], [boost]):

            def grown(job, cells, base, drawn):
                for k, (tree, _) in enumerate(boosted_cells(boost, base, drawn, cells, cuts)):
                    yield tree_row(k, 0, tree)

            rounds_by_cells(table, [Job(0)], boost, n_draws, cuts, grown, TABLE).write.parquet(path)
        elif about["n"] <= forest.LOCAL_ROWS:

            def use(job, node, ids, y, held, cells, which, trees, above):
                for k, (tree, _) in enumerate(boosted_rounds(boost, ids, y, held, cells, which, cuts)):
                    yield tree_row(k, 0, tree)

            subtrees(packed(table, [Job(0, trees=(0, 0))], {}), [Job(0, trees=(0, 0))], [], cuts, {}, use, TABLE).write.parquet(path)
        else:
            trees = boost_large(table, [Job(0)], [boost], cuts, [about["mean"]], _Stages([], []))[0]
            spark.createDataFrame([tuple(tree_row(k, 0, t).to_pylist()[0].values()) for k, t in enumerate(trees)], TABLE).write.parquet(path)
        return self._copyValues(BoostedModel(path, cuts, float(about["mean"]), boost.step))

    def staged_scores(self, dataset: DataFrame, fold: str, n_folds: int, points: Sequence[dict]) -> DataFrame:
        """(point, fold, r2, mae, rmse, n); points that differ in ``maxIter`` alone are stages of one run.

        Points that differ in the fewest rows of a leaf or split share a run as long as none of its splits breaks the stricter limit.
        """
        boosts = [self.boost(p) for p in points]
        stages = sorted({b.rounds for b in boosts})
        runs = sorted({replace(b, rounds=max(stages)) for b in boosts}, key=lambda b: (b.step, b.growth.min_leaf, b.growth.min_split))
        rows = training_rows(dataset, self.getFeaturesCol(), self.getLabelCol(), fold)
        cuts = feature_cuts(rows)
        table = coded(rows, cuts)
        (n_rows, n_cells), spark = counted(table), dataset.sparkSession
        like: dict[Boost, list[int]] = {}
        for r, b in enumerate(runs):
            like.setdefault(replace(b, growth=replace(b.growth, min_leaf=1, min_split=2)), []).append(r)
        families = list(like.values())

        def read_family(family: list[int], rounds_of) -> Iterator[tuple[list[int], np.ndarray]]:
            """Runs that made the same trees, and the predictions of the cells at each stage."""
            left = list(family)
            while left:
                mine, grown, read = runs[left[0]], [], []
                for k, (tree, so_far) in enumerate(rounds_of(mine)):
                    grown.append(tree)
                    if k + 1 in stages:
                        read.append(so_far)
                alike = [r for r in left if r == left[0] or same_under(mine, grown, runs[r])]
                yield alike, np.array(read)
                left = [r for r in left if r not in alike]

        if n_draws := draws_by_cell(n_rows, n_cells, runs):
            # draws are sent once a fold, for all its families
            parts = [families] if n_draws > 1 else [[family] for family in families]
            jobs = [Job(f * len(parts) + k, f, task=k) for f in range(n_folds) for k in range(len(parts))]

            def told(job, cells, base, drawn):
                kept = list(drawn) if drawn is not None else None
                for family in parts[job.task]:
                    for alike, read in read_family(family, lambda b: boosted_cells(b, base, iter(kept) if kept is not None else None, cells, cuts)):
                        for r in alike:
                            yield told_of(job.fold * len(runs) + r, 0, 0, cells, read.T)

            predicted = rounds_by_cells(table, jobs, runs[0], n_draws, cuts, told, by_cell.PREDICTED)
            found = staged_by_cell(table, predicted, [(f * len(runs) + r, f) for f in range(n_folds) for r in range(len(runs))], stages, len(cuts))
        elif n_rows <= forest.LOCAL_ROWS:
            jobs = [Job(f * len(families) + k, f, (0, 0), k) for f in range(n_folds) for k in range(len(families))]

            def use(job, node, ids, y, held, cells, which, trees, above):
                for alike, read in read_family(families[job.task], lambda b: boosted_rounds(b, ids, y, held, cells, which, cuts)):
                    for r in alike:
                        yield held_predictions(job, ids, y, held, which, read, job.fold * len(runs) + r)

            found = stage_scores(subtrees(packed(table, jobs, {}), jobs, [], cuts, {}, use, PREDICTED), stages)
        else:
            jobs = [Job(f * len(runs) + r, f, (0, 1), f * len(runs) + r) for f in range(n_folds) for r in range(len(runs))]
            means = {r["fold"]: r for r in table.groupBy("fold").agg(F.sum("y").alias("s"), F.count("*").alias("n")).collect()}
            total, count = sum(r["s"] for r in means.values()), sum(r["n"] for r in means.values())
            starts = [(total - (means[j.fold]["s"] if j.fold in means else 0)) / (count - (means[j.fold]["n"] if j.fold in means else 0)) for j in jobs]
            at_stage = _Stages(jobs, stages)
            boost_large(table, jobs, [runs[j.number % len(runs)] for j in jobs], cuts, starts, at_stage)
            found = at_stage.found
        where = [(k, runs.index(replace(b, rounds=max(stages))), b.rounds) for k, b in enumerate(boosts)]
        places = spark.createDataFrame(where, "point int, _run int, rounds int")
        parts = found.select((F.col("task") % len(runs)).cast("int").alias("_run"), F.floor(F.col("task") / len(runs)).cast("int").alias("fold"), "rounds", "r2", "mae", "rmse", "n")
        return parts.join(F.broadcast(places), ["_run", "rounds"]).select("point", "fold", "r2", "mae", "rmse", "n")


class AdaBoostModel(ForestModel):
    """Weighted median of the members' predictions; ``memberWeights`` are their says."""

    memberWeights = Param(Params._dummy(), "memberWeights", "say of each member", TypeConverters.toListFloat)

    def _members(self) -> list[Tree]:
        rows = self.table.orderBy("tree").collect()  # shallow trees, as many as there are stages
        return [tree_of(r.asDict(), ("feature", "cut", "left", "value")) for r in rows]

    def member_predictions(self, dataset: DataFrame) -> tuple[DataFrame, list[str]]:
        """The data with one prediction column per member, and their names."""
        members, cuts = self._members(), self.cuts

        @F.pandas_udf("array<double>")
        def each(x: pd.Series) -> pd.Series:
            codes = codes_of(np.stack(x.to_numpy()), cuts) if len(x) else np.zeros((0, len(cuts)), np.uint8)
            return pd.Series(list(np.stack([t.value[t.descend(codes)] for t in members], axis=1)))

        names = [f"_{self.uid}_{k}" for k in range(len(members))]
        out = dataset.withColumn("_each", each(vector_to_array(F.col(self.getFeaturesCol()))))
        return out.select(*dataset.columns, *[F.col("_each")[k].alias(n) for k, n in enumerate(names)]), names

    def _transform(self, dataset: DataFrame) -> DataFrame:
        members, cuts, says = self._members(), self.cuts, np.array(self.getOrDefault(self.memberWeights))

        @F.pandas_udf("double")
        def median(x: pd.Series) -> pd.Series:
            if x.empty:
                return pd.Series([], dtype="float64")
            cells, which = cells_of(codes_of(np.stack(x.to_numpy()), cuts))
            return pd.Series(weighted_median(np.stack([t.value[t.descend(cells)] for t in members], axis=1), says)[which])

        return dataset.withColumn(self.getPredictionCol(), median(vector_to_array(F.col(self.getFeaturesCol()))))


class AdaBoost(Estimator, Supervised, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """AdaBoost.R2 with linear loss over shallow trees; rows carry their weight from stage to stage."""

    numTrees = Param(Params._dummy(), "numTrees", "most stages", TypeConverters.toInt)
    learningRate = Param(Params._dummy(), "learningRate", "shrinkage of each stage's say", TypeConverters.toFloat)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of the trees", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", numTrees=50,
                 learningRate=1.0, maxDepth=3, seed=42) -> None:
        super().__init__()
        self._setDefault(numTrees=50, learningRate=1.0, maxDepth=3, seed=42)
        self._set(**self._input_kwargs)

    def rounds(self, point: dict) -> AdaRounds:
        at = {p.name: v for p, v in self.extractParamMap().items()} | point
        return AdaRounds(Growth(max_depth=at["maxDepth"], seed=at["seed"]), at["numTrees"], at["learningRate"])

    def _fit(self, dataset: DataFrame) -> AdaBoostModel:
        rows = training_rows(dataset, self.getFeaturesCol(), self.getLabelCol())
        cuts, ada = feature_cuts(rows), self.rounds({})
        table = coded(rows, cuts)
        spark = dataset.sparkSession
        n_rows, n_cells = counted(table)
        if ada_takes_cells(n_rows, n_cells, [Job(0)]):
            trees = ada_by_cells(table, [Job(0)], [ada], cuts)[1][0]
        elif n_rows <= forest.LOCAL_ROWS:

            def use(job, node, ids, y, held, cells, which, trees, above):
                for k, (tree, say, _) in enumerate(ada.run(y, held, cells, which, cuts)):
                    row = tree_row(k, 0, tree)
                    yield pa.RecordBatch.from_arrays([*row.columns, pa.array([say])], [*row.schema.names, "say"])

            found = subtrees(packed(table, [Job(0, trees=(0, 0))], {}), [Job(0, trees=(0, 0))], [], cuts, {}, use, f"{TABLE}, say double").collect()
            trees = [(tree_of(r.asDict()), r["say"]) for r in sorted(found, key=lambda r: r["tree"])]
        else:
            trees = ada_large(table, [Job(0)], [ada], cuts)[0]
        path = scratch_path(spark, "trees")
        spark.createDataFrame([tuple(tree_row(k, 0, t).to_pylist()[0].values()) for k, (t, _) in enumerate(trees)], TABLE).write.parquet(path)
        model = self._copyValues(AdaBoostModel(path, cuts))
        model._set(memberWeights=[s for _, s in trees])
        return model

    def staged_scores(self, dataset: DataFrame, fold: str, n_folds: int, points: Sequence[dict]) -> DataFrame:
        """(point, fold, r2, mae, rmse, n); points that differ in ``numTrees`` alone are stages of one run."""
        asked = [self.rounds(p) for p in points]
        stages = sorted({a.rounds for a in asked})
        keys = sorted({(a.rate, a.growth.max_depth) for a in asked})
        runs = [AdaRounds(Growth(max_depth=d, seed=self.getSeed()), max(stages), rate) for rate, d in keys]
        rows = training_rows(dataset, self.getFeaturesCol(), self.getLabelCol(), fold)
        cuts = feature_cuts(rows)
        table = coded(rows, cuts)
        jobs = [Job(f * len(runs) + r, f, (0, 0), f * len(runs) + r) for f in range(n_folds) for r in range(len(runs))]
        n_rows, n_cells = counted(table)
        small = n_rows <= forest.LOCAL_ROWS
        adas, on_cells = [runs[j.number % len(runs)] for j in jobs], ada_takes_cells(n_rows, n_cells, jobs)
        large = None if small or on_cells else ada_large(table, jobs, adas, cuts)

        def read(values: list[np.ndarray], says: list[float]) -> np.ndarray:
            together, said = np.array(values).T, np.array(says)
            return np.array([weighted_median(together[:, :k], said[:k]) for k in stages])

        def use(job, node, ids, y, held, cells, which, trees, above):
            found = list(runs[job.task % len(runs)].run(y, held, cells, which, cuts))
            yield held_predictions(job, ids, y, held, which, read([v for *_, v in found], [s for _, s, _ in found]), job.task)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, fold_of, y, codes = batch_arrays(batch)
                for job in jobs:
                    mine = np.flatnonzero(fold_of == job.fold)
                    if len(mine):
                        cell_values = read([t.value[t.descend(codes[mine])] for t, _ in large[job.number]], [s for _, s in large[job.number]])
                        yield held_predictions(job, np.arange(len(mine)), y[mine], np.ones(len(mine), bool), np.arange(len(mine)), cell_values, job.task)

        if on_cells:
            cells, found = ada_by_cells(table, jobs, adas, cuts)
            values = [read([t.value[t.descend(cells)] for t, _ in members], [s for _, s in members]) for members in found]
            told = [tuple(told_of(j.task, 0, 0, cells, v.T).to_pylist()[0].values()) for j, v in zip(jobs, values)]
            scores = staged_by_cell(table, dataset.sparkSession.createDataFrame(told, by_cell.PREDICTED), [(j.task, j.fold) for j in jobs], stages, len(cuts))
        else:
            scores = stage_scores(subtrees(packed(table, jobs, {}), jobs, [], cuts, {}, use, PREDICTED) if small else table.mapInArrow(score, PREDICTED), stages)
        where = [(k, keys.index((a.rate, a.growth.max_depth)), a.rounds) for k, a in enumerate(asked)]
        places = dataset.sparkSession.createDataFrame(where, "point int, _run int, rounds int")
        parts = scores.select((F.col("task") % len(runs)).cast("int").alias("_run"), F.floor(F.col("task") / len(runs)).cast("int").alias("fold"),
                                                  "rounds", "r2", "mae", "rmse", "n")
        return parts.join(F.broadcast(places), ["_run", "rounds"]).select("point", "fold", "r2", "mae", "rmse", "n")
