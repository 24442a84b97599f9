"""Forests grown level by level from sums that tasks add up, many trees, folds and settings at a time.

Every feature is coded by its place among at most 256 quantiles.  While a node of a tree holds more rows than a task should,
one Spark job a level sums (rows, weights, labels) per job, node, feature and code where the rows are, and adds the sums up
in a shuffle.  Once all nodes are small enough their rows are packed and brought together by node, and tasks finish the
subtrees.  Trees stay in a table in the shared folder; the driver sees the upper levels only.

A job is a set of trees over the rows outside one fold.  The rows held out go down the trees as they are grown, so that
scores of folds, and of all settings that are prefixes of one another (fewer trees, less depth, larger nodes), come from
the same pass and no model leaves the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasSeed
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable,
                             MLWriter)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.learning.base import Supervised
from airgrid.learning.cells import PREDICTED, added_stages, as_bytes, batch_arrays, cell_table, scores_by_cell, summed_draws, told_of
from airgrid.learning.growing import (Growth, Tree, best_splits, bootstrap_counts, cell_sums, cells_of, grow, keys_of, root_path)
from airgrid.session import materialise, scratch_path

CODES = 256  # a code is one byte
LOCAL_ROWS = 1_000_000  # rows of a node that one task finishes
SUMS_BYTES = 64 << 20  # of sums that a task holds at a time
MODEL_BYTES = 64 << 20  # of trees that are sent to the tasks at a time
KNOWN_CELLS = 1_000_000  # whose predictions a task remembers
TREES_AT_A_TIME = 10  # trees of a job that share one copy of the rows

CODED = "id bigint, fold int, y double, codes binary"
PACKED = "job int, node int, ids binary, ys binary, codes binary, held binary"
TABLE = "tree int, part int, feature binary, cut binary, left binary, value binary, n binary, gain binary"
SCORED = "task int, held boolean, id bigint, y double, copies bigint, growth int, stage int, sums array<double>"
KINDS = {"feature": np.int16, "cut": np.uint8, "left": np.int32, "value": np.float64, "n": np.int64, "gain": np.float64}


@dataclass(frozen=True)
class Job:
    """Trees ``trees[0]`` to ``trees[1] - 1`` over the rows outside ``fold`` (-1: all) whose id is at most ``upto``."""

    number: int
    fold: int = -1
    trees: tuple[int, int] = (0, 1)
    task: int = 0  # what its scores are of
    stage: int = 0  # scores of a stage include those of the stages before it
    upto: int = (1 << 63) - 1
    score_training: bool = False


def feature_cuts(rows: DataFrame) -> list[np.ndarray]:
    """Ascending values of each feature of ``rows(x)`` that codes stand for, the largest last; one mergeable sketch each."""
    first = rows.select(F.size("x")).first()
    if first is None:
        raise ValueError("no rows to fit on")
    names = [f"x{k}" for k in range(first[0])]
    wide = rows.select(*[F.col("x")[k].alias(n) for k, n in enumerate(names)])
    found = wide.approxQuantile(names, [k / CODES for k in range(1, CODES + 1)], 1 / (4 * CODES))
    return [np.unique(q) if q else np.zeros(1) for q in found]


def codes_of(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    return np.stack([np.minimum(np.searchsorted(c, x[:, f]), len(c) - 1) for f, c in enumerate(cuts)], axis=1).astype(np.uint8)


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists of numbers as one array."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def coded(rows: DataFrame, cuts: Sequence[np.ndarray]) -> DataFrame:
    """``rows(id, fold, y, x)`` with one byte a feature, written once for all the passes to come.

    Rows with equal codes lie together, so that a task meets few cells; a cell that holds many rows is cut over several ranges.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = codes_of(matrix(batch.column("x")), cuts)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "fold", "y")], as_bytes(codes)], ["id", "fold", "y", "codes"])

    path = scratch_path(rows.sparkSession, "coded")
    told = rows.select("id", "fold", "y", "x").mapInArrow(encode, CODED).withColumn("_part", F.spark_partition_id())
    told.repartitionByRange("codes", "_part").sortWithinPartitions("codes").drop("_part").write.parquet(path)
    return rows.sparkSession.read.schema(CODED).parquet(path)


def training_rows(dataset: DataFrame, features: str, label: str, fold: str | None = None, row_id: str | None = None) -> DataFrame:
    """``id``, ``fold``, ``y``, ``x`` of the rows with a label; rows that are alike in all inputs and label share an id if none is given."""
    x = vector_to_array(F.col(features))
    y = F.col(label).cast("double")
    key = F.col(row_id).cast("bigint") if row_id else F.xxhash64(x, y)
    return dataset.filter(F.col(label).isNotNull()).select(key.alias("id"), F.coalesce(F.col(fold).cast("int") if fold else F.lit(-2), F.lit(-2)).alias("fold"),
                                                           y.alias("y"), x.alias("x"))


def state_of(batch: pa.RecordBatch) -> np.ndarray:
    """What boosting has put aside for each row: one number a job, or nothing."""
    if "state" not in batch.schema.names:
        return np.zeros((batch.num_rows, 0))
    return np.frombuffer(b"".join(batch.column("state").to_pylist())).reshape(batch.num_rows, -1)


def streamed(key: Sequence[str], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Neighbouring rows with the same key."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            at = tuple(row[k] for k in key)
            if at != now:
                if rows:
                    yield now, rows
                now, rows = at, []
            rows.append(row)
    if rows:
        yield now, rows


def by_labels(job: Job, growth: Growth, ids: np.ndarray, y: np.ndarray, codes: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and targets of the rows of a forest's tree."""
    return bootstrap_counts(ids, job.trees[0], growth.seed) if growth.bootstrap else np.ones(len(ids)), y


def upper_levels(rows: DataFrame, jobs: Sequence[Job], growth: Growth | dict[int, Growth], values: list[np.ndarray], least_rows: int | None = None,
                 view: Callable = by_labels, columns: dict[int, np.ndarray] | None = None) -> dict[int, tuple[Tree, set[int]]]:
    """The levels of one-tree jobs down to nodes of ``least_rows`` (``LOCAL_ROWS``), and which of their leaves are final.

    ``view`` gives the weights and targets of rows; ``columns`` the features that a job may use.
    """
    least_rows = LOCAL_ROWS if least_rows is None else least_rows
    growths = growth if isinstance(growth, dict) else {j.number: growth for j in jobs}
    spark = rows.sparkSession
    tops, final = {}, {j.number: set() for j in jobs}
    for j in jobs:
        tops[j.number] = Tree()
        tops[j.number].add(np.zeros(1), np.zeros(1), root_path(growths[j.number].seed, j.trees[0]))
    open_nodes = {j.number: [0] for j in jobs}
    depth, cells = 0, len(values) * CODES
    while any(open_nodes.values()):
        asked = [(j, n) for j in jobs for n in open_nodes[j.number]]
        at_once = max(1, SUMS_BYTES // (cells * 24))
        open_nodes = {j.number: [] for j in jobs}
        for begin in range(0, len(asked), at_once):
            some = asked[begin:begin + at_once]
            sent = spark.sparkContext.broadcast((tops, some))

            def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                trees, wanted = sent.value
                sums = np.zeros((len(wanted), 3, cells))
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    ids, fold, y, codes = batch_arrays(batch)
                    states = state_of(batch)
                    for number in {j.number for j, _ in wanted}:
                        job = next(j for j, _ in wanted if j.number == number)
                        mine = np.flatnonzero((fold != job.fold) & (ids <= job.upto))
                        weights, target = view(job, growths[number], ids[mine], y[mine], codes[mine], states[mine])
                        node = trees[number].descend(codes[mine])
                        for k, (j, n) in enumerate(wanted):
                            if j.number == number:
                                here = (node == n) & (weights > 0)
                                spots = (codes[mine][here] + np.arange(len(values)) * CODES).ravel()
                                w, t = np.repeat(weights[here], len(values)), np.repeat(target[here], len(values))
                                sums[k] += [np.bincount(spots, minlength=cells), np.bincount(spots, w, cells), np.bincount(spots, w * t, cells)]
                for k in np.flatnonzero(sums[:, 0].any(axis=1)):
                    yield pa.RecordBatch.from_pylist([{"k": int(k), "sums": sums[k].tobytes()}], pa.schema([("k", pa.int32()), ("sums", pa.binary())]))

            def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                trees, wanted = sent.value
                now, total = None, None

                def best() -> pa.RecordBatch:
                    job, n = wanted[now]
                    by_feature = []
                    for f, part in enumerate(np.split(total, len(values), axis=1)):
                        used = np.flatnonzero(part[0])
                        by_feature.append((np.zeros(len(used), np.int64), used, part[:, used]))
                    whole = total[:, :CODES].sum(axis=1, keepdims=True)
                    may = columns[job.number] if columns else None
                    feature, cut, gain, left = best_splits(by_feature, whole, trees[job.number].path[[n]], growths[job.number], values, may)
                    return pa.RecordBatch.from_pylist([{"k": now, "feature": int(feature[0]), "cut": int(cut[0]), "gain": float(gain[0]),
                                                        "whole": whole[:, 0].tolist(), "left": left[:, 0].tolist()}], found)

                found = pa.schema([("k", pa.int32()), ("feature", pa.int32()), ("cut", pa.int32()), ("gain", pa.float64()),
                                   ("whole", pa.list_(pa.float64())), ("left", pa.list_(pa.float64()))])
                for batch in batches:
                    for k, packed in zip(batch.column("k").to_pylist(), batch.column("sums").to_pylist()):
                        if k != now and now is not None:
                            yield best()
                        part = np.frombuffer(packed).reshape(3, cells)
                        now, total = k, part.copy() if k != now else total + part
                if now is not None:
                    yield best()

            summed = rows.mapInArrow(add, "k int, sums binary").repartition("k").sortWithinPartitions("k")
            for r in summed.mapInArrow(choose, "k int, feature int, cut int, gain double, whole array<double>, left array<double>").collect():
                job, n = some[r["k"]]
                tree, (count, weight, total), growth = tops[job.number], r["whole"], growths[job.number]
                if n == 0:
                    tree.value[0], tree.n[0] = total / (weight + growth.l2), count
                if count <= least_rows:
                    continue
                if r["feature"] < 0 or depth >= growth.max_depth or count < max(2, growth.min_split):
                    final[job.number].add(n)
                    continue
                arrays = [np.array([x]) for x in (n, r["feature"], r["cut"], r["gain"])]
                child = int(tree.split(*arrays, np.array(r["whole"])[:, None], np.array(r["left"])[:, None], growth.l2)[0])
                open_nodes[job.number] += [c for c in (child, child + 1) if tree.n[c] > least_rows]
            sent.destroy()
        depth += 1
    return {number: (tree, final[number]) for number, tree in tops.items()}


def packed(rows: DataFrame, jobs: Sequence[Job], tops: dict[int, tuple[Tree, set[int]]]) -> DataFrame:
    """The rows of every job, many to a row, each under the node of the upper levels that it belongs to."""
    sent = rows.sparkSession.sparkContext.broadcast((list(jobs), tops))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, upper = sent.value
        schema = pa.schema([("job", pa.int32()), ("node", pa.int32()), *[(c, pa.binary()) for c in ("ids", "ys", "codes", "held")]])
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, fold, y, codes = batch_arrays(batch)
            for job in work:
                held = fold == job.fold
                mine = np.flatnonzero(held | (ids <= job.upto))
                tree, final = upper.get(job.number, (None, ()))
                node = tree.descend(codes[mine]) if tree else np.zeros(len(mine), np.int64)
                for n in np.unique(node):
                    here = mine[node == n]
                    if n in final:  # nothing left to grow, only rows to score
                        here = here[held[here] | job.score_training]
                    if len(here):
                        yield pa.RecordBatch.from_pylist([{"job": job.number, "node": int(n), "ids": ids[here].tobytes(), "ys": y[here].tobytes(),
                                                           "codes": codes[here].tobytes(), "held": held[here].tobytes()}], schema)

    out = rows.mapInArrow(run, PACKED)
    wide = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * len(jobs) if len(jobs) < 200 else 0)
    return out.repartition(wide, "job", "node").sortWithinPartitions("job", "node")


def subtrees(groups: DataFrame, jobs: Sequence[Job], growths: Sequence[Growth], values: list[np.ndarray], tops: dict[int, tuple[Tree, set[int]]],
             use: Callable, schema: str) -> DataFrame:
    """What ``use`` makes of each group: its job and node, rows and their cells, the trees grown on it, the values of the nodes above."""
    spark = groups.sparkSession
    sent = spark.sparkContext.broadcast(({j.number: j for j in jobs}, tops, values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, upper, cuts = sent.value
        for (number, node), parts in streamed(["job", "node"], batches):
            job = work[number]
            ids, y = (np.frombuffer(b"".join(p[c] for p in parts), kind) for c, kind in (("ids", np.int64), ("ys", np.float64)))
            codes = np.frombuffer(b"".join(p["codes"] for p in parts), np.uint8).reshape(len(ids), -1)
            held = np.frombuffer(b"".join(p["held"] for p in parts), bool)
            order = np.lexsort((y, ids))
            ids, y, codes, held = ids[order], y[order], codes[order], held[order]
            cells, which = cells_of(codes)
            tree, final = upper.get(number, (None, ()))
            above = ancestors(tree, node)

            def trees() -> Iterator[tuple[int, int, Tree]]:
                for t in range(*job.trees):
                    for g, growth in enumerate(growths):
                        if node in final:
                            leaf = Tree()
                            leaf.add(tree.value[[node]], tree.n[[node]], tree.path[[node]])
                            yield t, g, leaf
                            continue
                        drawn = bootstrap_counts(ids, t, growth.seed) if growth.bootstrap else np.ones(len(ids))
                        sums = cell_sums(which, len(cells), np.where(held, 0.0, drawn), y)
                        path = tree.path[[node]] if tree else root_path(growth.seed, t)
                        yield t, g, grow(cells, sums, growth, cuts, path, len(above))

            yield from use(job, node, ids, y, held, cells, which, trees(), tree.value[above] if above else [])

    return groups.mapInArrow(run, schema)


def ancestors(tree: Tree | None, node: int) -> list[int]:
    """The nodes from the root to the parent of ``node``."""
    out: list[int] = []
    while tree is not None and node:
        node = int(np.flatnonzero((tree.feature >= 0) & ((tree.left == node) | (tree.left == node - 1)))[0])
        out.insert(0, node)
    return out


def grown(rows: DataFrame, n_rows: int, jobs: Sequence[Job], growths: Sequence[Growth], values: list[np.ndarray], make_use: Callable, schema: str) -> list[DataFrame]:
    """``subtrees`` of all jobs and growths; tables past ``LOCAL_ROWS`` go down their upper levels first, tree by tree."""
    if n_rows <= LOCAL_ROWS:
        return [subtrees(packed(rows, jobs, {}), jobs, growths, values, {}, make_use(0), schema)]
    out = []
    for g, growth in enumerate(growths):
        singles = [(j, t) for j in jobs for t in range(*j.trees)]
        each = [Job(k, j.fold, (t, t + 1), j.task, j.stage, j.upto, j.score_training) for k, (j, t) in enumerate(singles)]
        tops = upper_levels(rows, each, growth, values)
        out.append((subtrees(packed(rows, each, tops), each, [growth], values, tops, make_use(g), schema), each, tops))
    return out


def by_cells(n_rows: int, n_cells: int, draws: int) -> bool:
    """Whether trees are grown from sums per cell: a task can hold the cells, and ``draws`` sums a job are less than its rows."""
    return n_cells <= LOCAL_ROWS and (n_rows > LOCAL_ROWS or 24 * n_cells * draws <= 20 * n_rows)


def counted(table: DataFrame) -> tuple[int, int]:
    """Rows and, within some hundredths, cells of a coded table."""
    return tuple(table.agg(F.count("*"), F.approx_count_distinct("codes", 0.02)).first())


def draws_of(jobs: Sequence[Job], growth: Growth) -> dict[int, Sequence[int]]:
    return {j.number: range(*j.trees) if growth.bootstrap else [-1] for j in jobs}


def grown_by_cells(rows: DataFrame, jobs: Sequence[Job], growths: Sequence[Growth], values: list[np.ndarray], use: Callable, schema: str) -> DataFrame:
    """What ``use`` makes of each job, its cells and (tree, growth, grown tree) for all its draws."""
    seed, bootstrap = growths[0].seed, growths[0].bootstrap
    table = cell_table(rows, jobs, draws_of(jobs, growths[0]), lambda ids, t: bootstrap_counts(ids, t, seed) if bootstrap else None)
    sent = rows.sparkSession.sparkContext.broadcast(({j.number: j for j in jobs}, values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, cuts = sent.value

        def trees(job: Job, t: int, cells: np.ndarray, sums: np.ndarray) -> Iterator[tuple[int, int, Tree]]:
            for k in range(*job.trees) if t < 0 else [t]:
                for g, growth in enumerate(growths):
                    yield k, g, grow(cells, sums, growth, cuts, root_path(growth.seed, k))

        for number, draws in groupby(summed_draws(batches, len(cuts)), key=lambda d: d[0]):
            yield from use(work[number], ((cells, trees(work[number], t, cells, sums)) for _, t, cells, sums in draws))

    return table.mapInArrow(run, schema)


def written_trees(rows: DataFrame, n_rows: int, n_trees: int, growth: Growth, values: list[np.ndarray], n_cells: int | None = None) -> str:
    """Path of the table of ``n_trees`` trees: a row per tree, or per subtree (``part``) below its upper levels (part -1)."""
    spark = rows.sparkSession
    if n_cells is not None and by_cells(n_rows, n_cells, TREES_AT_A_TIME if growth.bootstrap else 1):
        width = max(1, min(TREES_AT_A_TIME, LOCAL_ROWS // max(n_cells, 1)))
        jobs = [Job(k, trees=(b, min(b + width, n_trees))) for k, b in enumerate(range(0, n_trees, width))]

        def rows_of(job, draws):
            for _, trees in draws:
                for t, _, tree in trees:
                    yield tree_row(t, 0, tree)

        path = scratch_path(spark, "trees")
        grown_by_cells(rows, jobs, [growth], values, rows_of, TABLE).write.parquet(path)
        return path
    jobs = [Job(k, trees=(b, min(b + TREES_AT_A_TIME, n_trees))) for k, b in enumerate(range(0, n_trees, TREES_AT_A_TIME))]

    def make_use(_: int) -> Callable:
        def use(job, node, ids, y, held, cells, which, trees, above):
            for t, _, tree in trees:
                yield tree_row(t, node, tree)

        return use

    path = scratch_path(spark, "trees")
    for k, part in enumerate(grown(rows, n_rows, jobs, [growth], values, make_use, TABLE)):
        if isinstance(part, DataFrame):
            part.write.parquet(path)
            continue
        table, each, tops = part
        table.write.parquet(path)
        upper = [tree_row(j.trees[0], -1, tops[j.number][0]).to_pylist()[0] for j in each]
        spark.createDataFrame([tuple(r.values()) for r in upper], TABLE).write.mode("append").parquet(path)
    return path


def tree_row(t: int, part: int, tree: Tree) -> pa.RecordBatch:
    schema = pa.schema([("tree", pa.int32()), ("part", pa.int32()), *[(c, pa.binary()) for c in Tree.NAMES]])
    return pa.RecordBatch.from_pylist([{"tree": t, "part": part, **{c: getattr(tree, c).astype(KINDS[c]).tobytes() for c in Tree.NAMES}}], schema)


def tree_of(row: dict, names: Sequence[str] = Tree.NAMES) -> Tree:
    tree = Tree()
    for c in names:
        setattr(tree, c, np.frombuffer(bytes(row[c]), KINDS[c]))
    if "n" not in names:
        tree.n = np.broadcast_to(np.int64(2), len(tree.feature))
    return tree


def add_readings(sums: np.ndarray, tree: Tree, cells: np.ndarray, readings: Sequence[tuple[int, int]], above: Sequence[float]) -> None:
    """Add what a tree says of each cell, read at each (depth, fewest rows to split); ``above`` has the values over a subtree."""
    for m in {m for _, m in readings}:
        depths = sorted({d for d, k in readings if k == m})
        for d in [d for d in depths if d < len(above)]:  # read above this subtree
            sums[:, readings.index((d, m))] += above[d]
        below = tuple(d - len(above) for d in depths if d >= len(above))
        for d, nodes in zip(below, tree.descend(cells, below, m) if below else []):
            sums[:, readings.index((d + len(above), m))] += tree.value[nodes]


def fold_scores(rows: DataFrame, n_rows: int, jobs: Sequence[Job], growths: Sequence[Growth], values: list[np.ndarray], readings: Sequence[Sequence[tuple[int, int]]],
                trees_upto: Sequence[int], n_cells: int | None = None) -> DataFrame:
    """(task, held, growth, reading, stage, r2, mae, rmse, n) of the mean prediction of the first trees.

    ``readings`` lists for each growth the (depth, fewest rows to split) at which its trees are read; ``trees_upto`` the
    number of trees up to each stage.
    """
    if n_cells is not None and by_cells(n_rows, n_cells, TREES_AT_A_TIME if growths[0].bootstrap else 1):

        def told_by(job, draws):
            sums, codes = {}, None
            for cells, trees in draws:
                codes = cells
                for _, g, tree in trees:
                    if g not in sums:
                        sums[g] = np.zeros((len(cells), len(readings[g])))
                    add_readings(sums[g], tree, cells, readings[g], [])
            for g, total in sums.items():
                yield told_of(job.task, g, job.stage, codes, total)

        told = added_stages(grown_by_cells(rows, jobs, growths, values, told_by, PREDICTED), trees_upto, len(values))
        found = scores_by_cell(rows, told, {j.task: (j.fold, j.upto, j.score_training) for j in jobs}, len(values))
        n_stages = len(trees_upto)
        return found.select("task", "held", "growth", F.floor(F.col("place") / n_stages).cast("int").alias("reading"), "n", (F.col("place") % n_stages).alias("stage"),
                            "r2", "mae", "rmse")

    def make_use(offset: int) -> Callable:
        def use(job, node, ids, y, held, cells, which, trees, above):
            scored = np.flatnonzero(held | job.score_training)
            if not len(scored):
                return
            # rows that are alike share an id, and so a group
            _, first, copies = np.unique(ids[scored], return_index=True, return_counts=True)
            scored = scored[first]
            seen, at = np.unique(which[scored], return_inverse=True)
            sums = {}
            for _, g, tree in trees:
                mine = readings[g + offset]
                if g not in sums:
                    sums[g] = np.zeros((len(seen), len(mine)))
                add_readings(sums[g], tree, cells[seen], mine, above)
            for g, total in sums.items():
                flat = total[at]
                count = len(scored)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(count + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(count, job.task, np.int32)), pa.array(held[scored]), pa.array(ids[scored]), pa.array(y[scored]), pa.array(copies),
                     pa.array(np.full(count, g + offset, np.int32)), pa.array(np.full(count, job.stage, np.int32)), lists],
                    ["task", "held", "id", "y", "copies", "growth", "stage", "sums"])

        return use

    parts = grown(rows, n_rows, jobs, growths, values, make_use, SCORED)
    told = None
    for part in parts:
        part = part if isinstance(part, DataFrame) else part[0]
        told = part if told is None else told.unionByName(part)
    key = ["task", "held", "id", "y", "copies", "growth", "reading"]
    long = told.select(*key[:-1], "stage", F.posexplode("sums").alias("reading", "s"))
    per_row = long.groupBy(*key).agg(*[(F.sum(F.when(F.col("stage") <= k, F.col("s"))) / n).alias(f"p{k}") for k, n in enumerate(trees_upto)])
    return scores_of_stages(per_row, ["task", "held", "growth", "reading"], [f"p{k}" for k in range(len(trees_upto))])


def scores_of_stages(rows: DataFrame, by: Sequence[str], predictions: Sequence[str]) -> DataFrame:
    """(by, stage, r2, mae, rmse, n) of several prediction columns of ``rows(y, copies)``, all from one aggregate."""
    n, y = F.col("copies"), F.col("y")
    total = F.sum(n)
    spread = F.sum(n * y * y) - F.sum(n * y) * F.sum(n * y) / total
    stages = [F.struct(F.lit(k).alias("stage"), (1 - F.sum(n * (y - F.col(p)) * (y - F.col(p))) / F.when(spread > 0, spread)).alias("r2"),
                       (F.sum(n * F.abs(y - F.col(p))) / total).alias("mae"), F.sqrt(F.sum(n * (y - F.col(p)) * (y - F.col(p))) / total).alias("rmse"))
              for k, p in enumerate(predictions)]
    return rows.groupBy(*by).agg(total.alias("n"), F.array(*stages).alias("_stages")).select(*by, "n", F.inline("_stages"))


def sum_of_trees(sent: Broadcast, cuts: Sequence[np.ndarray]) -> Callable:
    """A function of feature arrays: the sum of the values that one chunk of trees gives."""

    @F.pandas_udf("double")
    def add(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        above, trees = sent.value
        known, told = np.zeros(0), np.zeros(0)  # cells met in this task, in order, and their sums
        for x in batches:
            if x.empty:
                yield pd.Series([], dtype="float64")
                continue
            cells, which = cells_of(codes_of(np.stack(x.to_numpy()), cuts))
            keys = keys_of(cells)
            if not len(known) or len(known) > KNOWN_CELLS:
                known, told = keys[:0], told[:0]
            at = np.searchsorted(known, keys)
            new = np.flatnonzero(known[np.minimum(at, len(known) - 1)] != keys) if len(known) else np.arange(len(keys))
            if len(new):
                fresh, total = cells[new], np.zeros(len(new))
                reached = {t: tree.descend(fresh) for t, tree in above.items()}
                for t, part, tree in trees:
                    here = np.flatnonzero(reached[t] == part) if t in reached else slice(None)
                    total[here] += tree.value[tree.descend(fresh[here])]
                known, told = np.insert(known, at[new], keys[new]), np.insert(told, at[new], total)
                at = np.searchsorted(known, keys)
            yield pd.Series(told[at][which])

    return add


class ForestModel(Model, Supervised, MLReadable, MLWritable):
    """Trees in a table; the prediction is ``offset`` plus ``scale`` times the sum of theirs."""

    def __init__(self, path: str = "", cuts: Sequence[np.ndarray] = (), offset: float = 0.0, scale: float = 1.0) -> None:
        super().__init__()
        self.path, self.cuts, self.offset, self.scale = path, list(cuts), offset, scale

    @property
    def table(self) -> DataFrame:
        return SparkSession.getActiveSession().read.schema(TABLE).parquet(self.path)

    def chunks(self) -> list[list[tuple[int, int]]]:
        """(tree, part) of the table in groups of at most ``MODEL_BYTES``."""
        size = sum((F.octet_length(c) for c in ("feature", "cut", "left", "value")), F.lit(0))
        out, used = [[]], 0
        for r in self.table.filter("part >= 0").select("tree", "part", size.alias("b")).orderBy("tree", "part").toLocalIterator():
            if used and used + r["b"] > MODEL_BYTES:
                out, used = [*out, []], 0
            out[-1].append((r["tree"], r["part"]))
            used += r["b"]
        return out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        spark, table, cuts = dataset.sparkSession, self.table, self.cuts
        names = ("feature", "cut", "left", "value")
        uppers = {r["tree"]: tree_of(r.asDict(), names) for r in table.filter("part = -1").collect()}
        chunks, name = self.chunks(), self.getPredictionCol()
        out, keep = dataset.withColumn(name, F.lit(0.0)), dataset.columns
        for k, chunk in enumerate(chunks):
            low, high = chunk[0], chunk[-1]
            place = F.struct("tree", "part")
            some = table.filter((F.col("part") >= 0) & place.between(F.struct(F.lit(low[0]), F.lit(low[1])), F.struct(F.lit(high[0]), F.lit(high[1]))))
            sent = spark.sparkContext.broadcast((uppers, [(r["tree"], r["part"], tree_of(r.asDict(), names)) for r in some.select("tree", "part", *names).collect()]))

            add = sum_of_trees(sent, cuts)
            out = out.withColumn(name, F.col(name) + add(vector_to_array(F.col(self.getFeaturesCol()))))
            if k < len(chunks) - 1:
                out = materialise(out)  # one chunk of trees in a task at a time
        return out.select(*keep, (F.col(name) * self.scale + self.offset).alias(name))

    def importances(self) -> np.ndarray:
        """Share of each feature in the decrease of variance, a mean over the trees."""
        size = len(self.cuts)

        def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for t, packed_feature, packed_gain in zip(*[batch.column(c).to_pylist() for c in ("tree", "feature", "gain")]):
                    feature, gain = np.frombuffer(packed_feature, np.int16), np.frombuffer(packed_gain)
                    sums = np.bincount(feature[feature >= 0], gain[feature >= 0], size)
                    yield pa.RecordBatch.from_pydict({"tree": pa.array([t] * size, pa.int32()), "f": pa.array(range(size), pa.int32()), "g": pa.array(sums)})

        each = self.table.select("tree", "feature", "gain").mapInArrow(gains, "tree int, f int, g double").groupBy("tree", "f").agg(F.sum("g").alias("g"))
        whole = each.groupBy("tree").agg(F.sum("g").alias("all"))
        mean = each.join(whole, "tree").groupBy("f").agg((F.sum(F.when(F.col("all") > 0, F.col("g") / F.col("all")).otherwise(0.0)) / F.count("*")).alias("v"))
        out = np.zeros(size)
        for r in mean.collect():  # one row a feature
            out[r["f"]] = r["v"]
        return out / out.sum() if out.sum() else out

    def tree_lines(self, tree: int, depth: int) -> list[tuple[int, int, str]]:
        """Numbered lines (line, level, text) of one tree's first levels."""
        rows = self.table.filter(F.col("tree") == tree).orderBy("part").limit(1).collect()  # the upper levels where there are any
        return lines_of(tree_of(rows[0].asDict()), self.cuts, tree, depth)

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)


def lines_of(tree: Tree, cuts: Sequence[np.ndarray], number: int, depth: int) -> list[tuple[int, int, str]]:
    lines = [f"Tree {number}: {len(tree.feature)} nodes"]
    levels = [0]

    def tell(node: int, level: int) -> None:
        if tree.feature[node] < 0:
            texts = [(f"Predict: {float(tree.value[node])!r}", None)]
        else:
            f, left = int(tree.feature[node]), int(tree.left[node])
            cut = float(cuts[f][tree.cut[node]])
            texts = [(f"If (feature {f} <= {cut!r})", left), (f"Else (feature {f} > {cut!r})", left + 1)]
        for text, child in texts:
            lines.append(text)
            levels.append(level)
            if child is not None and level <= depth:
                tell(child, level + 1)

    tell(0, 1)
    return [(n, level, text) for n, (level, text) in enumerate(zip(levels, lines))]


class _TableWriter(MLWriter):
    def __init__(self, instance: ForestModel) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        about = {"cuts": [c.tolist() for c in self.instance.cuts], "offset": self.instance.offset, "scale": self.instance.scale}
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata=about)
        self.instance.table.write.parquet(f"{path}/trees")


class _TableReader(MLReader):
    def __init__(self, cls: type) -> None:
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> ForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(f"{path}/trees", [np.array(c) for c in metadata["cuts"]], metadata["offset"], metadata["scale"])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class _Forest(Estimator, Supervised, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Averaged trees; see the module's text for how they are grown."""

    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "deepest level", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "fewest rows in a leaf", TypeConverters.toInt)
    minSplit = Param(Params._dummy(), "minSplit", "fewest rows of a node that is split", TypeConverters.toInt)
    featuresPerSplit = Param(Params._dummy(), "featuresPerSplit", "features a split chooses from, 0 for all", TypeConverters.toInt)

    model_class = ForestModel
    random_cuts = bootstrap = False

    def __init__(self, settings: dict) -> None:
        super().__init__()
        self._setDefault(numTrees=100, maxDepth=30, minInstancesPerNode=1, minSplit=2, featuresPerSplit=0, seed=42)
        self._set(**settings)

    def growth(self, **changed) -> Growth:
        """The growth of these parameters; ``minSplit`` is left to the readings."""
        return Growth(**{"max_depth": self.getOrDefault(self.maxDepth), "min_leaf": self.getOrDefault(self.minInstancesPerNode),
                         "min_split": self.getOrDefault(self.minSplit), "features": self.getOrDefault(self.featuresPerSplit),
                         "random_cuts": self.random_cuts, "bootstrap": self.bootstrap, "seed": self.getSeed(), **changed})

    def _fit(self, dataset: DataFrame) -> ForestModel:
        rows = training_rows(dataset, self.getFeaturesCol(), self.getLabelCol())
        cuts = feature_cuts(rows)
        table = coded(rows, cuts)
        n_trees, (n_rows, n_cells) = self.getOrDefault(self.numTrees), counted(table)
        path = written_trees(table, n_rows, n_trees, self.growth(), cuts, n_cells)
        return self._copyValues(self.model_class(path, cuts, 0.0, 1.0 / n_trees))

    def staged_scores(self, dataset: DataFrame, fold: str, n_folds: int, points: Sequence[dict]) -> DataFrame:
        """(point, fold, r2, mae, rmse, n) of every grid point (a dict of parameter names) on every fold, from shared growth.

        Points that differ in trees, depth or ``minSplit`` alone are read off the same trees.
        """
        rows = training_rows(dataset, self.getFeaturesCol(), self.getLabelCol(), fold)
        cuts = feature_cuts(rows)
        full = [{p.name: v for p, v in self.extractParamMap().items()} | p for p in points]
        for p in full:  # as many features as there are, or more, are all of them
            p["featuresPerSplit"] = p["featuresPerSplit"] if p["featuresPerSplit"] < len(cuts) else 0
        shared = sorted({(p["minInstancesPerNode"], p["featuresPerSplit"]) for p in full})
        readings = [sorted({(p["maxDepth"], max(2, p["minSplit"])) for p in full if (p["minInstancesPerNode"], p["featuresPerSplit"]) == s}) for s in shared]
        growths = [self.growth(min_leaf=s[0], features=s[1], max_depth=max(d for d, _ in r), min_split=min(m for _, m in r)) for s, r in zip(shared, readings)]
        counts = sorted({p["numTrees"] for p in full})
        table = coded(rows, cuts)
        jobs = []
        for f in range(n_folds):
            for stage, (begin, end) in enumerate(zip([0, *counts], counts)):
                jobs += [Job(0, f, (b, min(b + TREES_AT_A_TIME, end)), f, stage) for b in range(begin, end, TREES_AT_A_TIME)]
        jobs = [Job(k, j.fold, j.trees, j.task, j.stage) for k, j in enumerate(jobs)]
        n_rows, n_cells = counted(table)
        found = fold_scores(table, n_rows, jobs, growths, cuts, readings, counts, n_cells)
        where = [(k, shared.index((p["minInstancesPerNode"], p["featuresPerSplit"])), readings[shared.index((p["minInstancesPerNode"], p["featuresPerSplit"]))].index(
            (p["maxDepth"], max(2, p["minSplit"]))), counts.index(p["numTrees"])) for k, p in enumerate(full)]
        places = dataset.sparkSession.createDataFrame(where, "point int, growth int, reading int, stage int")
        return found.join(F.broadcast(places), ["growth", "reading", "stage"]).select("point", F.col("task").alias("fold"), "r2", "mae", "rmse", "n")

    def curve(self, dataset: DataFrame, fold: str, row_id: str, tasks: Sequence[tuple[int, int]]) -> DataFrame:
        """(task, held, r2, n) for tasks (fold, largest row_id to learn from), all grown in one pass over the rows."""
        rows = training_rows(dataset, self.getFeaturesCol(), self.getLabelCol(), fold, row_id)
        cuts = feature_cuts(rows)
        table = coded(rows, cuts)
        n_trees, growth = self.getOrDefault(self.numTrees), self.growth()
        jobs = [Job(0, f, (b, min(b + TREES_AT_A_TIME, n_trees)), k, 0, upto, True) for k, (f, upto) in enumerate(tasks) for b in range(0, n_trees, TREES_AT_A_TIME)]
        jobs = [Job(k, j.fold, j.trees, j.task, j.stage, j.upto, True) for k, j in enumerate(jobs)]
        n_rows, n_cells = counted(table)
        return fold_scores(table, n_rows, jobs, [growth], cuts, [[(growth.max_depth, growth.min_split)]], [n_trees], n_cells)


class RandomForestModel(ForestModel):
    """A fitted ``RandomForest``."""


class RandomForest(_Forest):
    """Each tree on rows drawn with replacement (by Poisson counts), best cuts of the features at each node."""

    model_class, bootstrap = RandomForestModel, True

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", numTrees=100, maxDepth=30, minInstancesPerNode=1, minSplit=2,
                 featuresPerSplit=0, seed=42) -> None:
        super().__init__(self._input_kwargs)


class ExtraTreesModel(ForestModel):
    """A fitted ``ExtraTrees``."""


class ExtraTrees(_Forest):
    """Each tree on all rows; at each node one cut a feature is drawn evenly between its least and largest value there."""

    model_class, random_cuts = ExtraTreesModel, True

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", numTrees=100, maxDepth=30, minInstancesPerNode=1, minSplit=2,
                 featuresPerSplit=0, seed=42) -> None:
        super().__init__(self._input_kwargs)
