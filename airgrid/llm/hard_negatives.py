"""Hard negatives by segment summaries: exact inner products only where cheap bounds leave a pair open.

A vector is cut into segments, and each segment keeps its mean and its deviation (the length of the segment without its
mean).  The inner product of two vectors is, segment by segment, the product of the means times the segment's length, plus
or minus at most the product of the deviations.  Long segments are tried first; pairs that their bounds leave open are
tried again with shorter ones, and what is still open is scored exactly.

The stated query set, the anchors, meets all rows in blocks: a chunk of anchors of bounded bytes is broadcast, each task
streams its rows past it and keeps the few best rows an anchor, and only those are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airgrid.llm.catalog import register, table
from airgrid.llm.tasks import stored
from airgrid.operators.ranking import with_rank
from airgrid.session import scratch_path

SCALE = 256  # components become whole numbers of this fraction
POSITIVES, NEGATIVES = 5, 5
LEAST_PERCENT = 80  # a negative's score, in percent of its positive's, lies between this and 100
CHUNK_BYTES = 4 << 20  # of scaled anchors that are broadcast at a time
CHUNK_ANCHORS, BLOCK_ROWS = 1024, 2048  # a block of scores takes 16 MB
SEGMENTS = (4, 16)  # per vector, coarse to fine
LARGEST = 1 << 15  # components from here on would not fit exact products
NONE = np.iinfo(np.int64).min
FOUND = "anchor bigint, slot int, score bigint, vec_id bigint"


class Summaries:
    """Means (times the root of the segment length) and deviations of the segments of a block of vectors, level by level."""

    def __init__(self, vectors: np.ndarray):
        self.levels = []
        width = vectors.shape[1]
        for parts in SEGMENTS:
            if parts >= width:
                break
            cuts = np.linspace(0, width, parts + 1).astype(int)
            lengths = np.diff(cuts)
            sums = np.add.reduceat(vectors, cuts[:-1], axis=1)
            squares = np.add.reduceat(vectors * vectors, cuts[:-1], axis=1)
            # a hair of slack covers rounding: scores are whole numbers
            self.levels.append((sums / np.sqrt(lengths), np.sqrt(np.maximum(squares - sums * sums / lengths, 0)) * (1 + 1e-9) + 1e-6))

    def taken(self, rows: np.ndarray) -> Summaries:
        out = object.__new__(Summaries)
        out.levels = [(means[rows], devs[rows]) for means, devs in self.levels]
        return out


def open_pairs(a: Summaries, b: Summaries, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and of ``b`` that have a pair which the bounds leave open.

    ``least`` and ``most``, one for each row of ``a``: scores outside them do not matter.  Each level looks only at the
    rows that the level before has left.
    """
    rows, columns = np.arange(len(least)), None
    for level in range(len(a.levels)):
        (means_a, devs_a), (means_b, devs_b) = a.levels[level], b.levels[level]
        if columns is None:
            columns = np.arange(len(means_b))
        middle, width = means_a[rows] @ means_b[columns].T, devs_a[rows] @ devs_b[columns].T
        is_open = (middle + width + 0.5 >= least[rows, None]) & (middle - width - 0.5 <= most[rows, None])
        rows, columns = rows[is_open.any(axis=1)], columns[is_open.any(axis=0)]
        if not len(rows):
            break
    return rows, columns


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number vectors held as doubles."""
    largest = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    return (a @ b.T).astype(np.int64) if largest < 2.0 ** 53 else a.astype(np.int64) @ b.astype(np.int64).T


class Best:
    """The best ``k`` (score, vec_id) of each of several slots, higher scores first, ties by smaller vec_id."""

    def __init__(self, slots: int, k: int):
        self.scores = np.full((slots, k), NONE)
        self.ids = np.zeros((slots, k), np.int64)

    @property
    def worst(self) -> np.ndarray:
        return self.scores[:, -1]

    def offer(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of several slots by candidate, ``NONE`` where a candidate does not count; ids ascend."""
        k = self.scores.shape[1]
        if scores.shape[1] > k:
            # ascending ids: the k-th highest score bounds what can enter; a stable sort keeps the smaller ids of ties
            picked = np.argsort(-np.maximum(scores, NONE + 1), axis=1, kind="stable")[:, :k]
            scores, ids = np.take_along_axis(scores, picked, 1), ids[picked]
        else:
            ids = np.broadcast_to(ids, scores.shape)
        both = np.hstack([self.scores[slots], scores])
        named = np.hstack([self.ids[slots], ids])
        order = np.lexsort((named, -np.maximum(both, NONE + 1)), axis=1)[:, :k]
        self.scores[slots], self.ids[slots] = np.take_along_axis(both, order, 1), np.take_along_axis(named, order, 1)


def vectors_of(batch: pa.RecordBatch) -> np.ndarray:
    """The scaled components of a batch, one row each; shorter vectors are filled up with zeros."""
    column = batch.column("q")
    values, lengths = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy()
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = values
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(vec_id, label, vectors) of bounded blocks of rows, by ascending vec_id in a block."""
    for batch in batches:
        for begin in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(begin, BLOCK_ROWS)
            ids = part.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            yield ids[order], part.column("label").to_numpy()[order], vectors_of(part)[order]


def scan(rows: DataFrame, chunk: Broadcast, k: int, negatives: bool) -> DataFrame:
    """(anchor, slot, score, vec_id): the best of each task's rows for every anchor of one chunk.

    A chunk has lists anchor, label, q and, for negatives, scores: the positives' scores, high to low, one slot each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = chunk.value
        number, label = np.array(sent["anchor"], np.int64), np.array(sent["label"], np.int64)
        width = max(map(len, sent["q"]))
        mine = np.array([np.pad(np.asarray(q, float), (0, width - len(q))) for q in sent["q"]])
        if negatives:
            slots = max(map(len, sent["scores"]))
            aims = np.array([[*s, *[NONE] * (slots - len(s))] for s in sent["scores"]], np.int64)
        else:
            slots, aims = 1, np.full((len(number), 1), np.iinfo(np.int64).max)
        floors = -(-aims * LEAST_PERCENT // 100) if negatives else np.full_like(aims, NONE + 1)
        # no score lies between 80 and 100 percent of a negative one
        used = (aims != NONE) & (floors <= aims)
        best = Best(len(number) * slots, k)
        summary = {width: Summaries(mine)}
        for ids, labels, theirs in blocks(batches):
            anchors_now, theirs = same_width(mine, theirs)
            if anchors_now.shape[1] not in summary:
                summary[anchors_now.shape[1]] = Summaries(anchors_now)
            # a slot that is full asks for more than its floor; equal scores may still win by their id
            asks = np.where(used, np.maximum(floors, best.worst.reshape(aims.shape)), np.iinfo(np.int64).max)
            tops = np.where(used, aims, NONE)
            least, most = asks.min(axis=1).astype(float), tops.max(axis=1).astype(float)
            live = np.flatnonzero(used.any(axis=1))
            a, b = open_pairs(summary[anchors_now.shape[1]].taken(live), Summaries(theirs), least[live], most[live])
            a = live[a]
            b = np.arange(len(ids)) if b is None else b
            if not len(a) or not len(b):
                continue
            scores = products(anchors_now[a], theirs[b])
            counts = (labels[b] != label[a, None]) if negatives else (labels[b] == label[a, None])
            for slot in range(slots):
                fits = counts & (scores >= asks[a, slot, None]) & (scores <= tops[a, slot, None]) & used[a, slot, None]
                hit, by = np.flatnonzero(fits.any(axis=1)), np.flatnonzero(fits.any(axis=0))
                if len(hit):
                    entering = np.ix_(hit, by)
                    best.offer(a[hit] * slots + slot, np.where(fits[entering], scores[entering], NONE), ids[b[by]])
        at, rank = np.nonzero(best.scores != NONE)
        yield pa.RecordBatch.from_arrays([pa.array(number[at // slots]), pa.array((at % slots).astype(np.int32)),
                                          pa.array(best.scores[at, rank]), pa.array(best.ids[at, rank])], ["anchor", "slot", "score", "vec_id"])

    return rows.select("vec_id", "label", "q").mapInArrow(run, FOUND)


def passes(rows: DataFrame, anchors: DataFrame, k: int, negatives: bool) -> DataFrame:
    """``scan`` chunk by chunk, each written before the next is sent."""
    spark = rows.sparkSession
    columns = ["anchor", "label", "q", *["scores"] * negatives]
    folder = scratch_path(spark, "passes")
    spark.createDataFrame([], FOUND).write.parquet(f"{folder}/pass=none")
    for chunk in sorted(r["chunk"] for r in anchors.select("chunk").distinct().collect()):
        some = anchors.filter(F.col("chunk") == chunk).select(*columns).toPandas()  # bounded by CHUNK_BYTES
        sent = spark.sparkContext.broadcast({c: list(some[c]) for c in columns})
        scan(rows, sent, k, negatives).write.parquet(f"{folder}/pass={chunk}")
        sent.destroy()
    return spark.read.schema(FOUND).parquet(folder)


def first_of(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first ``k`` of each group with their ``rank``; tasks cut to ``k`` rows a group before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def scaled_rows(rows: DataFrame) -> DataFrame:
    """``vec_id``, ``label`` and the whole-number components ``q`` of the rows that take part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float(LARGEST))))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fit).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"),
        F.transform(x, lambda v: F.floor(v * SCALE).cast("double")).alias("q"))


def mine(rows: DataFrame, is_anchor: Column) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``rows(vec_id, embedding, label)``.

    A row with a null vec_id, label or vector, or a component that is null, not finite, or 2^15 or more in size, takes no
    part.  An empty vector scores 0 with all; of two lengths the shorter vector is filled up with zeros.  Repeated rows
    count each; an anchor is never its own positive, but a repeated copy of it may be, and repeated anchors give their rows
    each.  Ties go to the smaller vec_id.  Extra columns do not matter; an empty table gives no rows.

    Work: anchors times rows, a pass over the rows a chunk of anchors.  The driver and each task hold one chunk at a time.
    """
    everything = stored(scaled_rows(rows), "vectors")
    anchors = stored(with_rank(everything.filter(is_anchor), ["vec_id", "label", "q"], "anchor"), "anchors")
    width = anchors.agg(F.max(F.size("q"))).first()[0]
    per_chunk = max(1, min(CHUNK_ANCHORS, CHUNK_BYTES // (8 * max(1, width or 1))))
    dealt = anchors.withColumn("chunk", F.floor((F.col("anchor") - 1) / per_chunk))

    # one more than wanted: the anchor itself may be among them
    near = passes(everything, dealt, POSITIVES + 1, False)
    own = F.aggregate("q", F.lit(0).cast("bigint"), lambda total, v: total + (v * v).cast("bigint"))
    named = anchors.select("anchor", F.col("vec_id").alias("anchor_id"), own.alias("own"))
    ranked = first_of(near, ["anchor"], POSITIVES + 1).join(named, "anchor")
    itself = (F.col("vec_id") == F.col("anchor_id")) & (F.col("score") == F.col("own"))
    me = F.row_number().over(Window.partitionBy("anchor", itself).orderBy("rank"))
    others = ranked.withColumn("_me", itself & (me == 1)).filter(~F.col("_me"))
    positives = stored(first_of(others.drop("rank", "slot"), ["anchor"], POSITIVES), "positives")
    aims = positives.groupBy("anchor").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda p: p["score"]).alias("scores"))
    far = passes(everything, stored(dealt.join(aims, "anchor"), "aims"), NEGATIVES, True)
    negatives = first_of(far, ["anchor", "slot"], NEGATIVES).select(
        "anchor", (F.col("slot") + 1).alias("_rank"), F.col("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    aimed = positives.select("anchor", F.col("rank").alias("_rank"), "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return aimed.join(negatives, ["anchor", "_rank"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL_NEGATIVES = f"""WITH vectors AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings)
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scores AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_inner_product(a.q, v.q)::BIGINT AS score
        FROM vectors a JOIN vectors v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
    positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND {LEAST_PERCENT} * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= {NEGATIVES}"""


@register("op13_segment_bounds", SQL_NEGATIVES)
def negatives_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose vec_id is divisible by 100; where it is divisible by 7 the label is moved on first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)
