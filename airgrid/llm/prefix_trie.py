"""Prefix trie of conversations, with the prefixes that only one conversation has kept out of the shuffle.

A prefix is named by the sum of the digests of its numbered turns, so names come from running sums and a conversation of
any length is cut over tasks.  A count-min sketch counts the names first.  It never counts too low: an estimate of one
proves that a prefix, and all that follows it in its conversation, belongs to that conversation alone.  Such tails are
given out where they lie; only the prefixes before them are shuffled and grouped by their exact names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.llm.catalog import register, table
from airgrid.llm.scans import in_order, with_sums, wrapped
from airgrid.llm.tasks import stored
from airgrid.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
SKETCH_ROWS = 3
MOST_COUNTERS = 1 << 24  # a row of the sketch; one byte each, so a task holds 48 MB at most
PIECE = 1 << 16  # counters in one row of the table of sketch pieces
ENDS_SPAN = 1 << 12  # of conv_ids in one row on their way to a hash; a power of two
NAME = ["d0", "d1"]  # the two halves of a prefix's name
BASE_STEP, HEAD_TURNS = 20, 3  # the query's rebuilt conversations start with up to three turns of every twentieth


def turn_rows(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``key`` (digest of role and text) and ``n_words``; texts stay behind."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("key"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("n_words"))


def placed(turns: DataFrame) -> DataFrame:
    """Turns with ``place``, from 1, in their conversation: by turn (null first), then by the digest of role and text.

    ``is_last`` tells a conversation's last turn.
    """
    ordered = in_order(turns, "conv_id", [F.col("turn").asc_nulls_first(), "key"])
    return with_sums(ordered.drop("turn"), "conv_id", {"place": F.lit(1)}, "is_last")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Placed turns of the query's conversations: up to three turns of conversation c - c % 20, then what c has after as many.

    Every conversation also gets a row with place 0 and neither key nor words, so that one without turns is not lost.
    """
    sizes = turns.filter("is_last").select("conv_id", F.col("place").alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % BASE_STEP
    wanted = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    known = stored(sizes.select("conv_id", base.alias("_base"), wanted.alias("_skip"), "n"), "sizes")
    there = known.select(F.col("conv_id").alias("_base"), F.least("n", F.lit(HEAD_TURNS)).alias("_there"))
    plans = known.filter(F.col("conv_id") % BASE_STEP != 0).join(there, "_base", "left").select(
        "conv_id", "_base", "_skip", F.least("_skip", F.coalesce("_there", F.lit(0))).alias("_given"))
    heads = turns.filter((F.col("conv_id") % BASE_STEP == 0) & (F.col("place") <= HEAD_TURNS)).select(
        F.col("conv_id").alias("_base"), "key", "n_words", "place")
    given = plans.join(heads, "_base").filter(F.col("place") <= F.col("_given")).select("conv_id", "key", "n_words", "place")
    own = turns.join(plans, "conv_id", "left").filter(F.col("place") > F.coalesce("_skip", F.lit(0))).select(
        "conv_id", "key", "n_words", (F.col("place") - F.coalesce("_skip", F.lit(0)) + F.coalesce("_given", F.lit(0))).alias("place"))
    return given.unionByName(own).unionByName(roots(known))


def roots(conversations: DataFrame) -> DataFrame:
    return conversations.select("conv_id", F.lit(None).cast("string").alias("key"), F.lit(0).cast("bigint").alias("n_words"),
                                F.lit(0).cast("bigint").alias("place"))


def _half(digest: Column, begin: int) -> Column:
    """Eight bytes of a hexadecimal digest as a signed number."""
    high, low = (F.conv(F.substring(digest, begin + k, 8), 16, 10).cast("bigint") for k in (0, 8))
    return F.shiftleft(high, 32).bitwiseOR(low)


def named_prefixes(turns: DataFrame) -> DataFrame:
    """A row per prefix of placed turns: ``d0``, ``d1`` name it, ``p0``, ``p1`` the prefix before it; written sorted by conversation."""
    tagged = F.sha2(F.concat_ws("/", F.col("place").cast("string"), "key"), 256)
    zero = F.lit(0).cast("bigint")
    halves = [F.when(F.col("key").isNull(), zero).otherwise(_half(tagged, begin)) for begin in (1, 17)]
    rows = turns.select("conv_id", F.col("place").alias("depth"), "n_words", *[h.alias(f"h{k}") for k, h in enumerate(halves)])
    summed = with_sums(in_order(rows, "conv_id", ["depth"]), "conv_id", {d: F.col(f"h{k}") for k, d in enumerate(NAME)}, write=materialise)
    # the name less this turn's part; sums wrap around
    minus = [wrapped(F.col(f"d{k}"), F.bitwise_not(F.col(f"h{k}")), 1).alias(f"p{k}") for k in (0, 1)]
    return summed.select("conv_id", "depth", "n_words", *NAME, *minus)


def places_of(d0: np.ndarray, d1: np.ndarray, row: int, counters: int) -> np.ndarray:
    """Counter of each name in one row of the sketch; ``counters`` is a power of two."""
    mixed = (d0.astype(np.uint64) ^ np.uint64(row * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9) + d1.astype(np.uint64)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0x94D049BB133111EB)
    return (mixed >> np.uint64(20)).astype(np.int64) & (counters - 1)


def count_min(prefixes: DataFrame, counters: int) -> np.ndarray:
    """The sketch of all names: one or more than one is all that matters, so counters stop at two.

    Tasks count for themselves and send what is not empty, piece by piece and compressed; pieces meet in a shuffle and are
    added up as they stream by.  The driver gets ``SKETCH_ROWS`` times ``counters`` bytes.
    """
    piece = min(PIECE, counters)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((SKETCH_ROWS, counters), np.uint8)
        for batch in batches:
            d0, d1 = (batch.column(d).to_numpy() for d in NAME)
            for row in range(SKETCH_ROWS):
                at, times = np.unique(places_of(d0, d1, row, counters), return_counts=True)
                sketch[row, at] = np.minimum(sketch[row, at] + np.minimum(times, 2), 2)
        pieces = sketch.reshape(-1, piece)
        for k in np.flatnonzero(pieces.any(axis=1)):
            yield pa.RecordBatch.from_pydict({"piece": pa.array([k], pa.int32()), "counts": pa.array([pa.compress(pieces[k].tobytes(), "zstd", asbytes=True)], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = None, None

        def done() -> pa.RecordBatch:
            packed = pa.compress(total.tobytes(), "zstd", asbytes=True)
            return pa.RecordBatch.from_pydict({"piece": pa.array([number], pa.int32()), "counts": pa.array([packed], pa.binary())})

        for batch in batches:
            for k, packed in zip(batch.column("piece").to_pylist(), batch.column("counts").to_pylist()):
                counts = np.frombuffer(pa.decompress(packed, piece, "zstd", asbytes=True), np.uint8)
                if k != number:
                    if number is not None:
                        yield done()
                    number, total = k, np.zeros(piece, np.uint8)
                total = np.minimum(total + counts, 2)
        if number is not None:
            yield done()

    kind = "piece int, counts binary"
    met = prefixes.select(*NAME).mapInArrow(count, kind).repartition("piece").sortWithinPartitions("piece").mapInArrow(add, kind)
    out = np.zeros((SKETCH_ROWS * counters // piece, piece), np.uint8)
    for r in met.collect():
        out[r["piece"]] = np.frombuffer(pa.decompress(bytes(r["counts"]), piece, "zstd", asbytes=True), np.uint8)
    return out.reshape(SKETCH_ROWS, counters)


def screened(prefixes: DataFrame, counters: int) -> DataFrame:
    """The prefixes with ``single``: 0: possibly shared, 1: the first that the sketch proves to be its conversation's own, above: all after it.

    Whatever follows a prefix of its own is its own too, also where the sketch's estimate is too high to prove that.  The root is
    always taken as shared.
    ``is_last`` tells a conversation's whole length.
    """
    sketch = count_min(prefixes, counters)
    sent = prefixes.sparkSession.sparkContext.broadcast(pa.compress(sketch.tobytes(), "zstd", asbytes=True))
    size = sketch.size

    held: list[np.ndarray] = []  # a task's copy

    def proven(batch: pa.RecordBatch) -> np.ndarray:
        if not held:
            held.append(np.frombuffer(pa.decompress(sent.value, size, "zstd", asbytes=True), np.uint8).reshape(SKETCH_ROWS, counters))
        d0, d1 = (batch.column(d).to_numpy() for d in NAME)
        least = np.min([held[0][row, places_of(d0, d1, row, counters)] for row in range(SKETCH_ROWS)], axis=0)
        return ((least == 1) & (batch.column("depth").to_numpy() > 0)).astype(np.int64)

    counted = with_sums(prefixes, "conv_id", {"proven": proven}, "is_last")
    follows = (F.col("proven") == 1) & (F.col("_proven") == 0)  # else one conversation would have several first ones
    return counted.withColumn("single", F.when(follows, 2).otherwise(F.col("proven"))).drop("_proven", "proven")


def hashed_ends(ends: DataFrame) -> DataFrame:
    """(d0, d1, depth, ends_sha256) of the conv_ids that end at each node, joined in ascending order.

    Ids of a short span are packed into a piece, at most ``ENDS_SPAN`` of them; a hash takes its pieces in order, as they
    stream by.
    """
    key = ["depth", *NAME]

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            for *node, ids in zip(*[batch.column(c).to_pylist() for c in [*key, "ids"]]):
                if node != now:
                    if now is not None:
                        yield pa.RecordBatch.from_pylist([dict(zip(key, now), ends_sha256=state.hexdigest())])
                    now, state = node, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(key, now), ends_sha256=state.hexdigest())])

    span = F.shiftright("conv_id", ENDS_SPAN.bit_length() - 1)
    ids = F.concat_ws(",", F.sort_array(F.collect_list("conv_id")).cast("array<string>")).alias("ids")
    pieces = ends.groupBy(*key, span.alias("span")).agg(ids)
    return pieces.repartition(*key).sortWithinPartitions(*key, "span").mapInArrow(hash_all, "depth bigint, d0 bigint, d1 bigint, ends_sha256 string")


def build_trie(turns: DataFrame, most_counters: int = MOST_COUNTERS) -> DataFrame:
    """One row per node of the trie of ``turns(conv_id, key, n_words, place)``, a row with place 0 for every conversation among them.

    A node is a distinct sequence of first turns; ``conv_id`` is its smallest member and ``depth`` its length, so the node's
    turns are the first ``depth`` turns of that conversation.  No rows in, no rows out.  Names have 128 bits.  The sketch
    has four counters a prefix up to ``most_counters``; beyond that more prefixes are shuffled, with the same result.
    """
    prefixes = named_prefixes(turns)
    n = max(1, prefixes.count())
    counters = min(most_counters, 1 << max(10, (4 * n - 1).bit_length()))
    rows = screened(prefixes, counters)
    shared, tops, tails = rows.filter("single = 0"), rows.filter("single = 1"), rows.filter("single > 1")
    node = ["depth", *NAME]
    nodes = shared.groupBy(*node).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("n_words").alias("n_words"),
                                      F.max("p0").alias("p0"), F.max("p1").alias("p1"))
    # a node's row meets a row from each child, so that children are counted without a join
    above = [(F.col("depth") - 1).alias("depth"), F.col("p0").alias("d0"), F.col("p1").alias("d1"), F.lit(1).alias("n_children")]
    facts = ["n_convs", "conv_id", "n_words", "p0", "p1"]
    nothing_known = [F.lit(None).cast("bigint").alias(c) for c in facts]
    both = F.array(F.struct(*node, F.lit(0).alias("n_children"), *facts), F.struct(*above, *nothing_known))
    met = nodes.select(F.inline(both)).filter("depth >= 0").unionByName(tops.select(*above, *nothing_known)).groupBy(*node)
    known = stored(met.agg(F.sum("n_children").alias("n_children"), *[F.max(c).alias(c) for c in facts]), "known")
    # a node counts at its smallest member: each conversation hands the sums of its own nodes to the prefixes above them
    leaf = (F.col("n_children") == 0).cast("bigint")
    own = known.select("conv_id", "depth", leaf.alias("leaves"), ((F.col("n_convs") - 1) * F.col("n_words")).alias("tokens"))
    upward = shared.select("conv_id", *node).join(own, ["conv_id", "depth"], "left").select(
        "conv_id", *node, F.coalesce("leaves", F.lit(0)).alias("leaves"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    hung = tops.select("conv_id", *node, F.lit(1).cast("bigint").alias("leaves"), F.lit(0).cast("bigint").alias("tokens"))
    climbing = with_sums(in_order(upward.unionByName(hung), "conv_id", [F.col("depth").desc()]), "conv_id",
                         {"n_leaves": F.col("leaves"), "saved_tokens": F.col("tokens")})
    subtree = climbing.filter("n_leaves > 0 OR saved_tokens > 0").groupBy(*node).agg(
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    ends = hashed_ends(shared.filter("is_last"))
    parents = known.select((F.col("depth") + 1).alias("depth"), F.col("d0").alias("p0"), F.col("d1").alias("p1"), F.col("conv_id").alias("parent_conv_id"))
    nothing = F.sha2(F.lit(""), 256)
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    end_here = F.when(F.col("is_last"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(nothing).alias("ends_sha256")
    alone = [one.alias("n_convs"), F.when(F.col("is_last"), zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"), end_here]
    inner = known.join(subtree, node).join(ends, node, "left").select(
        "conv_id", "depth", "p0", "p1", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
    linked = inner.unionByName(tops.select("conv_id", "depth", "p0", "p1", *alone)).join(parents, ["depth", "p0", "p1"], "left")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return linked.select(*columns).unionByName(tails.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), *alone))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of ``conversations(conv_id, turn, role, text)`` as they are.

    Turns sort by turn (null first), ties by the digest of role and text; repeated rows are turns of their own.  A null role
    or text is empty; rows with a null conv_id belong to no conversation and take no part.  Extra columns do not matter.
    """
    turns = placed(turn_rows(conversations))
    return build_trie(turns.select("conv_id", "key", "n_words", "place").unionByName(roots(turns.filter("is_last"))))


_CRC_TABLE = """SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, b) ORDER BY b) AS t
        FROM (SELECT unnest(range(256)) AS b)"""
# CRC-32 by the reflected polynomial of the standard (a fixed value): a table of 256 remainders, then a step per byte.
SQL_TRIE = f"""WITH remainders AS ({_CRC_TABLE}),
    turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
        sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS k FROM conversations WHERE conv_id IS NOT NULL),
    lists AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY k) AS own FROM turns GROUP BY conv_id),
    skips AS (SELECT conv_id, own, xor(4294967295, list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)) % 4 AS h FROM lists, remainders),
    rebuilt AS (SELECT s.conv_id, coalesce(b.own[1:s.h], []) || coalesce(s.own[s.h + 1:], []) AS turns
        FROM skips s LEFT JOIN lists b ON b.conv_id = s.conv_id - s.conv_id % {BASE_STEP}),
    members AS (SELECT conv_id, len(turns) AS n, turns, unnest(range(len(turns) + 1)) AS depth FROM rebuilt),
    named AS (SELECT conv_id, n, depth, CASE WHEN depth = 0 THEN [] ELSE turns[1:depth] END AS name,
        CASE WHEN depth < 2 THEN [] ELSE turns[1:depth - 1] END AS above, CASE WHEN depth = 0 THEN '' ELSE turns[depth].text END AS last FROM members),
    nodes AS (SELECT depth, name, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(above) AS above,
        any_value(len(list_filter(string_split_regex(last, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''))) AS words,
        coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '') AS ends FROM named GROUP BY depth, name),
    children AS (SELECT depth - 1 AS depth, above AS name, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
    known AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.depth = n.depth AND c.name = n.name),
    -- a node lies below another if its first turns are the other's
    sums AS (SELECT a.depth, a.name, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.words)::BIGINT AS saved_tokens
        FROM known a JOIN known b ON b.depth >= a.depth AND CASE WHEN a.depth = 0 THEN [] ELSE b.name[1:a.depth] END = a.name GROUP BY ALL)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved_tokens, sha256(k.ends) AS ends_sha256
FROM known k JOIN sums s ON s.depth = k.depth AND s.name = k.name LEFT JOIN nodes p ON p.depth = k.depth - 1 AND p.name = k.above"""


@register("op12_prefix_trie", SQL_TRIE)
def trie_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of conversations that start with up to three turns of every twentieth one."""
    return build_trie(rebuilt(placed(turn_rows(table(spark, sf_dir, "conversations")))))
