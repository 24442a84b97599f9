"""Near-duplicates by fast similarity sketching, banding and exact verification.

A sketch has ``COORDINATES`` places.  Round after round every shingle of a set is hashed into one place, and a place keeps
the least hash of the first round that reached it; rounds after ``COORDINATES`` serve one place each, so every place is
filled for sure.  Two sets agree in a place with a probability of their similarity, as concentrated as for independent
draws, at a cost near the size of the set.  Sets that share a band of the sketch are candidates, confirmed on whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airgrid.llm.catalog import register, table
from airgrid.llm.components import members, star_forest
from airgrid.llm.tasks import slices, stored
from airgrid.llm.tiles import text_key
from airgrid.llm.words import BASES, Powers, Sums, Words, mixed

BANDS, BAND_ROWS = 40, 5  # a pair at similarity 0.8 shares no band with a probability of 1.3e-7
COORDINATES = BANDS * BAND_ROWS
LEAST_PERCENT = 80  # below it the bands would miss more: 0.06 % of pairs at 0.7, 3.9 % at 0.6
FREQUENT = 16  # sets that hold a shingle, from which it is no key of its own
PLACES = 128  # hashed places in which frequent shingles are counted


def shingle_sets(texts: list[bytes], words: int, powers: Powers) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit names; a text of fewer words is one shingle, one without words none."""
    found = Words([t.lower() for t in texts], powers=powers)  # bytes: A to Z only
    n = np.diff(found.first)
    begins, names = found.runs(words)
    owner = found.text_of_word()[begins]
    short = np.flatnonzero((n > 0) & (n < words))
    if len(short):
        owner = np.concatenate([owner, short])
        names = np.concatenate([names, Sums(found.names, powers).names(found.first[short], found.first[short + 1])])
    order = np.lexsort((names, owner))
    owner, names = owner[order], names[order]
    new = np.ones(len(names), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (names[1:] != names[:-1])
    owner, names = owner[new], names[new]
    return np.split(names, np.searchsorted(owner, np.arange(1, len(texts))))


def sketches(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """One row per set, which must not be empty: the hash kept in each place, mixed with the round it was placed in."""
    out = np.full((len(sets), coordinates), np.uint64(0xFFFFFFFFFFFFFFFF))
    names = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    filled = np.zeros((len(sets), coordinates), bool)
    for r in range(2 * coordinates):
        if not len(names):
            break
        with np.errstate(over="ignore"):
            h = mixed(names + np.uint64(r + 1) * BASES[1])
        if r < coordinates:
            place = ((h >> np.uint64(32)) * np.uint64(coordinates) >> np.uint64(32)).astype(np.int64)
        else:
            place = np.full(len(h), r - coordinates)
        # hashes of this round: 40 bits under the number of the round, so an earlier round always wins
        value = (np.uint64(r) << np.uint64(40)) | (mixed(h) >> np.uint64(24))
        np.minimum.at(out.reshape(-1), owner * coordinates + place, value)
        filled[owner, place] = True
        open_sets = ~filled.all(axis=1)
        left = open_sets[owner]
        names, owner = names[left], owner[left]
    return out


def band_keys(sketch: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key per band; keys of different bands differ."""
    rows = sketch.shape[1] // bands
    with np.errstate(over="ignore"):
        keys = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None] * BASES[0], len(sketch), axis=0)
        for k in range(rows):
            keys = mixed(keys ^ sketch[:, k::rows][:, :bands]) * BASES[1]
    return mixed(keys).view(np.int64)


def _sketched(docs: DataFrame, words: int) -> DataFrame:
    """The other columns, n_shingles, set_key (null without words) and, for the first row of a set in a batch, its bands."""
    keep = [c for c in docs.columns if c != "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(0)
        for batch in slices(batches, "_text"):
            sets = shingle_sets(batch.column("_text").to_pylist(), words, powers)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            first = {k: i for i, k in reversed(list(enumerate(keys))) if k}
            rows = sorted(first.values())
            bands: list = [None] * len(sets)
            for i, b in zip(rows, band_keys(sketches([sets[i] for i in rows]))):
                bands[i] = b
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                [*keep, "n_shingles", "set_key", "bands"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.mapInArrow(run, f"{kinds}, n_shingles bigint, set_key binary, bands array<bigint>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """set_key and the set itself, of each row of ``docs(_text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(0)
        for batch in slices(batches, "_text"):
            sets = [s for s in shingle_sets(batch.column("_text").to_pylist(), words, powers) if len(s)]
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                                             ["set_key", "shingles"])

    return docs.select("_text").mapInArrow(run, "set_key binary, shingles array<bigint>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose whole sets are similar enough: 100 * intersection >= percent * union."""
    left = sets.select(F.col("set_key").alias("u"), F.col("shingles").alias("_a"))
    right = sets.select(F.col("set_key").alias("v"), F.col("shingles").alias("_b"))
    both = F.size(F.array_intersect("_a", "_b"))
    return pairs.join(left, "u").join(right, "v").filter(
        both * 100 >= (F.size("_a") + F.size("_b") - both) * percent).select("u", "v")


def _fits(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough at all."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def link_documents(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``; see ``placed_documents``."""
    return placed_documents(docs, words, percent).select("doc_id", "n_shingles", "component_id", "kept")


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the one that is first by doc_id (null last) and text.

    Rows without words are components of their own; rows equal in doc_id and text count as one.
    """
    made = {"_key", "_component", "_id", "_text_key", "_row"}
    if clash := made & set(docs.columns):
        raise ValueError(f"columns made here are there already: {clash}")
    keyed = docs.withColumn("_key", text_key(F.coalesce("text", F.lit(""))))
    rows = placed_documents(keyed.select("doc_id", "text", "_key"), words, percent, ["_key"])
    name = F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id").alias("_id"), F.col("_key").alias("_text_key"))
    grouped = rows.filter("_part is not null").groupBy("_part").agg(F.min(name).alias("first")).select("first.*")
    alone = rows.filter("_part is null").select(name.alias("first")).distinct().select("first.*")
    first = grouped.union(alone).select("_id", "_text_key")
    order = Window.partitionBy("doc_id", "_key").orderBy(F.xxhash64(*docs.columns))
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_text_key"))
    return keyed.join(first, same, "left_semi").withColumn("_row", F.row_number().over(order)).filter("_row = 1").select(*docs.columns)


def placed_documents(docs: DataFrame, words: int = 5, percent: int = 80, extra: Sequence[str] = ()) -> DataFrame:
    """``doc_id, extra, n_shingles, component_id, kept`` and ``_part``, null without words, for every row of ``docs(doc_id, text)``.

    Sets are distinct shingles of ``words`` words, A to Z in lower case.  Equal sets are linked by their key, different ones
    by shared bands, confirmed on their whole sets.  A component's id is its smallest doc_id; a row is kept if it has that id.  Rows
    without words (null and empty texts) are alone.  Null doc_ids never name a component unless all of it is null; then
    the id is null and the rows are kept.  Rows with equal ids are rows of their own.

    Copies meet in an aggregate and never as pairs.  Within a bucket every set meets its first one, then the one with most
    links; only sets that are not connected by then go on, to those of other parts that they can still be similar to.
    A ``percent`` under ``LEAST_PERCENT`` is refused: the bands are made for 80.
    """
    if percent < LEAST_PERCENT:
        raise ValueError(f"the bands find pairs from {LEAST_PERCENT} percent on, not from {percent}")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *extra, F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("_text"))
    rows = stored(_sketched(texts, words), "sketches")
    distinct = rows.filter("bands is not null").groupBy("set_key").agg(F.first("bands").alias("bands"), F.max("n_shingles").alias("n"))
    banded = stored(distinct.select("set_key", "n", F.explode("bands").alias("band")), "bands")
    leaders = banded.groupBy("band").agg(F.min("set_key").alias("lead"), F.min_by("n", "set_key").alias("lead_n"), F.count("*").alias("m")).filter("m > 1")
    met = banded.join(leaders, "band")
    stars = stored(met.filter((F.col("set_key") != F.col("lead")) & _fits(F.col("n"), F.col("lead_n"), percent)).select(
        F.col("lead").alias("u"), F.col("set_key").alias("v")).distinct(), "stars")
    shared = stored(met.select("band", "set_key", "n"), "shared")
    involved = shared.select("set_key").distinct()
    # one row of each involved set brings its text; all narrow but the text itself
    bearers = rows.filter("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("doc_id")).join(involved, "set_key")
    wanted = bearers.select(F.col("doc_id").alias("_id")).distinct()
    sets = stored(_sets(texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi"), words)
                  .join(involved, "set_key", "left_semi").dropDuplicates(["set_key"]), "sets")
    links = stored(_confirmed(stars, sets, percent), "links")
    # each step's links are added to the components found so far, so that a step without new ones takes no further round
    forest = star_forest(links)
    hubs = stored(_to_hubs(shared, members(forest), links, stars, percent), "hubs")
    forest = star_forest(forest.union(_confirmed(hubs, sets, percent)))
    rest = _confirmed(_across(shared, members(forest), sets, stars.union(hubs), percent), sets, percent)
    part = members(star_forest(forest.union(rest)))
    named = rows.drop("bands").join(part.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn(
        "_part", F.coalesce("component", "set_key"))
    smallest = named.filter("_part is not null").groupBy("_part").agg(F.min("doc_id").alias("_least"))
    out = named.join(smallest.withColumnRenamed("_part", "_p"), F.col("_p") == F.col("_part"), "left")
    component = F.when(F.col("_part").isNull(), F.col("doc_id")).otherwise(F.col("_least"))
    return out.select("doc_id", *extra, "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "_part")


def _placed(shared: DataFrame, part: DataFrame) -> DataFrame:
    """Bucket rows with the part their set is in so far; a set without links is a part of its own."""
    return stored(shared.join(part.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn(
        "part", F.coalesce("component", "set_key")).drop("component"), "placed")


def _ordered(pairs: DataFrame, a: str, b: str, done: DataFrame) -> DataFrame:
    """Pairs (u, v) with u before v, each once, less those that have met."""
    met = done.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return pairs.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct().join(met, ["u", "v"], "left_anti")


def _to_hubs(shared: DataFrame, part: DataFrame, links: DataFrame, done: DataFrame, percent: int) -> DataFrame:
    """Each set with the set of its bucket that has the most links so far, unless they are connected."""
    degree = links.select(F.explode(F.array("u", "v")).alias("set_key")).groupBy("set_key").agg(F.count("*").alias("degree"))
    placed = _placed(shared, part)
    hubs = placed.join(degree, "set_key").groupBy("band").agg(
        F.max_by(F.struct("set_key", "n", "part"), F.struct("degree", "set_key")).alias("hub"))
    pairs = placed.join(hubs, "band").filter((F.col("part") != F.col("hub.part")) & _fits(F.col("n"), F.col("hub.n"), percent))
    return _ordered(pairs.select("set_key", F.col("hub.set_key").alias("hub")), "set_key", "hub", done)


def _with_counts(described: DataFrame) -> DataFrame:
    """``places``, the place of each frequent shingle, made to ``counts``, the number in each place."""
    keep = [c for c in described.columns if c != "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [np.bincount(np.array(p, np.int64), minlength=PLACES) for p in batch.column("places").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(counts, pa.list_(pa.int32()))], [*keep, "counts"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in described.schema if f.name in keep)
    return described.mapInArrow(run, f"{kinds}, counts array<int>")


def _across(shared: DataFrame, part: DataFrame, sets: DataFrame, done: DataFrame, percent: int) -> DataFrame:
    """Pairs that may still be linked: sets of a bucket outside its largest part, each with the sets it can be similar to.

    Shingles in ``FREQUENT`` sets or more are frequent, the others rare.  A set x with f frequent shingles must share
    ``percent`` of its shingles with a partner, so at least that less f of its rare ones.  Of its rare shingles, rarest
    first, all but as many less one must then hold a shared one, and a rare shingle has few sets.  Only where f alone is
    enough can a partner share no rare shingle; such a pair meets in its bucket, if the frequent ones that both have in each
    of ``PLACES`` hashed places could add up to enough.  No link is lost, and sets that only look alike are not paired.
    """
    placed = _placed(shared, part)
    sizes = placed.groupBy("band", "part").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("band").agg(F.max_by("part", F.struct("k", "part")).alias("largest"), F.count("*").alias("parts")).filter("parts > 1")
    mixed_rows = stored(placed.join(largest.drop("parts"), "band"), "mixed")
    members = mixed_rows.groupBy("set_key").agg(F.first("n").alias("n"), F.first("part").alias("part"),
                                                F.max(F.col("part") != F.col("largest")).alias("loose"))
    held = sets.join(members.select("set_key"), "set_key", "left_semi").select("set_key", F.explode("shingles").alias("shingle"))
    times = held.groupBy("shingle").agg(F.count("*").alias("times"))
    rare = F.when(F.col("times") < FREQUENT, F.struct("times", "shingle"))
    counted = held.join(times, "shingle").groupBy("set_key").agg(
        F.count_if(F.col("times") >= FREQUENT).alias("frequent"), F.array_sort(F.collect_list(rare)).alias("rare"),
        F.collect_list(F.when(F.col("times") >= FREQUENT, F.pmod("shingle", F.lit(PLACES)).cast("smallint"))).alias("places"))
    need = F.ceil(F.col("n") * percent / 100) - F.col("frequent")
    described = stored(_with_counts(members.join(counted, "set_key").withColumn("need", need)), "described")
    shareable = F.filter("rare", lambda r: r["times"] > 1)
    first = F.slice("rare", F.lit(1), F.greatest(F.size("rare") - F.greatest("need", F.lit(1)) + 1, F.lit(0)).cast("int"))
    keys = F.when(F.col("need") > 0, F.filter(first, lambda r: r["times"] > 1)).otherwise(shareable)
    left = described.filter("loose").select(F.col("set_key").alias("a"), F.col("part").alias("part_a"), F.col("n").alias("n_a"),
                                            F.explode(F.transform(keys, lambda r: r["shingle"])).alias("shingle"))
    right = described.select(F.col("set_key").alias("b"), F.col("part").alias("part_b"), F.col("n").alias("n_b"),
                             F.explode(F.transform(shareable, lambda r: r["shingle"])).alias("shingle"))
    apart = (F.col("part_a") != F.col("part_b")) & _fits(F.col("n_a"), F.col("n_b"), percent)
    by_rare = left.join(right, "shingle").filter(apart)
    in_bucket = mixed_rows.select("band", "set_key").join(described.drop("rare", "frequent"), "set_key")
    x = in_bucket.filter("loose AND need <= 0").select("band", F.col("set_key").alias("a"), F.col("part").alias("part_a"), F.col("n").alias("n_a"),
                                                       F.col("counts").alias("counts_a"))
    y = in_bucket.join(x.select("band").distinct(), "band", "left_semi").select(
        "band", F.col("set_key").alias("b"), F.col("part").alias("part_b"), F.col("n").alias("n_b"), F.col("counts").alias("counts_b"))
    most = F.aggregate(F.zip_with("counts_a", "counts_b", lambda a, b: F.least(a, b)), F.lit(0), lambda acc, c: acc + c)
    by_bucket = x.join(y, "band").filter(apart & (most * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent))
    return _ordered(by_rare.select("a", "b").union(by_bucket.select("a", "b")), "a", "b", done)


SQL_COMPONENTS = """WITH RECURSIVE docs AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(
        coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words FROM documents),
    w AS (SELECT rid, len(words) AS n, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM docs),
    shingles AS (SELECT DISTINCT rid, s FROM (SELECT rid, n, i, w || chr(32) || coalesce(lead(w) OVER (PARTITION BY rid ORDER BY i), '') AS s FROM w)
        WHERE i < n OR n = 1),
    sizes AS (SELECT rid, count(*) AS n FROM shingles GROUP BY rid),
    shared AS (SELECT a.rid AS u, b.rid AS v, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.rid < b.rid GROUP BY ALL),
    links AS (SELECT u, v FROM shared JOIN sizes x ON x.rid = u JOIN sizes y ON y.rid = v WHERE 100 * k >= 80 * (x.n + y.n - k)),
    both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
    reached AS (SELECT rid, rid AS other FROM docs UNION SELECT r.rid, b.v FROM reached r JOIN both_ways b ON r.other = b.u),
    named AS (SELECT r.rid, min(d.doc_id) AS component_id FROM reached r JOIN docs d ON d.rid = r.other GROUP BY r.rid)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM docs JOIN named USING (rid) LEFT JOIN sizes USING (rid)"""


@register("op3_fast_similarity_sketch", SQL_COMPONENTS)
def near_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles, similarity 0.8 or more, over all of ``documents``."""
    return link_documents(table(spark, sf_dir, "documents"), words=2)
