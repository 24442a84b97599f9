"""Suffix-array deduplication with a difference cover, for repeated strings of a fixed length.

The places of a text whose remainder modulo ``PERIOD`` is in a difference cover are sampled: for any two places there is a
shift below ``PERIOD`` that takes both to sampled ones.  Sampled suffixes are sorted and named by their first ``SAMPLE_BYTES``
bytes.  A suffix that shares its first ``LENGTH`` bytes with another shares, at that shift, a sampled name with it; so only
suffixes next to a name found twice remain to be merged.  Their prefixes of ``LENGTH`` bytes are named in turn, sorted
over all tiles, and equal neighbours are repeats.  Order beyond ``LENGTH`` bytes decides nothing and is not worked out: the
recursion on names ends where two names span the prefix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.llm.catalog import register, table
from airgrid.llm.tasks import stored
from airgrid.llm.tiles import (NO_ID, QUESTION, Tiles, answered, bits_of, bucket_of, build_tiles, difference_cover_places, held_elsewhere,
                               low_bytes, marked, questions, text_key)
from airgrid.llm.words import Powers, Sums, byte_values

LENGTH = 200  # bytes
PERIOD = 133
COVER = (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)  # fixed values: every remainder is a difference of two of them, once
SAMPLE_BYTES = LENGTH - PERIOD + 1
NAME_BYTES = 5  # of a sampled name, beside its bucket; a false match only leaves a suffix in the merge
BUCKET_NAMES = 250_000  # names expected in a bucket


class Tile:
    """The texts of a tile and the names asked about them."""

    def __init__(self, data: bytes, sizes: list[int], n_bytes: int, powers: tuple[Powers, Powers]):
        self.data = np.frombuffer(data, np.uint8)
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.sums = Sums(byte_values(0)[self.data], powers[0])
        self.powers = powers[1]
        self.sample_buckets = 1 + n_bytes * len(COVER) // PERIOD // BUCKET_NAMES
        self.merge_buckets = 1 + n_bytes // (8 * BUCKET_NAMES)

    def sampled(self) -> None:
        """Names of the sampled places, each once and in order, and how often the tile has them."""
        most = int(self.sizes.max(initial=0))
        places = difference_cover_places(COVER, PERIOD, max(0, most - SAMPLE_BYTES + 1))
        long = self.sizes >= LENGTH
        upto = np.searchsorted(places, self.sizes - SAMPLE_BYTES + 1)
        parts = [s + places[:k] for s, k in zip(self.starts[long].tolist(), upto[long].tolist())]
        self.places = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        ends = (self.starts + self.sizes)[long]
        self.text_begin, self.text_end = np.repeat(self.starts[long], [len(p) for p in parts]), np.repeat(ends, [len(p) for p in parts])
        names = self.sums.names(self.places, self.places + SAMPLE_BYTES)
        self.names, self.name_of_place, self.times = np.unique(names, return_inverse=True, return_counts=True)
        self.name_buckets = bucket_of(self.names, self.sample_buckets)

    def remaining(self, answers: list | None) -> None:
        """Prefixes of the suffixes that remain: those within reach of a sampled name found twice."""
        shared = (bits_of(self.name_buckets, answers) | (self.times > 1))[self.name_of_place]
        place, begin, end = self.places[shared], self.text_begin[shared], self.text_end[shared]
        low, high = np.maximum(begin, place - PERIOD + 1), np.minimum(place, end - LENGTH)
        there = low <= high
        self.begins = np.flatnonzero(marked(len(self.data), low[there], high[there] + 1))
        names = self.sums.names(self.begins, self.begins + LENGTH)
        second = Sums(byte_values(1)[self.data], self.powers)
        buckets = bucket_of(second.names(self.begins, self.begins + LENGTH), self.merge_buckets)
        order = np.lexsort((names, buckets))
        names, buckets = names[order], buckets[order]
        new = np.ones(len(order), bool)
        new[1:] = (names[1:] != names[:-1]) | (buckets[1:] != buckets[:-1])
        which = np.cumsum(new) - 1
        self.prefixes, self.prefix_buckets = names[new], buckets[new]
        self.prefix_times = np.bincount(which, minlength=len(self.prefixes))
        self.prefix_of_begin = np.empty(len(order), np.int64)
        self.prefix_of_begin[order] = which

    def removed(self, answers: list | None) -> np.ndarray:
        """Bytes covered by prefixes that another suffix has too."""
        twice = (bits_of(self.prefix_buckets, answers) | (self.prefix_times > 1))[self.prefix_of_begin]
        begins = self.begins[twice]
        return marked(len(self.data), begins, begins + LENGTH)


def _each_tile(tiles: Tiles, rows: DataFrame, schema: str, work) -> DataFrame:
    """``work(row, tile) -> RecordBatch`` for every tile."""
    n_bytes = tiles.n_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = (Powers(0), Powers(1))
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                tile = Tile(row["data"], row["sizes"], n_bytes, powers)
                tile.sampled()
                yield work(row, tile)

    return rows.mapInArrow(run, schema)


def _ask_samples(row: dict, tile: Tile) -> pa.RecordBatch:
    return questions(row["tile"], tile.name_buckets, low_bytes(tile.names, NAME_BYTES))


def _ask_prefixes(row: dict, tile: Tile) -> pa.RecordBatch:
    tile.remaining(row["samples"])
    return questions(row["tile"], tile.prefix_buckets, low_bytes(tile.prefixes, 8))


def _cut(row: dict, tile: Tile, whole_characters: bool) -> pa.RecordBatch:
    """What is kept of each text of a tile; with ``whole_characters`` without those cut in two."""
    tile.remaining(row["samples"])
    gone = tile.removed(row["prefixes"])
    out = []
    for key, copies, begin, size in zip(row["keys"], row["copies"], tile.starts.tolist(), row["sizes"]):
        here = gone[begin:begin + size]
        if copies > 1 and size >= LENGTH:
            here = np.ones(size, bool)
        n = int(here.sum())
        spans = int((here[1:] & ~here[:-1]).sum() + here[0]) if n else 0
        kept = tile.data[begin:begin + size][~here].tobytes() if n else row["data"][begin:begin + size]
        out.append((key, size, n, spans, kept.decode("utf-8", "ignore").encode() if n and whole_characters else kept))
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["key", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, whole_characters: bool = False) -> tuple[DataFrame, DataFrame, Tiles]:
    """What is left of each distinct text, and which row has which text.

    Texts are UTF-8 bytes; a null text is an empty one.  Every byte covered by a string of ``LENGTH`` bytes that also
    starts anywhere else, in the same text too, is removed; strings never cross texts.  Rows of equal texts are copies of
    one another and lose all their bytes if there are ``LENGTH`` or more; rows are told apart by nothing else, so null and
    repeated doc_ids do not matter.  Returns (key, n_bytes, n_removed, n_spans, kept), (doc_id, key) and the tiles to close.
    """
    tiles = build_tiles(docs)
    asked = _each_tile(tiles, tiles.frame.select("tile", "sizes", "data"), QUESTION, _ask_samples)
    samples = stored(answered(asked, held_elsewhere(NAME_BYTES)), "samples")
    asked = _each_tile(tiles, tiles.joined(samples=samples).select("tile", "sizes", "data", "samples"), QUESTION, _ask_prefixes)
    prefixes = stored(answered(asked, held_elsewhere(8)), "prefixes")
    rows = tiles.joined(samples=samples, prefixes=prefixes).drop("firsts")
    cut = _each_tile(tiles, rows, "key binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary",
                     lambda row, tile: _cut(row, tile, whole_characters))
    return cut, tiles.members.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))), tiles


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and the digest of the remaining bytes."""
    cut, members, tiles = remove_repeats(docs)
    summed = stored(cut.select("key", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")), "kept")
    tiles.close()
    return members.join(summed, "key").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with ``text`` less its repeated strings; characters cut in two go as well.

    No row goes: a text that is repeated as a whole is left empty.
    """
    if "_key" in docs.columns:
        raise ValueError("column _key is made here")
    cut, _, tiles = remove_repeats(docs.select("doc_id", "text"), whole_characters=True)
    tiles.close()  # its files stay
    left = cut.select(F.col("key").alias("_key"), F.decode("kept", "UTF-8").alias("_kept"))
    rows = docs.withColumn("_key", text_key(F.coalesce("text", F.lit("")))).drop("text")
    return rows.join(left, "_key").select(*[F.col("_kept").alias(c) if c == "text" else F.col(c) for c in docs.columns])


SQL_BYTES = f"""WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, strlen(coalesce(text, '')) AS n,
        hex(encode(coalesce(text, ''))) AS x FROM documents),
    places AS (SELECT rid, unnest(range(n)) AS i FROM docs),
    strings AS (SELECT rid, i, substr(x, 2 * i + 1, 2) AS b,
        CASE WHEN i + {LENGTH} <= n THEN md5(substr(x, 2 * i + 1, {2 * LENGTH})) END AS h FROM places JOIN docs USING (rid)),
    twice AS (SELECT h FROM strings WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
    covered AS (SELECT rid, i, b, bool_or(t.h IS NOT NULL) OVER (
        PARTITION BY rid ORDER BY i ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW) AS gone FROM strings s LEFT JOIN twice t ON s.h = t.h),
    edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY rid ORDER BY i), false) AS begins FROM covered),
    cut AS (SELECT rid, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans,
        string_agg(b, '' ORDER BY i) FILTER (NOT gone) AS kept FROM edges GROUP BY rid)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM docs LEFT JOIN cut USING (rid)"""


@register("op9_difference_cover", SQL_BYTES)
def suffix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
