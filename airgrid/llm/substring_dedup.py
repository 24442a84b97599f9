"""Substring deduplication over a compacted De Bruijn graph of word windows.

Edges of the graph are windows of ``WINDOW`` words.  An edge's source is its occurrence in the text with the smallest doc_id.
Where a text follows one source word for word, its edges form a path that does not branch: they are compacted into one span
with the coordinates of its source.  Spans are confirmed at these coordinates before words are removed.

Edges that occur once need no place in the graph.  Shorter k-mers, sampled at the places of a difference cover, find the rest:
two equal windows hold a k-mer that is sampled in both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.llm.catalog import register, table
from airgrid.llm.tasks import stored
from airgrid.llm.tiles import (NO_ID, QUESTION, Tiles, answered, bits_of, bucket_of, build_tiles, difference_cover_places, held_elsewhere,
                               low_bytes, marked, questions, runs_of)
from airgrid.llm.words import Powers, Sums, byte_values, word_bounds

WINDOW = 50  # words
PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)  # fixed values: every remainder is a difference of two of them, once
SAMPLE_WORDS = WINDOW - PERIOD + 1
NAME_BYTES = 5
BUCKET_NAMES = 250_000
ENTRY = np.dtype([("name", "<u8"), ("first", "<i8"), ("text", "<u4"), ("at", "<u4")])  # an edge as a tile asks about it
SOURCE = np.dtype([("entry", "<u4"), ("tile", "<i8"), ("text", "<u4"), ("at", "<u4")])  # the answer: an edge with a smaller source
SPAN = "tile bigint, text int, begin int, words int, source_tile bigint, source_text int, source_begin int, print binary"


class Tile:
    """The words of a tile's texts, and the edges that may repeat."""

    def __init__(self, row: dict, n_bytes: int, powers: tuple[Powers, Powers]):
        self.tile, self.raw = row["tile"], row["data"]
        data = np.frombuffer(row["data"], np.uint8)
        sizes = np.array(row["sizes"], np.int64)
        self.sizes, self.starts = sizes, np.cumsum(sizes + 1) - sizes - 1
        self.begins, self.ends = word_bounds(data)
        self.first = np.searchsorted(self.begins, np.append(self.starts, len(data) + 1))
        self.n_words = np.diff(self.first)
        names = [Sums(byte_values(f)[data], powers[f]).names(self.begins, self.ends) for f in (0, 1)]
        self.sums = [Sums(n, powers[f]) for f, n in enumerate(names)]
        self.sample_buckets = 1 + n_bytes * len(COVER) // (6 * PERIOD) // BUCKET_NAMES
        self.edge_buckets = 1 + n_bytes // (16 * BUCKET_NAMES)

    def sampled(self) -> None:
        long = self.n_words >= WINDOW
        places = difference_cover_places(COVER, PERIOD, max(0, int(self.n_words.max(initial=0)) - SAMPLE_WORDS + 1))
        upto = np.searchsorted(places, self.n_words - SAMPLE_WORDS + 1)
        parts = [s + places[:k] for s, k in zip(self.first[:-1][long].tolist(), upto[long].tolist())]
        self.places = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.text_of_place = np.repeat(np.flatnonzero(long), [len(p) for p in parts])
        names = self.sums[0].names(self.places, self.places + SAMPLE_WORDS)
        self.names, self.name_of_place, self.times = np.unique(names, return_inverse=True, return_counts=True)
        self.name_buckets = bucket_of(self.names, self.sample_buckets)

    def edges(self, answers: list | None, firsts: list[int]) -> None:
        """Windows within reach of a sampled k-mer found twice: distinct ones with their smallest source in this tile."""
        shared = (bits_of(self.name_buckets, answers) | (self.times > 1))[self.name_of_place]
        place, text = self.places[shared], self.text_of_place[shared]
        low = np.maximum(self.first[text], place - PERIOD + 1)
        high = np.minimum(place, self.first[text + 1] - WINDOW)
        there = low <= high
        self.windows = np.flatnonzero(marked(len(self.begins), low[there], high[there] + 1))
        self.text = np.searchsorted(self.first, self.windows, side="right") - 1
        self.owner = np.array(firsts, np.int64)[self.text]
        names = self.sums[0].names(self.windows, self.windows + WINDOW)
        buckets = bucket_of(self.sums[1].names(self.windows, self.windows + WINDOW), self.edge_buckets)
        order = np.lexsort((self.windows, self.owner, names, buckets))
        names, buckets = names[order], buckets[order]
        new = np.ones(len(order), bool)
        new[1:] = (names[1:] != names[:-1]) | (buckets[1:] != buckets[:-1])
        self.edge_of_window = np.empty(len(order), np.int64)
        self.edge_of_window[order] = np.cumsum(new) - 1
        self.least = order[new]  # of each edge, the window with the smallest doc_id
        self.buckets = buckets[new]
        self.entries = np.empty(len(self.least), ENTRY)
        self.entries["name"], self.entries["first"] = names[new], self.owner[self.least]
        self.entries["text"] = self.text[self.least]
        self.entries["at"] = self.windows[self.least] - self.first[self.text[self.least]]

    def spans(self, answers: list | None) -> list[tuple]:
        """Compacted paths: runs of windows whose sources follow one another in one text with a smaller doc_id."""
        tile = np.full(len(self.entries), self.tile)
        text, at, first = self.entries["text"].astype(np.int64), self.entries["at"].astype(np.int64), self.entries["first"].copy()
        got = {a["bucket"]: a["answer"] for a in answers or []}
        for b, begin, _ in runs_of(self.buckets):
            if b in got:
                found = np.frombuffer(got[b], SOURCE)
                k = begin + found["entry"].astype(np.int64)
                tile[k], text[k], at[k], first[k] = found["tile"], found["text"], found["at"], -1 << 62
        edge = self.edge_of_window
        repeated = first[edge] < self.owner
        w, e = self.windows[repeated], edge[repeated]
        if not len(w):
            return []
        here = self.text[repeated]
        follows = (w[1:] == w[:-1] + 1) & (here[1:] == here[:-1]) & (tile[e][1:] == tile[e][:-1]) & (text[e][1:] == text[e][:-1]) & (at[e][1:] == at[e][:-1] + 1)
        starts = np.concatenate([[0], np.flatnonzero(~follows) + 1])
        ends = np.concatenate([starts[1:], [len(w)]])
        out = []
        for s, n in zip(starts.tolist(), (ends - starts).tolist()):
            begin = int(w[s] - self.first[here[s]])
            out.append((self.tile, int(here[s]), begin, n + WINDOW - 1, int(tile[e[s]]), int(text[e[s]]), int(at[e[s]]),
                        self.print_of(int(here[s]), begin, n + WINDOW - 1)))
        return out

    def print_of(self, text: int, begin: int, words: int) -> bytes | None:
        """Digest of a run of words, one blank between them; nothing if the text has no such run."""
        a = int(self.first[text]) + begin
        if a + words > self.first[text + 1]:
            return None
        run = self.raw[int(self.begins[a]):int(self.ends[a + words - 1])]
        return hashlib.blake2b(b" ".join(run.split()), digest_size=16).digest()


def _least_source(tiles: list[int], contents: list[bytes]) -> list[bytes | None]:
    """For each tile the entries whose smallest source stands in another tile, under a smaller doc_id."""
    parts = [np.frombuffer(c, ENTRY) for c in contents]
    entries = np.concatenate(parts)
    tile = np.repeat(np.array(tiles, np.int64), [len(p) for p in parts])
    order = np.lexsort((entries["at"], entries["text"], tile, entries["first"], entries["name"]))
    names = entries["name"][order]
    new = np.ones(len(order), bool)
    new[1:] = names[1:] != names[:-1]
    least = order[new][np.cumsum(new) - 1]  # for each place of the order
    smaller = entries["first"][least] < entries["first"][order]
    mine, source = order[smaller], least[smaller]
    out: list[bytes | None] = []
    begin = 0
    place = np.argsort(mine, kind="stable")
    mine, source = mine[place], source[place]
    for p in parts:
        low, high = np.searchsorted(mine, [begin, begin + len(p)])
        found = np.empty(high - low, SOURCE)
        found["entry"], found["tile"] = mine[low:high] - begin, tile[source[low:high]]
        found["text"], found["at"] = entries["text"][source[low:high]], entries["at"][source[low:high]]
        out.append(found.tobytes() if len(found) else None)
        begin += len(p)
    return out


def _each_tile(tiles: Tiles, rows: DataFrame, schema: str, work) -> DataFrame:
    n_bytes = tiles.n_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = (Powers(0), Powers(1))
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                yield work(row, Tile(row, n_bytes, powers))

    return rows.mapInArrow(run, schema)


def _ask_samples(row: dict, tile: Tile) -> pa.RecordBatch:
    tile.sampled()
    return questions(row["tile"], tile.name_buckets, low_bytes(tile.names, NAME_BYTES))


def _ask_edges(row: dict, tile: Tile) -> pa.RecordBatch:
    tile.sampled()
    tile.edges(row["samples"], row["firsts"])
    return questions(row["tile"], tile.buckets, tile.entries.view(np.uint8).reshape(-1, ENTRY.itemsize))


def _find_spans(row: dict, tile: Tile) -> pa.RecordBatch:
    tile.sampled()
    tile.edges(row["samples"], row["firsts"])
    rows = tile.spans(row["edges"])
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 8, kinds)],
                                      ["tile", "text", "begin", "words", "source_tile", "source_text", "source_begin", "print"])


def _confirm(row: dict, tile: Tile) -> pa.RecordBatch:
    """The prints of the spans that have their source in this tile, worked out from its own words."""
    spans = row["spans"] or []
    prints = [tile.print_of(s["source_text"], s["source_begin"], s["words"]) for s in spans]
    columns = [[tile.tile] * len(spans), *[[s[c] for s in spans] for c in ("source_text", "source_begin", "words")], prints]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["source_tile", "source_text", "source_begin", "words", "there"])


def _cut(row: dict, tile: Tile) -> pa.RecordBatch:
    """Words left of each text of a tile, one blank between them."""
    gone = np.zeros(len(tile.begins), bool)
    for s in row["spans"] or []:
        a = int(tile.first[s["text"]]) + s["begin"]
        gone[a:a + s["words"]] = True
    out = []
    for k, (key, first, begin, size) in enumerate(zip(row["keys"], row["firsts"], tile.starts.tolist(), row["sizes"])):
        words = tile.raw[begin:begin + size].split()
        here = gone[tile.first[k]:tile.first[k + 1]]
        n = int(here.sum())
        out.append((key, first, len(words), n, b" ".join([w for w, g in zip(words, here.tolist()) if not g] if n else words)))
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["key", "first", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame, Tiles]:
    """What is left of each distinct text in its first row, and which row has which text.

    Removed is each word covered by a window of ``WINDOW`` words whose sequence also starts in a row with a smaller
    doc_id.  Words are compared as they are; a null text has none.  A null doc_id is larger than every other, equal to
    other nulls; of rows with equal doc_ids none is smaller.  Later copies of a text lose all words if there are
    ``WINDOW`` or more.  Returns (key, first, n_words, n_removed, kept), (doc_id, key) and the tiles to close.
    """
    tiles = build_tiles(docs)
    asked = _each_tile(tiles, tiles.frame.select("tile", "sizes", "data"), QUESTION, _ask_samples)
    samples = stored(answered(asked, held_elsewhere(NAME_BYTES)), "samples")
    asked = _each_tile(tiles, tiles.joined(samples=samples).select("tile", "sizes", "data", "firsts", "samples"), QUESTION, _ask_edges)
    edges = stored(answered(asked, _least_source), "edges")
    rows = tiles.joined(samples=samples, edges=edges).select("tile", "sizes", "data", "firsts", "samples", "edges")
    spans = stored(_each_tile(tiles, rows, SPAN, _find_spans), "spans")
    # the same source run is looked up once, however many texts repeat it
    wanted = spans.groupBy(F.col("source_tile").alias("_tile")).agg(
        F.collect_set(F.struct("source_text", "source_begin", "words")).alias("spans"))
    at_source = tiles.frame.select("tile", "sizes", "data").join(wanted.hint("shuffle_hash"), F.col("tile") == F.col("_tile"))
    place = ["source_tile", "source_text", "source_begin", "words"]
    there = _each_tile(tiles, at_source.drop("_tile"), "source_tile bigint, source_text int, source_begin int, words int, there binary", _confirm)
    confirmed = spans.join(there, place).filter(F.col("there") == F.col("print")).groupBy(F.col("tile").alias("_tile")).agg(
        F.collect_list(F.struct("text", "begin", "words")).alias("spans"))
    rows = tiles.frame.drop("copies").join(confirmed.hint("shuffle_hash"), F.col("tile") == F.col("_tile"), "left").drop("_tile")
    cut = _each_tile(tiles, rows, "key binary, first bigint, n_words bigint, n_removed bigint, kept binary", _cut)
    return cut, tiles.members, tiles


def repeated_words(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_removed and the digest of the words kept, joined by blanks."""
    cut, members, tiles = remove_repeats(docs)
    summed = stored(cut.select("key", "first", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")), "kept")
    tiles.close()
    # a copy of a shorter text keeps it whole; n_removed is then 0 in the first row as well
    copy = (F.col("doc_id") != F.col("first")) & (F.col("n_words") >= WINDOW)
    return members.join(summed, "key").select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"))


SQL_WORDS = f"""WITH docs AS (SELECT row_number() OVER () AS rid, coalesce(doc_id, {NO_ID}) AS rank, doc_id, list_filter(
        string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words FROM documents),
    w AS (SELECT rid, rank, len(words) AS n, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM docs),
    windows AS (SELECT rid, rank, w, i, CASE WHEN i + {WINDOW - 1} <= n THEN md5(string_agg(w, ' ') OVER (
        PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)) END AS h FROM w),
    least AS (SELECT h, min(rank) AS least FROM windows WHERE h IS NOT NULL GROUP BY h),
    covered AS (SELECT rid, w, i, coalesce(bool_or(least < rank) OVER (
        PARTITION BY rid ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW), false) AS gone FROM windows LEFT JOIN least USING (h)),
    cut AS (SELECT rid, count(*) FILTER (gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM covered GROUP BY rid)
SELECT doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN cut USING (rid)"""


@register("op10_compacted_de_bruijn", SQL_WORDS)
def substring_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words(table(spark, sf_dir, "documents").select("doc_id", "text"))
