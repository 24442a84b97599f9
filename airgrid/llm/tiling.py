"""Benchmark decontamination by greedy string tiling.

A document meets a benchmark item through shared seeds, runs of ``MIN_MATCH`` tokens.  The pair is then tiled: the longest
common runs of unmarked tokens are marked first, found by running Karp-Rabin hashes over shorter and shorter windows, until
no common run of ``MIN_MATCH`` tokens is left.  Tiles may stand in any order, so a reordered passage is covered as well.
Where short items are asked for, an item of fewer tokens has one seed and one possible tile: all of it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from airgrid.llm.catalog import register, table
from airgrid.llm.tasks import slices, stored
from airgrid.llm.words import Powers, Sums, Words

MIN_MATCH = 5  # tokens in a seed and in the shortest tile
FIRST_WINDOW = 32  # tokens in the first, longest window
THRESHOLD = 0.5  # share of an item's tokens that tiles must cover
BLOCK_CHARS = 16 << 20  # benchmark characters sent to the tasks at once; larger benchmarks take several passes

# Tokens are runs of letters, marks and digits, compared without regard to case; in scripts written without breaks between words each
# character is one.  ``parted`` puts blanks where non-ASCII text is to be cut, so that bytes decide from there on.
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = False


JOINERS = "\u00ad\u200c\u200d"  # soft hyphen and (non-)joiner stand inside words
# Code points of scripts without word breaks: Thai, Lao, Myanmar, Khmer, the Tai scripts, Balinese, Javanese, radicals, kana,
# bopomofo, Han, Yi, cuneiform, hieroglyphs, Tangut, Khitan, kana supplements, Nushu and the ideographic planes.
UNBROKEN = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x2E80, 0x2FDF),
            (0x3005, 0x3007), (0x3021, 0x3035), (0x3038, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0xA4CF),
            (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x12000, 0x1345F), (0x17000, 0x18DFF),
            (0x1AFF0, 0x1B2FF), (0x20000, 0x3FFFF)]


class Parts(dict):
    """What stands for a character, by code point: itself, a blank, or itself between blanks."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = unicodedata.category(c)
        if any(a <= code <= b for a, b in UNBROKEN) and kind[0] not in "PZ":
            self[code] = f" {c} "
        elif code >= 0x80 and (kind[0] in "PSZ" or kind in ("Cc", "Cf")) and c not in JOINERS:
            self[code] = " "
        else:
            self[code] = c
        return self[code]


PARTS = Parts()


def parted(text: str) -> str:
    if text.isascii() or all(PARTS[ord(c)] == c for c in set(text)):
        return text
    return text.translate(PARTS)


def tokens(texts: list[str], powers: Powers) -> Words:
    return Words([parted(t.lower()).encode() for t in texts], 0, BETWEEN, powers)


def windows(sums: Sums, free: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First tokens and hashes of all windows of ``length`` unmarked tokens."""
    n = len(free) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    marked = np.concatenate([[0], np.cumsum(~free)])
    begins = np.flatnonzero(marked[length:] == marked[:n])
    return begins, sums.names(begins, begins + length)


def tile(item: np.ndarray, text: np.ndarray, powers: Powers, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (begin in item, begin in text, length), none shorter than ``min_match`` and none overlapping.

    Among equally long matches the first in the item, then in the text, is marked.
    """
    free_item, free_text = np.ones(len(item), bool), np.ones(len(text), bool)
    sums_item, sums_text = Sums(item, powers), Sums(text, powers)
    tiles: list[tuple[int, int, int]] = []
    length = max(min_match, min(FIRST_WINDOW, len(item), len(text)))
    while True:
        at_item, in_item = windows(sums_item, free_item, length)
        at_text, in_text = windows(sums_text, free_text, length)
        common = np.isin(in_text, in_item)
        places: dict[int, list[int]] = {}
        for p, name in zip(at_item.tolist(), in_item.tolist()):
            places.setdefault(name, []).append(p)
        found, longest = [], 0
        for t, name in zip(at_text[common].tolist(), in_text[common].tolist()):
            for p in places[name]:
                if p and t and free_item[p - 1] and free_text[t - 1] and item[p - 1] == text[t - 1]:
                    continue  # inside a match that begins earlier
                k = 0
                most = min(len(item) - p, len(text) - t)
                while k < most and free_item[p + k] and free_text[t + k] and item[p + k] == text[t + k]:
                    k += 1
                if k >= length:
                    found.append((-k, p, t))
                    longest = max(longest, k)
        if longest > 2 * length:
            length = longest  # the windows were too short for what is there: begin with the longest
            continue
        cut = False
        for k, p, t in sorted(found):
            if free_item[p:p - k].all() and free_text[t:t - k].all():
                free_item[p:p - k] = free_text[t:t - k] = False
                tiles.append((p, t, -k))
            else:
                cut = True
        if cut:
            continue  # what a longer tile has cut may still hold a match of this length
        if length == min_match:
            return tiles
        length = max(min_match, length // 2)


class Benchmark:
    """Seeds of a block of benchmark items."""

    def __init__(self, items: list[tuple[int | None, str]], min_match: int, short_items: bool = False):
        self.powers = Powers(0)
        words = tokens([t for _, t in items], self.powers)
        self.ids = [i for i, _ in items]
        self.first, self.names = words.first, words.names
        sizes = np.diff(words.first)
        short = np.unique(sizes[(sizes > 0) & (sizes < min_match)]).tolist() if short_items else []
        self.lengths = [min_match, *short]  # tokens in a seed; a short item is one seed
        runs = [words.runs(n) for n in self.lengths]
        for k, n in enumerate(short, 1):
            whole = sizes[words.text_of_word()[runs[k][0]]] == n
            runs[k] = runs[k][0][whole], runs[k][1][whole]
        begins, seeds = map(np.concatenate, zip(*runs))
        order = np.lexsort((begins, seeds))
        self.seeds, self.at = seeds[order], begins[order]
        self.item_of = words.text_of_word()[self.at]
        self.distinct = np.unique(seeds)
        self.min_match = min_match

    def best(self, texts: list[str], threshold: float) -> tuple[list[int], list[tuple]]:
        """Tokens of each text; (item, covered, item's tokens, tiles) of its best covered item, if any is beyond the threshold."""
        words = tokens(texts, self.powers)
        found: list[tuple] = [(None, 0, 0, 0)] * len(texts)
        begins, seeds = map(np.concatenate, zip(*[words.runs(n) for n in self.lengths]))
        if len(self.distinct) and len(seeds):
            place = np.minimum(np.searchsorted(self.distinct, seeds), len(self.distinct) - 1)
            hit = self.distinct[place] == seeds
            owner = words.text_of_word()[begins[hit]]
            for k in np.unique(owner).tolist():
                found[k] = self.tiled(words.names[words.first[k]:words.first[k + 1]], np.unique(seeds[hit][owner == k]), threshold)
        return np.diff(words.first).tolist(), found

    def tiled(self, text: np.ndarray, shared: np.ndarray, threshold: float) -> tuple:
        low, high = np.searchsorted(self.seeds, shared), np.searchsorted(self.seeds, shared, side="right")
        rows = np.concatenate([np.arange(a, b) for a, b in zip(low, high)])
        best: tuple = (None, 0, 0, 0)
        for k in np.unique(self.item_of[rows]).tolist():
            begin, end = int(self.first[k]), int(self.first[k + 1])
            shortest = min(self.min_match, end - begin)
            reach = np.zeros(end - begin, bool)  # what tiles could cover at most
            for at in self.at[rows[self.item_of[rows] == k]] - begin:
                reach[at:at + shortest] = True
            if reach.sum() < threshold * len(reach):
                continue
            tiles = tile(self.names[begin:end], text, self.powers, shortest)
            covered = sum(n for _, _, n in tiles)
            if covered >= threshold * len(reach) and covered * max(1, best[2]) > best[1] * len(reach):
                best = (k, covered, len(reach), len(tiles))
        return best


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, min_match: int = MIN_MATCH,
                  short_items: bool = False) -> DataFrame:
    """The columns of ``docs`` with ``n_tokens, contaminated, item_id, covered, item_tokens, n_tiles`` of the best covered item.

    A row is contaminated if tiles cover ``threshold`` of an item's tokens or more.  Null and empty texts have no tokens
    and are clean.  Items of fewer than ``min_match`` tokens are looked for whole with ``short_items`` and match nothing
    without; null ones and those without tokens match nothing; a null item_id is reported as null.  Of items equally covered
    the one that comes first by text and id counts.

    The benchmark is a query set set against all rows in blocks of ``BLOCK_CHARS``: its size is measured first, and each
    block beyond the first is a further pass over the written rows.
    """
    names = ["n_tokens", "contaminated", "item_id", "covered", "item_tokens", "n_tiles"]
    if clash := set(names) & set(docs.columns):
        raise ValueError(f"columns made here are there already: {clash}")
    spark, keep = docs.sparkSession, docs.columns
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter(F.col("text").isNotNull())
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + int(chars) // BLOCK_CHARS
    made = [StructField(n, BooleanType() if n == "contaminated" else LongType()) for n in names]
    kinds = StructType([*docs.schema.fields, *made])
    found = docs
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).orderBy("text", "item_id").collect()
        sent = spark.sparkContext.broadcast([(r.item_id, r.text) for r in rows])
        found = found.mapInArrow(_pass(sent, keep, names, threshold, min_match, short_items), kinds)
        if b + 1 < blocks:
            found = stored(found, "tiled")
    return found


def _pass(sent, keep: list[str], names: list[str], threshold: float, min_match: int, short_items: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = None
        for batch in slices(batches, "text"):
            items = items or Benchmark(sent.value, min_match, short_items)
            sizes, found = items.best([t or "" for t in batch.column("text").to_pylist()], threshold)
            rows = []
            earlier = zip(*[batch.column(n).to_pylist() for n in names]) if names[0] in batch.schema.names else [None] * len(sizes)
            for size, (k, covered, of, n), before in zip(sizes, found, earlier):
                if before and before[1] and (k is None or before[3] * of >= covered * before[4]):
                    rows.append(before)
                else:
                    rows.append((size, k is not None, None if k is None else items.ids[k], covered, of, n))
            columns = list(zip(*rows)) or [()] * len(names)
            kinds = [pa.int64(), pa.bool_(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(c, t) for c, t in zip(columns, kinds)]],
                                             [*keep, *names])

    return run


@register("op1_greedy_string_tiling")
def decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), short_items=True).drop("text")
