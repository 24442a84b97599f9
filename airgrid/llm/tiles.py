"""Distinct texts packed in tiles, and questions that tiles ask each other through shuffled buckets.

A tile is one row with the bytes of some megabytes of distinct texts.  Tiles are written once as a bucketed table, so later
steps join their answers without moving texts again.  A step hashes what it looks for into buckets: each tile sends one
row per bucket with the packed names it holds, each once, and gets back what the bucket knows from all tiles.  A name held
by a third of all texts is therefore at most one entry per tile.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.llm.tasks import slices
from airgrid.session import scratch_path

TILE_BYTES = 1 << 20  # expected bytes in a tile; one longer text makes a longer tile
NO_ID = (1 << 63) - 1  # stands for a null doc_id, after all others
TILE = "tile bigint, keys array<binary>, firsts array<bigint>, copies array<bigint>, sizes array<bigint>, data binary"


@dataclass
class Tiles:
    name: str
    frame: DataFrame
    members: DataFrame  # doc_id, key of every row
    n_bytes: int

    def joined(self, **answers: DataFrame) -> DataFrame:
        """The tiles with, per name, the list of (bucket, answer) they got."""
        out = self.frame
        for name, rows in answers.items():
            listed = rows.groupBy(F.col("tile").alias("_tile")).agg(F.collect_list(F.struct("bucket", "answer")).alias(name))
            out = out.join(listed.hint("shuffle_hash"), F.col("tile") == F.col("_tile"), "left").drop("_tile")
        return out

    def close(self) -> None:
        self.frame.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")


def text_key(text: Column) -> Column:
    """128 bits of SHA-256 of a text's bytes."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _first_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text once per partition, then the smallest id and the number of its further copies."""
    seen: dict[bytes, list] = {}
    names = ["tile", "key", "doc_id", "copies", "text"]
    for batch in slices(batches, "text"):
        rows = []
        for i, (tile, key, doc_id) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("tile", "key", "doc_id")])):
            if key in seen:
                entry = seen[key]
                entry[1], entry[2] = min(entry[1], doc_id), entry[2] + 1
            else:
                seen[key] = [tile, doc_id, 0]
                rows.append(i)
        if rows:
            part = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names[:3]], pa.array([1] * len(rows), pa.int64()), part.column("text")], names)
    more = [(e[0], k, e[1], e[2], None) for k, e in seen.items() if e[2]]
    for begin in range(0, len(more), 10_000):
        columns = zip(*more[begin:begin + 10_000])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()))], names)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile and key, packed into one row per tile."""
    kinds = [pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]

    def packed(tile: int, texts: dict[bytes, list]) -> pa.RecordBatch:
        sizes = [len(e[2]) for e in texts.values()]
        row = (tile, list(texts), [e[0] for e in texts.values()], [e[1] for e in texts.values()], sizes, b"\n".join(e[2] for e in texts.values()))
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row, kinds)], ["tile", "keys", "firsts", "copies", "sizes", "data"])

    now, texts = None, {}
    for batch in slices(batches, "text"):
        for tile, key, doc_id, copies, text in zip(*[batch.column(c).to_pylist() for c in ("tile", "key", "doc_id", "copies", "text")]):
            if tile != now:
                if texts:
                    yield packed(now, texts)
                now, texts = tile, {}
            entry = texts.setdefault(key, [NO_ID, 0, None])
            entry[0], entry[1] = min(entry[0], doc_id), entry[1] + copies
            entry[2] = text if entry[2] is None else entry[2]
    if texts:
        yield packed(now, texts)


def build_tiles(docs: DataFrame) -> Tiles:
    """Tiles of the distinct texts of ``docs(doc_id, text)``; a null text is an empty one."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    count = 1 + n_bytes // TILE_BYTES
    keyed = rows.select("doc_id", text_key(F.col("text")).alias("key"), F.encode("text", "UTF-8").alias("text"))
    keyed = keyed.select(F.pmod(F.xxhash64("key"), F.lit(count)).alias("tile"), "key", "doc_id", "text")
    # as many buckets as a shuffle has partitions: answers then meet the tiles without moving them
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"tiles_{uuid.uuid4().hex}"
    once = keyed.mapInArrow(_first_copies, "tile bigint, key binary, doc_id bigint, copies bigint, text binary")
    once.repartition(buckets, "tile").sortWithinPartitions("tile", "key").mapInArrow(_pack, TILE).write.format("parquet").bucketBy(
        buckets, "tile").option("compression", "zstd").option("path", scratch_path(spark, "tiles")).saveAsTable(name)
    return Tiles(name, spark.table(name), rows.select("doc_id", text_key(F.col("text")).alias("key")), n_bytes)


def bucket_of(names: np.ndarray, buckets: int) -> np.ndarray:
    return (names >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def runs_of(ordered: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, begin, end) of each run of equal values."""
    if not len(ordered):
        return []
    cuts = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
    return list(zip(ordered[np.concatenate([[0], cuts])].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(ordered)]))


def low_bytes(names: np.ndarray, width: int) -> np.ndarray:
    """The lowest bytes of each name, one row each."""
    return np.ascontiguousarray(names.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]


def from_bytes(content: bytes, width: int) -> np.ndarray:
    rows = np.frombuffer(content, np.uint8).reshape(-1, width)
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, :width] = rows
    return out.view("<u8").reshape(-1)


def questions(tile: int, buckets: np.ndarray, packed: np.ndarray) -> pa.RecordBatch:
    """One row per bucket with the packed entries (a byte row each) of that bucket; ``buckets`` ascends."""
    rows = [(b, packed[begin:end].tobytes()) for b, begin, end in runs_of(buckets)]
    return pa.RecordBatch.from_arrays(
        [pa.array([b for b, _ in rows], pa.int64()), pa.array([tile] * len(rows), pa.int64()), pa.array([x for _, x in rows], pa.binary())],
        ["bucket", "tile", "names"])


QUESTION = "bucket bigint, tile bigint, names binary"


def answered(asked: DataFrame, answer: Callable[[list[int], list[bytes]], list[bytes | None]]) -> DataFrame:
    """(tile, bucket, answer) for every tile to which ``answer(tiles, contents)`` of a bucket gives one."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("tile")
        answers = answer(frame.tile.tolist(), frame.names.tolist())
        kept = [a is not None for a in answers]
        return pd.DataFrame({"tile": frame.tile[kept], "bucket": frame.bucket[kept], "answer": [a for a in answers if a is not None]})

    return asked.groupBy("bucket").applyInPandas(run, "tile bigint, bucket bigint, answer binary")


def held_elsewhere(width: int) -> Callable:
    """Answers a bit per entry: whether another tile holds the same name (entries of one tile are distinct)."""

    def answer(tiles: list[int], contents: list[bytes]) -> list[bytes | None]:
        parts = [from_bytes(c, width) for c in contents]
        names = np.concatenate(parts)
        order = np.argsort(names, kind="stable")
        same = names[order][1:] == names[order][:-1]
        twice = np.zeros(len(names), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        ends = np.cumsum([len(p) for p in parts])
        return [np.packbits(x).tobytes() if x.any() else None for x in np.split(twice, ends[:-1])]

    return answer


def bits_of(buckets: np.ndarray, answers: list | None) -> np.ndarray:
    """The bits answered to the entries asked, in the order they were asked."""
    out = np.zeros(len(buckets), bool)
    got = {a["bucket"]: a["answer"] for a in answers or []}
    for b, begin, end in runs_of(buckets):
        if b in got:
            out[begin:end] = np.unpackbits(np.frombuffer(got[b], np.uint8), count=end - begin).astype(bool)
    return out


def difference_cover_places(cover: tuple[int, ...], period: int, n: int) -> np.ndarray:
    """Places below ``n`` whose remainder is in the cover."""
    return np.flatnonzero(np.isin(np.arange(n) % period, cover))


def marked(n: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places below ``n`` inside any of the ranges [begin, end)."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, begins, 1)
    np.add.at(edges, ends, -1)
    return np.cumsum(edges[:-1]) > 0
