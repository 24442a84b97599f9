"""Token files: independent zstandard frames, a document index, and a trailing seek table with a checksum per frame.

Layout of a file: zstandard frames whose contents, joined, are the documents' token ids as little-endian unsigned
32-bit integers; one skippable frame with the document index; one skippable frame with the seek table, in the published
seekable format (sizes and the low 32 bits of XXH64 of each frame's content, then a footer).  Any zstandard reader can
decompress the file; ours reads the tail first and decompresses only the frames of the documents asked for.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.llm.bpe import byte_characters
from airgrid.llm.catalog import register, table
from airgrid.llm.tasks import Memo, kept, slices
from airgrid.session import scratch_path

FRAME_BYTES = 256 << 10  # a frame ends with the first document that reaches this size
MEMO_WORDS, MEMO_PARTS = 500_000, 900_000  # distinct words, and parts of words, a worker remembers
# Fixed values of the zstandard seekable format.
SKIPPABLE, SEEK_FRAME, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80


class FrameWriter:
    """Writes documents to one open binary file."""

    def __init__(self, out):
        import xxhash
        import zstandard

        self.out, self.checksum = out, xxhash.xxh64_intdigest
        self.compress = zstandard.ZstdCompressor(level=3, write_checksum=False).compress
        self.buffer, self.buffered = [], 0
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int | None, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.buffer.append(ids)
        self.buffered += len(ids)
        self.docs.append((doc_id, len(ids) // 4))
        if self.buffered >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.buffered:
            content = b"".join(self.buffer)
            frame = self.compress(content)
            self.out.write(frame)
            self.frames.append((len(frame), len(content), self.checksum(content) & 0xFFFFFFFF))
            self.buffer, self.buffered = [], 0

    def close(self) -> None:
        self.flush()
        known = np.array([d is not None for d, _ in self.docs], np.uint8).tobytes()
        ids = np.array([d or 0 for d, _ in self.docs], "<i8").tobytes()
        sizes = np.array([n for _, n in self.docs], "<u4").tobytes()
        index = self.compress(struct.pack("<Q", len(self.docs)) + known + ids + sizes)
        index += struct.pack("<I", self.checksum(index) & 0xFFFFFFFF)
        self.out.write(struct.pack("<II", SKIPPABLE, len(index)) + index)
        entries = b"".join(struct.pack("<III", *f) for f in self.frames)
        # the index is an entry too, without content, so that sizes add up to the start of the seek table
        entries += struct.pack("<III", len(index) + 8, 0, 0)
        footer = struct.pack("<IBI", len(self.frames) + 1, CHECKSUMS, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SEEK_FRAME, len(entries) + len(footer)) + entries + footer)


class FrameReader:
    """Reads the tail of a file, then single frames."""

    def __init__(self, source, size: int):
        import xxhash
        import zstandard

        self.source, self.checksum = source, xxhash.xxh64_intdigest
        self.decompress = zstandard.ZstdDecompressor().decompress
        self.frames_read = 0
        n, flags, magic = struct.unpack("<IBI", self.at(size - 9, 9))
        if magic != SEEK_MAGIC or not flags & CHECKSUMS:
            raise ValueError("no seek table with checksums")
        table = np.frombuffer(self.at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.frames, tail = table[:-1], int(table[-1, 0])
        self.begins = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        index = self.at(int(self.begins[-1]) + 8, tail - 8)
        if self.checksum(index[:-4]) & 0xFFFFFFFF != struct.unpack("<I", index[-4:])[0]:
            raise ValueError("the index is damaged")
        index = self.decompress(index[:-4])
        k = struct.unpack("<Q", index[:8])[0]
        self.known = np.frombuffer(index, np.uint8, k, 8).astype(bool)
        self.doc_ids = np.frombuffer(index, "<i8", k, 8 + k)
        self.sizes = np.frombuffer(index, "<u4", k, 8 + 9 * k).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.contents = np.concatenate([[0], np.cumsum(self.frames[:, 1])])

    def at(self, begin: int, n: int) -> bytes:
        self.source.seek(begin)
        return self.source.read(n)

    def frame(self, k: int) -> bytes:
        content = self.decompress(self.at(int(self.begins[k]), int(self.frames[k, 0])), max_output_size=int(self.frames[k, 1]))
        self.frames_read += 1
        if len(content) != self.frames[k, 1] or self.checksum(content) & 0xFFFFFFFF != self.frames[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return content

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, ids before it in the file, its ids as bytes) of all documents, or of those with the ids ``wanted``."""
        rows = np.arange(len(self.sizes)) if wanted is None else np.flatnonzero(self.known & np.isin(self.doc_ids, list(wanted)))
        frame, content = -1, b""
        for r in rows:
            begin, end = 4 * int(self.starts[r]), 4 * int(self.starts[r + 1])
            k = int(np.searchsorted(self.contents, begin, side="right")) - 1
            if k != frame and end > begin:
                frame, content = k, self.frame(k)
            at = begin - int(self.contents[k])
            yield (int(self.doc_ids[r]) if self.known[r] else None), int(self.starts[r]), content[at:at + end - begin]


# Words of ASCII and Latin-1 letters are cut here as the vocabulary's normaliser and splitter cut them: lower case, then the
# splitter's alternatives in their order.  Words with other characters go through the library as they are.
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


class WordEncoder:
    """The tokenizers library, asked once per distinct word or part of a word.

    The vocabulary's normaliser and splitter never carry anything across ASCII white space and drop it, so a text's ids
    are those of its words in turn.  A special token's string stands for that token wherever it occurs, as in the library;
    words that hold one go through the library whole.  A vocabulary whose added tokens hold or take in white space, or are
    looked for in normalised text, is refused.
    """

    def __init__(self, content: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        added = json.loads(content).get("added_tokens") or []
        if any(t["lstrip"] or t["rstrip"] or t["normalized"] or re.search(r"\s", t["content"]) for t in added):
            raise ValueError("added tokens that hold or take in white space, or are looked for in normalised text")
        self.special = re.compile("|".join(re.escape(t["content"]) for t in added) or "(?!)")
        self.merge = self.tokenizer.model.tokenize
        self.characters = dict(enumerate(byte_characters()))
        self.words, self.parts = Memo(MEMO_WORDS), Memo(MEMO_PARTS)

    def encode(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        words = text.split()
        found = list(map(self.words.get, words))
        if None in found:
            new = {w: self.word(w.decode()) for w in {w for w, f in zip(words, found) if f is None}}
            self.words.make_room(len(new))
            self.words.update(new)
            found = [new[w] if f is None else f for w, f in zip(words, found)]
        return b"".join(found)

    def word(self, word: str) -> bytes:
        if PLAIN.fullmatch(word) and not self.special.search(word):
            return b"".join(map(self.part, PARTS.findall(word.lower())))
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            ids = [t.id for t in self.merge(part if part.isascii() else part.encode().decode("latin-1").translate(self.characters))]
            found = struct.pack(f"<{len(ids)}I", *ids)
            self.parts.make_room(1)
            self.parts[part] = found
        return found


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int) -> DataFrame:
    """Encode every whole text, append ``end_id`` and write token files in ascending doc_id order under ``folder``.

    Returns the written manifest: one row per file with ``file, part, n_docs, n_tokens, base`` (ids in files before).
    Null doc_ids come first, rows with equal doc_ids together, by a hash of their text (over several files if they are
    many); a null text is empty and holds the end id alone.  Empty input gives no files.  A task writes under a name of its own and renames when done, so a repeated
    task replaces a file by the same content.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        part = context.partitionId()
        path, own = f"{root}/part-{part:06d}.zst", f"{root}/.part-{part:06d}.{context.taskAttemptId()}"
        encoder = kept(("words", hash(sent.value)), lambda: WordEncoder(sent.value))
        end, writer, total, out = struct.pack("<I", end_id), None, 0, None
        for batch in slices(batches, "text"):
            if writer is None and batch.num_rows:
                store.create_dir(root)
                out = store.open_output_stream(own)
                writer = FrameWriter(out)
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encoder.encode(text) + end
                writer.add(doc_id, ids)
                total += len(ids) // 4
        if writer is not None:
            writer.close()
            out.close()
            store.move(own, path)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": pa.array([len(writer.docs)], pa.int64()),
                                              "n_tokens": pa.array([total], pa.int64())})

    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text")
                          ).withColumn("_name", F.xxhash64("text")).repartitionByRange("doc_id", "_name"
                          ).sortWithinPartitions("doc_id", "_name").drop("_name")
    # one row a file comes to the driver, as many as there are key ranges
    files = sorted(ordered.mapInArrow(write, "part int, n_docs bigint, n_tokens bigint").collect())
    rows, base = [], 0
    for part, n_docs, n_tokens in files:
        rows.append((f"part-{part:06d}.zst", part, n_docs, n_tokens, base))
        base += n_tokens
    manifest = f"{folder}/manifest"
    spark.createDataFrame(rows, "file string, part int, n_docs bigint, n_tokens bigint, base bigint").write.parquet(manifest)
    return spark.read.parquet(manifest)


def read_tokens(manifest: DataFrame, folder: str, wanted: list[int] | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (bytes) from token files, checksums verified.

    With ``wanted`` only the frames that hold those documents are decompressed.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        names = ["doc_id", "start", "n_tokens", "ids"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                path = f"{root}/{file}"
                with store.open_input_file(path) as source:
                    rows, held = [], 0
                    for doc_id, start, ids in FrameReader(source, source.size()).documents(wanted):
                        rows.append((doc_id, base + start, len(ids) // 4, ids))
                        held += len(ids)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    files = manifest.select("file", "base").repartitionByRange(max(1, manifest.count()), "base")
    return files.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def checksums(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@register("op2_seekable_frames")
def token_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write ``documents`` as token files in the shared folder, read them back and sum up each document's ids."""
    folder = scratch_path(spark, "tokens")
    manifest = write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), 1)
    return checksums(read_tokens(manifest, folder))
