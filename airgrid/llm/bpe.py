"""Byte-level BPE through a sentencepiece model written directly from a rank file.

Every byte is mapped to one printable character, every vocabulary entry becomes a piece whose score is its negative
rank, and the normaliser is the identity: sentencepiece's merge order, best score first and leftmost among equals, is
then the rank order of byte-level BPE.  Pre-tokens are encoded one by one; decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.llm.catalog import register, table
from airgrid.llm.tasks import Memo, kept, slices

MEMO_CHUNKS = 300_000  # distinct chunks of text, and as many matches of the pattern, that a worker remembers
# A chunk starts where one blank or line end stands between two other characters.  The splitting pattern always breaks
# there: its matches cover white space only in front of other characters.
CHUNK = r"(?<=\S)(?=[ \n]\S)"


def byte_characters() -> list[str]:
    """One character a byte that is neither white space nor a control: itself where it is such, else from 256 up."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(spare))
        spare += b not in plain
    return out


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised BPE model whose piece ids are the ranks; the unknown piece follows them and is never used."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    tokens = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in tokens] != list(range(len(tokens))) or not all(bytes([b]) in ranks for b in range(256)):
        raise ValueError("ranks must run from 0 without gaps and hold every single byte")
    char = byte_characters()
    model = pb.ModelProto()
    for rank, token in enumerate(tokens):
        model.pieces.add(piece="".join(char[b] for b in token), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    model.trainer_spec.model_type = pb.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(model.pieces)
    model.trainer_spec.byte_fallback = False
    model.trainer_spec.unk_id = len(tokens)
    model.trainer_spec.bos_id = model.trainer_spec.eos_id = model.trainer_spec.pad_id = -1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    return model.SerializeToString()


class Codec:
    """Encodes text to ranks and ranks back to bytes."""

    def __init__(self, content: bytes, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(content)
        self.tokens = sorted(self.ranks, key=self.ranks.get)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.ranks))
        self.matches = regex.compile(pattern).findall
        self.chunks = re.compile(CHUNK).split
        self.mapped = {i: c for i, c in enumerate(byte_characters())}
        self.memo, self.pieces = Memo(MEMO_CHUNKS), Memo(MEMO_CHUNKS)

    def encode_packed(self, text: str) -> tuple[bytes, bytes]:
        """The ids of a text as little-endian 32-bit numbers, and the bytes that these ids decode to."""
        chunks = self.chunks(text) if text else []
        new = list({c for c in chunks if c not in self.memo})
        if new:
            self.memo.make_room(len(new))
            self.learn(chunks if not self.memo else new)
        found = list(map(self.memo.__getitem__, chunks))
        return b"".join([ids for ids, _ in found]), b"".join([decoded for _, decoded in found])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text)[0], "<i4").tolist()

    def learn(self, chunks: list[str]) -> None:
        """Encode chunks that are not remembered, from matches that may be; a match that is itself a vocabulary entry is that entry."""
        cut = {c: self.matches(c) for c in chunks}
        new = {m for found in cut.values() for m in found if m not in self.pieces}
        if self.pieces.make_room(len(new)):
            new = {m for found in cut.values() for m in found}
        rare = []
        for m in new:
            data = m.encode()
            if data in self.ranks:
                self.pieces[m] = self.packed([self.ranks[data]])
            else:
                rare.append((m, data.decode("latin-1").translate(self.mapped)))
        if rare:
            for (m, _), ids in zip(rare, self.model.encode([x for _, x in rare], num_threads=1)):
                self.pieces[m] = self.packed(ids)
        remembered = self.pieces
        for c, found in cut.items():
            if len(found) == 1:
                self.memo[c] = remembered[found[0]]
            else:
                each = [remembered[m] for m in found]
                self.memo[c] = b"".join([ids for ids, _ in each]), b"".join([decoded for _, decoded in each])

    def packed(self, ids: list[int]) -> tuple[bytes, bytes]:
        return array("i", ids).tobytes(), self.decode(ids)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, ``ids`` array<int> and ``decoded`` binary (the bytes the ids stand for) of every whole text, and the columns ``keep``.

    ``vocabulary`` is the path of a rank file; its content, of fixed size, travels to the tasks.  A null text is empty
    and has no ids.  Rows are independent: repeated rows, null doc_ids and other columns do not matter.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        content = f.read()
    sent = spark.sparkContext.broadcast(content)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept(("codec", hash(sent.value), pattern), lambda: Codec(sent.value, pattern))
        for batch in slices(batches, "text"):
            packed, decoded = zip(*map(codec.encode_packed, batch.column("text").to_pylist()))
            ends = np.cumsum([0, *map(len, packed)]) // 4
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4"), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(decoded, pa.binary()), *[batch.column(c) for c in keep]],
                                             ["doc_id", "ids", "decoded", *keep])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *keep)
    kinds = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(encode, f"doc_id bigint, ids array<int>, decoded binary{kinds}")


def digests(encoded: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Token count and digests of ids and decoded bytes, after the columns ``keep``."""
    return encoded.select(
        "doc_id", *keep, F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def tokenised(docs: DataFrame) -> DataFrame:
    return digests(encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


@register("op8_byte_bpe")
def bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenised(table(spark, sf_dir, "documents"))
