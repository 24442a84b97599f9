import base64
import hashlib
import zlib

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import tiktoken
import zstandard
from llm_cases import SF_DIR, empty, hard  # noqa: F401
from tokenizers import Tokenizer

from airgrid.llm import bpe, token_output
from airgrid.llm.catalog import QUERIES


@pytest.fixture(scope="module")
def rank_library():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def expected_bpe(rows, library):
    out = []
    for doc_id, text in rows:
        ids = library.encode_ordinary(text or "")
        out.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                    hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_bpe_equals_the_library(spark, rank_library):
    docs = pd.read_parquet(f"{SF_DIR}/documents.parquet")
    got = sorted(map(tuple, QUERIES["op8_byte_bpe"](spark, SF_DIR).collect()), key=str)
    assert got == expected_bpe(zip(docs.doc_id.tolist(), docs.text), rank_library)


def test_bpe_hard_texts(hard, empty, rank_library):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    assert sorted(map(tuple, bpe.tokenised(hard).collect()), key=str) == expected_bpe(rows, rank_library)
    assert bpe.tokenised(empty).count() == 0


def test_bpe_memo_starts_anew(rank_library):
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        codec = bpe.Codec(f.read(), P.PATTERN)
    codec.memo.most = 3
    for text in ["a b c d e", "a b", "f g h a b c d", "x\n y  z"]:
        assert codec.encode(text) == rank_library.encode_ordinary(text)


def expected_tokens(rows, library):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_round_trip(spark, word_library):
    docs = pd.read_parquet(f"{SF_DIR}/documents.parquet")
    got = sorted(map(tuple, QUERIES["op2_seekable_frames"](spark, SF_DIR).collect()))
    assert got == expected_tokens(list(zip(docs.doc_id.tolist(), docs.text)), word_library)


def test_special_tokens_as_the_library_takes_them(spark, word_library, tmp_path):
    texts = ["a <|endoftext|> b", "a<|endoftext|>b", "<|startoftext|>", "it<|endoftext|>'s", "<|endoftext|><|endoftext|>x",
             "<|ENDOFTEXT|> <|end <|endoftext| >", "\n<|endoftext|>\t中<|endoftext|>Été", "'<|endoftext|>'"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = token_output.read_tokens(token_output.write_tokens(docs, f"{tmp_path}/s", P.path("word_bpe_49k.json"), 1), f"{tmp_path}/s")
    assert sorted(map(tuple, token_output.checksums(got).collect())) == expected_tokens(list(enumerate(texts)), word_library)


def test_token_files_of_hard_texts(hard, empty, word_library, tmp_path):
    path = P.path("word_bpe_49k.json")
    got = token_output.read_tokens(token_output.write_tokens(hard, f"{tmp_path}/a", path, 1), f"{tmp_path}/a")
    got = sorted(map(tuple, token_output.checksums(got).collect()), key=lambda r: r[1])
    assert got == expected_tokens([(r.doc_id, r.text) for r in hard.collect()], word_library)
    assert token_output.read_tokens(token_output.write_tokens(empty, f"{tmp_path}/b", path, 1), f"{tmp_path}/b").count() == 0


def test_reader_decompresses_only_what_is_asked(tmp_path):
    path = tmp_path / "one.zst"
    contents = [(k, np.arange(k * 1000, dtype="<u4").tobytes()) for k in range(1, 200)] + [(500, b"")]
    with open(path, "wb") as f:
        writer = token_output.FrameWriter(f)
        for doc_id, ids in contents:
            writer.add(doc_id, ids)
        writer.close()
    with open(path, "rb") as f:
        reader = token_output.FrameReader(f, path.stat().st_size)
        assert len(reader.frames) > 10
        assert [(d, b) for d, _, b in reader.documents([3, 150])] == [contents[2], contents[149]]
        assert reader.frames_read == 2
    with open(path, "rb") as f:  # any reader of the format sees the joined contents
        assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read() == b"".join(b for _, b in contents)
    damaged = bytearray(path.read_bytes())
    damaged[int(reader.begins[5]) + 100] ^= 1
    path.write_bytes(damaged)
    with open(path, "rb") as f, pytest.raises((ValueError, zstandard.ZstdError)):
        list(token_output.FrameReader(f, path.stat().st_size).documents())
