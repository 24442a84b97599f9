"""Names modulo the prime, on texts that collide modulo a power of two."""

import random

import duckdb
import numpy as np
import pytest
from llm_cases import SF_DIR  # noqa: F401

from airgrid.llm import near_dedup, substring_dedup, suffix_dedup, tiling
from airgrid.llm.words import PRIME, Powers, Sums, Words, byte_values, times

P = int(PRIME)


def pattern(n, turned=False):
    """The Thue-Morse word, or the one with its letters exchanged."""
    return "".join("ab"[(bin(k).count("1") & 1) ^ turned] for k in range(n))


def test_products_are_those_of_whole_numbers():
    rng = random.Random(1)
    x, y = ([rng.choice([0, 1, P - 1, rng.randrange(P)]) for _ in range(40_000)] for _ in range(2))
    got = times(np.array(x, np.uint64), np.array(y, np.uint64))
    assert got.tolist() == [a * b % P for a, b in zip(x, y)]


@pytest.mark.parametrize("family", [0, 1])
def test_a_run_has_one_name_wherever_it_stands(family):
    rng = np.random.default_rng(0)
    run = rng.integers(0, 256, 300).astype(np.uint8)
    data = np.concatenate([rng.integers(0, 256, 1000).astype(np.uint8), run, rng.integers(0, 256, 70_000).astype(np.uint8), run])
    sums = Sums(byte_values(family)[data], Powers(family))
    a, b, c = sums.names(np.array([1000, len(data) - 300, 5]), np.array([1300, len(data), 305]))
    assert a == b != c


@pytest.mark.parametrize("n", [1024, 2048])
@pytest.mark.parametrize("family", [0, 1])
def test_the_pattern_and_its_opposite_have_two_names(n, family):
    names = Words([pattern(n).encode(), pattern(n, True).encode()], family).names
    assert names[0] != names[1]


@pytest.mark.parametrize("n", [1024, 2048])
def test_operators_tell_the_pattern_from_its_opposite(spark, n):
    a, b = pattern(n), pattern(n, True)
    near = near_dedup.link_documents(spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string"))
    got = {r["doc_id"]: r["component_id"] for r in near.collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    fifty = [(1, " ".join([a] * 50)), (2, " ".join([b] * 50)), (3, "x " + " ".join([b] * 50))]
    words = {r["doc_id"]: r["n_removed"] for r in substring_dedup.repeated_words(spark.createDataFrame(fifty, "doc_id long, text string")).collect()}
    assert words == {1: 0, 2: 0, 3: 50}
    bench = spark.createDataFrame([(1, " ".join([a, *"cdefgh"]))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join([b, *"ijklmn"])), (2, " ".join(["say", a, *"cdefgh"]))], "doc_id long, text string")
    leaks = {r["doc_id"]: r["contaminated"] for r in tiling.decontaminate(docs, bench).collect()}
    assert leaks == {1: False, 2: True}


def test_repeated_bytes_of_the_pattern_are_those_of_sql(spark):
    rows = [(1, pattern(1024) + "x"), (2, "y" + pattern(1024, True)), (3, "z" * 150 + pattern(700)), (4, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = {r[0]: r[1:] for r in con.sql(f"SELECT doc_id, n_removed, n_spans, kept_sha256 FROM ({suffix_dedup.SQL_BYTES})").fetchall()}
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.repeated_bytes(docs).collect()}
    assert got == want
