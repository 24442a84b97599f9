"""A training corpus from raw documents: quality, near-duplicates, repeated strings, benchmark leaks, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.llm import bpe, near_dedup, quality_model, suffix_dedup, tiling
from airgrid.llm.catalog import table
from airgrid.session import prepare, scratch_path


def carried(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` beside the whole row, so that no other column can clash with those an operator makes."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier, trained on the labelled ones, does not reject."""
    model = quality_model.train(docs, table(spark, sf_dir, "labels"))
    return quality_model.score(carried(docs), model).filter(F.col("score") >= quality_model.THRESHOLD).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    return near_dedup.one_of_each(carried(docs)).select("row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that stand anywhere else; ``n_chars``, where there is one, follows the text."""
    left = suffix_dedup.without_repeats(carried(docs))
    made = {"text": F.col("text"), "n_chars": F.length("text")}
    return left.select(*[made[f.name].cast(f.dataType).alias(f.name) if f.name in made else F.col(f"row.`{f.name}`") for f in docs.schema])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that do not cover a benchmark item."""
    found = tiling.decontaminate(carried(docs), table(spark, sf_dir, "benchmark"), short_items=True)
    return found.filter(~F.col("contaminated")).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text with its doc_id, lang and source; their number, and digests of them and of the bytes they decode to."""
    about = [c for c in ("lang", "source") if c in docs.columns]
    encoded = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, about)
    return bpe.digests(encoded, [*about, "ids"])


STAGES = [("quality", keep_good), ("near_duplicates", drop_near_copies), ("repeated_strings", cut_repeats), ("decontamination", drop_leaks),
          ("tokens", encode)]

#: SQL can't fit the classifier; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again."""
    rows = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, rows, sf_dir).write.parquet(path)
        rows = spark.read.parquet(path)
    return rows
