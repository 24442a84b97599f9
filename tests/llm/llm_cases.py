import os

import pytest
from pyspark.sql import DataFrame

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
HARD_TEXTS = [
    (1, ""), (2, None), (3, "   \n\t "), (4, "one"), (5, "one"), (None, "no id"), (6, "It's  two\n\nlines .\x0b\x85  end of"),
    (7, "Ünï 漢字 🙂 é ﬁ ΑΣ İ <|endoftext|> ▁x"), (8, "x" * 30_000), (9, "word " * 6_000), (4, "one"), (10, "a\r\nb\x1cc\x1f d")]


@pytest.fixture
def hard(spark) -> DataFrame:
    """Nulls, empty and long texts, repeated rows, odd characters, and extra columns with clashing names."""
    rows = [(i, t, "en", 1, "clash", 0, 0.5) for i, t in HARD_TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, count long, digest string, bucket int, score double")


@pytest.fixture
def empty(hard) -> DataFrame:
    return hard.limit(0)
