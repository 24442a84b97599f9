"""Similarities the bands are not made for."""

import pytest

from airgrid.llm import near_dedup


@pytest.mark.parametrize("operator", [near_dedup.link_documents, near_dedup.one_of_each])
def test_lower_similarities_are_refused(spark, operator):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    with pytest.raises(ValueError, match="not from 60"):
        operator(docs, percent=60)
