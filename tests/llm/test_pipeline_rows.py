"""Each stage of the pipeline on odd rows, and against brute force."""

import re
from collections import defaultdict

import pandas as pd
import pytest
from llm_cases import HARD_TEXTS, SF_DIR, empty, hard  # noqa: F401

import corpus_pipeline

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture
def odd(hard):  # noqa: F811
    """Columns named as those that the operators make."""
    names = ["_text", "_key", "_row", "row", "n_tokens", "contaminated", "kept", "hits", "a b"]
    return hard.selectExpr("*", *[f"count AS `{n}`" for n in names])


@pytest.mark.parametrize("stage", sorted(STAGES))
def test_stages_take_odd_rows_and_clashing_columns(spark, odd, stage):
    out = STAGES[stage](spark, odd, SF_DIR)
    rows = out.collect()
    if stage == "tokens":
        assert len(rows) == len(HARD_TEXTS) and all(r["n_tokens"] == len(r["ids"]) for r in rows) and "lang" in out.columns
        return
    assert out.columns == odd.columns and 0 <= len(rows) <= len(HARD_TEXTS) and all(r["a b"] == 1 and r["digest"] == "clash" for r in rows)
    if stage == "repeated_strings":
        assert len(rows) == len(HARD_TEXTS)


@pytest.mark.parametrize("stage", sorted(STAGES))
def test_stages_take_no_rows(spark, odd, stage):
    assert STAGES[stage](spark, odd.limit(0), SF_DIR).count() == 0


def components(texts):
    """Five-word shingle sets linked at 80 percent, by comparing all pairs."""
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(texts)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return [top(k) for k in range(len(texts))]


def test_near_copies_of_whole_documents_are_those_of_all_pairs(spark):
    docs = pd.read_parquet(f"{SF_DIR}/documents.parquet").sort_values("doc_id")
    groups = defaultdict(list)
    for i, c in zip(docs.doc_id, components(docs.text.tolist())):
        groups[c].append(i)
    left = {r["doc_id"] for r in STAGES["near_duplicates"](spark, spark.read.parquet(f"{SF_DIR}/documents.parquet"), SF_DIR).collect()}
    assert all(len(left & set(g)) == 1 for g in groups.values())
