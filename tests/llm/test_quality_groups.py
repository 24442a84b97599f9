"""Cut-offs of sources that are made of junk, and of sources that grow by a few rows."""

import random

import pytest
from llm_cases import SF_DIR  # noqa: F401

from airgrid.llm import quality_rules


def text(rng, junk):
    words = [f"w{rng.randrange(5000)}" for _ in range(60)]
    return " ".join(w + "#$%"[:1 + rng.randrange(3)] if junk else w for w in words)


def kept(spark, rows):
    df = spark.createDataFrame([(k, t, "en", source) for k, (t, source) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    return {r["doc_id"]: r["kept"] for r in quality_rules.judge(df).collect()}


@pytest.mark.parametrize("sources", [["only"], ["a", "b", "c"]])
@pytest.mark.parametrize("share", [0.05, 0.4])
def test_a_share_of_junk_does_not_set_its_own_standard(spark, share, sources):
    rng = random.Random(1)
    junk = [k < share * 600 for k in range(600)]
    got = kept(spark, [(text(rng, j), rng.choice(sources)) for j in junk])
    assert not any(got[k] for k, j in enumerate(junk) if j)
    assert all(got[k] for k, j in enumerate(junk) if not j)


def test_a_source_of_junk_is_held_to_its_language(spark):
    rng = random.Random(2)
    rows = [(text(rng, True), "junk") for _ in range(300)] + [(text(rng, False), f"s{k % 5}") for k in range(900)]
    got = kept(spark, rows)
    assert sum(got[k] for k in range(300)) == 0 and all(got[k] for k in range(300, 1200))


def test_two_rows_more_do_not_turn_verdicts(spark):
    rng = random.Random(3)
    junk, clean, others = ([text(rng, j) for _ in range(n)] for j, n in ((True, 60), (False, 141), (False, 800)))
    for n_clean in (139, 141):
        got = kept(spark, [(t, "s") for t in [*junk, *clean[:n_clean]]] + [(t, "other") for t in others])
        assert not any(got[k] for k in range(60)) and all(got[k] for k in range(60, 60 + n_clean))
