import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from llm_cases import HARD_TEXTS, SF_DIR, empty, hard  # noqa: F401

import corpus_pipeline
from airgrid.llm import chat, quality_model, quality_rules, sharding, tiling
from airgrid.llm.catalog import QUERIES, SQL
from airgrid.llm.words import Powers
from check import canonical

TABLES = ["documents", "conversations", "benchmark", "labels", "embeddings"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def sql_on(df, name, sql):
    con = duckdb.connect()
    con.register(name, df.toPandas())
    return canonical(con.sql(sql).df())


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_match_their_sql(spark, duck, name):
    got, want = canonical(QUERIES[name](spark, SF_DIR).toPandas()), canonical(duck.sql(SQL[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        assert got[c].equals(want[c]), c


# sharding

def test_slots_have_no_gaps_and_the_new_shard_only_takes(spark):
    got = QUERIES["op7_weighted_hash_tree"](spark, SF_DIR).toPandas()
    for _, rows in got.groupby("shard"):
        assert sorted(rows.slot) == list(range(len(rows)))
    moved = got[got["shard"] != got.grown_shard]
    assert set(moved.grown_shard) == {16}
    texts = dict(pd.read_parquet(f"{SF_DIR}/documents.parquet")[["doc_id", "text"]].values)
    assert all(zlib.crc32(texts[i].encode()) == c for i, c in zip(got.doc_id, got.text_crc32))


def test_shares_follow_weights_and_only_changed_paths_move(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'' AS text")
    before = [sharding.Leaf(0, 0, 0, 1.0), sharding.Leaf(0, 0, 1, 3.0), sharding.Leaf(0, 1, 2, 2.0), sharding.Leaf(1, 0, 3, 4.0)]
    after = [*before[:2], sharding.Leaf(0, 1, 2, 4.0), before[3]]
    got = sharding.shard_documents(docs, before, after).toPandas()
    share = got["shard"].value_counts(normalize=True)
    assert all(abs(share[x.shard] - x.weight / 10) < 0.015 for x in before)
    moved = got[got["shard"] != got.grown_shard]
    # documents come into the region, and in it into the rack, whose weight grew
    assert not ((moved["shard"] != 3) & (moved.grown_shard != 2)).any()
    with pytest.raises(ValueError):
        sharding.tree_shard(None, [])


def test_sharding_hard_rows(hard, empty):
    got = sharding.shard_documents(hard, sharding.even_tree(4)).toPandas()
    assert len(got) == len(HARD_TEXTS) and got.loc[got.doc_id == 2, ["size", "text_crc32"]].values.tolist() == [[1, 0]]
    assert got[got.doc_id == 4]["shard"].nunique() == 1 and got.grown_shard.isna().all()
    assert sharding.shard_documents(empty, sharding.even_tree(4)).count() == 0


# chat

def test_perspectives_of_hard_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_TURNS", 512)
    rows = [(1, 0, "system", "be nice"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 2, "bob", None), (1, None, "cid", "late"),
            (1, 2, None, "who"), (None, 1, "ann", "lost"), (2, 1, "system", "alone"), (3, 1, "ann", "")]
    rows += [(9, k // 3, f"p{k % 2}", f"turn {k}") for k in range(1300)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, speaker string")
    got = canonical(chat.rotate_perspectives(df).toPandas())
    want = sql_on(df, "conversations", chat.SQL_CHAT)
    assert got.equals(want)
    assert sorted(got[got.conv_id == 9].part) == [0, 0, 1, 1, 2, 2]
    assert chat.rotate_perspectives(df.limit(0)).count() == 0
    for r in chat.rotate_perspectives(df.filter("conv_id = 1")).collect():
        for span in filter(None, r.spans.split(",")):
            begin, end = map(int, span.split("-"))
            assert r.rendered[:begin].endswith("<|im_start|>assistant\n") and r.rendered[begin:end].endswith(chat.END)


# quality

def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[k:k + 8]) for k in range(len(words) - 7))
    again = np.zeros(len(words), bool)
    for k in range(len(words) - 7):
        if windows[tuple(words[k:k + 8])] > 1:
            again[k:k + 8] = True
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), int(again.sum())


def test_base_counts_by_brute_force():
    draw = random.Random(3)
    texts = [t for _, t in HARD_TEXTS] + ["".join(draw.choices("ab #|\n\té", k=draw.randrange(1, 400))) for _ in range(300)]
    assert [quality_rules.base_counts((t or "").encode()) for t in texts] == [base(t) for t in texts]


def test_rules_on_hard_rows(spark, hard, empty, monkeypatch):
    df = hard.withColumn("source", hard.lang)
    got = canonical(quality_rules.judge(df).toPandas())
    assert got.equals(sql_on(df, "documents", quality_rules.SQL_RULES))
    assert quality_rules.judge(empty.withColumn("source", empty.lang)).count() == 0


def test_cut_offs_follow_the_group(spark):
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(40)) + ("".join(f" |{j}" for j in range(20)) if k % 2 or k > 996 else ""), "en", "tables" if k % 2 else None) for k in range(1000)]
    got = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    # bars are usual in one source and odd in the other
    assert all(got[k] for k in range(996)) and not got[998]


def test_sketch_bounds_values(spark):
    from pyspark.sql import functions as F

    values = [*range(70), 127, 128, 129, 1000, 4095, 4096, 123_456, 10**9]
    df = spark.createDataFrame([(v,) for v in values], "x long").select("x", quality_rules.upper(quality_rules.bucket(F.col("x"))).alias("u"))
    assert all(x <= u <= x * 33 / 32 + 1 for x, u in df.collect())


def test_classifier_is_accurate_on_held_out_rows(spark):
    sf = SF_DIR.replace("sf0.001", "sf0.01")
    labels = pd.read_parquet(f"{sf}/labels.parquet").set_index("doc_id").quality
    got = QUERIES["op5_nb_support_vectors"](spark, sf).toPandas().set_index("doc_id")
    assert all(got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.index])
    assert got.score.between(0, 1).all() and ((got.score >= 0.3).astype(int) == got.predicted).all()
    seen = got[got.held_out].join(labels, how="inner")
    assert (seen.predicted == seen.quality).mean() > 0.93 > labels.mean()


def test_classifier_on_hard_rows(spark, hard, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in HARD_TEXTS if i] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_model.classify(hard, labels).toPandas()
    assert len(got) == len(HARD_TEXTS) and got.score.between(0, 1).all() and not got[got.doc_id.isna()].held_out.any()
    assert quality_model.classify(hard, labels.limit(0)).count() == len(HARD_TEXTS)
    assert quality_model.classify(empty, labels).count() == 0


def test_descent_separates():
    draw = np.random.default_rng(0)
    rows = [np.unique(draw.integers(0, 500, 40) + (500 if k % 2 else 0)).astype(np.int32) for k in range(60)]
    y = np.array([1 if k % 2 else -1 for k in range(60)])
    ratios = quality_model.log_count_ratios(rows, y)
    w, bias = quality_model.descend(rows, y, ratios)
    assert all((w[r] @ ratios[r] + bias * np.linalg.norm(ratios[r])) * s > 0 for r, s in zip(rows, y))


# decontamination

def longest_first(item, text, least):
    """Greedy string tiling by trying all pairs: the longest free match, first in the item, then in the text."""
    free_item, free_text, covered = [True] * len(item), [True] * len(text), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(text)):
                k = 0
                while p + k < len(item) and t + k < len(text) and free_item[p + k] and free_text[t + k] and item[p + k] == text[t + k]:
                    k += 1
                best = max(best, (k, -p, -t))
        k, p, t = best
        if k < least:
            return covered
        free_item[-p:-p + k] = free_text[-t:-t + k] = [False] * k
        covered += k


def test_tiles_by_brute_force():
    draw, powers = random.Random(2), Powers(0)
    for _ in range(60):
        item = [draw.randrange(6) for _ in range(draw.randrange(3, 25))]
        text = [draw.randrange(6) for _ in range(5)] + item[10:] + [draw.randrange(6) for _ in range(4)] + item[:10] + [9]
        names = np.array(item, np.uint64) + 7, np.array(text, np.uint64) + 7
        found = tiling.tile(*names, powers, 3)
        assert all(item[p:p + n] == text[t:t + n] and n >= 3 for p, t, n in found)
        for places in ([q for p, _, n in found for q in range(p, p + n)], [q for _, t, n in found for q in range(t, t + n)]):
            assert len(places) == len(set(places))
        assert sum(n for _, _, n in found) >= 0.8 * longest_first(item, text, 3)


def test_leaks_in_any_order_are_found(spark, monkeypatch):
    draw = random.Random(4)
    words = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    items = [(k, words(30)) for k in range(20)] + [(50, words(4)), (51, [])]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(None, None)], "item_id long, text string")
    moved = items[3][1][20:] + words(10) + items[3][1][:18]
    docs = [(1, " ".join(words(50) + items[2][1] + words(20))), (2, " ".join(w.upper() + "!" for w in moved)), (3, " ".join(words(30) + items[5][1][:12])),
            (4, " ".join(items[50 - 30][1])), (5, ""), (6, None), (1, " ".join(items[7][1])), (None, " ".join(words(9)))]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, tile string")
    want = [(1, True, 2, 30), (1, True, 7, 30), (2, True, 3, 28), (3, False, None, 0), (4, False, None, 0), (5, False, None, 0), (6, False, None, 0),
            (None, False, None, 0)]
    for most in (tiling.BLOCK_CHARS, 700):  # one block, then several
        monkeypatch.setattr(tiling, "BLOCK_CHARS", most)
        got = sorted([(r.doc_id, r.contaminated, r.item_id, r.covered) for r in tiling.decontaminate(df, bench).collect()], key=str)
        assert got == sorted(want, key=str)
    assert tiling.decontaminate(df, bench.limit(0)).filter("contaminated").count() == 0
    assert tiling.decontaminate(df.limit(0), bench).count() == 0


def test_documents_with_whole_items_are_the_contaminated_ones(spark):
    docs, bench = (pd.read_parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {r.doc_id: r.contaminated for r in QUERIES["op1_greedy_string_tiling"](spark, SF_DIR).collect()}
    assert got == {i: any(b in t for b in bench.text) for i, t in zip(docs.doc_id, docs.text)} and any(got.values())


# pipeline

def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    bench = pd.read_parquet(f"{SF_DIR}/benchmark.parquet").text.tolist()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_strings", "decontamination", "tokens"]
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, SF_DIR)
    assert good.columns == docs.columns and 0.7 * docs.count() < good.count() < docs.count()
    single = stages["near_duplicates"](spark, docs, SF_DIR)
    assert single.columns == docs.columns and single.select("doc_id").distinct().count() == single.count()
    cut = stages["repeated_strings"](spark, docs, SF_DIR)
    assert cut.columns == docs.columns and cut.count() == docs.count() and cut.filter("n_chars <> length(text)").count() == 0
    clean = stages["decontamination"](spark, docs, SF_DIR)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect() if not any(b in r.text for b in bench)}
    out = corpus_pipeline.run(spark, SF_DIR)
    assert out.columns == ["doc_id", "lang", "source", "ids", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < out.count() < docs.count()
    assert out.filter("size(ids) <> n_tokens OR lang IS NULL OR source IS NULL").count() == 0
