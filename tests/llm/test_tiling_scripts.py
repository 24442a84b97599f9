"""Benchmark items in scripts without spaces, and items shorter than a seed."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from airgrid.llm.tiling import decontaminate, tokens
from airgrid.llm.words import Powers

CHINESE = "海洋上空的气溶胶光学厚度由卫星每小时观测一次，然后按网格求平均值。地面站的读数与最近的网格单元相匹配"
THAI = "ความลึกเชิงแสงของละอองลอยเหนือมหาสมุทรถูกวัดโดยดาวเทียมทุกชั่วโมง"


def found(spark, docs, items):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return [(r["contaminated"], r["item_id"], r["covered"], r["item_tokens"]) for r in decontaminate(d, b, short_items=True).orderBy("doc_id").collect()]


@pytest.mark.parametrize("item", [CHINESE, THAI, "エアロゾルの光学的厚さは衛星によって毎時間観測される"])
def test_copies_in_scripts_without_spaces(spark, item):
    got = found(spark, ["前文がある" + item + "后面还有文字", "全く別の短い文章である"], [item])
    n = int(tokens([item], Powers(0)).first[-1])
    assert n >= 20 and got == [(True, 0, n, n), (False, None, 0, 0)]


def test_punctuation_beyond_ascii_separates():
    def count(text):
        return int(tokens([text], Powers(0)).first[-1])

    assert count("l’été «bleu» – déjà…") == count("l'été \"bleu\" - déjà...") == 4
    assert count("नमस्ते दुनिया") == 2 and count("안녕 세상") == 2 and count("2024年3月") == 4


def test_short_items_are_looked_for_whole(spark):
    items = ["Blue whale song", "one two three four five six"]
    got = found(spark, ["we heard a blue whale song there", "blue whales sing a song", "a whale song, blue", "one two three four"], items)
    assert got == [(True, 0, 3, 3), *[(False, None, 0, 0)] * 3]


def test_query_and_pipeline_look_for_short_items(spark, tmp_path):
    docs = spark.createDataFrame([(1, "we heard a blue whale song there"), (2, "nothing of it")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "Blue whale song")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = entry.queries()["op1_greedy_string_tiling"](spark, str(tmp_path)).filter("contaminated").collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 7)]
    assert [r["doc_id"] for r in corpus_pipeline.drop_leaks(spark, docs, str(tmp_path)).collect()] == [2]
