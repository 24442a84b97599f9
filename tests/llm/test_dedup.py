import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_cases import HARD_TEXTS, empty, hard  # noqa: F401

from airgrid.llm import components, near_dedup, substring_dedup, suffix_dedup, tiles
from airgrid.llm.words import Powers, Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def copies_and_passages():
    """Texts with exact copies, near copies, shared passages, a passage repeated in one text, ties in doc_id and null ids."""
    draw = random.Random(5)
    words = lambda n: " ".join(f"w{draw.randrange(5000)}" for _ in range(n))
    base, passage = words(300), words(80)
    rows = [(k, words(draw.randrange(1, 200))) for k in range(40)]
    rows += [(100 + k, base) for k in range(30)] + [(7, base), (None, base), (None, words(90)), (50, base.upper())]
    for k in range(60):
        w = base.split()
        for _ in range(draw.randrange(1, 40)):
            w[draw.randrange(len(w))] = f"x{draw.randrange(10**6)}"
        rows.append((200 + k, " ".join(w)))
    rows += [(300 + k, f"{words(30)} {passage}\n{words(20)}") for k in range(10)]
    rows += [(400, f"{passage} {words(5)} {passage}"), (401, words(60) + " é" * 400), (401, words(70)), (402, passage)]
    return rows + HARD_TEXTS


def shingles(text, n):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(text or "")]
    return frozenset(zip(*[w[k:] for k in range(n)])) if len(w) >= n else frozenset([tuple(w)] if w else [])


def expected_components(rows, n):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs."""
    sets = [shingles(t, n) for _, t in rows]
    part = list(range(len(rows)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                part[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        ids = [x for x in (least.get(find(i)), doc_id) if x is not None]
        least[find(i)] = min(ids) if ids else None
    out = []
    for i, (doc_id, _) in enumerate(rows):
        component = least[find(i)] if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), component, doc_id == component))
    return sorted(out, key=str)


@pytest.mark.parametrize("words", [2, 5])
def test_components_of_hard_cases(spark, words):
    rows = copies_and_passages()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, band string")
    assert rows_of(near_dedup.link_documents(df, words)) == expected_components(rows, words)


def test_one_row_of_each_group(spark, hard, empty):
    rows = copies_and_passages()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_shingles int")
    got = [(r.doc_id, r.text) for r in near_dedup.one_of_each(df, 5).collect()]
    groups = {}
    for row, (doc_id, n, component, _) in zip(sorted(rows, key=str), sorted(zip(*zip(*expected_rows(rows, 5))), key=str)):
        groups.setdefault(component, []).append(row)
    assert sorted(got, key=str) == sorted([min(g, key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).digest()))
                                           for g in groups.values()], key=str)
    assert near_dedup.one_of_each(empty).count() == 0 and near_dedup.link_documents(empty).count() == 0


def expected_rows(rows, n):
    """Like expected_components, with a label of its own for each group (rows without words are groups by id and text)."""
    sets = [shingles(t, n) for _, t in rows]
    label = {}
    out = []
    order = sorted(range(len(rows)), key=lambda i: str(rows[i]))
    part = {i: i for i in order}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a in order:
        for b in order:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                part[find(a)] = find(b)
    for i in order:
        key = ("part", find(i)) if sets[i] else ("row", rows[i])
        out.append((str(rows[i]), 0, label.setdefault(key, len(label)), True))
    return [(f"{k:06d}", *x[1:]) for k, x in enumerate(out)]


def test_sketches_agree_as_often_as_sets_are_similar():
    draw = np.random.default_rng(1)
    names = draw.integers(0, 1 << 63, 3000).astype(np.uint64)
    for a, b in [(np.arange(900), np.arange(100, 1000)), (np.arange(9), np.arange(1, 10)), (np.arange(1), np.arange(1))]:
        s = near_dedup.sketches([np.sort(names[a]), np.sort(names[b])], 2000)
        assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
        similarity = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s[0] == s[1]).mean() - similarity) < 0.06


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(5, 5)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(30)}}


def test_components_found_so_far_take_no_further_round(spark, monkeypatch):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)]
    frame = spark.createDataFrame(edges, "u long, v long")
    written = []
    monkeypatch.setattr(components, "stored", lambda df, label, f=components.stored: written.append(label) or f(df, label))
    forest = components.star_forest(frame)
    rounds = len(written)
    again = components.star_forest(forest.union(frame.limit(0)))
    assert len(written) == rounds + 1  # written once, no round
    joined = components.star_forest(again.union(spark.createDataFrame([(0, 59), (59, 7)], "u long, v long")))
    for found, of in ((again, edges), (joined, [*edges, (0, 59), (59, 7)])):
        least = {x: x for e in of for x in e if e[0] != e[1]}
        for _ in range(60):
            for a, b in of:
                if a != b:
                    least[a] = least[b] = min(least[a], least[b])
        assert dict(map(tuple, components.members(found).collect())) == least
    del written[:]
    near_dedup.link_documents(spark.createDataFrame([(k, f"a text of its own, word by word, number {k // 2}") for k in range(8)], "doc_id long, text string")).count()
    assert written == ["edges"] * 3  # no links, or stars: no round in any of the three steps


def expected_bytes(rows):
    texts = [(t or "").encode() for _, t in rows]
    times = Counter(t[k:k + 200] for t in texts for k in range(len(t) - 199))
    out = []
    for (doc_id, _), t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if times[t[k:k + 200]] > 1:
                gone[k:k + 200] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((doc_id, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_repeated_bytes_of_hard_cases(spark, hard, empty, monkeypatch):
    monkeypatch.setattr(tiles, "TILE_BYTES", 20_000)  # several tiles
    rows = copies_and_passages()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, tile int")
    assert rows_of(suffix_dedup.repeated_bytes(df)) == expected_bytes(rows)
    assert rows_of(suffix_dedup.repeated_bytes(hard)) == expected_bytes(HARD_TEXTS)
    assert suffix_dedup.repeated_bytes(empty).count() == 0


def test_texts_without_repeats_stay_text(spark, hard):
    shared = "é" * 130
    df = spark.createDataFrame([(1, f"ab{shared}é!", "x"), (2, f"cde{shared}", "y"), (3, "é only", "z")], "doc_id long, text string, key string")
    assert rows_of(suffix_dedup.without_repeats(df)) == [(1, "ab!", "x"), (2, "cde", "y"), (3, "é only", "z")]
    assert suffix_dedup.without_repeats(hard).count() == len(HARD_TEXTS)


def expected_words(rows):
    texts = [WORD.findall(t or "") for _, t in rows]
    least: dict = {}
    rank = lambda i: (i is None, i or 0)
    for (doc_id, _), w in zip(rows, texts):
        for k in range(len(w) - 49):
            g = tuple(w[k:k + 50])
            least[g] = min(least.get(g, (True, 1)), rank(doc_id))
    out = []
    for (doc_id, _), w in zip(rows, texts):
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 49):
            if least[tuple(w[k:k + 50])] < rank(doc_id):
                gone[k:k + 50] = True
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc_id, len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_repeated_words_of_hard_cases(spark, hard, empty, monkeypatch):
    monkeypatch.setattr(tiles, "TILE_BYTES", 20_000)
    rows = copies_and_passages()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, first int")
    assert rows_of(substring_dedup.repeated_words(df)) == expected_words(rows)
    assert rows_of(substring_dedup.repeated_words(hard)) == expected_words(HARD_TEXTS)
    assert substring_dedup.repeated_words(empty).count() == 0


@pytest.mark.parametrize("module", [suffix_dedup, substring_dedup])
def test_covers_hold_every_difference(module):
    assert {(a - b) % module.PERIOD for a in module.COVER for b in module.COVER} == set(range(module.PERIOD))


def test_words_and_their_runs():
    texts = [b"a b  c", b"", b" \n", b"b c\xc3\xa9 \x0bd", b"a b c"]
    w = Words(texts)
    assert np.diff(w.first).tolist() == [3, 0, 0, 3, 3]
    assert [w.data[b:e].tobytes() for b, e in zip(w.begins, w.ends)] == [b"a", b"b", b"c", b"b", b"c\xc3\xa9", b"d", b"a", b"b", b"c"]
    begins, names = w.runs(2)
    assert begins.tolist() == [0, 1, 3, 4, 6, 7] and names[0] == names[4] and names[1] == names[5] and len(set(names.tolist())) == 4
    assert len(Powers(0).upto(10)[0]) >= 10
