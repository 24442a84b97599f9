import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from llm_cases import HARD_TEXTS, SF_DIR, empty, hard  # noqa: F401
from pyspark.sql import functions as F

from airgrid.llm import hard_negatives, prefix_trie, sanitisation, scans
from airgrid.llm.catalog import QUERIES

# running sums


@pytest.mark.parametrize("parts", [1, 7])
def test_running_sums_go_on_over_ranges(spark, parts):
    rng = random.Random(1)
    rows = [(rng.choice([3, 3, 3, 3, 5, -2, 9]), k, rng.randrange(-2**62, 2**62)) for k in range(400)]
    df = spark.createDataFrame(rows, "key long, place long, v long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        ordered = scans.in_order(df, "key", ["place"])
        got = scans.with_sums(ordered, "key", {"total": F.col("v"), "n": F.lit(1)}, "last").toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = pd.DataFrame(rows, columns=["key", "place", "v"]).sort_values(["key", "place"])
    want["total"] = want.groupby("key").v.transform(lambda v: np.cumsum(v.to_numpy()))
    want["n"] = want.groupby("key").cumcount() + 1
    want["last"] = want.groupby("key").place.transform("max") == want.place
    got = got.sort_values(["key", "place"])
    for c in want:
        assert got[c].tolist() == want[c].tolist(), c


def test_running_sums_are_worked_out_once_for_all_that_read_them(spark):
    rows = spark.createDataFrame([(c, k, "user", f"{c % 3} {k}") for c in range(40) for k in range(5)], "conv_id long, turn long, role string, text string")
    placed = prefix_trie.placed(prefix_trie.turn_rows(rows))
    named = prefix_trie.named_prefixes(prefix_trie.rebuilt(placed))
    for df in (placed, named, prefix_trie.screened(named, 1 << 10)):
        assert "MapInArrow" not in df._jdf.queryExecution().executedPlan().toString()


def test_sums_wrap_around(spark):
    ends = [0, 1, -1, 2**32 - 1, 2**32, -2**32, 2**62, -2**62, 2**63 - 1, -2**63, 0x123456789ABCDEF]
    df = spark.createDataFrame([(a, b) for a in ends for b in ends], "a long, b long")
    got = df.select("a", "b", scans.wrapped(F.col("a"), F.col("b")).alias("plus"), scans.wrapped(F.col("a"), F.bitwise_not(F.col("b")), 1).alias("minus"))
    for r in got.collect():
        assert (r.plus - (r.a + r.b)) % 2**64 == 0 and (r.minus - (r.a - r.b)) % 2**64 == 0


# operator 12

def plain_trie(convs: dict[int, list[tuple[str, str]]]) -> dict[tuple[int, int], tuple]:
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)

    def below(path):
        leaves, saved = (0, 0) if children[path] else (1, 0)
        for child in children[path]:
            a, b = below(child)
            leaves, saved = leaves + a, saved + b
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        return leaves, saved + (len(members[path]) - 1) * words

    out = {}
    for path, own in members.items():
        ends = ",".join(str(c) for c in own if len(convs[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out[(min(own), len(path))] = (parent, len(own), len(children[path]), *below(path), hashlib.sha256(ends.encode()).hexdigest())
    return out


def plain_order(rows) -> dict[int, list[tuple[str, str]]]:
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs[c].append((turn is not None, turn or 0, key, role, text))
    return {c: [x[3:] for x in sorted(turns)] for c, turns in convs.items()}


def plain_rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    return out


def trie_rows(df):
    rows = df.toPandas().astype(object)
    rows = rows.where(rows.notna(), None)
    got = {(r.conv_id, r.depth): (None if r.parent_conv_id is None else int(r.parent_conv_id), r.n_convs, r.n_children, r.n_leaves,
                                  r.saved_tokens, r.ends_sha256) for r in rows.itertuples()}
    assert len(got) == len(rows)
    return got


def odd_conversations():
    rng = random.Random(7)
    rows = []
    for c in range(-25, 130):
        like = rng.choice([0, 0, 0, c])  # many share one script
        for k in range(rng.choice([1, 2, 3, 4, 6])):
            rows.append((c, rng.choice([k, k, k, None]), rng.choice(["user", "assistant", None]) if like else "user", f"say {like} {k}" if rng.random() < 0.9 else None))
    rows += [(None, 1, "user", "nobody's"), (7, 3, "user", "again"), (7, 3, "user", "again"), (60, 1, "", ""), (61, 1, None, None)]
    rows += [(c, k, "user", f"long {k}") for c in (200, 201) for k in range(300)]  # as deep as they are alike
    rows += [(c, k, "user", f"copy {k}") for c in range(300, 360) for k in range(4)]
    return rows


@pytest.mark.parametrize("counters", [2, 1 << 20])
def test_trie_is_that_of_plain_python(spark, ranges, counters):
    rows = odd_conversations()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, depth string, key int")
    convs = plain_rebuilt(plain_order(rows))
    got = trie_rows(prefix_trie.build_trie(prefix_trie.rebuilt(prefix_trie.placed(prefix_trie.turn_rows(df))), counters))
    assert got == plain_trie(convs)


@pytest.mark.parametrize("counters", [512, 1024, 2048])
def test_a_tail_begins_once_where_the_sketch_is_too_high_further_on(spark, counters):
    rows = odd_conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = prefix_trie.rebuilt(prefix_trie.placed(prefix_trie.turn_rows(df)))
    found = prefix_trie.screened(prefix_trie.materialise(prefix_trie.named_prefixes(turns)), counters).select("conv_id", "depth", "single").toPandas()
    tops = found[found.single == 1]
    assert len(tops) and not tops.conv_id.duplicated().any()
    tails = found[found.single > 1].merge(tops, on="conv_id")
    assert len(tails) == (found.single > 1).sum() and (tails.depth_x > tails.depth_y).all()
    assert trie_rows(prefix_trie.build_trie(turns, counters)) == plain_trie(plain_rebuilt(plain_order(rows)))


def test_trie_query_is_that_of_plain_python_on_a_larger_table(spark):
    folder = SF_DIR.replace("sf0.001", "sf0.1")
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert trie_rows(QUERIES["op12_prefix_trie"](spark, folder)) == plain_trie(plain_rebuilt(plain_order(rows)))


def test_trie_of_conversations_as_they_are(spark):
    rows = odd_conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert trie_rows(prefix_trie.conversation_trie(df)) == plain_trie(plain_order(rows))
    assert prefix_trie.conversation_trie(df.limit(0)).count() == 0


@pytest.mark.parametrize("span", [1, 4, 1 << 12])
def test_ends_are_hashed_over_many_pieces(spark, ranges, monkeypatch, span):
    monkeypatch.setattr(prefix_trie, "ENDS_SPAN", span)
    rows = [(c * step, k, "user", f"{c % 2} {k}") for c in range(-30, 30) for k in range(2) for step in (1, 10**15)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert trie_rows(prefix_trie.conversation_trie(df)) == plain_trie(plain_order(rows))


def test_tails_stay_out_of_the_groups(spark):
    rows = [(c, k, "user", f"{c} {k}") for c in range(50) for k in range(20)]
    turns = prefix_trie.placed(prefix_trie.turn_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    prefixes = prefix_trie.materialise(prefix_trie.named_prefixes(
        turns.select("conv_id", "key", "n_words", "place").unionByName(prefix_trie.roots(turns.select("conv_id").distinct()))))
    found = {r["single"]: r["count"] for r in prefix_trie.screened(prefixes, 1 << 20).groupBy("single").count().collect()}
    assert found[0] == 50 and sum(found.values()) == 50 * 21  # only the roots are shared


# operator 13

def plain_negatives(rows):
    def usable(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    rows = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows if i is not None and label is not None and usable(v)]

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    out = []
    for n, (i, label, v) in enumerate(rows):
        if i % 100:
            continue
        others = [(-score(v, w), j, m) for k, (j, m, w) in enumerate(rows) if k != n]
        for p, j, _ in sorted((s, j, m) for s, j, m in others if m == label)[:5]:
            fit = sorted((s, k) for s, k, m in others if m != label and 80 * -p <= 100 * -s <= 100 * -p)[:5]
            out += [(i, j, rank + 1, k, -p, -s) for rank, (s, k) in enumerate(fit)]
    return sorted(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("width", [1, 3, 24, 64])
def test_negatives_are_those_of_all_pairs(spark, monkeypatch, width):
    rng = np.random.default_rng(width)
    rows = []
    for i in rng.permutation(900):
        label = int(i) % 3
        v = rng.normal(size=width) * 0.2 + (label == 1) * 0.3 + 0.2
        rows.append((int(i), [round(float(x), 2) for x in v], label))
    rows += [(2000 + k, rows[5][1], k % 3) for k in range(40)]  # ties
    rows += [(5000, None, 1), (5100, [0.1] * width, None), (None, [0.1] * width, 1), (5200, [None] * width, 1), (5300, [float("nan")] * width, 0),
             (5400, [], 1), (5500, [0.5], 2), (5501, [0.5, 0.25, 0.125, 0.5], 1), (5502, [-0.5] * (width + 2), 0), (5600, [float("inf")], 0)]
    rows += [rows[0], (600, [0.4] * width, 1)]  # a repeated row, a repeated id
    monkeypatch.setattr(hard_negatives, "CHUNK_ANCHORS", 4)
    df = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "vec_id long, embedding array<double>, label int, q string, score double").repartition(5)
    got = sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0).select(COLUMNS).collect())
    assert got == plain_negatives(rows)


def test_negatives_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(df, F.col("vec_id") % 100 == 0).columns == COLUMNS
    assert hard_negatives.mine(df, F.col("vec_id") % 100 == 0).count() == 0


def test_bounds_hold_and_close_pairs():
    rng = np.random.default_rng(0)
    a, b = (np.floor(256 * (rng.normal(size=(n, 64)) + shift)) for n, shift in ((20, 3.0), (30, -3.0)))
    scores = hard_negatives.products(a, b)
    sa, sb = hard_negatives.Summaries(a), hard_negatives.Summaries(b)
    for (ma, da), (mb, db) in zip(sa.levels, sb.levels):
        assert (np.abs(ma @ mb.T - scores) <= da @ db.T + 1e-3).all()
    far = np.full(len(a), float(scores.max() + 10**8))
    assert not len(hard_negatives.open_pairs(sa, sb, far, far + 1)[0])
    rows, columns = hard_negatives.open_pairs(sa, sb, np.full(len(a), float(scores.min())), np.full(len(a), float(scores.max())))
    assert set(np.nonzero(scores == scores.max())[0]) <= set(rows) and set(np.nonzero(scores == scores.max())[1]) <= set(columns)


# operator 11

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(text):
    def good(kind, value):
        digits = "".join(c for c in value if c in "0123456789")
        if kind == "ip":
            return all(int(p) <= 255 for p in value.split("."))
        if kind == "card":
            total = sum(int(d) if k % 2 == 0 else sum(map(int, str(2 * int(d)))) for k, d in enumerate(reversed(digits)))
            return 12 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    found = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text) if good(kind, m[0])]
    return ",".join(f"{list(PLAIN)[k]}:{a}:{b}" for a, k, b in sorted(found))


PII_TEXTS = [
    "Write to a.b@c.de_x@d.example.com, b@c or @d.e, a@b..c; Größe@x.yz", "10.0.0.255 256.1.1.1 1.2.3.4.5.6.7.8 0001.2.3.4 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 0000000000000",
    "+1 (234) 567-8901 +12 +1-2-3-4-5-6-7-8-9-0 ++4989123456 7", "١٢٣.1.1.1 ４111111111111111", "x@y.z" * 50, "9" * 5000, "a" * 5000 + "@b.co", "1." * 3000, "+" * 2000 + "1 2 3 4 5 6 7 8 9", "1 " * 3000]


def test_base_spans_are_those_of_the_plain_patterns():
    rng = random.Random(3)
    texts = [*PII_TEXTS, *["".join(rng.choice("aB1@.+- ()_9é") for _ in range(rng.randrange(80))) for _ in range(4000)]]
    for text in texts:
        assert ",".join(f"{sanitisation.KINDS[k]}:{a}:{b}" for a, k, b in sanitisation.base_spans(text)) == plain_base(text), text[:80]


def test_query_has_the_base_spans_of_every_document(spark):
    got = QUERIES["op11_disclosure"](spark, SF_DIR).toPandas()
    docs = pd.read_parquet(f"{SF_DIR}/documents.parquet")
    base = {i: plain_base(t) for i, t in zip(docs.doc_id, docs.text)}
    assert len(got) == len(docs)
    for r in got.itertuples():
        kinds = [s.split(":")[0] for s in base[r.doc_id].split(",")]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds.count(k) for k in sanitisation.KINDS]
        assert r.base_sha256 == hashlib.sha256(base[r.doc_id].encode()).hexdigest()
        assert set(filter(None, base[r.doc_id].split(","))) <= set(r.spans.split(","))


def told_corpus():
    """A nickname that stands by one address, another whose first letters many share, a phrase around all addresses."""
    rng = random.Random(5)
    filler = [f"filler{k}" for k in range(300)]

    def some(n):
        return " ".join(rng.sample(filler, n))

    texts = [f"{some(12)} zorblax {some(3)} write john.doe@mail.example.com {some(12)}" for _ in range(8)]
    texts += [f"{some(12)} Quinquist {some(3)} write ann@mail.example.com {some(12)}" for _ in range(8)]
    texts += [f"{some(20)} quin{k} quinces" for k in range(60)]
    texts += [f"{some(5)} write other{k}@mail.example.com now" for k in range(40)]
    texts += [f"{some(20)} write zorblax again"] + [some(30) for _ in range(300)]
    texts += ["copied oncealone text +49 89 123456 78 here"] * 50  # one context, however often it is copied
    return texts


def plain_verdicts(texts):
    """By counting sets of documents."""
    docs, near, contexts_of = defaultdict(set), defaultdict(set), defaultdict(set)
    of = defaultdict(set)
    for n, text in enumerate(texts):
        spans = [(int(a), k, int(b)) for s in plain_base(text).split(",") if s for k, a, b in [s.split(":")]]
        words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"\w{3,}", text) if not any(a < m.end() and m.start() < b for a, _, b in spans)]
        for w in words:
            docs[w[2]].add(n)
            docs[w[2][:4] + "*"].add(n)
        for a, kind, b in spans:
            value = text[a:b].lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", text[a:b])
            before, after = [w[2] for w in words if w[0] < a][-8:], [w[2] for w in words if w[0] >= a][:8]
            of[value].add(n)
            for w in before + after:
                for x in (w, w[:4] + "*"):
                    near[value, x].add(n)
                    contexts_of[value, x].add(" ".join(before + after))
    told = set()
    for (value, x), both in near.items():
        information = math.log(len(texts) / len(of[value]))
        if len(contexts_of[value, x]) >= 3 and math.log(len(both) / len(docs[x])) + information >= 0.95 * information:
            told.add((value, x))
    verdicts = {}
    for value, x in told:
        if not x.endswith("*"):
            worse = len(x) <= 4 or (value, x[:4] + "*") in told or verdicts.get(x) == "removed"
            verdicts[x] = "removed" if worse else "stem"
    return verdicts


def test_disclosing_words_are_generalised_or_removed(spark, monkeypatch):
    texts = told_corpus()
    want = plain_verdicts(texts)
    assert want.get("zorblax") == "removed" and want.get("quinquist") == "stem" and "write" not in want and "oncealone" not in want
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r["word"]: r["verdict"] for r in sanitisation.disclosing_words(df).collect()}
    assert got == want
    whole = {r["doc_id"]: r for r in sanitisation.sanitise(df).collect()}
    assert "[WORD]" in whole[0]["clean"] and "[EMAIL]" in whole[0]["clean"] and "zorblax" not in whole[0]["clean"]
    assert "Quin* " in whole[8]["clean"] and whole[116]["clean"].endswith("write [WORD] again")
    assert whole[200]["clean"] == texts[200]
    monkeypatch.setattr(sanitisation, "CHUNK_WORDS", 1)
    assert {r["doc_id"]: r for r in sanitisation.sanitise(df).collect()} == whole


def test_sanitising_odd_rows(spark, hard, empty):  # noqa: F811
    got = sanitisation.reported(sanitisation.sanitise(hard.withColumn("hits", F.lit(1)))).toPandas()
    assert len(got) == len(HARD_TEXTS) and (got.spans == "").all()
    assert sanitisation.sanitise(empty).count() == 0
    rows = [(None, "mail a@b.cd"), (1, "mail a@b.cd"), (1, "mail a@b.cd"), (2, None)]
    got = sanitisation.reported(sanitisation.sanitise(spark.createDataFrame(rows, "doc_id long, text string"))).toPandas()
    assert sorted(got.spans) == ["", *["email:5:11"] * 3]
