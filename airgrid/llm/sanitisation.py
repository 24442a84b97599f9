"""Personal data, and the words that give it away: what the corpus says about a word decides whether it may stay.

E-mail addresses, IP addresses, card and phone numbers are found by pattern; each distinct value is a protected entity.  A
word near an entity tells about it as much as the corpus lets one conclude from the word: their pointwise mutual
information, log(n_we * N / (n_w * n_e)), against the entity's own information, log(N / n_e), counted over all documents.
Where the first reaches ``SHARE`` of the second, in ``SUPPORT`` different contexts at least, the word discloses the entity:
it is generalised to its first letters if these alone do not disclose it, else removed, wherever it stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.llm.catalog import register, table
from airgrid.llm.tasks import slices, stored
from airgrid.operators.ranking import with_rank
from airgrid.session import scratch_path

SHARE = 0.95  # of an entity's information that a word may not reach
SUPPORT = 3  # different contexts of a word and an entity
NEAR = 8  # words on either side of an entity that count as its context
STEM = 4  # letters that a generalised word keeps
CHUNK_WORDS = 200_000  # disclosing words that travel to the tasks at a time
MEMO_COUNTS = 200_000  # words a task counts before it hands its counts on
SPANS = "array<struct<kind: string, start: int, end: int>>"
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
KINDS = ["email", "ip", "card", "phone"]
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "removed": "[WORD]"}

# Fixed patterns of the base spans.  An address is found from its @, and a run of digits from its start, so that long runs
# are read once; the matches are the leftmost ones of the plain patterns.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"\w\w\w+")
_LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> Iterator[tuple[int, int]]:
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARACTERS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(free, at + 1))


def small_part(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def luhn(digits: str) -> bool:
    doubled = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(doubled) + sum(map(int, digits[::-2]))) % 10 == 0


def digits_of(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the base spans, in order; ends are exclusive, places count code points."""
    found = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(map(small_part, m[0].split("."))):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = digits_of(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits_of(m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def entity(kind: int, value: str) -> str:
    return f"{KINDS[kind]}:{digits_of(value) if kind > 1 else value.lower()}"


def stem(word: str) -> str:
    """What a word is generalised to."""
    return word[:STEM] + "*"


def free_words(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, word in small letters) of the words that touch no span; words are runs of three word characters or more."""
    words = [(m.start(), m.end(), m[0].lower()) for m in WORD.finditer(text)]
    if not spans:
        return words
    out, k, reach = [], 0, 0
    for w in words:
        while k < len(spans) and spans[k][0] < w[1]:
            reach = max(reach, spans[k][2])
            k += 1
        if reach <= w[0]:
            out.append(w)
    return out


def contexts(spans: list[tuple[int, int, int]], text: str, words: list[tuple[int, int, str]]) -> Iterator[tuple[str, str, str]]:
    """(entity, context, word) for the words near each base span; the context is the words and says where it was met."""
    from bisect import bisect_left

    starts = [w[0] for w in words]
    for start, kind, end in spans:
        at = bisect_left(starts, start)
        near = [w[2] for w in words[max(0, at - NEAR):at + NEAR]]
        name = entity(kind, text[start:end])
        context = " ".join(near)
        yield name, context, ""
        for word in set(near):
            yield name, context, word


def evidence(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What one reading of the texts tells about entities and words.

    First: (entity, word, context, n_docs), a row per document and context, where n_docs is one for the first context of
    a document only; the empty word stands for the entity itself, and stems for all words that begin with them.  Second:
    (word, n_docs), the documents with a word or stem, pre-counted.
    """
    path = scratch_path(docs.sparkSession, "evidence")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        counts: dict[str, int] = {}
        schema = pa.schema([("entity", pa.string()), ("word", pa.string()), ("context", pa.binary()), ("n_docs", pa.int64())])

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.nulls(len(counts), pa.string()), pa.array(counts, pa.string()),
                                               pa.nulls(len(counts), pa.binary()), pa.array(counts.values(), pa.int64())], schema=schema)

        def told_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in slices(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                spans = base_spans(text)
                words = free_words(text, spans) if spans else []
                once = {w[2] for w in words} if spans else {w.lower() for w in set(WORD.findall(text))}
                for w in [*once, *{stem(w) for w in once}, ""]:
                    counts[w] = counts.get(w, 0) + 1
                seen = set()
                for name, context, word in contexts(spans, text, words):
                    met = hashlib.blake2b(context.encode(), digest_size=8).digest()
                    for w in (word, stem(word)) if word else ("",):
                        rows.append((name, w, met, int((name, w) not in seen)))
                        seen.add((name, w))
                    if len(rows) > MEMO_COUNTS:
                        yield told_of(rows)
                        rows = []
            if rows:
                yield told_of(rows)
            if len(counts) > MEMO_COUNTS:
                yield counted()
                counts.clear()
        if counts:
            yield counted()

    told = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(read, "entity string, word string, context binary, n_docs bigint")
    # one row per word, entity and context leaves a task
    told.groupBy("entity", "word", "context").agg(F.sum("n_docs").alias("n_docs")).write.parquet(path)
    rows = docs.sparkSession.read.schema("entity string, word string, context binary, n_docs bigint").parquet(path)
    return rows.filter("entity IS NOT NULL"), rows.filter("entity IS NULL").select("word", "n_docs")


def disclosing_words(docs: DataFrame) -> DataFrame:
    """(word, verdict): ``stem`` where a word may stay by its first letters, ``removed`` where these disclose too."""
    near, everywhere = evidence(docs)
    pairs = near.groupBy("entity", "word").agg(F.sum("n_docs").alias("n_both"), F.count("*").alias("n_contexts"))
    pairs = stored(pairs.filter((F.col("n_contexts") >= SUPPORT) | (F.col("word") == "")), "pairs")
    entities = pairs.filter("word = ''").select("entity", F.col("n_both").alias("n_entity"))
    total = everywhere.filter("word = ''").agg(F.sum("n_docs")).first()[0] or 0
    shares = pairs.filter("word <> ''").join(entities, "entity").join(everywhere.filter("word <> ''"), "word")
    information = F.log(F.lit(float(total)) / F.col("n_entity"))
    told = F.log(F.col("n_both") / F.col("n_docs")) + information
    judged = shares.filter(told >= information * SHARE).select("entity", "word").withColumn("is_stem", F.col("word").endswith("*"))
    words = judged.filter("NOT is_stem").select("entity", "word", F.concat(F.substring("word", 1, STEM), F.lit("*")).alias("stem"))
    stems = judged.filter("is_stem").select("entity", F.col("word").alias("stem"), F.lit(True).alias("_told"))
    return words.join(stems, ["entity", "stem"], "left").groupBy("word").agg(
        F.when(F.bool_or(F.coalesce("_told", F.lit(False)) | (F.length("word") <= STEM)), "removed").otherwise("stem").alias("verdict"))


def sanitise(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``base`` and ``spans`` (arrays of kind, start, end) and ``clean``, the text made safe, per row of ``docs``.

    ``spans`` holds the base spans and those of disclosing words, of kind ``stem`` or ``removed``; words that touch a base
    span are left to it.  In ``clean`` a span is a mark in brackets or the word's first letters and an asterisk; where base
    spans overlap, the earlier one stands for both.  Rows are independent of each other's order; repeated rows count as
    documents but not as new contexts.  A null text is empty; null doc_ids, ties and extra columns do not matter; an empty
    table gives no rows.

    The list of disclosing words goes to the tasks in chunks of bounded size, each a pass over the texts.
    """
    spark = docs.sparkSession
    words = with_rank(disclosing_words(docs), ["word"])
    chunked = stored(words.withColumn("chunk", F.floor((F.col("rank") - 1) / CHUNK_WORDS)), "words")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                       F.array().cast(SPANS).alias("hits"))
    last = chunked.agg(F.max("chunk")).first()[0] or 0
    for chunk in range(last + 1):
        some = chunked.filter(F.col("chunk") == chunk).select("word", "verdict").toPandas()
        sent = spark.sparkContext.broadcast(dict(zip(some["word"], some["verdict"])))
        rows = with_hits(rows, sent)
        if chunk < last:
            rows = stored(rows, "hits")
            sent.destroy()
    return marked(rows)


def with_hits(rows: DataFrame, sent: Broadcast) -> DataFrame:
    """``rows(doc_id, text, hits)`` with the words of one chunk added to ``hits``."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verdicts = sent.value
        for batch in slices(batches, "text"):
            hits = batch.column("hits").to_pylist()
            if verdicts:
                for text, own in zip(batch.column("text").to_pylist(), hits):
                    if any(w.lower() in verdicts for w in set(WORD.findall(text))):
                        own += [{"kind": verdicts[w], "start": a, "end": b} for a, b, w in free_words(text, base_spans(text)) if w in verdicts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(hits, ARROW_SPANS)], ["doc_id", "text", "hits"])

    return rows.mapInArrow(look, f"doc_id bigint, text string, hits {SPANS}")


def marked(rows: DataFrame) -> DataFrame:
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            base, every, clean = [], [], []
            for text, hits in zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist()):
                found = [(a, k, KINDS[k], b) for a, k, b in base_spans(text)]
                base.append([{"kind": kind, "start": a, "end": b} for a, _, kind, b in found])
                found = sorted([*found, *[(h["start"], len(KINDS), h["kind"], h["end"]) for h in hits]])
                every.append([{"kind": kind, "start": a, "end": b} for a, _, kind, b in found])
                clean.append(cleaned(text, found))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, ARROW_SPANS), pa.array(every, ARROW_SPANS), pa.array(clean, pa.string())],
                                             ["doc_id", "base", "spans", "clean"])

    return rows.mapInArrow(mark, f"doc_id bigint, base {SPANS}, spans {SPANS}, clean string")


def cleaned(text: str, found: list[tuple[int, int, str, int]]) -> str:
    if not found:
        return text
    out, upto = [], 0
    for a, _, kind, b in found:
        if a >= upto:
            out += [text[upto:a], stem(text[a:b]) if kind == "stem" else MARKS[kind]]
        upto = max(upto, b)
    return "".join([*out, text[upto:]])


def reported(sanitised: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans as text."""

    def joined(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = map(count, KINDS)
    return sanitised.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


@register("op11_disclosure")
def sanitisation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reported(sanitise(table(spark, sf_dir, "documents")))
