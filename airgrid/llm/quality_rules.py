"""Quality rules whose cut-offs come from the data: quantile sketches per language and source.

The sketch is a histogram with buckets of bounded relative width (integers below 64 exact, then 32 buckets per doubling).
Sketches merge by adding counts, in any order and grouping, with the same result: Spark's partial aggregation is the merge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airgrid.llm.catalog import register, table
from airgrid.llm.tasks import slices, stored
from airgrid.llm.words import word_bounds

# Fixed base rules.
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 20, 30, 8
# Adaptive rules: a document goes if a metric is beyond SLACK times a quantile (in per mille) plus a margin.  The quantile is
# the group's, blended with its language's, and that with the table's: of n documents a level's own counts n against WEIGHT.
# A group's cut-off is at most BOUND times its language's, and that at most BOUND times the table's.
QUANTILE, SLACK, WEIGHT, BOUND = 500, 3, 50, 4
MOST = 1_000_000  # from here on more documents leave a level's say as it is: products stay within 64 bits
MARGIN = {"symbol_rate": 30, "dup_line_rate": 30, "repeat_rate": 50, "word_length": 0}  # per mille; for groups whose quantile is 0
METRICS = list(MARGIN)
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words covered by windows of ``window`` words (a power of two) found twice or more; exact.

    Windows are named by doubling: the rank of a pair of names is the name of a window twice as long.
    """
    n, length = len(ids), 1
    if n <= window:
        return 0
    while length < window:
        pairs = ids[:-length].astype(np.int64) * (int(ids.max()) + 1) + ids[length:]
        ids = np.unique(pairs, return_inverse=True)[1]
        length *= 2
    twice = np.bincount(ids)[ids] > 1
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, np.flatnonzero(twice), 1)
    np.add.at(edges, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text's UTF-8 bytes."""
    data = np.frombuffer(text, np.uint8)
    begins, _ = word_bounds(data)
    if not len(begins):
        return 0, 0, int(SYMBOLS[data].sum()), 0, 0
    words = text.split()
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    chars = sum(map(len, words)) - int(((data & 0xC0) == 0x80).sum())
    lines = [x for x in text.split(b"\n") if x.strip()] if b"\n" in text else [text]
    return len(words), chars, int(SYMBOLS[data].sum()), len(lines) - len(set(lines)), repeated_words(ids)


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the base counts of every whole text; a null text counts as empty."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            counts = np.array([base_counts(t) for t in batch.column("_text").to_pylist()], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *map(pa.array, counts.T)], [*keep, *names])

    chosen = docs.select(*keep, F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("_text"))
    kinds = ", ".join(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in keep)
    return chosen.mapInArrow(count, f"{kinds}, {', '.join(f'{n} bigint' for n in names)}")


def bucket(x: Column) -> Column:
    """Bucket of a non-negative integer: itself below 64, else by its highest bit and the five bits below."""
    shift = F.length(F.bin(x)) - 6
    return F.when(x < 64, x).otherwise(shift * 32 + F.floor(x / F.pow(F.lit(2), shift))).cast("int")


def upper(b: Column) -> Column:
    """The largest integer of a bucket."""
    shift = F.floor((b - 64) / 32) + 1
    return F.when(b < 64, b).otherwise((((b - 64) % 32 + 33) * F.pow(F.lit(2), shift)) - 1).cast("bigint")


def sketches(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Bucket counts per group and metric: (keys, metric, bucket, n)."""
    long = F.array(*[F.struct(F.lit(m).alias("metric"), bucket(F.col(m)).alias("bucket")) for m in METRICS])
    return metrics.select(*keys, F.inline(long)).groupBy(*keys, "metric", "bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """The sketch of coarser groups, from that of finer ones."""
    return sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group: its number of documents ``n_group`` and the quantile ``q_`` of each metric, all from the sketch."""
    upto = Window.partitionBy(*keys, "metric").orderBy("bucket")
    whole = Window.partitionBy(*keys, "metric")
    ranked = sketch.withColumns({"_upto": F.sum("n").over(upto), "_all": F.sum("n").over(whole)})
    quantile = F.min(F.when(F.col("_upto") * 1000 >= F.col("_all") * QUANTILE, F.col("bucket")))
    per_metric = ranked.groupBy(*keys, "metric").agg(upper(quantile).alias("q"), F.max("_all").alias("n_group"))
    return per_metric.groupBy(*keys).agg(F.max("n_group").alias("n_group"), *[F.max(F.when(F.col("metric") == m, F.col("q"))).alias(f"q_{m}") for m in METRICS])


def blended(own: Column, n: Column, coarser: Column) -> Column:
    """A level's quantile drawn towards that of the level above, the more the fewer documents it has."""
    n = F.least(n, F.lit(MOST))
    return F.call_function("div", own * n + coarser * WEIGHT, n + WEIGHT)


def cutoff(metric: str, group: Column, language: Column, table: Column) -> Column:
    """The cut-off of a document by the quantiles of its group, language and table."""
    q = f"q_{metric}"
    upper_q = table[q]
    lang_q = blended(language[q], language["n_group"], upper_q)
    group_q = blended(group[q], group["n_group"], lang_q)
    of_table, of_lang, of_group = (x * SLACK + MARGIN[metric] for x in (upper_q, lang_q, group_q))
    return F.least(of_group, BOUND * F.least(of_lang, BOUND * of_table))


def judge(docs: DataFrame) -> DataFrame:
    """Base counts and verdict for every row of ``docs(doc_id, text, lang, source)``.

    ``base_failed``: fewer than 20 words, or over 30 % of the words in repeated windows of eight.  Otherwise a row is kept
    if none of its rates is beyond the cut-off of its language and source: ``SLACK`` times a ``QUANTILE`` plus a margin,
    where the quantile moves from the table's to the language's to the group's own as these grow, without a step, and is
    bounded by the levels above, so that a source made of junk does not set its own standard.  A null language or source is a group like any other; a null text is empty and fails.  Repeated rows count each.
    """
    kept = stored(measure(docs, ["doc_id", "lang", "source"]), "measured")
    words = F.greatest("n_words", F.lit(1))
    rates = {"symbol_rate": F.col("n_symbols") * 1000 / F.greatest("word_chars", F.lit(1)), "dup_line_rate": F.col("n_dup_lines") * 1000 / words,
             "repeat_rate": F.col("n_repeat_words") * 1000 / words, "word_length": F.col("word_chars") * 1000 / words}
    base_failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT)
    rated = kept.select("*", base_failed.alias("base_failed"), *[F.floor(rates[m]).cast("bigint").alias(m) for m in METRICS])
    finest = stored(sketches(rated, ["lang", "source"]), "sketches")
    by_lang = merged(finest, ["lang"])
    everywhere = merged(by_lang, [])
    out = rated
    for name, level, keys in (("_group", quantiles(finest, ["lang", "source"]), ["lang", "source"]), ("_language", quantiles(by_lang, ["lang"]), ["lang"])):
        cut = level.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct("n_group", *[f"q_{m}" for m in METRICS]).alias(name))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        out = out.join(cut, same, "left").drop(*[f"_{k}" for k in keys])
    last = quantiles(everywhere, []).first()  # one row: the whole table's
    whole = F.struct(*[F.lit(last[f"q_{m}"] if last else None).cast("bigint").alias(f"q_{m}") for m in METRICS])
    beyond = F.lit(False)
    for m in METRICS:
        beyond = beyond | (F.col(m) > cutoff(m, F.col("_group"), F.col("_language"), whole))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & ~beyond).alias("kept"))


_QUANTILES = ", ".join(f"max(CASE WHEN metric = '{m}' THEN q END) AS q_{m}" for m in METRICS)
_SPLIT = r"list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"


def _level_sql(name: str, sketch: str, keys: str) -> str:
    by = f"{keys}, " if keys else ""
    return f"""{name} AS (SELECT {by}max(n_group) AS n_group, {_QUANTILES} FROM (SELECT {by}metric, max(a) AS n_group,
        min(CASE WHEN c * 1000 >= a * {QUANTILE} THEN CASE WHEN bucket < 64 THEN bucket
            ELSE ((bucket - 64) % 32 + 33) * (1::BIGINT << ((bucket - 64) // 32 + 1)) - 1 END END) AS q
        FROM (SELECT *, sum(n) OVER (PARTITION BY {by}metric ORDER BY bucket) AS c, sum(n) OVER (PARTITION BY {by}metric) AS a
            FROM {sketch}) GROUP BY {by}metric) {f'GROUP BY {keys}' if keys else ''})"""


def _cut_sql(m: str) -> str:
    n_lang, n_group = (f"least({level}.n_group, {MOST})" for level in "ba")
    lang_q = f"((b.q_{m} * {n_lang} + c.q_{m} * {WEIGHT}) // ({n_lang} + {WEIGHT}))"
    group_q = f"((a.q_{m} * {n_group} + {lang_q} * {WEIGHT}) // ({n_group} + {WEIGHT}))"
    of_group, of_lang, of_table = (f"({q} * {SLACK} + {MARGIN[m]})" for q in (group_q, lang_q, f"c.q_{m}"))
    return f"least({of_group}, {BOUND} * least({of_lang}, {BOUND} * {of_table}))"


SQL_RULES = f"""WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text, {_SPLIT} AS words FROM documents),
    w AS (SELECT rid, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM docs),
    grams AS (SELECT rid, i, [{', '.join(['w', *[f'lead(w, {k}) OVER o' for k in range(1, 8)]])}] AS g FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
    twice AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) > 1 AND g[8] IS NOT NULL AS t FROM grams),
    covered AS (SELECT rid, bool_or(t) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c FROM twice),
    repeats AS (SELECT rid, count(*) FILTER (c) AS n FROM covered GROUP BY rid),
    lines AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs)
        WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]') GROUP BY rid),
    measured AS (SELECT doc_id, lang, source, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
        FROM docs LEFT JOIN repeats r USING (rid) LEFT JOIN lines l USING (rid)),
    rated AS (SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEATED_PERCENT} AS base_failed,
        n_symbols * 1000 // greatest(word_chars, 1) AS symbol_rate, n_dup_lines * 1000 // greatest(n_words, 1) AS dup_line_rate,
        n_repeat_words * 1000 // greatest(n_words, 1) AS repeat_rate, word_chars * 1000 // greatest(n_words, 1) AS word_length FROM measured),
    valued AS (UNPIVOT (SELECT lang, source, {', '.join(METRICS)} FROM rated) ON {', '.join(METRICS)} INTO NAME metric VALUE x),
    finest AS (SELECT lang, source, metric, CASE WHEN x < 64 THEN x ELSE (length(to_base(x, 2)) - 6) * 32
        + (x >> (length(to_base(x, 2)) - 6)) END AS bucket, count(*) AS n FROM valued GROUP BY ALL),
    by_lang AS (SELECT lang, metric, bucket, sum(n) AS n FROM finest GROUP BY ALL),
    everywhere AS (SELECT metric, bucket, sum(n) AS n FROM by_lang GROUP BY ALL),
    {_level_sql('cut_0', 'finest', 'lang, source')}, {_level_sql('cut_1', 'by_lang', 'lang')}, {_level_sql('cut_2', 'everywhere', '')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed
    {' '.join(f"AND {m} <= {_cut_sql(m)}" for m in METRICS)} AS kept
FROM rated LEFT JOIN cut_0 a ON rated.lang IS NOT DISTINCT FROM a.lang AND rated.source IS NOT DISTINCT FROM a.source
    LEFT JOIN cut_1 b ON rated.lang IS NOT DISTINCT FROM b.lang CROSS JOIN cut_2 c"""


@register("op6_adaptive_rules", SQL_RULES)
def rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
