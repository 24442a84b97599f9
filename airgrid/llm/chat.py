"""Multi-party perspective rotation: each participant's view of a dialogue, with that speaker as the assistant.

Native DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.llm.catalog import register, table
from airgrid.operators.ranking import with_rank

PART_TURNS = 512  # turns rendered into one row; longer dialogues go on in further parts
END = "<|im_end|>"


def _rendered(turns: Column, speaker: Column) -> Column:
    """Segments of the turns as ``speaker`` sees them: rendered text, and whether it is trained on."""

    def segment(t: Column) -> Column:
        mine = t["role"].eqNullSafe(speaker)
        head = F.when(mine, F.lit("assistant")).when(t["role"] == "system", F.lit("system")).otherwise(F.concat(F.lit("user name="), t["role"]))
        return F.struct(F.concat(F.lit("<|im_start|>"), head, F.lit("\n")).alias("head"),
                        F.concat(t["text"], F.lit(END)).alias("body"), mine.alias("trained"))

    return F.transform(turns, segment)


def _spans(segments: Column) -> Column:
    """Character spans [start, end) of what is trained on: the speaker's own text and its end mark."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        begin = acc["at"] + F.length(s["head"])
        end = begin + F.length(s["body"])
        span = F.concat_ws("-", begin.cast("string"), end.cast("string"))
        return F.struct((end + 1).alias("at"), F.when(s["trained"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(segments, start, step, lambda acc: F.array_join(acc["spans"], ","))


def rotate_perspectives(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """One row per (conversation, participant, part): the dialogue with that participant as the assistant.

    Every role but ``system`` is a participant; the others appear as users under their role's name.  A dialogue without
    participants gives one row with a null speaker and nothing trained.  Turns sort by turn (null last), role, text; a
    repeated row counts once.  A null role is ``unknown``, a null text empty, a null conv_id a conversation of its own.
    Control marks inside a text are broken by a space, so that a text cannot open a turn.  Dialogues of more than
    ``part_turns`` turns are cut into parts numbered from 0, so no row, and no task, holds more than one part: the turns
    of the long ones are ranked over key ranges, not gathered.
    """
    turns = conversations.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"),
        F.regexp_replace(F.coalesce("text", F.lit("")), r"<\|im_", "< |im_").alias("text")).distinct()
    long = turns.groupBy("conv_id").count().filter(F.col("count") > part_turns).select(F.col("conv_id").alias("_conv"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv"))
    late = F.coalesce("turn", F.lit((1 << 63) - 1))
    ranked = with_rank(turns.join(long, same, "left_semi").withColumn("_late", late), ["conv_id", "_late", "role", "text"])
    first = ranked.groupBy(F.col("conv_id").alias("_conv")).agg(F.min("rank").alias("_first"))
    cut = ranked.join(first, same).select(*turns.columns, F.floor((F.col("rank") - F.col("_first")) / part_turns).cast("int").alias("part"))
    whole = turns.join(long, same, "left_anti").withColumn("part", F.lit(0))
    turn = F.struct(F.col("turn").isNull().alias("_null"), "turn", "role", "text")
    parts = whole.unionByName(cut).groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    speakers = turns.filter(F.col("role") != "system").select(F.col("conv_id").alias("_conv"), F.col("role").alias("speaker")).distinct()
    seen = parts.join(speakers, same, "left").withColumn("segments", _rendered(F.col("turns"), F.col("speaker")))
    return seen.select(
        "conv_id", "speaker", "part", F.size("turns").cast("bigint").alias("n_turns"),
        F.size(F.filter("segments", lambda s: s["trained"])).cast("bigint").alias("n_trained"),
        F.concat(F.array_join(F.transform("segments", lambda s: F.concat(s["head"], s["body"])), "\n"), F.lit("\n")).alias("rendered"),
        _spans(F.col("segments")).alias("spans"))


SQL_CHAT = f"""WITH turns AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role,
        replace(coalesce(text, ''), '<|im_', '< |im_') AS text FROM conversations),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) - 1 AS k FROM turns),
    speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM turns WHERE role <> 'system'),
    seen AS (SELECT r.conv_id, speaker, k, (k // {PART_TURNS})::INT AS part, r.role IS NOT DISTINCT FROM speaker AS trained,
        '<|im_start|>' || CASE WHEN r.role IS NOT DISTINCT FROM speaker THEN 'assistant' WHEN r.role = 'system' THEN 'system'
            ELSE 'user name=' || r.role END || chr(10) AS head, text || '{END}' AS body
        FROM ranked r LEFT JOIN speakers s ON r.conv_id IS NOT DISTINCT FROM s.conv_id),
    placed AS (SELECT *, (sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker, part ORDER BY k)
        - length(body) - 1)::BIGINT AS b FROM seen)
SELECT conv_id, speaker, part, count(*) AS n_turns, count(*) FILTER (trained) AS n_trained,
    string_agg(head || body || chr(10), '' ORDER BY k) AS rendered,
    coalesce(string_agg(b::VARCHAR || '-' || (b + length(body))::VARCHAR, ',' ORDER BY k) FILTER (trained), '') AS spans
FROM placed GROUP BY conv_id, speaker, part"""


@register("op4_perspective_rotation", SQL_CHAT)
def chat_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(table(spark, sf_dir, "conversations"))
