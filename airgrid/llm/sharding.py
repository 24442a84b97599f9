"""Hierarchical weighted hash tree: documents descend region, rack and shard by weighted hash draws.

A node's children draw ``-ln(u) / weight`` with ``u`` hashed from the document and the child; the least draw wins.  A
child's share is its weight's share, and a change of one weight moves documents only along the paths whose weights
change.  A shard opened under a region of its own therefore takes documents only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airgrid.llm.catalog import register, table

CHUNKS = 4096  # equal parts of the key hash in which slots are numbered
OFFSET_ROWS = 100_000  # chunk offsets up to this many rows (24 bytes each) are broadcast


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def even_tree(shards: int, per_rack: int = 4, racks: int = 2) -> list[Leaf]:
    """Shards of weight 1, ``per_rack`` to a rack and ``racks`` to a region; the first shard past a full region opens a new one."""
    per_region = per_rack * racks
    return [Leaf(s // per_region, s % per_region // per_rack, s) for s in range(shards)]


def _draw(key: Column, child: Column, weight: Column) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat_ws("/", key, child)), 1, 13), 16, 10).cast("bigint")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / weight


def tree_shard(key: Column, leaves: list[Leaf]) -> Column:
    """The shard of a document, by three weighted draws; weights must be positive."""
    if not leaves or any(x.weight <= 0 for x in leaves) or len({x.shard for x in leaves}) < len(leaves):
        raise ValueError("a tree needs leaves with positive weights and distinct shards")
    children: dict[str, dict[str, float]] = {}
    for x in leaves:
        path = ["", f"r{x.region}", f"r{x.region}/k{x.rack}", f"r{x.region}/k{x.rack}/s{x.shard}"]
        for parent, child in zip(path, path[1:]):
            level = children.setdefault(parent, {})
            level[child] = level.get(child, 0.0) + x.weight
    tree = F.create_map(*[part for parent, level in sorted(children.items()) for part in (
        F.lit(parent), F.array(*[F.struct(F.lit(c).alias("child"), F.lit(w).alias("weight")) for c, w in sorted(level.items())]))])
    node = F.lit("")
    for _ in range(3):
        draws = F.transform(F.element_at(tree, node), lambda c: F.struct(_draw(key, c["child"], c["weight"]).alias("draw"), c["child"].alias("child")))
        node = F.array_min(draws)["child"]
    return F.regexp_extract(node, "s([0-9]+)$", 1).cast("int")


def shard_documents(docs: DataFrame, leaves: list[Leaf], grown: list[Leaf] | None = None) -> DataFrame:
    """Place every row of ``docs(doc_id, text)`` and number the rows of each shard without gaps.

    The shard depends on doc_id and the tree alone (law ``key``), so rows that share a doc_id share a shard.  A null
    doc_id is a key like any other.  A null text has size 1 and checksum 0.  Slots follow the hash of the key, then
    doc_id, checksum and size; rows equal in all of them are interchangeable.  No rows in, no rows out.

    Slots are counted per chunk of the key hash, then moved on by the chunks before; a chunk is ``1 / CHUNKS`` of a shard.
    Only narrow rows are shuffled; the counting pass reads doc_id alone.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    chunk = F.conv(F.substring(F.md5("_key"), 1, 3), 16, 10).cast("int").alias("chunk")
    keyed = docs.select("doc_id", key.alias("_key")).select(tree_shard(F.col("_key"), leaves).alias("shard"), chunk)
    counts = keyed.groupBy("shard", "chunk").count()
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    if len(leaves) * CHUNKS <= OFFSET_ROWS:
        offsets = F.broadcast(offsets)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", key.alias("_key"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = rows.select("doc_id", "size", "text_crc32", tree_shard(F.col("_key"), leaves).alias("shard"), chunk,
                         (tree_shard(F.col("_key"), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"))
    order = Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("_row", F.row_number().over(order) - 1).join(offsets, ["shard", "chunk"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                           (F.col("_before") + F.col("_row")).cast("bigint").alias("slot"), "grown_shard")


def _draw_sql(key: str, child: str, weight: str) -> str:
    return f"-ln((('0x' || substr(md5({key} || '/' || {child}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / {weight}"


def _tree_sql(shards: int) -> str:
    """Rows (key, shard) of an even tree: the winner of each level, found by window."""
    values = ", ".join(f"('r{x.region}', 'r{x.region}/k{x.rack}', 'r{x.region}/k{x.rack}/s{x.shard}', {x.shard})" for x in even_tree(shards))
    return f"""leaves_{shards} AS (SELECT * FROM (VALUES {values}) v(region, rack, leaf, shard)),
    region_{shards} AS (SELECT key, arg_min(region, draw) AS region FROM (SELECT key, region, {_draw_sql('key', 'region', 'w')} AS draw
        FROM keys, (SELECT region, count(*) AS w FROM leaves_{shards} GROUP BY region)) GROUP BY key),
    rack_{shards} AS (SELECT key, arg_min(rack, draw) AS rack FROM (SELECT key, rack, {_draw_sql('key', 'rack', 'w')} AS draw
        FROM region_{shards} JOIN (SELECT region, rack, count(*) AS w FROM leaves_{shards} GROUP BY ALL) USING (region)) GROUP BY key),
    shard_{shards} AS (SELECT key, arg_min(shard, draw) AS shard FROM (SELECT key, shard, {_draw_sql('key', 'leaf', '1')} AS draw
        FROM rack_{shards} JOIN leaves_{shards} USING (rack)) GROUP BY key)"""


# CRC-32 by the reflected polynomial of the standard (a fixed value): a table of 256 remainders, then a step per byte.
SQL_SHARDS = f"""WITH keys AS (SELECT DISTINCT coalesce(doc_id::VARCHAR, 'null') AS key FROM documents),
    {_tree_sql(16)}, {_tree_sql(17)},
    remainders AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, b) ORDER BY b) AS t
        FROM (SELECT unnest(range(256)) AS b)),
    sized AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS key, strlen(coalesce(text, '')) + 1 AS size,
        hex(encode(coalesce(text, ''))) AS x FROM documents),
    summed AS (SELECT doc_id, key, size, xor(4294967295, list_reduce(list_transform(range(size - 1), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)) AS text_crc32 FROM sized, remainders)
SELECT doc_id, size, text_crc32, 'key' AS law, a.shard::INT AS shard, row_number() OVER (PARTITION BY a.shard
        ORDER BY substr(md5(s.key), 1, 3), doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, b.shard::INT AS grown_shard
FROM summed s JOIN shard_16 a ON a.key = s.key JOIN shard_17 b ON b.key = s.key"""


@register("op7_weighted_hash_tree", SQL_SHARDS)
def sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards in two regions of two racks; the seventeenth opens a third region."""
    return shard_documents(table(spark, sf_dir, "documents"), even_tree(16), even_tree(17))
