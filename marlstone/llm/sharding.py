"""Sharding by a hierarchical weighted hash tree (native).

A tree of regions, racks and shards carries weights (a parent weighs what its
children weigh).  Each document descends from the root: at a node every child
draws ln(u) / weight, u a hash of (child, doc_id) in (0, 1), and the largest
draw wins.  A draw depends on nothing but the child and the document, so a
changed weight moves documents only into (or out of) the subtree whose weight
changed.  Trees grow by whole subtrees at the root, so that a further shard
takes documents only into itself.

``slot`` numbers the documents of a shard from 0 without gaps, by (hash block,
doc_id, checksum, size).  Counts per block give each block its first slot, and
rows are ranked inside blocks only, so no task ever holds a whole shard.

Edge cases: a null text has 8 bytes and checksum 0; null doc_ids draw as one
key; rows that repeat get slots of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import documents

N_SHARDS = 24
SHARDS_PER_RACK, RACKS_PER_REGION = 4, 3

#: path of a node -> [(path of a child, weight)]
Tree = dict[str, list[tuple[str, float]]]


def tree(n_shards: int, base: int = N_SHARDS) -> Tree:
    """Regions of racks of shards; each shard beyond ``base`` is a region of
    its own.  Every shard weighs 1."""
    per_region = SHARDS_PER_RACK * RACKS_PER_REGION
    place = lambda s: (f"/r{s // per_region}", f"k{s % per_region // SHARDS_PER_RACK}") if s < base else (f"/x{s}", "k0")
    kids: Tree = {"/": []}
    for s in range(n_shards):
        region, rack = place(s)
        rack = f"{region}/{rack}"
        for parent, child in (("/", region), (region, rack), (rack, f"{rack}/s{s}")):
            row = dict(kids.get(parent, []))
            kids[parent] = list((row | {child: row.get(child, 0.0) + 1.0}).items())
    return kids


def _draw(child: Column, key: Column) -> Column:
    digits = F.substring(F.md5(F.concat(child, F.lit("|"), key)), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))
    return F.ln(u)


def shard_of(key: Column, t: Tree) -> Column:
    """The shard that ``key`` (a string column) descends to."""
    nodes = F.create_map(*[x for p, kids in t.items() for x in (F.lit(p), F.array(*[F.struct(F.lit(c).alias("c"), F.lit(w).alias("w")) for c, w in kids]))])
    node: Column = F.lit("/")
    for _ in range(3):
        drawn = F.transform(F.element_at(nodes, node), lambda k: F.struct((_draw(k["c"], key) / k["w"]).alias("d"), k["c"].alias("c")))
        node = F.array_max(drawn)["c"]
    return F.substring_index(node, "/s", -1).cast("int")


def sharded(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and grown_shard of each document."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(F.coalesce("text", F.lit(""))) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        shard_of(key, tree(n_shards)).alias("shard"),
        shard_of(key, tree(n_shards + 1)).alias("grown_shard"),
        F.substring(F.md5(key), 1, 3).alias("block"),
    )
    counts = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = W.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")
    ranked = rows.withColumn("nth", F.row_number().over(inside) - 1)
    return ranked.join(first, ["shard", "block"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("nth")).cast("long").alias("slot"), "grown_shard")


def op3_weighted_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(documents(spark, sf_dir)).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _descent_sql(t: Tree, out: str) -> str:
    """CTEs <out>_1 to <out>_3 (id, node): the tree's levels as joins."""
    edges = ", ".join(f"('{p}', '{c}', {w})" for p, kids in t.items() for c, w in kids)
    sql = f"{out}_e(parent, child, w) AS (VALUES {edges}),\n{out}_0 AS (SELECT DISTINCT id, '/' AS node FROM d)"
    for i in range(3):
        sql += f",\n{out}_{i + 1} AS (SELECT id, max_by(child, ln((('0x' || substr(md5(child || '|' || id), 1, 13))::BIGINT::DOUBLE + 0.5) / {2.0**52}) / w) AS node FROM {out}_{i} JOIN {out}_e ON parent = node GROUP BY id)"
    return sql + f",\n{out} AS (SELECT id, split_part(node, '/s', 2)::INT AS shard FROM {out}_3)"


# The sixteen remainders of the CRC-32 polynomial for one nibble: fixed values.
_CRC = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"

OP3_SQL = f"""WITH d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS id, coalesce(text, '') AS t FROM documents),
nib AS (SELECT *, octet_length(encode(t)) AS n, string_split(hex(encode(t)), '') AS hx FROM d),
crc AS (SELECT doc_id, id, n + 8 AS size, xor(list_reduce(list_transform(range(0, 2 * n), lambda k: (instr('0123456789ABCDEF', hx[xor(k, 1) + 1]) - 1)::BIGINT),
  lambda c, b: xor(({_CRC})[xor(c, b) % 16 + 1], c >> 4), 4294967295::BIGINT), 4294967295) AS text_crc32 FROM nib),
{_descent_sql(tree(N_SHARDS), 'now')},
{_descent_sql(tree(N_SHARDS + 1), 'grown')}
SELECT doc_id, size, text_crc32, 'key' AS law, now.shard AS shard,
  row_number() OVER (PARTITION BY now.shard ORDER BY substr(md5(crc.id), 1, 3), doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown.shard AS grown_shard
FROM crc JOIN now USING (id) JOIN grown USING (id)"""
