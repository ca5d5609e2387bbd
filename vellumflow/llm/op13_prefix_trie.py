"""Prefix trie of conversations, built and summed up level by level.

A node of depth d stands for a sequence of d turns that conversations begin with. Going down, the conversations of each node that
has several members are grouped by their next turn, all nodes of a depth in one job; a group is a node of the next depth and takes
its smallest conversation's identifier. Going up, each depth's nodes are joined with the sums of their children. What comes after a
node with one member is a path of nodes with one member each, whose figures follow from its length, so levels end with the longest
beginning that two conversations share.

Turns are compared by SHA-256 of role and text; texts are read once and not shuffled. A turn is a row, a conversation is numbered
by ranges of all turns, and hot nodes meet partial counts only, so neither a long conversation nor a common beginning is one task's.
Identifiers that end at a node are hashed in order while they stream through a task, which holds one batch of them.

Defined cases
- null role or text: empty. Null turn: before all numbers. Turns with the same number: in order of their SHA-256; repeated rows are
  repeated turns. Rows without a conversation's identifier belong to no conversation and are left out.
- a rebuilt conversation without turns is a member of the root. An empty table has no nodes, not even a root.
- the rest of a division keeps the sign of the identifier, so -7 is rebuilt from -5. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialize, scratch_path
from ..sources.tables import read_table

#: Depths made from a row at a time where a path of single nodes is written out.
STEP = 1 << 16
LEVEL = "conv long, len long, node long, parent long, n long, bytes long"
SUMS = "conv long, len long, parent long, n long, bytes long, n_children long, n_leaves long, saved_tokens long"


# --- conversations --------------------------------------------------------------------------------------------------------


def digest_turns(conversations: DataFrame) -> DataFrame:
    """conv, turn, key (SHA-256 of role and text), bytes of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where(F.col("conv_id").isNotNull())
    return rows.select(F.col("conv_id").cast("long").alias("conv"), "turn", key.alias("key"), F.octet_length(text).cast("long").alias("bytes"))


def number_turns(turns: DataFrame) -> DataFrame:
    """conv, pos (1, 2, ... in order of turn), key, bytes.

    Ranges of all turns are numbered each on their own; a range adds what earlier ones hold of the conversation it begins with, which
    is one row for a range at most.
    """
    placed = materialize(turns.repartitionByRange("conv", "turn", "key").withColumn("part", F.spark_partition_id()), "trie-turns")
    sizes = placed.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("size"))
    earlier = F.sum("size").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select("conv", "part", earlier.alias("before")).where("before > 0")
    inside = placed.withColumn("at", F.row_number().over(Window.partitionBy("part", "conv").orderBy("turn", "key")))
    return inside.join(F.broadcast(before), ["conv", "part"], "left").select("conv", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "key", "bytes")


def as_they_are(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) for ``build_trie``: conv, len and conv, pos, key, bytes."""
    return numbered.groupBy("conv").agg(F.max("pos").alias("len")), numbered


def rebuilt(numbered: DataFrame, *, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) in which each conversation c begins with the first h turns of c - c % every.

    h is crc32 of c in decimal, modulo ``most``; of c's own turns those after the first h follow.
    """
    own = numbered.groupBy("conv").agg(F.max("pos").alias("own"))
    first, h = F.col("conv") - F.col("conv") % every, F.crc32(F.col("conv").cast("string")) % most
    plan = own.select("conv", first.alias("first"), F.when(first == F.col("conv"), 0).otherwise(h).alias("h"), "own")
    firsts = own.select(F.col("conv").alias("first"), F.col("own").alias("there"))
    plan = plan.join(firsts, "first", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    plan = plan.select("conv", "first", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len"))
    plan = materialize(plan, "trie-plan")
    rest = numbered.join(plan, "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "key", "bytes")
    begin = numbered.where(F.col("pos") < most).withColumnRenamed("conv", "first")
    begin = begin.join(plan.where("taken > 0"), "first").where("pos <= h").select("conv", "pos", "key", "bytes")
    return plan.select("conv", "len"), rest.unionByName(begin)


# --- levels ----------------------------------------------------------------------------------------------------------------


def _write_level(rows: DataFrame, path: str, depth: int) -> bool:
    """Write the level of ``depth``; whether a node of it has several members of which some go on."""
    seen = Observation()
    more = F.count_if((F.col("n") > 1) & (F.col("len") > depth)).alias("more")
    rows.observe(seen, more).write.parquet(f"{path}/depth={depth}")
    return seen.get.get("more", 0) > 0


def build_levels(conversations: DataFrame, turns: DataFrame) -> tuple[str, int]:
    """(path, depths) of tables depth=0, 1, ... of (conv, len, node, parent, n, bytes): members of nodes whose parent has several."""
    spark, path = conversations.sparkSession, scratch_path(conversations.sparkSession, "trie-levels")
    turns = materialize(turns.sortWithinPartitions("pos"), "trie-rebuilt")  # a level reads the pages that hold its position
    root = conversations.agg(F.min("conv").alias("node"), F.count(F.lit(1)).alias("n")).where("n > 0")
    rows = conversations.crossJoin(F.broadcast(root))  # one row
    rows = rows.select("conv", "len", "node", F.lit(None).cast("long").alias("parent"), "n", F.lit(0).cast("long").alias("bytes"))
    depth = 0
    while _write_level(rows, path, depth):
        level = spark.read.schema(LEVEL).parquet(f"{path}/depth={depth}").where((F.col("n") > 1) & (F.col("len") > depth))
        depth += 1
        here = level.select("conv", "len", F.col("node").alias("parent")).join(turns.where(F.col("pos") == depth), "conv")
        nodes = here.groupBy("parent", "key").agg(F.min("conv").alias("node"), F.count(F.lit(1)).alias("n"))
        rows = here.join(nodes, ["parent", "key"]).select("conv", "len", "node", "parent", "n", "bytes")
    return path, depth + 1


def roll_up(spark: SparkSession, levels: str, depths: int) -> str:
    """Path of tables depth=0, 1, ... with a row per node, ``conv``, from the deepest up: children, leaves and savings of subtrees."""
    path, below = scratch_path(spark, "trie-sums"), None
    for depth in reversed(range(depths)):
        nodes = spark.read.schema(LEVEL).parquet(f"{levels}/depth={depth}").where("conv = node").drop("node")
        if below is None:
            below = nodes.limit(0).select("parent", F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
        sums = below.groupBy(F.col("parent").alias("conv")).agg(F.count(F.lit(1)).alias("_children"), F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved"))
        single, leaves = F.col("n") == 1, F.coalesce("_leaves", F.lit(1))
        nodes.join(sums, "conv", "left").select(
            "conv",
            "len",
            "parent",
            "n",
            "bytes",
            F.when(single, (F.col("len") > depth).cast("long")).otherwise(F.coalesce("_children", F.lit(0))).alias("n_children"),
            F.when(single, 1).otherwise(leaves).cast("long").alias("n_leaves"),
            ((F.col("n") - 1) * F.col("bytes") + F.coalesce("_saved", F.lit(0))).alias("saved_tokens"),
        ).write.parquet(f"{path}/depth={depth}")
        below = spark.read.schema(SUMS).parquet(f"{path}/depth={depth}")
    return path


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(depth, node, ends_sha256) from (depth, node, conv) in this order; a group may span any number of batches."""
    at, digest = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"depth": pa.array([at[0]], pa.int64()), "node": pa.array([at[1]], pa.int64()), "ends_sha256": pa.array([digest.hexdigest()])})

    for batch in batches:
        depths, nodes, convs = (batch.column(i).to_pylist() for i in range(3))
        i = 0
        while i < len(convs):
            here, j = (depths[i], nodes[i]), i + 1
            while j < len(convs) and depths[j] == here[0] and nodes[j] == here[1]:
                j += 1
            ids = ",".join(map(str, convs[i:j])).encode()
            if here == at:
                digest.update(b"," + ids)
            else:
                if at is not None:
                    yield row()
                at, digest = here, hashlib.sha256(ids)
            i = j
    if at is not None:
        yield row()


def build_trie(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    spark = conversations.sparkSession
    levels, depths = build_levels(conversations, turns)
    sums = roll_up(spark, levels, depths)
    members = spark.read.schema(f"{LEVEL}, depth long").parquet(levels)
    nodes = spark.read.schema(f"{SUMS}, depth long").parquet(sums)
    ending = members.where("n > 1 and len = depth").select("depth", "node", "conv")
    ends = ending.repartition("depth", "node").sortWithinPartitions("depth", "node", "conv").mapInArrow(_hash_ends, "depth long, node long, ends_sha256 string")
    none = F.sha2(F.lit("").cast("binary"), 256)
    own = F.when(F.col("len") == F.col("depth"), F.sha2(F.col("conv").cast("string"), 256)).otherwise(none)
    shared = nodes.where("n > 1").join(ends.withColumnRenamed("node", "conv"), ["depth", "conv"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none))
    figures = ["conv", "depth", "parent", "n", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    single = nodes.where("n = 1").withColumn("ends_sha256", own)
    # Nodes below a single one: depth + 1 to len, some thousands from a row at a time.
    below = single.where("len > depth").select("conv", "len", F.explode(F.sequence(F.col("depth") + 1, "len", F.lit(STEP))).alias("begin"))
    path = below.select("conv", "len", F.explode(F.sequence("begin", F.least("len", F.col("begin") + STEP - 1))).alias("depth"))
    path = path.select(
        "conv",
        "depth",
        F.col("conv").alias("parent"),
        F.lit(1).cast("long").alias("n"),
        (F.col("len") > F.col("depth")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        own.alias("ends_sha256"),
    )
    out = shared.select(*figures).unionByName(single.select(*figures)).unionByName(path)
    return out.withColumnsRenamed({"conv": "conv_id", "parent": "parent_conv_id", "n": "n_convs"})


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = materialize(number_turns(digest_turns(read_table(spark, sf_dir, "conversations"))), "trie-numbered")
    return build_trie(*rebuilt(turns))


# crc32 is worked out bit by bit. A node's ancestors are the nodes along the path of its smallest member.
SQL = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, count(*) AS own, conv_id - conv_id % 5 AS first,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, i: xor(v >> 1, (v & 1) * 3988292384)))) % 9 AS h
  FROM turns GROUP BY conv_id
), plan AS (
  SELECT c.conv_id, c.first, CASE WHEN c.first = c.conv_id THEN 0 ELSE c.h END AS h, coalesce(f.own, 0) AS there
  FROM own c LEFT JOIN own f ON f.conv_id = c.first
), rebuilt AS (
  SELECT p.conv_id, t.pos - p.h + least(p.h, p.there) AS pos, role, text FROM turns t JOIN plan p USING (conv_id) WHERE t.pos > p.h
  UNION ALL
  SELECT p.conv_id, t.pos, role, text FROM plan p JOIN turns t ON t.conv_id = p.first AND t.pos <= p.h
), prefixes AS (
  SELECT conv_id, pos, strlen(text) AS bytes,
    sha256(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY pos)) AS prefix
  FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM plan
), sized AS (
  SELECT *, max(pos) OVER (PARTITION BY conv_id) AS len FROM prefixes
), nodes AS (
  SELECT pos AS depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes, max(len) = pos AS leaf,
    sha256(coalesce(string_agg(CASE WHEN len = pos THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM sized GROUP BY pos, prefix
), members AS (
  SELECT s.conv_id, s.pos, n.conv_id AS node FROM sized s JOIN nodes n ON n.depth = s.pos AND n.prefix = s.prefix
), above AS (
  SELECT m.node AS conv_id, m.pos AS depth, sum(n.leaf::INT) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved_tokens, count(*) FILTER (n.depth = m.pos + 1) AS n_children
  FROM nodes n JOIN members m ON m.conv_id = n.conv_id AND m.pos <= n.depth GROUP BY m.node, m.pos
)
SELECT n.conv_id, n.depth::BIGINT AS depth, m.node AS parent_conv_id, n.n_convs, a.n_children, a.n_leaves::BIGINT AS n_leaves, a.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN above a ON a.conv_id = n.conv_id AND a.depth = n.depth
LEFT JOIN members m ON m.conv_id = n.conv_id AND m.pos = n.depth - 1
"""
