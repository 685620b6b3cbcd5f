"""The prefix trie of conversations by pointer jumping.

Conversations that begin with the same turns share a node for each turn they share. A node is keyed by a
digest chained over its turns, and knows the digest of its parent; what its subtree holds is added up in
rounds that double the distance each node reaches, so a trie of depth d takes log2(d) of them.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.llm._spark import checkpointed, dealt_anew, map_partitions

#: First turns that come from another conversation: fewer than ``HEADS`` of them, from the conversation at the last multiple of ``EVERY``.
HEADS, EVERY = 6, 100
#: Bytes of a digest that are kept; n distinct nodes are all told apart but for a probability of about n² / 2^129.
DIGEST = 16
#: The key of the root, which no turn leads to.
ROOT = bytes(DIGEST)
#: Characters of conversation ids that are put together before they meet in the task of their node.
ID_CHARS = 1 << 16

_STEPS = "node binary, parent binary, depth long, conv_id long, size long, ends boolean"


def _root() -> Column:
    return F.lit(bytearray(ROOT))


def turn_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, size) of (conv_id, turn, role, text): a digest of each turn's role and text, and the text's code points.

    Null roles and texts are empty. Texts go no further than this.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    whole = F.unhex(F.sha2(said, 256))
    return turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.substring(whole, 1, DIGEST).alias("digest"), F.char_length(text).cast("long").alias("size"),
    )


def heads(conv: Column) -> Column:
    """How many first turns of a conversation come from another one."""
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(HEADS)).cast("int")


def shared_heads(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, size, place): the turns of the rebuilt conversations, of every conversation at least one row.

    ``turns`` has the columns of ``turn_digests``. ``place`` 0 marks first turns from the conversation c - c % 100 (its
    remainder taken as SQL does), 1 the conversation's own, of which the first ``heads`` are to be left out.
    At most five rows of a base are repeated for at most a hundred conversations.
    """
    bases = turns.where(F.col("conv_id") % EVERY == 0)
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    first = bases.withColumn("at", F.row_number().over(order)).where(F.col("at") < HEADS)
    first = first.select(F.col("conv_id").alias("base"), "at", "digest", "size")
    takers = turns.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % EVERY).alias("base"), heads(F.col("conv_id")).alias("h"))
    lent = takers.join(first, "base").where("at <= h")
    lent = lent.select("conv_id", F.col("at").cast("long").alias("turn"), "digest", "size", F.lit(0).alias("place"))
    return turns.withColumn("place", F.lit(1)).unionByName(lent)


def prefixes(turns: DataFrame, left_out: Column | None = None) -> DataFrame:
    """(node, parent, depth, conv_id, size, ends): a row for each turn of each conversation, keyed by all turns up to it.

    ``turns`` has (conv_id, turn, digest, size, place). Rows are taken by place, turn (null first) and digest; the first
    ``left_out`` of place 1 are skipped. The last row of a conversation ``ends``; one without turns left
    has a single row at the root. Digests are chained as a stream over sorted rows of fixed size,
    so a task holds one digest, however long the conversation; what follows a turn depends on all before it, so
    a conversation is one task's.
    """
    rows = turns.withColumn("skip", left_out if left_out is not None else F.lit(0))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "place", F.asc_nulls_first("turn"), "digest").select("conv_id", "place", "digest", "size", "skip")

    def run(batches):
        kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        names = ["node", "parent", "depth", "conv_id", "size", "ends"]
        current, held, own = None, None, 0
        for batch in batches:
            out: list[tuple] = []
            for conv, place, digest, size, skip in zip(*(c.to_pylist() for c in batch.columns)):
                if conv != current:
                    if held is not None:
                        out.append((*held, True))
                    current, own = conv, 0
                    held = (ROOT, None, 0, conv, 0)
                own += place
                if place and own <= skip:
                    continue
                node, _, depth, _, _ = held
                if depth:
                    out.append((*held, False))
                held = (hashlib.sha256(node + digest).digest()[:DIGEST], node, depth + 1, conv, size)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*held, True), kinds)], names)

    return map_partitions(rows, run, _STEPS)


def end_digests(steps: DataFrame) -> DataFrame:
    """(node, ends_sha256): the digest of the ids of the conversations that end at a node, ascending, comma-joined.

    Ids are first dealt by ranges of (node, id) and joined to strings of ``ID_CHARS``, several tasks sharing a
    node where many end; a node's task then reads these strings in order and keeps a running digest.
    """
    ends = steps.where("ends").select("node", "conv_id")
    ranged = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")

    def join(batches):
        names, kinds = ["node", "first", "ids"], [pa.binary(), pa.int64(), pa.string()]
        node, ids, size = None, [], 0
        for batch in batches:
            out: list[tuple] = []
            for own, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (own != node or size > ID_CHARS):
                    out.append((node, ids[0], ",".join(map(str, ids))))
                    ids, size = [], 0
                node = own
                ids.append(conv)
                size += 8
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((node, ids[0], ",".join(map(str, ids))), kinds)], names)

    def digest(batches):
        names = ["node", "ends_sha256"]
        node, running = None, None
        for batch in batches:
            out: list[tuple] = []
            for own, ids in zip(batch.column(0).to_pylist(), batch.column(2)):
                if running is not None and own == node:
                    running.update(b",")
                else:
                    if running is not None:
                        out.append((node, running.hexdigest()))
                    node, running = own, hashlib.sha256()
                running.update(ids.as_py().encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.binary(), pa.string()))], names)
        if running is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([running.hexdigest()])], names)

    joined = map_partitions(ranged, join, "node binary, first long, ids string")
    return map_partitions(joined.repartition("node").sortWithinPartitions("node", "first"), digest, "node binary, ends_sha256 string")


def subtree_sums(nodes: DataFrame, sums: list[str], deepest: int) -> DataFrame:
    """(node, *sums): each of the columns ``sums`` added up over every node's subtree, the node included.

    ``nodes`` has (node, parent, depth). Before round k a node has the sums of all that lie fewer than 2^k below it, and
    points to the ancestor 2^k above. A round hands the node's sums to where it points, added up by that
    ancestor first, and doubles the pointers. Only nodes that still have an ancestor that far up take
    part in the next round; what the others are given meanwhile is put aside and added at the end, so rounds shrink
    and a long conversation among short ones costs rounds of its own nodes alone. Pointers that
    end at the root are known by depth, so it is no key of a join. Each round is written to the checkpoint folder.
    """
    state = checkpointed(nodes.select("node", F.col("parent").alias("above"), "depth", *sums, F.lit(True).alias("points")))
    aside, reach = [], 1
    while True:
        going = F.col("points") & (F.col("depth") >= 2 * reach)
        aside.append(state.where(~going).select("node", *sums))
        if reach > deepest:
            break
        given = state.where(F.col("points") & (F.col("depth") >= reach)).groupBy(F.col("above").alias("node"))
        given = given.agg((F.first("depth") - reach).alias("depth"), *(F.sum(c).alias(c) for c in sums))
        added = dealt_anew(given.where(F.col("depth") >= 2 * reach).select("node", *(F.col(c).alias(f"{c}_below") for c in sums)), "node")
        ahead = dealt_anew(state.where(F.col("points") & (F.col("depth") > reach)).select(F.col("node").alias("above"), F.col("above").alias("next")), "above")
        moved = state.where(going).join(ahead, "above", "left").join(added, "node", "left")
        above = F.when(F.col("depth") == 2 * reach, _root()).otherwise(F.col("next")).alias("above")
        moved = moved.select("node", above, "depth", *((F.col(c) + F.coalesce(f"{c}_below", F.lit(0))).alias(c) for c in sums), "points")
        put = given.where(F.col("depth") < 2 * reach).select("node", F.lit(None).cast("binary").alias("above"), "depth", *sums, F.lit(False).alias("points"))
        state = checkpointed(moved.unionByName(put))
        reach *= 2
    return reduce(DataFrame.unionByName, aside).groupBy("node").agg(*(F.sum(c).alias(c) for c in sums))


def trie(steps: DataFrame) -> DataFrame:
    """The nodes of ``prefixes``: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node's ``conv_id`` is its smallest member, ``saved_tokens`` what writing each turn of its subtree once
    saves against once a member, in code points. No conversations give no nodes, not even the root.
    """
    steps = checkpointed(steps)
    inner = steps.where("depth > 0").groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("size").alias("size"))
    root = steps.where("ends").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(_root().alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("size"))
    nodes = checkpointed(inner.unionByName(root))
    children = dealt_anew(nodes.where("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children")), "node")
    nodes = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    own = nodes.select("node", "parent", "depth", "conv_id", "n_convs", "n_children", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"))
    own = checkpointed(own)
    deepest = own.agg(F.max("depth")).first()[0] or 0
    below = subtree_sums(own, ["n_leaves", "saved_tokens"], deepest)
    parents = dealt_anew(own.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent")
    found = own.drop("n_leaves", "saved_tokens").join(below, "node").join(end_digests(steps), "node", "left").join(parents, "parent", "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text) as they are.

    Turns of one number are taken in the order of their digests, repeated rows are turns of their own, and rows
    without a conv_id belong to no conversation. Further columns are ignored.
    """
    return trie(prefixes(turn_digests(conversations).withColumn("place", F.lit(1))))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations whose first turns are replaced by those of another one (``shared_heads``)."""
    turns = checkpointed(turn_digests(conversations))
    return trie(prefixes(shared_heads(turns), heads(F.col("conv_id"))))


def sql() -> str:
    """DuckDB SQL for ``rebuilt_trie`` over ``conversations``: nodes by their whole paths, sums over all descendants."""
    table = "list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    return f"""
WITH crc AS MATERIALIZED (SELECT {table} AS t),
rows AS MATERIALIZED (SELECT conv_id, r, t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(r) || ':' || r || t)) AS at
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL)),
convs AS MATERIALIZED (SELECT conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(CAST(conv_id AS VARCHAR))), lambda i: CAST(ascii(CAST(conv_id AS VARCHAR)[i + 1]) AS BIGINT))),
  lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295) % {HEADS} AS h FROM (SELECT DISTINCT conv_id FROM rows), crc),
built AS (SELECT c.conv_id, r.r, r.t, row_number() OVER (PARTITION BY c.conv_id ORDER BY place, r.at) AS d FROM (
  SELECT conv_id, h, conv_id - conv_id % {EVERY} AS source, 0 AS place FROM convs UNION ALL SELECT conv_id, h, conv_id, 1 FROM convs) c
  JOIN rows r ON r.conv_id = c.source AND (place = 0 AND r.at <= h OR place = 1 AND r.at > h)),
steps AS MATERIALIZED (SELECT conv_id, d, length(t) AS size, string_agg(sha256(length(r) || ':' || r || t), '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d) AS path FROM built
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
last AS (SELECT conv_id, arg_max(path, d) AS path FROM steps GROUP BY conv_id),
ended AS (SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM last GROUP BY path),
nodes AS MATERIALIZED (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * max(size) END AS saved, path[:-65] AS up FROM steps GROUP BY path, d),
kids AS (SELECT up AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY up),
full_nodes AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (path)),
below AS (SELECT path[:64 * k] AS path, k AS d, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT path, d, n_children, saved, unnest(range(0, d + 1)) AS k FROM full_nodes) GROUP BY ALL)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM full_nodes n JOIN below b USING (path, d) LEFT JOIN full_nodes p ON n.d > 0 AND p.path = n.up LEFT JOIN ended e ON e.path = n.path"""
