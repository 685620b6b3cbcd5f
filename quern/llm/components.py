"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quern.llm._spark import checkpointed, dealt_anew, forget

#: Rounds after which the computation is given up as faulty; n nodes need about log2(n) squared at worst.
MAX_ROUNDS = 200


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 998_244_353)).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a long, b long); component is its smallest node.

    Links may repeat and run either way; self links are ignored. Each round replaces a
    node's links by links to its smallest neighbour (groupBy with map-side minimum, then a
    join whose large side adaptive execution splits where a node has many) and is written to the checkpoint
    folder, so a lost executor costs one round at most; the round before is deleted then. Nothing but two sums reaches the driver.
    """
    edges = checkpointed(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    state = _state(edges)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = dealt_anew(both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("least", "u").alias("m")), "u")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = dealt_anew(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        last, edges = edges, checkpointed(small.select("e.u", "e.v").where("u <> v").distinct())
        forget(last)
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError("components did not converge")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
