"""Exact top-k inner-product search by Fagin's threshold algorithm.

Rows are dealt into shards and queries into blocks, both of bounded size. In a cell of one
block and one shard each dimension is a sorted list. A query walks the lists of its non-zero
dimensions from their better ends; every vector met is scored in full, and the walk stops
when the bound on unseen vectors, the sum of query component times list value at the
present depth, is below the k-th score. The best of each shard are then ranked together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quern.llm._spark import checkpointed, ship

#: Rows of a shard and queries of a block, on average: the memory of a cell.
SHARD_ROWS, QUERY_ROWS = 16_384, 1_024
#: Depth of the first look at the lists; it doubles from look to look.
FIRST_DEPTH = 64


class Lists:
    """One shard: distinct vectors, the ids of each in order, and a sorted list per dimension.

    ``vectors`` holds longs; ``reach`` is the largest component, in absolute value, of the
    queries to come. Scores are exact: in single or double precision where all sums fit, else in
    whole numbers of any size, and then cut to the range of a long.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, reach: int = 0):
        order = np.lexsort((ids, *vectors.T[::-1])) if vectors.shape[1] else np.argsort(ids)
        ids, vectors = ids[order], vectors[order]
        first = np.ones(len(ids), bool)
        first[1:] = (vectors[1:] != vectors[:-1]).any(1)
        self.starts = np.flatnonzero(first)
        self.ends = np.r_[self.starts[1:], len(ids)]
        # single precision is exact for whole numbers below 2 to the 24th, double precision below 2 to the 53rd
        largest = max(reach, largest_component(vectors))
        bound = largest * largest * vectors.shape[1]
        kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object
        self.ids, self.vectors, self.k = ids, np.ascontiguousarray(vectors[first].astype(kind)), k
        self.by_id = np.argsort(ids, kind="stable")
        self.order = np.argsort(self.vectors, axis=0, kind="stable").T.astype(np.int32)
        self.values = np.take_along_axis(self.vectors.T, self.order.astype(np.int64), 1)

    def search(self, own: int, query: np.ndarray) -> list[tuple[int, int]]:
        """(score, id) of the k best rows but ``own``, best first, ties to the smaller id."""
        n = len(self.vectors)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        query = query.astype(self.vectors.dtype)
        exact = query.dtype == object
        seen, scores = np.zeros(n, bool), np.full(n, -np.inf, object if exact else np.float64)
        place = np.searchsorted(self.ids, own, sorter=self.by_id)
        here = place < len(self.ids) and self.ids[self.by_id[place]] == own
        own_vector = int(np.searchsorted(self.starts, self.by_id[place], side="right")) - 1 if here else -1
        depth, reached = 0, min(FIRST_DEPTH, n)
        if not len(up) and not len(down):
            seen[:], scores[:], depth = True, 0, n
        while depth < n:
            before = seen.copy()
            seen[self.order[up, n - reached : n - depth].ravel()] = True
            seen[self.order[down, depth:reached].ravel()] = True
            new = np.flatnonzero(seen > before)
            # many at once are cheaper in one sweep; only those met count
            scores[new] = (self.vectors @ query)[new] if 8 * len(new) > n else self.vectors[new] @ query
            if exact:
                scores[new] = np.clip(scores[new], -(1 << 63), (1 << 63) - 1)
            depth = reached
            if seen.all():
                break
            bound = query[up] @ self.values[up, n - depth] + query[down] @ self.values[down, depth - 1]
            if self._kth(scores, own_vector) > bound:
                break
            reached = min(2 * depth, n)
        least = self._kth(scores, own_vector)
        found = [(int(s), i) for v in np.flatnonzero(seen & (scores >= least)).tolist() for s in (scores[v],) for i in self._rows(v, own)]
        return sorted(found, key=lambda x: (-x[0], x[1]))[: self.k]

    def _rows(self, v: int, own: int) -> list[int]:
        """The smallest k ids of a vector, without ``own``."""
        return [i for i in self.ids[self.starts[v] : min(self.ends[v], self.starts[v] + self.k + 1)].tolist() if i != own][: self.k]

    def _kth(self, scores: np.ndarray, own_vector: int) -> float:
        """The k-th best row score so far; minus infinity while there are fewer rows."""
        # k + 1 vectors have at least k rows that aren't the query's own
        at = np.arange(len(scores))
        if len(scores) > self.k + 1:
            at = np.argsort(scores)[-self.k - 1 :] if scores.dtype == object else np.argpartition(scores, len(scores) - self.k - 1)[-self.k - 1 :]
        at = at[np.argsort(-scores[at], kind="stable")]
        rows = np.cumsum(self.ends[at] - self.starts[at] - (at == own_vector))
        enough = np.searchsorted(rows, self.k)
        return scores[at[enough]] if enough < len(at) else -np.inf


def largest_component(vectors: np.ndarray) -> int:
    return max(int(vectors.max(initial=0)), -int(vectors.min(initial=0)))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    rows = column.combine_chunks()
    sizes = np.diff(rows.offsets.to_numpy())
    flat = rows.flatten().to_numpy()
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), flat.dtype)
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(s) for s in sizes]) if len(sizes) else []] = flat
    return out


def _cell(k: int):
    def search(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if queries.num_rows and rows.num_rows:
            width = max(int(np.diff(t["v"].combine_chunks().offsets.to_numpy()).max()) for t in (queries, rows))
            vectors = _matrix(queries["v"], width)
            lists = Lists(rows["vec_id"].to_numpy(), _matrix(rows["v"], width), k, largest_component(vectors))
            for own, q in zip(queries["vec_id"].to_pylist(), vectors):
                for score, i in lists.search(own, q):
                    for column, x in zip(out, (own, i, score)):
                        column.append(x)
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), out)})

    return search


def integer_vectors(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v array<long>) with v = floor(scale * x), beyond a long the nearest long.

    Rows with a null, NaN or infinite component, without a vector or without an id are left out.
    """
    bad = F.exists("embedding", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    return embeddings.where(F.col("embedding").isNotNull() & ~bad & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")
    )


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products over all rows but its own.

    Both sides are (vec_id, v array<long>); shorter vectors count as padded with zeros, a
    repeated (vec_id, v) is one row. A score beyond a long counts as the nearest long. Every query meets every shard once: rows are sent to
    each block of queries and queries to each shard, a grid of cells of bounded size, and the
    shards' answers, k a query, are ranked with a limit before the shuffle.
    """
    vectors, queries = checkpointed(vectors.distinct()), queries.distinct()
    shards = max(1, -(-vectors.count() // SHARD_ROWS))
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    ship(vectors.sparkSession)
    dealt = vectors.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = queries.select("vec_id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    found = asked.groupBy("shard", "block").cogroup(dealt.groupBy("shard", "block")).applyInArrow(_cell(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def sql(k: int = 20) -> str:
    """DuckDB SQL for the query: every query against every row."""
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(list_inner_product(q.v, r.v) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= {k}"""
