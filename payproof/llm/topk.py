"""Exact top-k search by integer inner product, with a k-d tree for each shard.

Components become floor(1024 * x). Candidates are dealt to shards of a bounded size by a hash of their row. In a shard, a
tree is built by median splits along the widest side; every node has the tight box of its vectors. A query visits nodes
best first, by the highest inner product that their box allows, and stops where no box can reach its kth score. Each query
is first searched in one shard; the kth score found there is handed on to all others, which then skip what cannot reach it.
A shard's tree is built once and the queries stream past it in blocks; only where these are very many is it copied.

Vectors that are null, or hold a null or a component that is not finite, take no part, nor do rows without id. Only vectors
of one length are compared. Repeated rows and ids are rows of their own, as queries too, and only a query's own row is not
its neighbour. Ties go to the smaller id. Other columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from payproof.llm.tables import written

SCALE = 1024
SHARD_ROWS, BLOCK_QUERIES, LEAF = 8192, 2048, 64
#: Queries that stream past one copy of a shard.
STREAM = 1 << 16
EXACT = 2.0**53


def quantized(vectors: DataFrame, is_query, scale: int = SCALE) -> DataFrame:
    """The rows that take part, numbered: row, vec_id, vector as integers, its length, is_query; as a written table, which
    fixes the numbers."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    given = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("is_query"),
    )
    whole = given.where("vec_id is not null and v is not null").where(F.coalesce(finite, F.lit(False)))
    return written(
        whole.select(
            F.monotonically_increasing_id().alias("row"),
            "vec_id",
            F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"),
            F.size("v").alias("dim"),
            "is_query",
        )
    )


class Tree:
    """Nodes in order of creation: box, and either two children or the rows of a leaf."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        self.low, self.high, self.children, self.rows = [], [], [], []
        self._build(vectors, np.arange(len(vectors)), leaf)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _build(self, vectors: np.ndarray, rows: np.ndarray, leaf: int) -> int:
        """Add the node of some rows; the recursion is as deep as the logarithm of the rows."""
        own = vectors[rows]
        node = len(self.low)
        self.low.append(own.min(axis=0))
        self.high.append(own.max(axis=0))
        self.children.append(None)
        self.rows.append(rows)
        if len(rows) > leaf and vectors.shape[1]:
            widest = int(np.argmax(self.high[node] - self.low[node]))
            if self.high[node][widest] > self.low[node][widest]:
                order = np.argpartition(own[:, widest], len(rows) // 2)
                half = len(rows) // 2
                self.children[node] = (
                    self._build(vectors, rows[order[:half]], leaf),
                    self._build(vectors, rows[order[half:]], leaf),
                )
        return node

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The highest inner product of each query with any point in each node's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T


class Shard:
    """The candidates of a shard; trees are built when they are first needed, over whole numbers as doubles where these are
    exact, and as Python's otherwise."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        self.vectors, self.ids, self.rows = vectors, ids, rows
        self.top = float(abs(vectors).max(initial=0))
        self.trees: dict[type, Tree] = {}

    def search(
        self, queries: np.ndarray, query_rows: np.ndarray, least: np.ndarray, k: int
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, candidate and score of the best k candidates of each query whose score is least or more."""
        # Sums of products are whole numbers that doubles hold exactly.
        exact = self.top * float(abs(queries).max(initial=0)) * max(1, queries.shape[1]) < EXACT
        kind = float if exact else object
        vectors, queries = self.vectors.astype(kind), queries.astype(kind)
        if kind not in self.trees:
            self.trees[kind] = Tree(vectors)
        tree = self.trees[kind]
        bounds = tree.bounds(queries)
        out_q, out_c, out_s = [], [], []
        for i in range(len(queries)):
            worst = least[i]
            found: list[tuple] = []  # (score, -id, candidate), the worst on top
            todo = [(-bounds[i, 0], 0)]
            while todo:
                bound, node = heapq.heappop(todo)
                if -bound < worst:
                    break
                if (children := tree.children[node]) is not None:
                    for c in children:
                        if bounds[i, c] >= worst:
                            heapq.heappush(todo, (-bounds[i, c], c))
                    continue
                at = tree.rows[node]
                scores = vectors[at] @ queries[i]
                for j in np.flatnonzero((scores >= worst) & (self.rows[at] != query_rows[i])):
                    entry = (int(scores[j]), -int(self.ids[at[j]]), int(at[j]))
                    if len(found) < k:
                        heapq.heappush(found, entry)
                    else:
                        heapq.heappushpop(found, entry)
                    if len(found) == k:
                        worst = max(worst, found[0][0])
            out_q += [i] * len(found)
            out_c += [f[2] for f in found]
            out_s += [f[0] for f in found]
        return np.array(out_q, np.int64), np.array(out_c, np.int64), np.array(out_s, np.int64)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


HITS = "query bigint, row bigint, vec_id bigint, score bigint"


def _stream(k: int):
    """Rows come run by run, by length, shard and part: the candidates of a shard, then the queries that stream past it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard, gathered = None, None, []
        for batch in batches:
            place = np.column_stack([batch.column(c).to_numpy() for c in ("dim", "shard", "part", "kind")])
            edges = np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *edges], [*edges, len(place)], strict=True):
                if a == b:
                    continue
                *here, kind = place[a].tolist()
                if here != at:
                    at, shard, gathered = here, None, []
                rows = batch.slice(a, b - a)
                if kind == 0:
                    gathered.append(rows)
                    continue
                if shard is None and gathered:
                    whole = pa.Table.from_batches(gathered).combine_chunks().to_batches()[0]
                    ids, numbers = (whole.column(c).to_numpy() for c in ("vec_id", "row"))
                    shard, gathered = Shard(_matrix(whole.column("v"), here[0]), ids, numbers), []
                if shard is None:
                    continue
                for i in range(0, len(rows), BLOCK_QUERIES):
                    block = rows.slice(i, BLOCK_QUERIES)
                    numbers = block.column("row").to_numpy()
                    least = np.array([float("-inf") if x is None else x for x in block.column("least").to_pylist()], object)
                    q, c, scores = shard.search(_matrix(block.column("v"), here[0]), numbers, least, k)
                    columns = [numbers[q], shard.rows[c], shard.ids[c], scores]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["query", "row", "vec_id", "score"])

    return run


def _searched(rows: DataFrame, queries: DataFrame, parts: int, k: int) -> DataFrame:
    """Rows (dim, shard, row, vec_id, v) as candidates meet queries (the same, and least) of their shard."""
    part = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(parts)).cast("int").alias("part")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    none = F.lit(None).cast("long").alias("least")
    columns = ("dim", "shard", "part", "kind", "row", "vec_id", "v", "least")
    candidates = rows.select("*", every, F.lit(0).alias("kind"), none).select(*columns)
    passing = queries.select("*", part, F.lit(1).alias("kind")).select(*columns)
    dealt = candidates.unionAll(passing).repartition("dim", "shard", "part").sortWithinPartitions("dim", "shard", "part", "kind")
    return dealt.mapInArrow(_stream(k), HITS)


def top_k(vectors: DataFrame, is_query, k: int = 10, shard_rows: int = SHARD_ROWS, stream: int = STREAM) -> DataFrame:
    """query_id, rank, vec_id and score of the k highest scores of each row for which is_query (a Column) holds."""
    whole = quantized(vectors, is_query)
    shards = max(1, -(-whole.count() // shard_rows))
    parts = max(1, -(-whole.where("is_query").count() // stream))
    placed = whole.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    rows, queries = placed.drop("is_query"), placed.where("is_query").drop("is_query")
    at_home = written(_searched(rows, queries.withColumn("least", F.lit(None).cast("long")), 1, k))
    kth = at_home.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("worst"))
    least = F.when(F.col("n") >= k, F.col("worst")).alias("least")
    known = queries.withColumnRenamed("shard", "home").join(kth.select(F.col("query").alias("row"), least), "row", "left")
    others = known.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> home").drop("home")
    elsewhere = _searched(rows, others, parts, k)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    ranked = at_home.unionAll(elsewhere).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    ids = queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return ranked.join(ids, "query").select("query_id", "rank", "vec_id", "score")
