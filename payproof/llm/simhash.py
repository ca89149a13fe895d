"""Near duplicates by SimHash: fingerprints of 64 bits that differ in few bits, found with BK-trees.

A fingerprint bit is set if it is set in over half the hashes of a text's runs of four words. Equal fingerprints are one
node. The 64 bits are cut into six blocks; two fingerprints that differ in at most four bits agree in two blocks at least,
so nodes are dealt to a shard for every pair of blocks, by the bits of that pair. A shard has a BK-tree: a node's children
are keyed by their distance to it, and a search follows only the edges whose key is within the radius of the query's own
distance. A shard of too many nodes is dealt to trees of a bounded size, and each tree is copied to the tasks among which
the queries of the shard are dealt. What a task finds goes on as a spanning forest, not as pairs.

A null or empty text, or one without words, has fingerprint 0, which links like any other. Rows without id come back with
a null component and link nothing. Rows of one id are rows of their own; ties do not arise. Other columns are not looked at.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from xxhash import xxh64_intdigest

from payproof.llm import words as W
from payproof.llm.components import components
from payproof.llm.tables import written

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Blocks that the bits are cut into; all pairs of radius or fewer differing bits agree in BLOCKS - RADIUS of them.
BLOCKS = 6
#: Nodes of a tree, about.
TREE_ROWS = 4096
#: Rows of runs that a task searches at once, and queries of one search.
BATCH_ROWS, QUERIES = 1 << 15, 256
#: Hashes whose bits are counted at once.
HASHES = 1 << 17
_KEYS = np.int64(128)


def shingle_hashes(text: bytes, size: int = SHINGLE, seed: int = SEED) -> list[int]:
    """Hash of each run of words, in lower case and joined by one space; fewer words are one run."""
    parts = text.lower().split()
    if len(parts) <= size:
        return [xxh64_intdigest(b" ".join(parts), seed)] if parts else []
    joined = b" ".join(parts)
    ends = list(accumulate(len(p) + 1 for p in parts))
    starts = [0, *ends]
    return [xxh64_intdigest(joined[a : b - 1], seed) for a, b in zip(starts, ends[size - 1 :], strict=False)]


def fingerprint(hashes: list[int]) -> int:
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), HASHES):
        part = np.array(hashes[i : i + HASHES], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


@functools.cache
def _fingerprint_udf(size: int):
    @arrow_udf("bigint")
    def prints(texts: pa.Array) -> pa.Array:
        out = []
        for chunk in W.chunks(texts):
            data = chunk.data.tobytes()
            bounds = chunk.offsets.tolist()
            out += [fingerprint(shingle_hashes(data[a:b], size)) for a, b in zip(bounds, bounds[1:], strict=False)]
        return pa.array(np.array(out, np.uint64).view(np.int64), pa.int64())

    return prints.asNondeterministic()


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and print, the fingerprint as a signed number, of every row."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), _fingerprint_udf(shingle)(F.col("text").cast("string")).alias("print")
    )


class Forest:
    """BK-trees over runs of values; a run is the values of one tree. Nodes are the positions of the values."""

    def __init__(self, values: np.ndarray, tree: np.ndarray):
        """Level by level for all trees: the first of each group becomes the node of the others, and these are grouped
        by node and distance."""
        self.values = values
        rest = np.argsort(tree, kind="stable")
        group = tree[rest].astype(np.int64)
        levels = []
        while len(rest):
            leads = np.ones(len(rest), bool)
            leads[1:] = group[1:] != group[:-1]
            nodes = rest[leads]
            levels.append((group[leads], nodes))
            owner = nodes[np.cumsum(leads) - 1][~leads]
            rest = rest[~leads]
            group = owner * _KEYS + np.bitwise_count(values[rest] ^ values[owner])
            order = np.argsort(group, kind="stable")
            rest, group = rest[order], group[order]
        none = np.empty(0, np.int64)
        self.trees, self.roots = levels[0] if levels else (none, none)
        self.edge = np.concatenate([none, *(keys for keys, _ in levels[1:])])
        self.child = np.concatenate([none, *(nodes for _, nodes in levels[1:])])
        order = np.argsort(self.edge)
        self.edge, self.child = self.edge[order], self.child[order]

    def search(self, queries: np.ndarray, tree: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Query and node, for each node of the query's own tree within the radius."""
        query, node = np.arange(len(queries)), self.roots[np.searchsorted(self.trees, tree)]
        found_q, found_n = [query[:0]], [query[:0]]
        while len(query):
            far = np.bitwise_count(queries[query] ^ self.values[node]).astype(np.int64)
            near = far <= radius
            found_q.append(query[near])
            found_n.append(node[near])
            low = np.searchsorted(self.edge, node * _KEYS + np.maximum(far - radius, 0))
            high = np.searchsorted(self.edge, node * _KEYS + far + radius, side="right")
            count = high - low
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            query, node = np.repeat(query, count), self.child[np.repeat(low, count) + step]
        return np.concatenate(found_q), np.concatenate(found_n)


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the same values as the given ones, one fewer than values in each component."""
    values, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(values))
    while len(apart := np.flatnonzero(label[a] != label[b])):
        a, b = a[apart], b[apart]
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    tied = np.flatnonzero(label != np.arange(len(values)))
    return values[label[tied]], values[tied]


def links(values: np.ndarray, run: np.ndarray, kind: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between the members of each run (kind 0 and 2) and its queries (kind 1 and 2)."""
    member, query = np.flatnonzero(kind != 1), np.flatnonzero(kind != 0)
    forest = Forest(values[member], run[member])
    query = query[np.isin(run[query], forest.trees)]
    u, v = np.empty(0, values.dtype), np.empty(0, values.dtype)
    for i in range(0, len(query), QUERIES):
        own = query[i : i + QUERIES]
        q, n = forest.search(values[own], run[own], radius)
        a, b = values[own[q]], forest.values[n]
        u, v = spanning(np.concatenate([u, a[a != b]]), np.concatenate([v, b[a != b]]))
    return u, v


def _search(radius: int):
    """Rows come run by run, members first; whole runs are searched together once there are enough rows."""

    def found(rows: pa.Table) -> pa.RecordBatch:
        key, tree, block, kind, value = (rows.column(c).to_numpy() for c in ("key", "tree", "block", "kind", "print"))
        change = np.ones(len(key), bool)
        change[1:] = (key[1:] != key[:-1]) | (tree[1:] != tree[:-1]) | (block[1:] != block[:-1])
        u, v = links(value.view(np.uint64), np.cumsum(change) - 1, kind, radius)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (u, v)], ["u", "v"])

    def whole_runs(rows: pa.Table) -> int:
        """Rows before the last run, which may go on."""
        last = np.ones(rows.num_rows, bool)
        for name in ("key", "tree", "block"):
            column = rows.column(name).to_numpy()
            last &= column == column[-1]
        return rows.num_rows - int(last.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= BATCH_ROWS:
                rows = pa.Table.from_batches(held)
                if whole := whole_runs(rows):
                    yield found(rows.slice(0, whole))
                    held, n = rows.slice(whole).to_batches(), rows.num_rows - whole
        if n:
            yield found(pa.Table.from_batches(held))

    return run


def shard_keys(value: Column, blocks: int, agree: int) -> Column:
    """One number for each choice of blocks: which, and the bits of the fingerprint there."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    out = []
    for n, chosen in enumerate(combinations(range(blocks), agree)):
        key = F.lit(n).cast("long")
        for block in chosen:
            width = edges[block + 1] - edges[block]
            bits = F.shiftrightunsigned(value, edges[block]).bitwiseAND(F.lit((1 << width) - 1))
            key = F.shiftleft(key, width).bitwiseOR(bits)
        out.append(key)
    return F.array(*out)


def near(nodes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """u and v: edges that tie all of the different fingerprints (print) which radius or fewer differing bits link."""
    keyed = nodes.select(F.explode(shard_keys(F.col("print"), blocks, blocks - radius)).alias("key"), "print")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = sizes.select("key", F.ceil(F.col("n") / tree_rows).cast("int").alias("trees"))
    tree = F.pmod(F.xxhash64("print"), F.col("trees")).cast("int")
    block = F.pmod(F.xxhash64("print", F.lit(1)), F.col("trees")).cast("int")

    def place(tree: Column, block: Column, kind: int) -> Column:
        return F.struct(tree.alias("tree"), block.alias("block"), F.lit(kind).alias("kind"))

    # Each tree is copied to the tasks of all blocks; a query goes to its own tree and those before it, in its block.
    copies = F.transform(F.sequence(F.lit(0), F.col("trees") - 1), lambda b: place(F.col("own"), b, 0))
    queries = F.transform(F.sequence(F.lit(0), F.col("own")), lambda t: place(t, F.col("block"), 1))
    alone = F.array(place(F.lit(0), F.lit(0), 2))
    places = F.when(F.col("trees") == 1, alone).otherwise(F.concat(copies, queries))
    dealt = (
        keyed.join(sizes, "key")
        .select("key", "print", "trees", tree.alias("own"), block.alias("block"))
        .select("key", "print", F.explode(places).alias("at"))
        .select("key", "at.*", "print")
        .repartition("key", "tree", "block")
        .sortWithinPartitions("key", "tree", "block", "kind")
    )
    return dealt.mapInArrow(_search(radius), "u bigint, v bigint")


def linked(
    docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, blocks: int = BLOCKS, tree_rows: int = TREE_ROWS
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least id that links lead to, of every row."""
    prints = written(fingerprints(docs, shingle))
    nodes = written(prints.where("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("least")))
    tied = components(near(nodes, radius, blocks, tree_rows)).withColumnsRenamed({"id": "print"})
    group = F.coalesce("component", "print").alias("component")
    of_print = nodes.join(tied, "print", "left").select("print", "least", group)
    groups = of_print.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = of_print.join(groups, "component").select("print", "component_id")
    return prints.join(ids, "print", "left").select(
        "doc_id",
        F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )
