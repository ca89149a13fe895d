"""Hard negatives: for each anchor and each of its best positives, the best rows of other labels in a window of scores.

Components become floor(scale * x). A score is an integer inner product. Candidates are dealt to tiles of a bounded size,
and the anchors stream past each tile in blocks; a block is multiplied with the tile by Strassen's recursion on 64-bit
integers, with zero padding to even sizes, so all sums are exact. Heaps hold the best few of each anchor; those of two
tiles merge into the best few of both. A first pass gives the positives, a second one the windows that their scores open.
Neither pass keeps scores that are in no heap.

Rows with a null id, label or vector, or a component that is null or not finite, take no part; a row whose anchor condition
is null is no anchor. Only vectors of one length meet. Repeated rows and ids are rows of their own, as anchors too, and only
an anchor's own row is never its positive. Ties go to the smaller id. A score that 64 bits could not hold fails the query. An
anchor without positives, or a window without rows, gives none. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from payproof.llm.tables import written

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: Per cent of the positive's score that a negative's must reach and may not exceed.
LOW, HIGH = 50, 95
#: Candidates of a tile, anchors that stream past one copy of it, anchors multiplied at once, side of a product by rows.
TILE_ROWS, STREAM, ANCHORS, LEAF = 8192, 1 << 16, 256, 16


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two matrices of 64-bit integers, by seven products of their quarters.

    Sums that wrap on the way cancel, as they are exact modulo 2 ** 64.
    """
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    a, b = (np.pad(x, [(0, s % 2) for s in x.shape]) if any(s % 2 for s in x.shape) else x for x in (a, b))
    r, s, t = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:r, :s], a[:r, s:], a[r:, :s], a[r:, s:]
    b11, b12, b21, b22 = b[:s, :t], b[:s, t:], b[s:, :t], b[s:, t:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * r, 2 * t), np.int64)
    out[:r, :t] = p1 + p4 - p5 + p7
    out[:r, t:] = p3 + p5
    out[r:, :t] = p2 + p4
    out[r:, t:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def products(anchors: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """The score of each anchor with each row of the tile."""
    if not anchors.shape[1]:
        return np.zeros((len(anchors), len(tile)), np.int64)
    top = [max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) for x in (anchors, tile)]
    if top[0] * top[1] * anchors.shape[1] >= 1 << 63:
        raise OverflowError("a score does not fit 64 bits: take a smaller scale")
    return strassen(anchors, tile.T)


def best(scores: np.ndarray, taken: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k highest scores among those taken of each row, ties to the lower column."""
    if scores.shape[1] > k:
        floor = np.iinfo(np.int64).min
        kth = np.partition(np.where(taken, scores, floor), -k, axis=1)[:, -k]
        taken = taken & (scores >= kth[:, None])
    row, column = np.nonzero(taken)
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], column[rank < k]


def vectors_of(vectors: DataFrame, is_anchor: Column, label: Column | str, scale: int = SCALE) -> DataFrame:
    """The rows that take part, numbered: row, vec_id, label, dim, v, anchor; as a written table, which fixes the numbers."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col(label) if isinstance(label, str) else label
    given = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        label.cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("v"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    )
    whole = given.where("vec_id is not null and label is not null and v is not null").where(F.coalesce(finite, F.lit(False)))
    return written(
        whole.select(
            F.monotonically_increasing_id().alias("row"),
            "vec_id",
            "label",
            F.size("v").alias("dim"),
            F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"),
            "anchor",
        )
    )


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


class Tile:
    """The candidates that one run of rows begins with, in order of their ids."""

    def __init__(self, rows: pa.RecordBatch, dim: int):
        order = np.argsort(rows.column("vec_id").to_numpy(), kind="stable")
        self.row, self.vec_id, self.label = (rows.column(c).to_numpy()[order] for c in ("row", "vec_id", "label"))
        self.v = _matrix(rows.column("v"), dim)[order]


Heaps = Callable[[Tile, pa.RecordBatch, np.ndarray], list[np.ndarray]]


def _streamed(heaps: Heaps, names: list[str]):
    """Rows come run by run, by length, tile and part: the candidates of a tile, then the anchors that stream past it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tile, gathered = None, None, []
        for batch in batches:
            place = np.column_stack([batch.column(c).to_numpy() for c in ("dim", "tile", "part", "kind")])
            edges = np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1 if len(place) else []
            for a, b in zip([0, *edges], [*edges, len(place)], strict=True):
                if a == b:
                    continue
                *here, kind = place[a].tolist()
                if here != at:
                    at, tile, gathered = here, None, []
                rows = batch.slice(a, b - a)
                if kind == 0:
                    gathered.append(rows)
                    continue
                if tile is None and gathered:
                    tile, gathered = Tile(pa.Table.from_batches(gathered).combine_chunks().to_batches()[0], here[0]), []
                if tile is None:
                    continue
                for i in range(0, len(rows), ANCHORS):
                    block = rows.slice(i, ANCHORS)
                    found = heaps(tile, block, products(_matrix(block.column("v"), here[0]), tile.v))
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names)

    return run


def _met(rows: DataFrame, anchors: DataFrame, heaps: Heaps, names: list[str], tile_rows: int, stream: int) -> DataFrame:
    """Every tile of rows with all anchors; a tile is copied once for each stream of so many anchors."""
    tiles = max(1, -(-rows.count() // tile_rows))
    parts = max(1, -(-anchors.count() // stream))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    columns = ("dim", "tile", "part", "kind", "row", "vec_id", "label", "v", "positives")
    candidates = rows.select(
        "*",
        F.pmod(F.xxhash64("row"), F.lit(tiles)).cast("int").alias("tile"),
        every(parts).alias("part"),
        F.lit(0).alias("kind"),
        F.lit(None).cast(anchors.schema["positives"].dataType).alias("positives"),
    )
    passing = anchors.select(
        "*",
        every(tiles).alias("tile"),
        F.pmod(F.xxhash64("row", F.lit(1)), F.lit(parts)).cast("int").alias("part"),
        F.lit(1).alias("kind"),
    )
    return (
        candidates.select(*columns)
        .unionAll(passing.select(*columns))
        .repartition("dim", "tile", "part")
        .sortWithinPartitions("dim", "tile", "part", "kind")
        .mapInArrow(_streamed(heaps, names), ", ".join(f"{n} bigint" for n in names))
    )


def _positive_heaps(k: int) -> Heaps:
    def heaps(tile: Tile, block: pa.RecordBatch, scores: np.ndarray) -> list[np.ndarray]:
        own, label = block.column("row").to_numpy(), block.column("label").to_numpy()
        a, c = best(scores, (label[:, None] == tile.label) & (own[:, None] != tile.row), k)
        return [own[a], scores[a, c], tile.vec_id[c], tile.row[c]]

    return heaps


def _window_heaps(k: int, low: int, high: int) -> Heaps:
    def heaps(tile: Tile, block: pa.RecordBatch, scores: np.ndarray) -> list[np.ndarray]:
        own, label = block.column("row").to_numpy(), block.column("label").to_numpy()
        listed = block.column("positives").to_pylist()
        other, out = label[:, None] != tile.label, []
        for slot in range(max(map(len, listed))):
            has = np.array([i for i, p in enumerate(listed) if slot < len(p)], np.int64)
            # Bounds of the window in whole scores: 100 * score from low to high times the positive's score.
            p = [listed[i][slot] for i in has]
            least = np.array([-(-low * x // 100) for x in p], np.int64)
            most = np.array([high * x // 100 for x in p], np.int64)
            mine = scores[has]
            a, c = best(mine, other[has] & (mine >= least[:, None]) & (mine <= most[:, None]), k)
            out.append([own[has][a], np.full(len(a), slot), mine[a, c], tile.vec_id[c], tile.row[c]])
        return [np.concatenate(x) for x in zip(*out, strict=True)]

    return heaps


def _merged(heaps: DataFrame, of: list[str], k: int) -> DataFrame:
    """The heaps of all tiles merged: the k best of each, with their rank; ties to the smaller id."""
    order = Window.partitionBy(*of).orderBy(F.desc("score"), "vec_id", "candidate")
    return heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column | str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
    tile_rows: int = TILE_ROWS,
    stream: int = STREAM,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    The positives of an anchor are its first rows of the same label; the negatives of a positive are the first rows of
    other labels whose score is from low to high per cent of the positive's.
    """
    rows = vectors_of(vectors, is_anchor, label, scale)
    anchors = rows.where("anchor").drop("anchor")
    none = F.lit(None).cast("array<bigint>").alias("positives")
    found = _met(
        rows, anchors.select("*", none), _positive_heaps(positives), ["anchor", "score", "vec_id", "candidate"], tile_rows, stream
    )
    chosen = written(_merged(found, ["anchor"], positives).select("anchor", "rank", "vec_id", "score"))
    in_order = F.array_sort(F.collect_list(F.struct("rank", "score")))
    opened = chosen.groupBy(F.col("anchor").alias("row")).agg(F.transform(in_order, lambda p: p["score"]).alias("positives"))
    windows = _met(
        rows,
        anchors.join(opened, "row"),
        _window_heaps(negatives, low, high),
        ["anchor", "slot", "score", "vec_id", "candidate"],
        tile_rows,
        stream,
    )
    kept = _merged(windows, ["anchor", "slot"], negatives)
    names = chosen.select(
        "anchor", (F.col("rank") - 1).cast("long").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    ).join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return kept.join(names, ["anchor", "slot"]).select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("vec_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
