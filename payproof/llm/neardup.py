"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

Shingles are five words (lower-case letters and digits); a text of fewer words is one shingle. The weight of a shingle is
its count in the text times an inverse document frequency, taken over all documents. Samples, which only propose candidates,
take the frequencies in a fixed number of hashed buckets, and logarithms of weights rounded to a grid, so that the random part
of a sample comes out of tables; links take the frequency of each shingle as it is. Equal texts are taken together first. Samples are banded; texts that share a band are candidates, and a candidate pair is a link if its
weighted Jaccard similarity, over the whole texts, reaches the threshold. Classes are the connected components of links.

In a band, every text is first compared with the one of the least id. Texts that candidates tie together are a family;
where a family has several components, its members outside the largest are compared with all the others, block by block,
so that no link between texts of a common band is lost. Members of the largest component are never paired with each other,
and only links come out of a block.

A text without words, or null, is a class of its own; so is a row without id. Rows of one id belong to one class. Other
columns are not looked at.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from payproof.llm import words as W
from payproof.llm.components import components
from payproof.llm.tables import written

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 3
BUCKETS = 1 << 18
#: Texts of a block, where members of a family are compared.
BLOCK = 512
#: Step and number of the grid for logarithms of weights.
STEP, LEVELS = 0.05, 440  # up to 2^30 times in a text
POOL, POOL_C = 1 << 14, 1 << 16
#: Shingles that are counted together, about.
PART_SHINGLES = 1 << 21


def shingles(chunk: W.Chunk) -> tuple[np.ndarray, np.ndarray, W.Words]:
    """Hash and text of every shingle."""
    found = W.words(chunk, W.LETTERS, lower=True)
    at = np.flatnonzero(W.whole_windows(found, SHINGLE))
    keys, owner = [W.window_hashes(found.hashes, SHINGLE)[at]], [found.text_of[at]]
    for size in range(1, SHINGLE):
        short = np.flatnonzero(found.counts == size)
        keys.append(W.window_hashes(found.hashes, size)[found.by_text[short]] + np.uint64(size))
        owner.append(short)
    return np.concatenate(keys), np.concatenate(owner), found


def counted(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different shingles of each text, in order of text: hash, text, count."""
    if len(keys) == 0:
        return keys, owner, np.empty(0, np.int64)
    order = np.argsort(W.keyed(keys, owner))
    keys, owner = keys[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])]))
    times = np.diff(np.append(first, len(keys)))
    keys, owner = keys[first], owner[first]
    order = np.argsort(owner, kind="stable")
    return keys[order], owner[order], times[order]


def bucket_of(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """How many documents have words, and how many hold a shingle of each bucket; over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for chunk in W.chunks(batch.column(0)):
                keys, owner, _ = counted(*shingles(chunk)[:2])
                total += np.bincount(bucket_of(keys), minlength=BUCKETS)
                n += len(np.unique(owner))
        full = np.flatnonzero(total)
        buckets, counts = np.append(full, -1), np.append(total[full], n)
        yield pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int32)), pa.array(counts)], ["bucket", "n"])

    rows = (
        docs.select(F.col("text").cast("string"))
        .mapInArrow(count, "bucket int, n bigint")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    buckets, n = rows.column("bucket").to_numpy(), rows.column("n").to_numpy()
    out = np.zeros(BUCKETS, np.int64)
    out[buckets[buckets >= 0]] = n[buckets >= 0]
    return int(n[buckets < 0].sum()), out


def idf(n: int, frequencies: np.ndarray) -> np.ndarray:
    """From 2 for a shingle in no document down to 1 for one in all."""
    return 1 + np.log((1 + n) / (1 + np.minimum(frequencies, n))) / np.log(2 + n)


def shingle_frequencies(docs: DataFrame, total: int) -> DataFrame:
    """Every shingle that several documents hold, and how many; over all documents. ``total`` is about how many different
    shingles they have, each document's counted by itself.

    Shingles are counted in sorted runs, which are cut into parts by their upper bits and meet part by part: a row is a piece
    of a run and not a shingle.
    """
    parts = max(1, -(-total // PART_SHINGLES))

    def cut(held: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(held), return_counts=True)
        part = ((found >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
        edges = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(part))

        def pieces(values: np.ndarray) -> pa.Array:
            offsets = (edges * values.itemsize).astype(np.int32)
            return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])

        columns = [pa.array(part[edges[:-1]]), pieces(found.astype("<u8")), pieces(n.astype("<u4"))]
        return pa.RecordBatch.from_arrays(columns, ["part", "hashes", "counts"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for chunk in W.chunks(batch.column(0)):
                if len(keys := counted(*shingles(chunk)[:2])[0]):
                    held.append(keys)
                if sum(map(len, held)) >= PART_SHINGLES:
                    yield cut(held)
                    held = []
        if held:
            yield cut(held)

    def count(pieces: pa.Table) -> pa.Table:
        hashes = np.frombuffer(b"".join(pieces.column("hashes").to_pylist()), "<u8")
        counts = np.frombuffer(b"".join(pieces.column("counts").to_pylist()), "<u4")
        order = np.argsort(hashes)
        hashes = hashes[order]
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        n = np.add.reduceat(counts[order].astype(np.int64), first)
        several = n > 1
        return pa.table({"hash": hashes[first][several].view(np.int64), "n": n[several]})

    rows = docs.select(F.col("text").cast("string")).mapInArrow(runs, "part int, hashes binary, counts binary")
    return rows.groupBy("part").applyInArrow(count, "hash bigint, n bigint")


def with_frequencies(texts: DataFrame, frequencies: DataFrame) -> DataFrame:
    """id and text with known: the frequencies of its shingles, but for those of no other document."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for chunk in W.chunks(batch.column(1)):
                keys, owner, _ = counted(*shingles(chunk)[:2])
                yield pa.RecordBatch.from_arrays([pa.array(ids[owner + chunk.first]), pa.array(keys.view(np.int64))], ["id", "hash"])

    held = texts.select("id", "text").mapInArrow(listed, "id bigint, hash bigint").join(frequencies, "hash")
    known = held.groupBy("id").agg(F.collect_set(F.struct("hash", "n")).alias("known"))
    return texts.select("id", "text").join(known, "id", "left")


def levels(keys: np.ndarray, times: np.ndarray, idf_of: np.ndarray) -> np.ndarray:
    """Weights of shingles as steps of the grid."""
    steps = np.log(times * idf_of[bucket_of(keys)]) / STEP
    return np.clip(np.rint(steps), 0, LEVELS - 1).astype(np.int64)


@functools.cache
def _pools() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The random numbers of samples: r, beta, the logarithm of c, and the multipliers of hashes."""
    random = np.random.default_rng(7)
    r, beta = random.gamma(2, 1, POOL), random.uniform(0, 1, POOL)
    multipliers = random.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return r, beta, np.log(random.gamma(2, 1, POOL_C)).astype(np.float32), multipliers


def _parts(used: np.ndarray) -> np.ndarray:
    """For each of some levels and each pool entry the part of a sample's logarithm that depends on the weight.

    Few levels occur in a chunk, and all of them together would stay in every worker.
    """
    r, beta, *_ = _pools()
    out = np.empty((len(used), POOL), np.float32)
    for row, level in zip(out, used, strict=True):
        row[:] = -r * (np.floor(level * STEP / r + beta) - beta) - r
    return out.ravel()


def bands(keys: np.ndarray, owner: np.ndarray, level: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes of each text that has shingles, and which texts those are. Shingles come in order of text."""
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.empty(0, np.int64)
    texts = owner[starts]
    sizes = np.diff(np.append(starts, len(owner)))
    r, beta, log_c, multipliers = _pools()
    out = np.zeros((len(texts), BANDS), np.uint64)
    if len(texts) == 0:
        return out, texts
    used = np.flatnonzero(np.bincount(level, minlength=LEVELS))
    part, row = _parts(used), np.zeros(LEVELS, np.int64)
    row[used] = np.arange(len(used))
    base = row[level] * POOL
    for k, multiplier in enumerate(multipliers):
        x = keys * multiplier
        entry = base + (x >> np.uint64(65 - POOL.bit_length())).astype(np.int64)
        a = part[entry]
        a += log_c[((x >> np.uint64(32)) & np.uint64(POOL_C - 1)).astype(np.int64)]
        least = np.repeat(np.minimum.reduceat(a, starts), sizes)
        at = np.flatnonzero(a == least)
        pool = entry[at] - base[at]
        t = np.floor(level[at] * STEP / r[pool] + beta[pool])
        sample = W.mix(keys[at] + W.mix(t.astype(np.int64).astype(np.uint64) + W.MIX_A))
        first = np.searchsorted(at, starts)
        band = k // ROWS
        out[:, band] = W.mix(out[:, band] + np.minimum.reduceat(sample, first) + np.uint64((band + 1) * 0x9E3779B97F4A7C15 % 2**64))
    return out, texts


def whole_hash(found: W.Words, seed: np.uint64) -> np.ndarray:
    """One hash for all the words of each text."""
    place = (np.arange(len(found.starts)) - np.repeat(found.by_text[:-1], found.counts)).astype(np.uint64)
    total = np.concatenate([[np.uint64(0)], np.cumsum(W.mix(found.hashes * seed + W.mix(place + seed)), dtype=np.uint64)])
    return W.mix(total[found.by_text[1:]] - total[found.by_text[:-1]] + found.counts.astype(np.uint64))


def _signature(idf_of: np.ndarray):
    def sign(texts: pa.Array) -> pa.Array:
        parts = []
        for chunk in W.chunks(texts):
            keys, owner, found = shingles(chunk)
            keys, owner, times = counted(keys, owner)
            hashes, rows = bands(keys, owner, levels(keys, times, idf_of), chunk.n)
            size = np.zeros(chunk.n, np.int64)
            size[rows] = BANDS
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.ravel().view(np.int64)))
            one, two = (whole_hash(found, s).view(np.int64) for s in (W.MIX_A, W.MIX_B))
            parts.append(pa.StructArray.from_arrays([pa.array(one), pa.array(two), listed], names=["h1", "h2", "bands"]))
        kind = pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("bands", pa.list_(pa.int64()))])
        return pa.concat_arrays([p.cast(kind) for p in parts]) if parts else pa.array([], kind)

    return sign


def weights(keys: np.ndarray, times: np.ndarray, n: int, *known: pa.Array) -> np.ndarray:
    """Weights of shingles of texts, given the lists known of these texts."""
    flat = [k.flatten() for k in known]
    hashes = np.concatenate([x.field("hash").to_numpy(zero_copy_only=False).astype(np.int64) for x in flat]).view(np.uint64)
    hashes, first = np.unique(hashes, return_index=True)
    frequencies = np.ones(len(keys), np.int64)
    if len(hashes):
        listed = np.concatenate([x.field("n").to_numpy(zero_copy_only=False).astype(np.int64) for x in flat])[first]
        at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
        frequencies = np.where(hashes[at] == keys, listed[at], 1)
    return times * idf(n, frequencies)


def _similarity(n: int):
    def similarity(one: pa.Array, known_one: pa.Array, two: pa.Array, known_two: pa.Array) -> pa.Array:
        out = []
        for i in range(len(one)):
            sides = []
            for texts, known in ((one, known_one), (two, known_two)):
                (chunk,) = W.chunks(texts.slice(i, 1))
                keys, _, times = counted(*shingles(chunk)[:2])
                sides.append((keys, weights(keys, times, n, known.slice(i, 1))))
            (ka, wa), (kb, wb) = sides
            _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
            common = np.minimum(wa[ia], wb[ib]).sum()
            out.append(common / max(wa.sum() + wb.sum() - common, 1e-12))
        return pa.array(out, pa.float64())

    return similarity


def _linked(pairs: DataFrame, texts: DataFrame, similarity, threshold: float) -> DataFrame:
    """The pairs (u, v) whose texts are similar enough."""
    one = texts.select(F.col("id").alias("u"), F.col("text").alias("text_u"), F.col("known").alias("known_u"))
    two = texts.select(F.col("id").alias("v"), F.col("text").alias("text_v"), F.col("known").alias("known_v"))
    return pairs.join(two, "v").join(one, "u").where(similarity("text_u", "known_u", "text_v", "known_v") >= threshold).select("u", "v")


def _crossing(docs: DataFrame, families: DataFrame, parts: DataFrame, n: int, threshold: float) -> DataFrame:
    """Links between texts of one family (candidates, and candidates of those) that are not yet in one component.

    Members outside the largest component of their family are compared with all members, in blocks of at most about
    BLOCK texts a side; what comes out is one link for each pair of components that a text ties together.
    """
    placed = families.withColumnRenamed("component", "family").join(parts, "id", "left")
    placed = placed.select("id", "family", F.coalesce("component", "id").alias("part"))
    sizes = (
        placed.groupBy("family", "part")
        .agg(F.count("*").alias("n"))
        .groupBy("family")
        .agg(F.sum("n").alias("members"), F.max(F.struct("n", "part")).alias("main"), F.count("*").alias("parts"))
        .where("parts > 1 and members > 2")  # of two, both have been compared
        .select(
            "family",
            F.col("main.part").alias("main"),
            F.ceil(F.col("members") / BLOCK).cast("int").alias("columns"),
            F.ceil((F.col("members") - F.col("main.n")) / BLOCK).cast("int").alias("rows"),
        )
    )
    members = placed.join(sizes, "family").join(docs, "id")
    some = F.xxhash64("id")
    strays = members.where("part <> main").select(
        "family",
        F.pmod(some, F.col("rows")).cast("int").alias("row"),
        F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("column"),
        "id",
        "part",
        "text",
        "known",
    )
    others = members.select(
        "family",
        F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"),
        F.pmod(some, F.col("columns")).cast("int").alias("column"),
        "id",
        "part",
        "text",
        "known",
    )
    both = strays.withColumn("stray", F.lit(True)).unionByName(others.withColumn("stray", F.lit(False)))

    def compare(block: pa.Table) -> pa.Table:
        stray = block.column("stray")
        u, v = _block_links(block.filter(stray), block.filter(pc.invert(stray)), n, threshold)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return both.groupBy("family", "row", "column").applyInArrow(compare, "u bigint, v bigint")


def _block_links(one: pa.Table, two: pa.Table, n_docs: int, threshold: float) -> tuple[list[int], list[int]]:
    """For each text of one, a text of two at least as similar as the threshold in every other component."""
    sides = []
    for table in (one, two):
        keys, owner, counts = [], [], []
        for chunk in W.chunks(table.column("text").combine_chunks()) if table.num_rows else ():
            k, o, times = counted(*shingles(chunk)[:2])
            keys.append(k)
            owner.append(o + chunk.first)
            counts.append(times)
        empty = np.empty(0, np.int64)
        sides.append([np.concatenate([x.astype(x.dtype), *y]) for x, y in ((empty.astype(np.uint64), keys), (empty, owner))])
        known = table.column("known").combine_chunks()
        sides[-1].append(weights(sides[-1][0], np.concatenate([empty, *counts]), n_docs, known))
    (ka, oa, wa), (kb, ob, wb) = sides
    order = np.argsort(kb, kind="stable")
    kb, ob, wb = kb[order], ob[order], wb[order]
    total = np.bincount(ob, weights=wb, minlength=two.num_rows)
    low, high = np.searchsorted(kb, ka, side="left"), np.searchsorted(kb, ka, side="right")
    begins = np.searchsorted(oa, np.arange(one.num_rows + 1))
    ids_a, ids_b = one.column("id").to_numpy(), two.column("id").to_numpy()
    parts_a, parts_b = one.column("part").to_numpy(), two.column("part").to_numpy()
    u, v = [], []
    for i in range(one.num_rows):
        span = slice(begins[i], begins[i + 1])
        n = high[span] - low[span]
        at = np.repeat(low[span] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.bincount(ob[at], weights=np.minimum(np.repeat(wa[span], n), wb[at]), minlength=two.num_rows)
        alike = common >= threshold * (wa[span].sum() + total - common) - 1e-9
        hits = np.flatnonzero(alike & (parts_b != parts_a[i]))
        _, first = np.unique(parts_b[hits], return_index=True)
        u += [int(ids_a[i])] * len(first)
        v += ids_b[hits[first]].tolist()
    return u, v


def classes(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """doc_id and class_id, the least doc_id of its class, for every row."""
    spark: SparkSession = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    n, frequencies = document_frequencies(docs)
    idf_of = idf(n, frequencies).astype(np.float32)
    shared = spark.sparkContext.broadcast(idf_of)  # BUCKETS numbers, whatever the input

    @arrow_udf("struct<h1: bigint, h2: bigint, bands: array<bigint>>")
    def sign(texts: pa.Array) -> pa.Array:
        return _signature(shared.value)(texts)

    @arrow_udf("double")
    def similarity(one: pa.Array, known_one: pa.Array, two: pa.Array, known_two: pa.Array) -> pa.Array:
        return _similarity(n)(one, known_one, two, known_two)

    signed = written(docs.where("id is not null").select("id", sign("text").alias("s")).select("id", "s.*"))
    full = signed.where(F.size("bands") > 0)
    # Texts with the same words, and bands in which several of them meet.
    same = full.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.first("bands").alias("bands"))
    in_band = written(same.select("id", F.explode("bands").alias("band")))
    least = in_band.groupBy("band").agg(F.min("id").alias("u"), F.max("id").alias("last")).where("u < last")
    pairs = in_band.join(least.select("band", "u"), "band").where("id > u").select("u", F.col("id").alias("v")).distinct()
    pairs = written(pairs)
    candidates = docs.join(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "id")
    texts = written(with_frequencies(candidates, written(shingle_frequencies(docs, int(frequencies.sum())))))
    links = written(_linked(pairs, texts, similarity, threshold))
    parts = components(links)
    more = written(_crossing(texts, components(pairs), components(links), n, threshold))
    equal = full.join(same.select("h1", "h2", F.col("id").alias("v")), ["h1", "h2"]).select(F.col("id").alias("u"), "v")
    final = components(links.unionByName(more).unionByName(equal))
    found = signed.select("id").distinct().join(final, "id", "left")
    return (
        docs.select("id")
        .join(found, "id", "left")
        .select(F.col("id").alias("doc_id"), F.coalesce("component", "id").alias("class_id"))
    )
