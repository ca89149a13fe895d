"""Substring dedup: words of windows that an earlier document holds too are taken out.

Texts with the same words are found first: of those the least id stands for all, and the others go whole. In what is left,
every window of 50 words has a least hash among its runs of ten words; windows can only be equal if these are, so only
windows whose least hash occurs in two documents are looked at further. For each of them the first document that holds it
is its reference. A reference shard is the part of one such document that others repeat. Its suffix automaton is copied to
every task that streams documents against it (many documents to one reference are dealt to several tasks), and matching
statistics give the maximal spans of at least 50 words to remove. Windows are judged on the input, whatever else goes.

A null or empty text has no words. Rows without id are kept whole and are no reference. Rows of one id are no reference to
each other. Repeated rows each come back. Other columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from payproof.llm import words as W
from payproof.llm.neardup import whole_hash
from payproof.llm.tables import written

WINDOW = 50
GRAM = 10
#: Documents that one task streams against one reference.
STREAMS = 256
#: Texts of a batch for the workers.
BATCH_ROWS = 500


def least_grams(found: W.Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of every window of one text, and the least hash among its runs of GRAM words."""
    at = np.flatnonzero(W.whole_windows(found, window))
    if len(at) == 0:
        return at, np.empty(0, np.uint64)
    least, width, want = W.window_hashes(found.hashes, GRAM), 1, window - GRAM + 1
    while 2 * width <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return at, np.minimum(least[at], least[at + want - width])


class Automaton:
    """Suffix automaton of word runs. State 0 is the empty run."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, run: list[bytes]) -> None:
        following, link, length = self.next, self.link, self.length
        last = 0
        for word in run:
            if (known := following[last].get(word)) is not None and length[known] == length[last] + 1:
                last = known
                continue
            new = len(following)
            following.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and word not in following[p]:
                following[p][word] = new
                p = link[p]
            if p >= 0:
                q = following[p][word]
                if length[q] != length[p] + 1:
                    twin = len(following)
                    following.append(dict(following[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and following[p].get(word) == q:
                        following[p][word] = twin
                        p = link[p]
                    link[q] = twin
                    q = twin
                link[new] = q
            last = new

    def spans(self, words: list[bytes], least: int) -> list[tuple[int, int]]:
        """Maximal runs of words, of at least so many, each of which occurs in the automaton; those that touch are joined."""
        out: list[list[int]] = []
        state = matched = 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if (to := self.next[state].get(word)) is not None:
                state, matched = to, matched + 1
            if matched >= least:
                start = i + 1 - matched
                if out and start <= out[-1][1]:
                    out[-1][0] = min(out[-1][0], start)
                    out[-1][1] = i + 1
                else:
                    out.append([start, i + 1])
        return [(a, b) for a, b in out]


SUMMARY = "struct<n_words: bigint, h1: bigint, h2: bigint, sha: string, grams: array<bigint>>"


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _text_words(chunk: W.Chunk, row: int) -> list[bytes]:
    return chunk.data[chunk.offsets[row] : chunk.offsets[row + 1]].tobytes().split()


def _whole_hashes(chunk: W.Chunk) -> tuple[list[int], list[int]]:
    """The two hashes for all the words of each text."""
    found = W.words(chunk)
    one, two = (whole_hash(found, seed).view(np.int64).tolist() for seed in (W.MIX_A, W.MIX_B))
    return one, two


def _longs(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate([np.empty(0, np.int64), *(v.view(np.int64) for v in values)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))


@functools.cache
def _summary_udf(window: int):
    @arrow_udf(SUMMARY)
    def summary(texts: pa.Array) -> pa.Array:
        counts, ones, twos, digests, grams = [], [], [], [], []
        for chunk in W.chunks(texts):
            found = W.words(chunk)
            at, least = least_grams(found, window)
            owner = found.text_of[at]
            change = np.ones(len(at), bool)
            change[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
            least, owner = least[change], owner[change]
            bounds = np.searchsorted(owner, np.arange(chunk.n + 1))
            grams += [np.unique(least[bounds[i] : bounds[i + 1]]) for i in range(chunk.n)]
            counts += found.counts.tolist()
            ones += whole_hash(found, W.MIX_A).view(np.int64).tolist()
            twos += whole_hash(found, W.MIX_B).view(np.int64).tolist()
            digests += [_digest(_text_words(chunk, i)) for i in range(chunk.n)]
        columns = [pa.array(counts, pa.int64()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), pa.array(digests, pa.string())]
        return pa.StructArray.from_arrays([*columns, _longs(grams)], names=["n_words", "h1", "h2", "sha", "grams"])

    return summary.asNondeterministic()


@functools.cache
def _windows_udf(window: int):
    """Windows of a text whose least hash is among the given ones: first word and hash."""

    @arrow_udf("array<struct<pos: int, hash: bigint>>")
    def windows(texts: pa.Array, shared: pa.Array) -> pa.Array:
        positions, hashes = [], []
        for chunk in W.chunks(texts):
            found = W.words(chunk)
            at, least = least_grams(found, window)
            all_hashes = W.window_hashes(found.hashes, window)
            bounds = np.searchsorted(at, found.by_text)
            for i in range(chunk.n):
                wanted = np.array(shared[chunk.first + i].as_py(), np.int64).view(np.uint64)
                own = at[bounds[i] : bounds[i + 1]][np.isin(least[bounds[i] : bounds[i + 1]], wanted)]
                positions.append(own - found.by_text[i])
                hashes.append(all_hashes[own])
        listed = _longs(hashes)
        flat = np.concatenate([np.empty(0, np.int64), *positions]).astype(np.int32)
        both = pa.StructArray.from_arrays([pa.array(flat, pa.int32()), listed.values], names=["pos", "hash"])
        return pa.ListArray.from_arrays(listed.offsets, both)

    return windows.asNondeterministic()


@functools.cache
def _cut_udf():
    """Words from lo to hi of a text, joined by one space, and the hashes of all its words."""

    @arrow_udf("struct<part: string, h1: bigint, h2: bigint>")
    def cut(texts: pa.Array, lo: pa.Array, hi: pa.Array) -> pa.Array:
        out, ones, twos = [], [], []
        for chunk in W.chunks(texts):
            for hashes, more in zip((ones, twos), _whole_hashes(chunk), strict=True):
                hashes += more
            for i in range(chunk.n):
                a, b = lo[chunk.first + i].as_py(), hi[chunk.first + i].as_py()
                out.append(b" ".join(_text_words(chunk, i)[a:b]).decode("utf-8", "replace"))
        columns = [pa.array(out, pa.string()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64())]
        return pa.StructArray.from_arrays(columns, names=["part", "h1", "h2"])

    return cut.asNondeterministic()


def _left(words: list[bytes], spans: list[dict]) -> tuple[list[bytes], int]:
    """Words outside the spans, and how many are inside."""
    gone = np.zeros(len(words), bool)
    for span in spans:
        gone[span["s"] : span["e"]] = True
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g], int(gone.sum())


@functools.cache
def _removed_udf():
    @arrow_udf("struct<n_removed: bigint, sha: string>")
    def removed(texts: pa.Array, spans: pa.Array) -> pa.Array:
        counts, digests = [], []
        for chunk in W.chunks(texts):
            for i in range(chunk.n):
                kept, n = _left(_text_words(chunk, i), spans[chunk.first + i].as_py() or [])
                counts.append(n)
                digests.append(_digest(kept))
        columns = [pa.array(counts, pa.int64()), pa.array(digests, pa.string())]
        return pa.StructArray.from_arrays(columns, names=["n_removed", "sha"])

    return removed.asNondeterministic()


@functools.cache
def _kept_udf():
    """A text without those of the spans that are given for its words; null if there are none."""

    @arrow_udf("string")
    def kept(texts: pa.Array, given: pa.Array) -> pa.Array:
        out = []
        for chunk in W.chunks(texts):
            for i, own in enumerate(zip(*_whole_hashes(chunk), strict=True)):
                lists = given[chunk.first + i].as_py() or []
                spans = [s for g in lists if (g["h1"], g["h2"]) == own for s in g["spans"]]
                out.append(b" ".join(_left(_text_words(chunk, i), spans)[0]).decode("utf-8", "replace") if spans else None)
        return pa.array(out, pa.string())

    return kept.asNondeterministic()


STREAMED = "id bigint, h1 bigint, h2 bigint, spans array<struct<s: int, e: int>>"


def _stream(window: int):
    """Rows come by reference and salt, the reference's text first; its automaton meets the documents after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, automaton = None, Automaton()
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if at != (place := (row["owner"], row["salt"])):
                    at, automaton = place, Automaton()
                words = row["part"].encode().split()
                if row["kind"] == 0:
                    automaton.add(words)
                elif spans := automaton.spans(words, window):
                    rows.append((row["id"], row["h1"], row["h2"], [{"s": row["lo"] + a, "e": row["lo"] + b} for a, b in spans]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "h1", "h2", "spans"])

    return run


def summaries(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """id, n_words, sha of the words, hashes of all words, least hashes of the windows; as a written table."""
    # Whole texts go to the workers, some of them long: fewer in a batch keep a worker's memory small.
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    given = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return written(given.select("id", _summary_udf(window)("text").alias("s")).select("id", "s.*"))


def suspects(docs: DataFrame, summary: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Copies of a text of a smaller id, and the texts (as a written table) that share a least hash with another."""
    long = summary.where(f"id is not null and n_words >= {window}")
    first = long.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.first("grams").alias("grams"))
    copies = (
        long.join(first.where("first < last").select("h1", "h2", "first"), ["h1", "h2"])
        .where("id > first")
        .select("id", "h1", "h2")
        .distinct()
    )
    grams = first.select(F.col("first").alias("id"), F.explode("grams").alias("gram"))
    twice = grams.groupBy("gram").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("gram")
    shared = grams.join(twice, "gram").groupBy("id").agg(F.collect_set("gram").alias("shared"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return copies, written(shared.join(texts, "id").select("id", "text", "shared"))


def matched(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """Spans of each text (by id and hashes of its words) that an earlier one holds, from the automata of references."""
    each = texts.select("id", F.explode(_windows_udf(window)("text", "shared")).alias("w")).select("id", "w.*")
    owners = each.groupBy("hash").agg(F.min("id").alias("owner"), F.max("id").alias("last")).where("owner < last")
    pairs = (
        each.join(owners.select("hash", "owner"), "hash")
        .groupBy("id", "owner")
        .agg(F.min("pos").alias("lo"), (F.max("pos") + window).alias("hi"))
    )
    pairs = written(pairs)
    salts = pairs.groupBy("owner").agg(F.ceil(F.count("*") / STREAMS).cast("int").alias("salts"))
    parts = (
        pairs.join(texts.select("id", "text"), "id")
        .withColumn("cut", _cut_udf()("text", "lo", "hi"))  # one function: each one of a step has a worker of its own
        .join(salts, "owner")
        .select(
            "owner",
            F.explode(
                F.when(F.col("id") == F.col("owner"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(
                    F.array(F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
                )
            ).alias("salt"),
            F.when(F.col("id") == F.col("owner"), 0).otherwise(1).alias("kind"),
            "id",
            "cut.h1",
            "cut.h2",
            "lo",
            "cut.part",
        )
    )
    dealt = parts.repartition("owner", "salt").sortWithinPartitions("owner", "salt", "kind", "id")
    found = dealt.mapInArrow(_stream(window), STREAMED)
    return found.groupBy("id", "h1", "h2").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words of every row."""
    summary = summaries(docs, window)
    copies, texts = suspects(docs, summary, window)
    of_text = texts.withColumn("h", _summary_udf(window)("text")).select("id", "h.h1", "h.h2", "text")
    spans = matched(texts, window)
    cut = of_text.join(spans, ["id", "h1", "h2"]).withColumn("r", _removed_udf()("text", "spans"))
    changed = cut.select("id", "h1", "h2", "r.n_removed", F.col("r.sha").alias("kept")).dropDuplicates(["id", "h1", "h2"])
    whole = copies.select("id", "h1", "h2", F.lit(None).cast("long").alias("n_removed"), F.sha2(F.lit(""), 256).alias("kept"))
    both = changed.join(copies, ["id", "h1", "h2"], "left_anti").unionByName(whole).withColumn("hit", F.lit(True))
    return summary.join(both, ["id", "h1", "h2"], "left").select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.when(F.col("hit"), F.coalesce("n_removed", "n_words")).otherwise(0).alias("n_removed"),
        F.when(F.col("hit"), F.col("kept")).otherwise(F.col("sha")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every row with the repeated spans cut out of its text; texts without any stay as they are."""
    summary = summaries(docs, window)
    copies, texts = suspects(docs, summary, window)
    spans = matched(texts, window).join(copies, ["id", "h1", "h2"], "left_anti")
    everything = F.array(F.struct(F.lit(0).alias("s"), F.lit((1 << 31) - 1).alias("e"))).alias("spans")
    gone = spans.unionByName(copies.select("id", "h1", "h2", everything))
    by_id = gone.groupBy(F.col("id").alias("gone_id")).agg(F.collect_list(F.struct("h1", "h2", "spans")).alias("gone"))
    joined = docs.join(by_id, F.col("doc_id") == F.col("gone_id"), "left")
    left = _kept_udf()(F.when(F.col("gone").isNotNull(), F.col("text")), "gone")
    return joined.withColumn("text", F.coalesce(left, "text")).select(*docs.columns)
