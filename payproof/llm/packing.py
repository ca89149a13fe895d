"""Packing token ids into windows of a fixed size by best-fit decreasing.

A document is its token ids and one end id. It is cut into full windows from its beginning; what is left, shorter than a
window, is packed: longest first, each into the open window with the least room that still takes it. A segment tree over
the remaining capacity finds that window. Documents are dealt to shards by a hash, each shard is packed by itself, and
the shards grow in number, not in size, with the input.

A null text counts as an empty one and is packed as its end id. Rows are taken one by one, so repeated rows and ids, and
null ids, each give their own pieces. Ties go to the smaller id, then by content. Other columns are not looked at.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payproof.llm import words as W

WINDOW = 2048
END_ID = 1
#: Documents of a shard.
SHARD_DOCS = 4096
#: Words whose ids a worker remembers.
MEMORY = 1_000_000
#: Units encoded in one run.
RUN_UNITS = 20_000

#: White space beyond ASCII; it may join ASCII white space in one token, so such texts are encoded as they stand.
_WIDE_SPACE = tuple(
    map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(0x1C, 0x20)))
)


class Known:
    """Ids of units by the hash of the unit: sorted hashes, and where in one flat array the ids of each begin and how many."""

    def __init__(self) -> None:
        self.keys, self.begin, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0

    def missing(self, keys: np.ndarray) -> np.ndarray:
        """Positions of the keys (sorted, each once) that are not known."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        return np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))

    def add(self, keys: np.ndarray, ids: list[np.ndarray]) -> None:
        """Take in unknown keys (sorted, each once) with their ids."""
        size = np.array([len(x) for x in ids], np.int64)
        begin = self.used + np.cumsum(size) - size
        self.used += int(size.sum())
        while self.used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used - int(size.sum()) : self.used] = np.concatenate([*ids, self.flat[:0]])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.begin, self.size = (
            np.insert(old, at, new) for old, new in ((self.keys, keys), (self.begin, begin), (self.size, size))
        )

    def keep(self, keys: np.ndarray) -> None:
        """Forget all but some known keys (sorted, each once)."""
        at = np.searchsorted(self.keys, keys)
        ids = self.ids(at)
        self.keys, self.size = keys, self.size[at]
        self.begin, self.used = np.cumsum(self.size) - self.size, len(ids)
        self.flat = np.concatenate([ids, np.empty(1 << 16, np.uint32)])

    def ids(self, at: np.ndarray) -> np.ndarray:
        """The ids of the entries at some positions, one after the other."""
        count = self.size[at]
        return self.flat[np.repeat(self.begin[at] - (np.cumsum(count) - count), count) + np.arange(count.sum())]


class Encoder:
    """Ids of whole texts. A token never reaches back over the beginning of a run of white space, so a run with the
    word after it is encoded once and then looked up by its hash."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known = Known()
        size = self.tokenizer.get_vocab_size()
        # Every byte is one letter of the byte-level alphabet, so a token is as many bytes as its name has letters.
        self.n_bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_units(self, units: list[bytes]) -> list[np.ndarray]:
        """Ids of each unit. Units that begin with white space and end with a word are encoded as running text and
        told apart by the bytes of their tokens; that is cheaper than one call for each."""
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(units)
        spaces = b" \t\n\x0b\x0c\r"
        joint = [i for i, u in enumerate(units) if u[0] in spaces and u[-1] not in spaces]
        alone = sorted(set(range(len(units))) - set(joint))
        for i, ids in zip(alone, self._encode([units[i].decode("utf-8", "replace") for i in alone]), strict=True):
            out[i] = ids
        for k in range(0, len(joint), RUN_UNITS):
            run = joint[k : k + RUN_UNITS]
            (ids,) = self._encode([b"".join([units[i] for i in run]).decode("utf-8", "replace")])
            ends = np.cumsum([len(units[i]) for i in run])
            stops = np.searchsorted(np.cumsum(self.n_bytes[ids]), ends, side="right").tolist()
            for i, a, b in zip(run, [0, *stops[:-1]], stops, strict=True):
                out[i] = ids[a:b]
        return out

    def chunk(self, chunk: W.Chunk) -> list[np.ndarray]:
        """The ids of each text of a chunk."""
        found = W.words(chunk)
        # A unit goes from the end of the last word, or the beginning of the text, to the end of its word;
        # white space at the end of a text is a unit too.
        last = np.full(chunk.n, -1)
        full = found.counts > 0
        last[full] = found.ends[found.by_text[1:][full] - 1]
        tail_from = np.where(full, last, chunk.offsets[:-1])
        has_tail = tail_from < chunk.offsets[1:]
        begins = np.concatenate([[0], found.ends[:-1]]) if len(found.ends) else found.ends
        first = found.by_text[:-1][full]
        begins[first] = chunk.offsets[:-1][full]
        starts = np.concatenate([begins, tail_from[has_tail]])
        ends = np.concatenate([found.ends, chunk.offsets[1:][has_tail]])
        owner = np.concatenate([found.text_of, np.flatnonzero(has_tail)])
        order = np.lexsort((starts, owner))
        starts, ends, owner = starts[order], ends[order], owner[order]
        keys, at, which = np.unique(W.range_hash(found.prefix, starts, ends), return_index=True, return_inverse=True)
        if len(self.known.keys) > MEMORY:  # those of this chunk are the likeliest to come again
            self.known.keep(np.delete(keys, self.known.missing(keys)))
        new = self.known.missing(keys)
        if len(new):
            text = chunk.data.tobytes()
            units = [text[s:e] for s, e in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)]
            self.known.add(keys[new], self._encode_units(units))
        place = np.searchsorted(self.known.keys, keys)[which]
        count = self.known.size[place]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, weights=count, minlength=chunk.n))]).astype(np.int64)
        out = np.split(self.known.ids(place), bounds[1:-1])
        for row in self._odd(chunk):
            out[row] = self._encode([chunk.text(row)])[0]
        return out

    def _odd(self, chunk: W.Chunk) -> list[int]:
        """Texts with white space beyond ASCII."""
        control = np.flatnonzero((chunk.data >= 0x1C) & (chunk.data <= 0x1F))
        lead = np.flatnonzero(np.isin(chunk.data, np.frombuffer(b"\xc2\xe1\xe2\xe3", np.uint8)))
        rows = np.unique(np.searchsorted(chunk.offsets, np.concatenate([control, lead]), side="right") - 1)
        return [int(r) for r in rows if any(c in chunk.text(r) for c in _WIDE_SPACE)]


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(ids: np.ndarray, window: int = WINDOW) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document: full windows, then the rest."""
    return [(s, min(window, len(ids) - s)) for s in range(0, len(ids), window)]


class Capacities:
    """Open windows by remaining capacity: a segment tree whose nodes count the windows below them."""

    def __init__(self, most: int):
        self.size = 1 << (most + 1).bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, capacity: int, by: int) -> None:
        i = capacity + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, window: int, capacity: int) -> None:
        self.open[capacity].append(window)
        self._add(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """The window with the smallest capacity of least or more, and that capacity."""
        i = least + self.size
        while not self.count[i]:
            while i & 1:  # a right child: nothing larger below its parent
                i >>= 1
                if i <= 1:
                    return None
            i += 1
            if i >= 2 * self.size:
                return None
        while i < self.size:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.size
        self._add(capacity, -1)
        return self.open[capacity].pop(), capacity


def best_fit(lengths: Iterable[int], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece; lengths come in descending order."""
    tree, where, at, n = Capacities(window), [], [], 0
    for length in lengths:
        found = tree.take(length) if length < window else None
        if found is None:
            found, n = (n, window), n + 1
        where.append(found[0])
        at.append(window - found[1])
        if found[1] > length:
            tree.put(found[0], found[1] - length)
    return np.array(where, np.int64), np.array(at, np.int64)


PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """The pieces of every document, with a checksum of their ids or, if keep_ids, the ids too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            doc_id = batch.column(0)
            for chunk in W.chunks(batch.column(1)):
                rows, values = [], []
                for row, ids in enumerate(encode.chunk(chunk)):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for start, length in cut(ids, window):
                        part = ids[start : start + length]
                        rows.append((chunk.first + row, start, length, zlib.crc32(part.tobytes()), len(ids)))
                        if keep_ids:
                            values.append(part.astype(np.int32))
                table = np.array(rows, np.int64).reshape(-1, 5)
                columns = [doc_id.take(pa.array(table[:, 0])), *(pa.array(table[:, i]) for i in range(1, 5))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if keep_ids:
                    columns, names = [*columns, pa.array(values, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = PIECES + (", ids array<int>" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def pack(
    docs: DataFrame,
    path: str | None = None,
    window: int = WINDOW,
    end_id: int = END_ID,
    keep_ids: bool = False,
    shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """Every piece with its sequence and its place there. The sequence id holds the shard in its upper half."""
    cut_up = pieces(docs, path or public_tokenizers.path("byte_bpe_50k.json"), window, end_id, keep_ids)
    shards = max(1, -(-docs.count() // shard_docs))

    def place(key: tuple[int], group: pd.DataFrame) -> pd.DataFrame:
        order = ["length", "doc_id", "start", "ids_crc32"]
        group = group.sort_values(order, ascending=[False, True, True, True], kind="stable")
        where, at = best_fit(group["length"].tolist(), window)
        return group.drop(columns="shard").assign(sequence_id=(int(key[0]) << 32) + where, offset=at)

    whole = F.xxhash64("doc_id", "doc_tokens", F.when(F.col("start") == 0, F.col("ids_crc32")))
    dealt = cut_up.withColumn("shard", F.pmod(whole, F.lit(shards)))
    schema = PIECES + (", ids array<int>" if keep_ids else "") + ", sequence_id bigint, offset bigint"
    return dealt.groupBy("shard").applyInPandas(place, schema)


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = END_ID) -> DataFrame:
    """The ids of each sequence, padded to the window; needs pack(keep_ids=True)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    ids = F.flatten(F.transform(parts, lambda p: p["ids"]))
    return (
        packed.groupBy("sequence_id")
        .agg(ids.alias("ids"))
        .select(
            "sequence_id",
            F.size("ids").cast("long").alias("n_ids"),
            F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(window) - F.size("ids"))).alias("ids"),
        )
    )
