"""Encoding and decoding with the pieces of a SentencePiece model, by batched merges or batched Viterbi in numpy.

A text is cut into units: a run of spaces with the letters after it, up to the next space. Each different unit of a chunk
is segmented once. Units of one length advance together (long ones with those of a similar length): hashes of all substrings
probe the sorted hashes of the pieces. For a model of merges, every round joins in each unit the two neighbours that make the
piece of highest score, the leftmost of equals, until none is left; very long units do so one by one, with a heap. For
other models a maximum over the pieces that end at a letter stores the size of the best one as the way back, and the path of
highest total score is taken. The ids are those of the model's own encoder, but for a literal of the space mark, which
becomes byte pieces, like a letter without a piece, so that every text decodes exactly.

A null text counts as an empty one, which has no ids. Bytes that are not UTF-8 count as the replacement letter. Rows are
taken one by one; other columns are not looked at.
"""

from __future__ import annotations

import functools
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from payproof.llm import words as W

MARK, LITERAL, PADDING = 0x2581, -1, -2
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of texts taken together, letters of units that advance together, letters up to which lengths are kept apart.
CHUNK, CELLS, APART = 1 << 22, 1 << 17, 24
#: Bits of a hash that say whether there may be a piece.
MAYBE_BITS = 20
#: Letters of a unit up to which merges are done in rounds, and the type of a model of merges.
ROUNDS, MERGES = 256, 2


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the ranges that begin at starts, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def powers(n: int) -> np.ndarray:
    out = np.full(n, BASE)
    out[:1] = 1
    return np.cumprod(out)


def letter_hashes(codes: np.ndarray) -> np.ndarray:
    return W.mix(codes.astype(np.int64).astype(np.uint64) + W.MIX_A)


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        usable = [
            i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        names = [model.id_to_piece(i) for i in usable]
        kept = [k for k, name in enumerate(names) if chr(MARK) not in name.lstrip(chr(MARK))]  # none goes over a unit's end
        self.longest = max(len(names[k]) for k in kept)
        self.powers = powers(self.longest + 1)
        hashes = np.array([self._hash(names[k]) for k in kept], np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.maybe = np.zeros(1 << MAYBE_BITS, bool)
        self.maybe[self.hashes >> np.uint64(64 - MAYBE_BITS)] = True
        self.ids = np.array([usable[k] for k in kept], np.int32)[order]
        self.scores = np.array([model.get_score(usable[k]) for k in kept], np.float32)[order]
        self.unknown = float(self.scores.min()) - 10
        self.letters = [b""] * n
        for k, name in zip(usable, names, strict=True):
            self.letters[k] = name.replace(chr(MARK), " ").encode()
        for b, i in enumerate(self.bytes_ids):
            self.letters[i] = bytes([b])
        self.sizes = np.array([len(x) for x in self.letters])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(self.letters), np.uint8)

    def _hash(self, name: str) -> np.uint64:
        letters = letter_hashes(np.array([ord(c) for c in name]))
        return (letters * self.powers[: len(name)][::-1]).sum(dtype=np.uint64)

    def _probed(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and id of the piece by last letter, size and unit."""
        n, length = codes.shape
        letters = np.ascontiguousarray(letter_hashes(codes).T)
        prefix = np.zeros((length + 1, n), np.uint64)
        for j in range(length):
            prefix[j + 1] = prefix[j] * BASE + letters[j]
        sizes = min(self.longest, length)
        score = np.full((length + 1, sizes, n), -np.inf, np.float32)
        piece = np.full((length + 1, sizes, n), -1, np.int32)
        score[:, 0] = self.unknown
        for size in range(1, sizes + 1):
            keys = prefix[size:] - prefix[:-size] * self.powers[size]
            j, i = np.nonzero(self.maybe[keys >> np.uint64(64 - MAYBE_BITS)])
            keys = keys[j, i]
            at = np.minimum(np.searchsorted(self.hashes, keys), len(self.hashes) - 1)
            hit = self.hashes[at] == keys
            j, i, at = j[hit] + size, i[hit], at[hit]
            score[j, size - 1, i] = self.scores[at]
            piece[j, size - 1, i] = self.ids[at]
        return score, piece

    def _cut(self, score: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By letter and unit, whether a piece of the best path ends there, and its size."""
        length, sizes, n = score.shape[0] - 1, score.shape[1], score.shape[2]
        every = np.arange(n)
        best = np.full((length + sizes, n), -np.inf)  # row j + sizes - 1 is letter j
        best[sizes - 1] = 0
        back = np.zeros((length + 1, n), np.int32)
        for j in range(1, length + 1):
            total = best[j - 1 : j + sizes - 1][::-1] + score[j]
            k = total.argmax(axis=0)
            best[j + sizes - 1], back[j] = total[k, every], k + 1
        ends, at = np.zeros((length + 1, n), bool), lengths.copy()
        for j in range(length, 0, -1):
            ends[j] = at == j
            at -= ends[j] * back[j]
        return ends, back

    def _units(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, given as rows of code points that are padded at the end, and how many each has."""
        n = len(codes)
        score, piece = self._probed(codes)
        ends, size = self._cut(score, lengths)
        unit, last = np.nonzero(ends.T)
        ids = piece[last, size[last, unit] - 1, unit]
        without = ids < 0
        if without.any():
            alone = codes[unit[without], last[without] - 1]
            alone = np.where(alone == LITERAL, MARK, alone)
            data = np.frombuffer(alone.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
            times = np.ones(len(ids), np.int64)
            times[without] = 1 + (alone >= 0x80) + (alone >= 0x800) + (alone >= 0x10000)
            ids, unit = np.repeat(ids, times), np.repeat(unit, times)
            ids[ids < 0] = self.bytes_ids[data]
        return ids, np.bincount(unit, minlength=n)

    def _segmented(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the given units, in their order, and how many each has."""
        # Lengths up to APART are kept apart; beyond, those within a quarter go together.
        beyond = APART + 1 + np.floor(np.log(np.maximum(lengths, APART) / APART) / np.log(1.25))
        group_of = np.where(lengths <= APART, lengths, beyond)
        order = np.lexsort((lengths, group_of))
        sorted_lengths, group = lengths[order], group_of[order]
        flat, unit, counts = [np.empty(0, np.int32)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        a = 0
        while a < len(order):
            stop = int(np.searchsorted(group, group[a], side="right"))
            length = int(sorted_lengths[stop - 1])
            b = min(stop, a + max(1, CELLS // length))
            of = order[a:b]
            rows = np.full((b - a, length), PADDING, np.int64)
            rows[np.arange(length) < lengths[of, None]] = codes[ranges(starts[of], lengths[of])]
            ids, n = self._units(rows, lengths[of])
            flat.append(ids)
            unit.append(of)
            counts.append(n)
            a = b
        flat, unit, counts = (np.concatenate(x) for x in (flat, unit, counts))
        back = np.argsort(unit)
        return flat[ranges((np.cumsum(counts) - counts)[back], counts[back])], counts[back]

    def chunk(self, chunk: W.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a chunk, and where those of each text begin."""
        codes = np.frombuffer(chunk.data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        before = np.concatenate([[0], np.cumsum((chunk.data & 0xC0) != 0x80)])[chunk.offsets]
        full = before[:-1] < before[1:]
        codes = np.insert(codes, before[:-1][full], 32)
        texts = before + np.concatenate([[0], np.cumsum(full)])
        if not len(codes):
            return np.empty(0, np.int32), np.zeros(chunk.n + 1, np.int64)
        space = codes == 32
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[texts[:-1][full]] = True
        starts = np.flatnonzero(begins)
        lengths = np.diff(np.append(starts, len(codes)))
        codes = np.where(codes == MARK, LITERAL, np.where(space, MARK, codes))
        # Equal units once: taken together by hash, then compared letter by letter.
        place = ranges(np.zeros(len(starts), np.int64), lengths)
        hashes = np.add.reduceat(letter_hashes(codes) * powers(int(lengths.max()))[place], starts)
        _, one, which = np.unique(W.mix(hashes + lengths.astype(np.uint64) * W.MIX_B), return_index=True, return_inverse=True)
        twin = np.minimum(np.repeat(starts[one][which], lengths) + place, len(codes) - 1)
        alike = np.logical_and.reduceat(codes == codes[twin], starts) & (lengths == lengths[one][which])
        other = np.flatnonzero(~alike)
        which[other] = len(one) + np.arange(len(other))
        one = np.concatenate([one, other])
        flat, counts = self._segmented(codes, starts[one], lengths[one])
        ids = flat[ranges((np.cumsum(counts) - counts)[which], counts[which])]
        by_unit = np.concatenate([[0], np.cumsum(counts[which])])
        return ids, by_unit[np.searchsorted(starts, texts)]

    def decoded(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of the texts of a chunk, each after a space, and where each begins."""
        sizes = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat[ranges(self.starts[ids], sizes)].tobytes(), ends[offsets]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for chunk in chunks(pa.array(texts, pa.string())):
            ids, offsets = self.chunk(chunk)
            out += np.split(ids, offsets[1:-1])
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join([self.letters[i] for i in ids.tolist()]).decode("utf-8", "replace")[1:]


class Merges(Pieces):
    """The pieces of a model of merges: scores are the ranks of merges, not parts of a sum."""

    def _cut(self, score: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length, sizes, n = score.shape[0] - 1, score.shape[1], score.shape[2]
        ends, size = np.zeros((length + 1, n), bool), np.ones((length + 1, n), np.int32)
        if length > ROUNDS:
            for i in range(n):
                found = _merged(score[:, :, i], int(lengths[i]))
                at = np.flatnonzero(found)
                ends[at + found[at], i], size[at + found[at], i] = True, found[at]
            return ends, size

        def scores(of: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
            whole = right - left
            return np.where(whole <= sizes, score[right, np.minimum(whole, sizes) - 1, of], -np.inf)

        # Bounds of the symbols of each unit that still has merges, and scores of neighbours. A round takes one bound from each.
        unit = np.arange(n)
        bounds = np.tile(np.arange(length + 1), (n, 1))
        pairs = scores(unit[:, None], bounds[:, :-2], bounds[:, 2:])
        while len(unit):
            at = pairs.argmax(axis=1) if pairs.shape[1] else np.zeros(len(unit), np.int64)
            more = pairs[np.arange(len(unit)), at] > -np.inf if pairs.shape[1] else np.zeros(len(unit), bool)
            ready = np.flatnonzero(~more)
            last = bounds[ready, 1:]
            ends[last, unit[ready, None]], size[last, unit[ready, None]] = True, np.diff(bounds[ready])
            unit, bounds, pairs, at = unit[more], bounds[more], pairs[more], at[more]
            if not len(unit):
                break
            rows, kept = np.arange(len(unit)), np.ones(bounds.shape, bool)
            kept[rows, at + 1] = False
            bounds = bounds[kept].reshape(len(unit), -1)
            kept = np.ones(pairs.shape, bool)
            kept[rows, at] = False
            pairs = pairs[kept].reshape(len(unit), -1)
            for place in (at - 1, at):
                some = np.flatnonzero((place >= 0) & (place < pairs.shape[1]))
                k = place[some]
                pairs[some, k] = scores(unit[some], bounds[some, k], bounds[some, k + 2])
        ends &= np.arange(length + 1)[:, None] <= lengths
        return ends, size


def _merged(score: np.ndarray, length: int) -> np.ndarray:
    """For each letter of a unit the size of the symbol that begins there, 0 within a symbol."""
    sizes = score.shape[1]
    size, before = [1] * length, list(range(-1, length))
    first = np.flatnonzero(score[2 : length + 1, 1] > -np.inf)
    heap = [(-s, i, 2) for s, i in zip(score[first + 2, 1].tolist(), first.tolist(), strict=True)]
    heapq.heapify(heap)
    while heap:
        _, i, whole = heapq.heappop(heap)
        j = i + size[i]
        if not size[i] or j >= length or size[i] + size[j] != whole:
            continue
        size[i], size[j] = whole, 0
        before[i + whole] = i
        for left in (before[i], i):
            middle = left + size[left] if left >= 0 else length
            if middle < length and (both := size[left] + size[middle]) <= sizes and score[left + both, both - 1] > -np.inf:
                heapq.heappush(heap, (-float(score[left + both, both - 1]), left, both))
    return np.array(size, np.int32)


def chunks(texts: pa.Array) -> Iterator[W.Chunk]:
    """Chunks of whole texts, all of them UTF-8."""
    for chunk in W.chunks(texts, CHUNK):
        try:
            chunk.data.tobytes().decode()
            yield chunk
        except UnicodeDecodeError:
            cleaned = [chunk.text(i).encode() for i in range(chunk.n)]
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in cleaned])])
            yield W.Chunk(chunk.first, np.frombuffer(b"".join(cleaned), np.uint8), offsets)


@functools.cache
def pieces(path: str) -> Pieces:
    """The encoder of the model: by merges if it is one of merges."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    return (Merges if model.trainer_spec.model_type == MERGES else Pieces)(path)


def encoded(docs: DataFrame, path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """Every row as it is, with the number of its ids, their checksum, whether they decode to the text, and the ids."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    fields = [("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_())]
    kind = pa.struct(fields + [("ids", pa.list_(pa.int32()))] * keep_ids)

    @arrow_udf("struct<n_ids: bigint, ids_crc32: bigint, round_trip: boolean" + ", ids: array<int>" * keep_ids + ">")
    def encode(texts: pa.Array) -> pa.Array:
        model, parts = pieces(path), []
        for chunk in chunks(texts):
            ids, offsets = model.chunk(chunk)
            data, ends = model.decoded(ids, offsets)
            raw, whole = ids.astype("<u4").tobytes(), chunk.data.tobytes()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets, offsets[1:])]
            same = [data[a + 1 : b] == whole[c:d] for a, b, c, d in zip(ends, ends[1:], chunk.offsets, chunk.offsets[1:])]
            columns = [pa.array(np.diff(offsets)), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)))
            parts.append(pa.StructArray.from_arrays(columns, fields=list(kind)))
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return docs.withColumn("encoded", encode(F.col("text").cast("string")))
