"""Fill-in-middle: a text is cut at two line boundaries into prefix, middle and suffix, and written in another order.

The boundaries of all texts of a chunk, as offsets by rank, are held in a learned index: segments of a line that miss no
offset by more than a bound, and the small remainders of all of them. A cut asks for the offset of a rank: its segment
predicts it, and the stored remainder makes it exact.

Lines are `[^\n]*\n|[^\n]+`. The draw of a document depends on its id and the seed alone. A text that is empty or holds a
marker stays as it is, and so do all others that the draw leaves out. A null text counts as empty, a null id is drawn as an
empty one. Rows are taken one by one, so repeated rows and ids each come back. Other columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from payproof.llm import words as W

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Documents of a hundred that are transformed, and of a hundred of these that begin with the suffix.
RATE, SPM_RATE, SEED = 100, 50, 7
#: Bytes by which a segment may miss an offset; the remainders are stored as 16-bit numbers.
ERROR = 1024
_NEWLINE = 10


@dataclass
class RankIndex:
    """Offsets by rank: the segment that begins at rank first predicts base + slope * (rank - first)."""

    first: np.ndarray
    base: np.ndarray
    slope: np.ndarray
    remainder: np.ndarray

    @classmethod
    def fit(cls, offsets: np.ndarray, error: int = ERROR) -> RankIndex:
        """The fewest segments, each begun where the one before cannot go on: all slopes that stay within the bound of
        every offset so far form an interval, which only shrinks; the segment ends where it is empty."""
        first, slope, i, n = [], [], 0, len(offsets)
        while i < n:
            low, high, j, width = -np.inf, np.inf, i + 1, 32
            while j < n:
                k = min(n, j + width)
                run, rise = np.arange(j - i, k - i), offsets[j:k] - offsets[i]
                lows = np.maximum(low, np.maximum.accumulate((rise - error) / run))
                highs = np.minimum(high, np.minimum.accumulate((rise + error) / run))
                fits = int(np.argmax(lows > highs)) if lows[-1] > highs[-1] else k - j
                if fits:
                    low, high = lows[fits - 1], highs[fits - 1]
                j += fits
                if fits < len(run):
                    break
                width *= 2
            first.append(i)
            slope.append((low + high) / 2 if j > i + 1 else 0.0)
            i = j
        first = np.array(first, np.int64)
        index = cls(first, offsets[first], np.array(slope), np.zeros(n, np.int16))
        index.remainder = (offsets - index.predicted(np.arange(n))).astype(np.int16)
        return index

    def predicted(self, ranks: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.first, ranks, side="right") - 1
        return self.base[at] + np.rint(self.slope[at] * (ranks - self.first[at])).astype(np.int64)

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        return self.predicted(ranks) + self.remainder[ranks]


def boundaries(chunk: W.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the beginning of every text and the end of each of its lines, text by text, and the lines of each."""
    ends = np.flatnonzero(chunk.data == _NEWLINE) + 1
    stops = chunk.offsets[1:][chunk.offsets[1:] > chunk.offsets[:-1]]
    ends = np.union1d(ends, stops)
    by_text = np.searchsorted(ends, chunk.offsets, side="right")
    lines = np.diff(by_text)
    out = np.empty(len(ends) + chunk.n, np.int64)
    out[by_text[:-1] + np.arange(chunk.n)] = chunk.offsets[:-1]
    out[np.arange(len(ends)) + np.repeat(np.arange(chunk.n), lines) + 1] = ends
    return out, lines


def arranged(prefix: bytes, middle: bytes, suffix: bytes, form: str) -> bytes:
    if form == PSM:
        return PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle


def restored(output: bytes, form: str) -> bytes:
    """The text that an output was made of. No part holds a marker, so the first of each is the one that was put in."""
    if form == PLAIN:
        return output
    head, _, middle = output.partition(MIDDLE)
    if form == PSM:
        prefix, _, suffix = head.removeprefix(PREFIX).partition(SUFFIX)
    else:
        suffix, _, prefix = head.removeprefix(SUFFIX).partition(PREFIX)
    return prefix + middle + suffix


_COLUMNS = {
    "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string(),
    "output_sha256": pa.string(), "restored_sha256": pa.string(),
}
_RESULT = (
    "struct<n: bigint, form: string, prefix_chars: bigint, middle_chars: bigint, output: string, "
    "output_sha256: string, restored_sha256: string>"
)


@functools.cache
def _transform_udf(rate: int, spm_rate: int, keep_output: bool):
    @arrow_udf(_RESULT)
    def transform(texts: pa.Array, draws: pa.Array) -> pa.Array:
        drawn = draws.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
        rows: list[tuple] = []
        for chunk in W.chunks(texts):
            rows += _chunk(chunk, drawn[chunk.first : chunk.first + chunk.n], rate, spm_rate, keep_output)
        columns = list(zip(*rows, strict=True)) or [()] * len(_COLUMNS)
        arrays = [pa.array(c, kind) for c, kind in zip(columns, _COLUMNS.values(), strict=True)]
        return pa.StructArray.from_arrays(arrays, names=list(_COLUMNS))

    return transform.asNondeterministic()


def _chunk(chunk: W.Chunk, draws: np.ndarray, rate: int, spm_rate: int, keep_output: bool) -> list[tuple]:
    offsets, lines = boundaries(chunk)
    index = RankIndex.fit(offsets)
    base = np.cumsum(lines + 1) - (lines + 1)
    cuts = np.sort(draws[:, :2] % (lines + 1)[:, None], axis=1)
    ends = index.offsets((base[:, None] + cuts).ravel()).reshape(-1, 2)
    chars = np.zeros(len(chunk.data) + 1, np.int64)
    np.cumsum((chunk.data & 0xC0) != 0x80, out=chars[1:])
    at = chars[np.column_stack([chunk.offsets[:-1], ends])]
    data, out = chunk.data.tobytes(), []
    for i in range(chunk.n):
        start, stop = chunk.offsets[i : i + 2].tolist()
        text = data[start:stop]
        if not text or draws[i, 2] % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
            form, output, counts = PLAIN, text, (None, None)
        else:
            form = SPM if draws[i, 3] % 100 < spm_rate else PSM
            a, b = ends[i].tolist()
            output = arranged(data[start:a], data[a:b], data[b:stop], form)
            counts = (int(at[i, 1] - at[i, 0]), int(at[i, 2] - at[i, 1]))
        again = hashlib.sha256(restored(output, form)).hexdigest()
        kept = output.decode("utf-8", "replace") if keep_output else None
        out.append((int(lines[i]), form, *counts, kept, hashlib.sha256(output).hexdigest(), again))
    return out


def transformed(
    docs: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED, keep_output: bool = True
) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output, its digest and that of the text rebuilt from it, for each row.

    The first four groups of eight digits of the sha256 of `seed:doc_id` draw both cuts, whether, and in which order.
    """
    doc_id = F.col("doc_id").cast("long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    draws = F.array(*(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)))
    given = docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"), draws.alias("draws"))
    cut = _transform_udf(rate, spm_rate, keep_output)("text", "draws")
    return given.select("doc_id", cut.alias("cut")).select("doc_id", "cut.*")
