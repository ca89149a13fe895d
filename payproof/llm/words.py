"""Words of many texts at once: boundaries and 64-bit hashes from the Arrow buffer, without a Python object per word.

Every function works on a chunk of whole texts of a few MB, so that memory is bounded by the chunk, or by the longest text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 21


def _give_back(least: int = 1 << 22) -> None:
    """Let arrays of so many bytes go back to the system when they are freed.

    Workers outlive their tasks. By default both the C library and Arrow keep what was freed, so each worker would hold the
    most that any of its tasks needed, while the next stage needs it elsewhere.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt is not None:  # the GNU C library: M_MMAP_THRESHOLD
        mallopt(-3, least)


_give_back()
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_SPACES = frozenset(b" \t\n\x0b\x0c\r")
#: Bytes of words `[^\x20\x09-\x0D]+`.
PLAIN = np.array([b not in _SPACES for b in range(256)])
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower case: digits, letters, all beyond ASCII.
LETTERS = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)

_random = np.random.default_rng(20250101)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POSITION = _random.integers(1, 2**63, 128, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Powers are products of one below this number and a multiple of it, so that no table grows with the texts.
_LOW = 1 << 11


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit depends on every other."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def _first_powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two factors of the powers up to n: that of i has i % _LOW in the first and i // _LOW in the second."""
    return _first_powers(base, _LOW), _first_powers(pow(base, _LOW, 1 << 64), n // _LOW + 1)


@dataclass
class Chunk:
    """Some whole texts: their rows, their bytes, where each begins and the last ends."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def text(self, row: int) -> str:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes().decode("utf-8", "replace")


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a column of texts into chunks of whole rows; a null text counts as an empty one."""
    if len(texts) == 0:
        return
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, len(texts))
        yield Chunk(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


@dataclass
class Words:
    """Words of a chunk: first byte, byte after the last, hash; by_text has the first word of each text and the count."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    by_text: np.ndarray
    prefix: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.by_text)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.by_text) - 1), self.counts)


def spans(chunk: Chunk, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes where inside is true; no run goes from one text into the next."""
    n = len(inside)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = chunk.offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    begins[edge] = inside[edge]
    stops[edge - 1] = inside[edge - 1]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix hashes: entry i covers the first i bytes."""
    n = len(data)
    out = np.zeros(n + 1, dtype=np.uint64)
    terms = out[1:]
    np.take(_BYTE, data, out=terms, mode="clip")
    low, high = _powers(_BASE, n)
    whole = n - n % _LOW
    blocks = terms[:whole].reshape(-1, _LOW)
    blocks *= low
    blocks *= high[:-1, None]
    terms[whole:] *= low[: n - whole] * high[-1]
    np.cumsum(terms, out=terms)
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte range, the same wherever the bytes stand."""
    low, high = _powers(_INVERSE, len(prefix))
    shift = low[starts % _LOW] * high[starts // _LOW]
    return mix((prefix[ends] - prefix[starts]) * shift + (ends - starts).astype(np.uint64) * MIX_A)


def words(chunk: Chunk, kind: np.ndarray = PLAIN, lower: bool = False) -> Words:
    data = LOWER[chunk.data] if lower else chunk.data
    starts, ends = spans(chunk, kind[data])
    prefix = prefix_hash(data)
    return Words(starts, ends, range_hash(prefix, starts, ends), np.searchsorted(starts, chunk.offsets), prefix)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of size hashes, by its first."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += hashes[k : k + n] * _POSITION[k % 128] if k < 128 else mix(hashes[k : k + n] + np.uint64(k))
    return mix(out)


def whole_windows(found: Words, size: int) -> np.ndarray:
    """True at each word that begins a run of size words of its own text."""
    left = np.repeat(found.by_text[1:], found.counts) - np.arange(len(found.starts))
    return left >= size


def keyed(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes told apart by owner."""
    return mix(values + mix(owner.astype(np.uint64) + MIX_B))


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """True at each of n words that lies in a window of size words which begins at one of starts."""
    change = np.zeros(n + 1, np.int64)
    change[starts] += 1
    change[starts + size] -= 1
    return np.cumsum(change[:-1]) > 0


def per_text(flags: np.ndarray, by_text: np.ndarray) -> np.ndarray:
    """How many flags are true in each text, given where each text begins."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[by_text[1:]] - total[by_text[:-1]]
