"""Vectorised text primitives shared by the corpus operators.

Everything here works on whole Arrow string arrays at once: a batch of texts is
one byte buffer plus offsets, and words, hashes and shingles are numpy arrays
over that buffer.  No Python loop runs per word or per character.

A *word* is a maximal run of lower-cased ASCII letters, digits and non-ASCII
bytes.  A null text behaves as an empty one and has no words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))

WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
WORD_BYTE[128:] = True

_powers: dict[str, np.ndarray] = {"p": np.ones(1, U64), "q": np.ones(1, U64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["p"]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for key, base in (("p", _BASE), ("q", _BASE_INV)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["p"], _powers["q"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def byte_view(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and the n + 1 offsets of the texts in it."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def byte_batches(texts: pa.Array, most: int = 1 << 20):
    """Slices (first, last) of the array of about ``most`` bytes and at most 2**19 texts each; one long text is one slice."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        base = ends[first - 1] if first else 0
        last = min(max(first + 1, int(np.searchsorted(ends, base + most, "right"))), first + (1 << 19))
        yield first, last
        first = last


def words(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD_BYTE):
    """Starts and ends (byte positions) of all words, and the index of the text each is in."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = table[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(len(raw), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal spans have equal hashes wherever they are."""
    p, q = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * p[: len(raw)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * q[starts])


def word_hashes(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD_BYTE):
    starts, ends, doc = words(raw, offsets, table)
    return span_hashes(raw, starts, ends), doc, starts, ends


def shingles(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, and the index of each one's first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    out = np.zeros(n, U64)
    for j in range(k):
        out = out * _BASE + hashes[j : j + n]
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return mix64(out[at]), at


def sums_by(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Sum of the values of each text (values in text order), zero where there are none."""
    ends = np.searchsorted(doc, np.arange(n), "right")
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[ends] - total[np.concatenate([[0], ends[:-1]])] if n else np.zeros(0)
