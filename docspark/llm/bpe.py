"""Operator 3: byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

A text is split by the vocabulary's pattern; each piece starts as its bytes.
The leaves of a piece's segment tree are the adjacent pairs, keyed by (rank of
the merge, position), so the root is the leftmost pair of the lowest rank.  A
merge updates three leaves and their ancestors: logarithmic work.  It goes on
until the root holds no mergeable pair.

Pieces of like length are encoded together: one numpy array holds all their
trees and one step merges the root pair of every unfinished piece.  Pieces
longer than ``LONG`` bytes use one tree each.  Pieces that were encoded before
are taken from a table that each worker keeps (bounded, then emptied).

Null and empty texts have no tokens; decoding them gives the empty text.
Repeated rows are encoded alike, rows with a null key are kept, texts are
encoded whole, and extra columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map
from .textkernel import byte_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG = 128
KEPT = 300_000
_NONE = np.int64(1) << 62


class Vocabulary:
    """Token bytes by id, and the merges as sorted (left id, right id) keys with the merged id, which is its rank."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.size = max(ranks.values()) + 1
        tokens = [b""] * self.size
        for token, i in ranks.items():
            tokens[i] = token
        self.pattern = pattern
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        keys, merged = [], []
        for token, i in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    merged.append(i)
        order = np.argsort(keys)
        self.keys, self.merged = np.array(keys, np.int64)[order], np.array(merged, np.int64)[order]
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each merge, ``_NONE`` where there is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], _NONE)


def encode_pieces(vocabulary: Vocabulary, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of all pieces in some order, and where each piece's ids start and how many they are."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    starts, counts = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
    parts: list[np.ndarray] = []
    base = 0

    def put(at: np.ndarray, flat: np.ndarray, n: np.ndarray) -> None:
        nonlocal base
        starts[at], counts[at] = base + np.cumsum(n) - n, n
        parts.append(flat)
        base += len(flat)

    single = np.flatnonzero(sizes == 1)
    put(single, vocabulary.bytes[np.frombuffer(b"".join([pieces[i] for i in single.tolist()]), np.uint8)].astype(np.int32), np.ones(len(single), np.int64))
    for i in np.flatnonzero(sizes > LONG).tolist():
        ids = _encode_long(vocabulary, pieces[i])
        put(np.array([i]), ids, np.array([len(ids)]))
    width = 2
    while width <= LONG:
        at = np.flatnonzero((sizes > width // 2) & (sizes <= width) & (sizes > 1))
        step = max(64, (1 << 19) // width)
        for a in range(0, len(at), step):
            own = at[a : a + step]
            put(own, *_encode_group(vocabulary, [pieces[i] for i in own.tolist()], sizes[own], width))
        width *= 2
    return np.concatenate(parts), starts, counts


def _encode_group(v: Vocabulary, pieces: list[bytes], lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All trees of pieces of at most ``width`` (a power of two) bytes, stepped together: ids and their number by piece."""
    n = len(pieces)
    padded = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
    token = v.bytes[padded]
    place = np.arange(width)
    after = np.where(place + 1 < lengths[:, None], place + 1, width)  # next living position; width: none
    before = np.broadcast_to(place - 1, (n, width)).copy()
    alive = place < lengths[:, None]
    tree = np.full((n, 2 * width), _NONE, np.int64)
    some = after < width
    row, col = np.nonzero(some)
    r = v.ranks(token[row, col], token[row, col + 1])
    tree[row, width + col] = np.where(r < _NONE, r * width + col, _NONE)
    level = width
    while level > 1:
        level //= 2
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])

    rows = np.flatnonzero(tree[:, 1] < _NONE)
    while len(rows):
        root = tree[rows, 1]
        left = root % width
        gone = after[rows, left]
        token[rows, left] = root // width
        right = after[rows, gone]
        after[rows, left] = right
        alive[rows, gone] = False
        has = right < width
        before[rows[has], right[has]] = left[has]
        # The pair that starts at the merged token, the one that ends at it, and the one that is gone.
        new = np.full(len(rows), _NONE)
        r = v.ranks(token[rows[has], left[has]], token[rows[has], right[has]])
        new[has] = np.where(r < _NONE, r * width + left[has], _NONE)
        tree[rows, width + left] = new
        tree[rows, width + gone] = _NONE
        prev = before[rows, left]
        behind = prev >= 0
        own, p = rows[behind], prev[behind]
        r = v.ranks(token[own, p], token[own, left[behind]])
        tree[own, width + p] = np.where(r < _NONE, r * width + p, _NONE)
        a, b, c = (width + left) >> 1, (width + gone) >> 1, (width + np.maximum(prev, 0)) >> 1
        while a[0] >= 1:
            for node in (a, b, c):
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            a, b, c = a >> 1, b >> 1, c >> 1
        rows = rows[tree[rows, 1] < _NONE]
    return token[alive].astype(np.int32), alive.sum(axis=1)


def _encode_long(v: Vocabulary, piece: bytes) -> np.ndarray:
    """One tree in lists: each merge costs a few list operations a level."""
    n = len(piece)
    width = 1 << (n - 1).bit_length()
    first = v.bytes[np.frombuffer(piece, np.uint8)]
    r = v.ranks(first[:-1], first[1:])
    none = int(_NONE)
    leaves = np.full(width, _NONE)
    leaves[: n - 1] = np.where(r < _NONE, r * width + np.arange(n - 1), _NONE)
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
    tree = [none, *np.concatenate(levels[::-1]).tolist()]
    token, after, before = first.tolist(), [*range(1, n), -1], [*range(-1, n - 1)]
    known = dict(zip(v.keys.tolist(), v.merged.tolist())) if not hasattr(v, "known") else v.known
    v.known = known

    def put(at: int, value: int) -> None:
        node = width + at
        tree[node] = value
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            low = a if a < b else b
            if tree[node] == low:
                return
            tree[node] = low
            node >>= 1

    while tree[1] < none:
        rank, at = divmod(tree[1], width)
        gone = after[at]
        right = after[gone]
        token[at], after[at], token[gone] = rank, right, -1
        put(gone, none)
        if right >= 0:
            before[right] = at
            m = known.get(rank * v.size + token[right])
            put(at, none if m is None else m * width + at)
        else:
            put(at, none)
        if before[at] >= 0:
            p = before[at]
            m = known.get(token[p] * v.size + rank)
            put(p, none if m is None else m * width + p)
    return np.array([t for t in token if t >= 0], np.int32)


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + lengths[i]] for all i, one after another."""
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Encodes arrays of texts; keeps the ids of pieces it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.find = regex.compile(vocabulary.pattern).findall
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of each text's ids."""
        if len(self.index) > KEPT:
            self._clear()
        pieces: list[str] = []
        ends = []
        for t in texts:
            pieces += self.find(t)
            ends.append(len(pieces))
        index = self.index
        new = [p for p in dict.fromkeys(pieces) if p not in index]
        if new:
            flat, start, size = encode_pieces(self.v, [p.encode("utf8") for p in new])
            index.update(zip(new, range(len(index), len(index) + len(new))))
            self.starts, self.lengths = np.r_[self.starts, len(self.flat) + start], np.r_[self.lengths, size]
            self.flat = np.concatenate([self.flat, flat])
        at = np.fromiter(map(index.__getitem__, pieces), np.int64, len(pieces))
        size = self.lengths[at]
        total = np.r_[0, np.cumsum(size)]
        counts = np.diff(total[np.r_[0, np.array(ends, np.int64)]])
        return _gather(self.flat, self.starts[at], size), counts


def decode_ids(v: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The text of each run of ids."""
    data = _gather(v.flat, v.starts[ids], v.lengths[ids])
    sums = np.r_[0, np.cumsum(v.lengths[ids])]
    offsets = sums[np.r_[0, np.cumsum(counts)]].astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def encode(docs: DataFrame, *, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens, n_tokens, round_trip): round_trip tells whether the decoded tokens are the text."""
    v = Vocabulary(vocabulary)
    held: dict[str, Encoder] = {}

    def run(batch):
        encoder = held.setdefault("one", Encoder(v)) if "one" not in held else held["one"]
        for a, b in byte_batches(batch.column(1), 1 << 20):
            texts = [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]
            ids, counts = encoder.encode(texts)
            back = decode_ids(v, ids, counts)
            same = back.cast(pa.large_string()).equals(pa.array(texts, pa.large_string())) or None
            ok = pa.array([True] * len(texts)) if same else pa.array([x == t.encode("utf8") for x, t in zip(back.to_pylist(), texts)])
            tokens = pa.ListArray.from_arrays(np.r_[0, np.cumsum(counts)].astype(np.int32), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), tokens, pa.array(counts), ok], names=["doc_id", "tokens", "n_tokens", "round_trip"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return arrow_map(rows, run, f"doc_id {rows.schema[0].dataType.simpleString()}, tokens array<int>, n_tokens long, round_trip boolean", held.clear)


def decode(rows: DataFrame, *, key: str = "doc_id", tokens: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from token ids; null tokens give the empty text."""
    v = Vocabulary(vocabulary)

    def run(batch):
        lists = batch.column(1)
        counts = np.nan_to_num(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
        back = decode_ids(v, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.decode("utf8", "replace") for x in back.to_pylist()], pa.string())], names=["doc_id", "text"])

    rows = rows.select(F.col(key).alias("doc_id"), F.col(tokens).alias("tokens"))
    return arrow_map(rows, run, f"doc_id {rows.schema[0].dataType.simpleString()}, text string")
