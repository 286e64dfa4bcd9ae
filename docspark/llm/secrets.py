"""Operator 4: secret scan by dictionary-primed zstandard novelty.

Candidates are values in a sensitive context: assigned to a name such as
``password``, ``contraseña``, ``token`` or ``api_key`` (also by "is"), the
password of an address (``scheme://user:password@host``), of a known credential
shape, or assigned to any name and by their look no word or number but random
(20 characters or more of capitals, small letters and digits that change kind
more often than names in code do).  A value in quotes may hold spaces, and the
search goes on right after each name.  Every pattern is searched in linear time.
For each candidate the marginal compressed bytes are measured: what it adds to the text
around it, under a compressor primed with a dictionary of the identifiers that
are frequent around all candidates of the corpus.  A value
that repeats its surroundings or is made of known identifiers adds few bytes; a
random one adds about its own information.  Values with at least
``min_novelty`` marginal bytes a character (and ``min_bytes`` in all) are
reported.  zstandard stores under 64 literals as they are, but codes more of
them by their frequency, down to half a byte a hex digit: of longer values the
share ``min_novelty`` of what their own alphabet holds is enough.

The dictionary is counted by grouped aggregation over every candidate's
surroundings in all documents, with the candidates themselves blanked; its size
is ``dictionary_bytes``.

Null and empty texts have no candidates.  Rows with a null key, repeated rows
and repeated keys are scanned row by row; each row reports its own spans.
Positions count code points of the text.  Texts are scanned whole.  Extra
columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

_NAME = r"pass(?:word|wd|phrase)?|passwort|kennwort|contrase(?:ñ|n)a|clave|mot[ _-]?de[ _-]?passe|senha|parola|пароль|密码|pwd|secret(?:[_-]?key)?|token|api[_-]?key|access[_-]?key|auth(?:orization)?|credentials?|private[_-]?key|bearer"
_SHAPES = {
    "aws_key": r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    "github": r"gh[pousr]_[A-Za-z0-9]{20,}",
    "slack": r"xox[baprs]-[A-Za-z0-9-]{10,}",
    "stripe": r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}",
    "google": r"AIza[0-9A-Za-z_-]{35}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+",
}
#: RE2 syntax; a text without a match has no candidate.
PREFILTER = rf"(?i:{_NAME})|" + "|".join(_SHAPES.values()) + r"|PRIVATE KEY-----|://[^\s/:@]*:[^\s/@]{6}|[=:][\"' ]{0,3}[A-Za-z0-9+/_-]{20}"
_ASSIGNED = re.compile(rf"(?i:({_NAME}))[\"']?(?:\s*(?:=>|:=|==|=|:)\s*|\s+(?:(?i:is|was|ist|lautet|est|es)\s+)?)(?:(?i:bearer|basic)\s+)?(?:\"([^\"\r\n]{{8,}})\"|'([^'\r\n]{{8,}})'|(?!(?i:{_NAME})[\"']?\s*[=:])([A-Za-z0-9+/_.~$!@#%^&*-]{{8,}}+={{0,2}}+)(?![\\[(]))")
_LABEL = re.compile(rf"(?i:{_NAME})(?:=|[\"']?\s*[=:])")
_SHAPED = re.compile(r"(?<![A-Za-z0-9])(?:" + "|".join(f"(?P<{k}>{v})" for k, v in _SHAPES.items()) + r")(?![A-Za-z0-9])")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z]+ ){0,4})PRIVATE KEY-----")
_PEM_BODY = re.compile(r"[A-Za-z0-9+/=\s]+")
_ADDRESS = re.compile(r"://[^\s/:@]*+:([^\s/@]{6,}+)@")
_RANDOM = re.compile(r"[=:][\"' ]{0,3}([A-Za-z0-9+/_-]{20,}+={0,2})")
_KINDS = np.zeros(128, np.int8)
_KINDS[48:58], _KINDS[65:91], _KINDS[97:123] = 1, 2, 3
_IDENTIFIER = re.compile(r"\w{3,40}")
#: Literals from which zstandard codes them by their frequency, and bytes that a block of them or of matches has besides.
RAW_LITERALS, OVERHEAD = 64, 16


def _private_keys(text: str):
    """(start, end) from each header to its footer, or over the key material if there is none."""
    at, endless = 0, set()
    while m := _PEM.search(text, at):
        footer = f"-----END {m.group(1)}PRIVATE KEY-----"
        end = -1 if footer in endless else text.find(footer, m.end())
        if end >= 0:
            yield m.start(), end + len(footer)
            at = end + len(footer)
        else:
            endless.add(footer)
            body = _PEM_BODY.match(text, m.end())
            if body:
                yield m.start(), body.end()
            at = body.end() if body else m.end()


def looks_random(value: str) -> bool:
    """Digits, capitals and small letters, two or more of each, that change kind in over a third of the places."""
    kinds = _KINDS[np.frombuffer(value.encode("ascii"), np.uint8)]
    return bool((np.bincount(kinds, minlength=4)[1:] >= 2).all()) and 3 * int((kinds[1:] != kinds[:-1]).sum()) > len(value)


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the candidates, in order; of those that overlap the first, and the longest, comes first."""
    found = [(s, e, "private_key") for s, e in _private_keys(text)]
    found += [(m.start(1), m.end(1), "address") for m in _ADDRESS.finditer(text)]
    found += [(m.start(), m.end(), m.lastgroup) for m in _SHAPED.finditer(text)]
    at = 0
    while m := _ASSIGNED.search(text, at):
        at = m.end(1)  # a value may hold, or be, the name of the next one
        g = next(g for g in (2, 3, 4) if m.group(g) is not None)
        # Without an assignment mark the value must mix digits and letters, else prose after "token" is a candidate.
        marked = re.search(r"[=:]", text[m.end(1) : m.start(g)])
        value = m.group(g)
        if marked or (re.search(r"\d", value) and re.search(r"[A-Za-z]", value) and not (g == 4 and any(x.end() >= m.end(4) for x in _LABEL.finditer(text, m.start(4), m.end(4) + 3)))):
            found.append((m.start(g), m.end(g), m.group(1).lower()))
    found += [(m.start(1), m.end(1), "assigned") for m in _RANDOM.finditer(text) if looks_random(m.group(1))]
    out: list[tuple[int, int, str]] = []
    for x in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or x[:2] != out[-1][:2]:
            out.append(x)
    return out


def surroundings(text: str, spans: list[tuple[int, int, str]], start: int, end: int, window: int) -> tuple[str, str]:
    """The text before and after a span, with other candidates blanked."""
    lo, hi = max(0, start - window), min(len(text), end + window)
    parts, at = [], lo
    for s, e, _ in spans:
        if e <= lo or s >= hi or (s, e) == (start, end):
            continue
        parts.append((max(s, lo), min(e, hi)))
    before, after = [], []
    for side, a, b in ((before, lo, start), (after, end, hi)):
        at = a
        for s, e in parts:
            if s < b and e > a:
                side.append(text[at:s])
                at = max(at, e)
        side.append(text[at:b])
    return "".join(before), "".join(after)


class Novelty:
    """Marginal compressed bytes under a compressor primed with a dictionary."""

    def __init__(self, dictionary: bytes):
        primed = {}
        if len(dictionary) >= 8:
            primed["dict_data"] = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=9, write_checksum=False, write_content_size=False, **primed)

    def marginal(self, before: str, value: str, after: str) -> int:
        """Bytes of the value's own block, which may refer to its surroundings and the dictionary but not share their entropy tables."""
        stream = self.compressor.compressobj()
        stream.compress((before + after).encode("utf8", "replace"))
        stream.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK)
        out = stream.compress(value.encode("utf8", "replace")) + stream.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK)
        return max(0, len(out) - 3)  # without the block's header


def _suspects(batch: pa.RecordBatch, column: int):
    texts = batch.column(column)
    flags = pc.fill_null(pc.match_substring_regex(texts, PREFILTER), False)
    for i in np.flatnonzero(flags.to_numpy(zero_copy_only=False)).tolist():
        text = texts[i].as_py()
        spans = candidates(text)
        if spans:
            yield i, text, spans


def identifier_dictionary(docs: DataFrame, text: str, window: int, size: int) -> bytes:
    """The most frequent identifiers around candidates, the most frequent last (zstandard finds late content cheapest)."""

    def run(batch):
        counts: dict[str, int] = {}
        for _, body, spans in _suspects(batch, 0):
            for s, e, _ in spans:
                for part in surroundings(body, spans, s, e, window):
                    for w in _IDENTIFIER.findall(part):
                        counts[w] = counts.get(w, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    counts = arrow_map(docs.select(text), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    top = counts.orderBy(F.desc("n"), "word").limit(size // 4).collect()  # a word and its space have four bytes or more
    out: list[bytes] = []
    left = size
    for row in top:
        word = row.word.encode() + b" "
        if len(word) > left:
            break
        out.append(word)
        left -= len(word)
    return b"".join(reversed(out))


def least_novel(value: str, min_novelty: float) -> float:
    """Marginal bytes from which a value is novel."""
    n = len(value)
    if n < RAW_LITERALS:
        return min_novelty * n
    information = n * min(1.0, math.log2(len(set(value))) / 8)
    return min_novelty * min(n, OVERHEAD + information)


def judge(text: str, spans, novelty: Novelty, window: int, min_novelty: float, min_bytes: int):
    """(start, end, kind, marginal, novelty) of the candidates that are novel, without overlaps."""
    last = 0
    for s, e, kind in spans:
        if s < last:
            continue
        before, after = surroundings(text, spans, s, e, window)
        n = novelty.marginal(before, text[s:e], after)
        if n >= min_bytes and n >= least_novel(text[s:e], min_novelty):
            yield s, e, kind, n, n / (e - s)
            last = e


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = 256, min_novelty: float = 0.6, min_bytes: int = 6, dictionary_bytes: int = 32_768) -> DataFrame:
    """(doc_id, start, end, kind, secret, marginal_bytes, novelty), one row per secret."""
    dictionary = identifier_dictionary(docs, text, window, dictionary_bytes)

    def run(batch):
        novelty, rows = Novelty(dictionary), []
        for i, body, spans in _suspects(batch, 1):
            rows += [(i, s, e, kind, body[s:e], n, x) for s, e, kind, n, x in judge(body, spans, novelty, window, min_novelty, min_bytes)]
        cols = list(zip(*rows)) if rows else [()] * 7
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.int64()), pa.array(cols[6], pa.float64())],
            names=["doc_id", "start", "end", "kind", "secret", "marginal_bytes", "novelty"],
        )

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return arrow_map(rows, run, f"doc_id {rows.schema[0].dataType.simpleString()}, start long, `end` long, kind string, secret string, marginal_bytes long, novelty double")


def redact(docs: DataFrame, *, text: str = "text", mask: str = "[SECRET]", window: int = 256, min_novelty: float = 0.6, min_bytes: int = 6, dictionary_bytes: int = 32_768) -> DataFrame:
    """All rows and columns of ``docs``, with the secrets of the text column replaced by ``mask``."""
    dictionary = identifier_dictionary(docs, text, window, dictionary_bytes)
    column = docs.columns.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batch):
        novelty, new = Novelty(dictionary), {}
        for i, body, spans in _suspects(batch, column):
            parts, at = [], 0
            for s, e, *_ in judge(body, spans, novelty, window, min_novelty, min_bytes):
                parts += [body[at:s], mask]
                at = e
            if at:
                new[i] = "".join([*parts, body[at:]])
        if new:
            flags = np.zeros(batch.num_rows, bool)
            flags[list(new)] = True
            changed = pc.replace_with_mask(batch.column(column), pa.array(flags), pa.array([new[i] for i in sorted(new)], batch.column(column).type))
            batch = batch.set_column(column, batch.schema.field(column), changed)
        yield batch

    return arrow_map(docs, run, schema)
