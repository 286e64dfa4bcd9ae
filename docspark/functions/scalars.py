"""Scalar functions as Column builders: no Python runs per row."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def interval_ms(text: str | int) -> int:
    """'5m', '250ms', '1h' or plain milliseconds."""
    if isinstance(text, (int, float)):
        return int(text)
    m = re.fullmatch(r"\s*(\d+)\s*(ms|s|m|h|d)?\s*", text)
    if not m:
        raise ValueError(f"not an interval: {text!r}")
    return int(m[1]) * _UNITS[m[2] or "ms"]


def soundex(c: Column | str) -> Column:
    """Phonetic code in which every vowel, H and W separates equal codes (unlike Spark's built-in); '' for no letters."""
    letters = F.regexp_replace(F.upper(col(c)), "[^A-Z]", "")
    codes = F.translate(letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "01230120022455012623010202")
    # A digit counts if it differs from the one before it: mark repeats by comparing with the shifted string.
    digits = F.transform(F.sequence(F.lit(2), F.greatest(F.length(codes), F.lit(2))), lambda i: F.when((F.substring(codes, i, 1) != "0") & (F.substring(codes, i, 1) != F.substring(codes, i - 1, 1)), F.substring(codes, i, 1)).otherwise(""))
    tail = F.rpad(F.substring(F.array_join(digits, ""), 1, 3), 3, "0")
    return F.when(F.length(letters) == 0, "").otherwise(F.concat(F.substring(letters, 1, 1), tail))


def _soundex_of(text: str) -> str:
    letters = re.sub("[^A-Z]", "", text.upper())
    if not letters:
        return ""
    codes = letters.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "01230120022455012623010202"))
    tail = "".join(c for p, c in zip(codes, codes[1:]) if c != "0" and c != p)
    return letters[0] + tail[:3].ljust(3, "0")


def sounds_like(c: Column, wanted: str) -> Column:
    code = _soundex_of(wanted)
    return (soundex(c) == code) | F.exists(F.split(c, r"\s+"), lambda t: soundex(t) == code)


def fuzzy(c: Column, wanted: str, most: int = 1) -> Column:
    """Within ``most`` edits as a whole, containing, or with a token within ``most`` edits; case doesn't matter."""
    text, wanted = F.lower(c), wanted.lower()
    near = lambda x: F.levenshtein(x, F.lit(wanted)) <= most
    return near(text) | text.contains(wanted) | F.exists(F.split(text, r"\s+"), near)


def fnv1a(c: Column | str) -> Column:
    """32-bit FNV-1a over code points, unsigned."""
    return F.aggregate(F.split(col(c), ""), F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(F.ascii(x).cast("long")) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")))


def digits_to_ascii(c: Column | str) -> Column:
    """Arabic-Indic, Persian and Devanagari digits as 0-9."""
    other = "".join(chr(base + d) for base in (0x660, 0x6F0, 0x966) for d in range(10))
    return F.translate(col(c), other, "0123456789" * 3)


def tokens_ascii(c: Column | str) -> Column:
    """Lower-cased runs of ASCII word characters of two or more."""
    return F.filter(F.split(F.regexp_replace(F.lower(col(c)), r"[^\w\s]", " "), r"\s+"), lambda t: F.length(t) > 1)


#: The stop words of the Unicode tokeniser.
STOP_WORDS = tuple(sorted(set("a an at in is of on or to and are for the with about".split() + "معلومات إلى الى حتى على أن أو إن ان او ثم عن في قد لا لم لن ما مع من هل هو هي".split())))


def tokens_unicode(c: Column | str) -> Column:
    """Lower-cased runs of letters and digits of any script, without stop words."""
    words = F.split(F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}\s]", " "), r"\s+")
    return F.filter(words, lambda t: (F.length(t) > 0) & ~t.isin(*STOP_WORDS))


def chunks(c: Column | str, size: int = 512, overlap: int = 64) -> Column:
    """Overlapping pieces of a text; blank ones are left out."""
    text, step = col(c), size - overlap
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(starts, lambda i: F.trim(F.substring(text, i, F.lit(size)))), lambda x: F.length(x) > 0)


def estimate_tokens(c: Column | str) -> Column:
    """Token estimate from counts of character classes; 0 for null and empty texts."""
    text = col(c)
    rest = text
    total = F.lit(0.0)
    for pattern, weight in (
        (r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}\x{0e00}-\x{0e7f}]", 80),
        (r"[\x{0250}-\x{1fff}]", 52),
        (r"[\x{00}-\x{2f}\x{3a}-\x{40}]", 35),
        (r"[\x{00}-\x{024f}]", 25),
    ):
        left = F.regexp_replace(rest, pattern, "")
        total = total + (F.length(rest) - F.length(left)) * weight
        rest = left
    total = total + F.length(rest) * 75
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(total / 100))).cast("int")


def word_jaccard(a: Column | str, b: Column | str) -> Column:
    """Jaccard resemblance of word sets; 1 for equal texts, 0 if both have no words."""
    a, b = col(a), col(b)
    words = lambda c: F.filter(F.array_distinct(F.split(F.lower(c), r"\s+")), lambda t: F.length(t) > 0)
    union = F.size(F.array_union(words(a), words(b)))
    return F.when(a == b, 1.0).when(union == 0, 0.0).otherwise(F.size(F.array_intersect(words(a), words(b))) / union)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 for different lengths or a zero vector."""
    a, b = col(a), col(b)
    parts = F.struct(dot(a, b).alias("dot"), (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))).alias("norm"))
    once = F.transform(F.array(parts), lambda x: F.when(x["norm"] == 0, 0.0).otherwise(x["dot"] / x["norm"]))  # binds the parts, which are used twice
    return F.when(F.size(a) != F.size(b), 0.0).otherwise(F.get(once, F.lit(0)))


def euclidean(a: Column | str, b: Column | str) -> Column:
    gap = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6_371_000.0) -> Column:
    """Great-circle distance in the unit of ``radius``."""
    lat1, lon1, lat2, lon2 = (F.radians(c) for c in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return 2 * radius * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def in_polygon(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Even-odd ray casting against a fixed polygon; points on its edges are outside."""
    crossings, on = F.lit(0), F.lit(False)
    for ends in zip(polygon, polygon[-1:] + polygon[:-1]):
        (xi, yi), (xj, yj) = sorted(((float(a), float(b)) for a, b in ends), key=lambda p: p[1])
        across, along = (x - xi) * (yj - yi), (y - yi) * (xj - xi)  # a quotient would round points off the edge
        crossings += F.when((y >= yi) & (y < yj) & (across < along), 1).otherwise(0)
        on |= (across == along) & x.between(min(xi, xj), max(xi, xj)) & y.between(yi, yj)
    return F.coalesce((crossings % 2 == 1) & ~on, F.lit(False))


def round_product(c: Column | str, digits: int) -> Column:
    """Rounds c * 10^digits to the nearest integer as DuckDB does; Spark's round takes the shortest decimal text, which halves may differ by."""
    return F.round(col(c) * 10.0**digits) / 10.0**digits


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two arrays of words."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def string_rank(c: Column | str) -> Column:
    """The first six characters as a number in base 256."""
    text = F.substring(col(c), 1, 6)
    return F.aggregate(F.sequence(F.lit(1), F.lit(6)), F.lit(0).cast("long"), lambda s, i: s * 256 + F.when(i <= F.length(text), F.ascii(F.substring(text, i, 1)) % 256).otherwise(0))


def recency(age_hours: Column, half: float = 168.0) -> Column:
    return F.exp(-age_hours / half)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a text, as hex, from two SHA-256 calls."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in block) for pad in (0x36, 0x5C))
    first = F.sha2(F.concat(F.lit(inner), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)
