"""Privacy operators as column expressions: tokens, masks, redaction, encryption, private aggregates."""

from __future__ import annotations

import decimal
import hashlib
import hmac

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import col, hmac_sha256

#: The largest prime below 2**64.
MODULUS = (1 << 64) - 59

PII = (
    ("email", r"[\w%+.-]+@(?:[A-Za-z\d-]+\.)+[A-Za-z]{2,}"),
    ("phone", r"\+?\d[-\s\d]{8,}\d"),
    ("ssn", r"\b\d\d\d-\d\d-\d{4}\b"),
    ("api_key", r"\b(?:Bearer\s+[\w.-]+|sk-[A-Za-z\d]{20,})"),
    ("credit_card", r"\b\d{4}(?:[ -]?\d{4}){3}\b"),
)


_MAY_HOLD = {
    "email": lambda c: c.contains("@"),
    "phone": lambda c: c.rlike(r"\d[-\s\d]{8}"),
    "ssn": lambda c: c.rlike(r"\d-\d\d-\d"),
    "api_key": lambda c: c.contains("sk-") | c.contains("Bearer"),
    "credit_card": lambda c: c.rlike(r"\d{4}[ -]?\d{4}"),
}


def exact_token(field: str, c: Column | str, key: bytes) -> Column:
    """Equality token of a value: case and outer space don't matter."""
    return hmac_sha256(key, F.concat(F.lit(f"exact:{field}:"), F.lower(F.trim(col(c).cast("string")))))


def exact_token_of(field: str, value: str, key: bytes) -> str:
    return hmac.new(key, f"exact:{field}:{value.strip().lower()}".encode(), hashlib.sha256).hexdigest()


def ngram_tokens(field: str, c: Column | str, key: bytes, n: int = 3, padding: bool = True) -> Column:
    """Tokens of the n-grams; a shorter value has its exact token.  Padding adds dummies up to the next multiple of four."""
    text = F.lower(col(c))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    tokens = F.when(F.length(text) < n, F.array(exact_token(field, text, key))).otherwise(F.transform(F.array_distinct(grams), lambda g: hmac_sha256(key, F.concat(F.lit(f"ngram:{field}:"), g))))
    if padding:
        size = F.size(tokens)
        dummies = F.transform(F.sequence(F.lit(0), 3 - size % 4), lambda p: hmac_sha256(key, F.concat(F.lit(f"honey:{field}:"), (size + p).cast("string"), F.lit(":"), p.cast("string"))))
        tokens = F.concat(tokens, dummies)
    return tokens


def range_token(field: str, c: Column | str, key: bytes, width: int = 10) -> Column:
    """Token of the value's bucket."""
    return hmac_sha256(key, F.concat(F.lit(f"range:{field}:"), F.floor(col(c) / width).cast("long").cast("string")))


def range_tokens_of(field: str, low: float, high: float, key: bytes, width: int = 10) -> list[str]:
    return [hmac.new(key, f"range:{field}:{b}".encode(), hashlib.sha256).hexdigest() for b in range(int(low // width), int(high // width) + 1)]


def _mask(record: Column, field: str, key: bytes) -> Column:
    """The record's pseudo-random summand: the first 8 bytes of an HMAC, below the modulus."""
    h = F.substring(hmac_sha256(key, F.concat(F.lit("homo:"), record.cast("string"), F.lit(f":{field}:1"))), 1, 16)
    return F.conv(h, 16, 10).cast("decimal(38,0)") % F.lit(decimal.Decimal(MODULUS)).cast("decimal(38,0)")


def encrypt_additive(c: Column | str, record: Column | str, field: str, key: bytes) -> Column:
    """A number, in hundredths, hidden by its record's mask."""
    cents = F.round(col(c).cast("double") * 100).cast("decimal(38,0)")
    return ((cents + _mask(col(record), field, key)) % F.lit(decimal.Decimal(MODULUS)).cast("decimal(38,0)")).cast("decimal(38,0)")


def additive_sum(c: Column | str) -> Column:
    """Sum of hidden numbers, modulo the modulus."""
    return F.sum(col(c)).cast("decimal(38,0)") % F.lit(decimal.Decimal(MODULUS)).cast("decimal(38,0)")


def decrypt_sum(total: Column, records: Column | str, field: str, key: bytes) -> Column:
    """An aggregate: the plain sum from the hidden one (given as an aggregate) and the masks of its records."""
    p = F.lit(decimal.Decimal(MODULUS)).cast("decimal(38,0)")
    masks = F.sum(_mask(col(records), field, key)).cast("decimal(38,0)") % p
    plain = (total - masks + p) % p
    return F.when(plain > p / 2, plain - p).otherwise(plain).cast("double") / 100


def homomorphic_sum(df: DataFrame, value: str, record: str, field: str, key: bytes) -> DataFrame:
    hidden = df.where(F.col(value).isNotNull()).withColumn("_c", encrypt_additive(value, record, field, key))
    return hidden.agg(decrypt_sum(additive_sum("_c"), record, field, key).alias("sum"))


def laplace(scale: Column | float, seed: int) -> Column:
    u = F.rand(seed) - 0.5
    return -F.lit(scale) * F.signum(u) * F.log(1 - 2 * F.abs(u))


def private_aggregates(df: DataFrame, value: str, *, epsilon: float, low: float, high: float, seed: int = 0) -> DataFrame:
    """Differentially private count, sum and mean of values clipped to [low, high]."""
    clipped = F.least(F.greatest(F.col(value), F.lit(float(low))), F.lit(float(high)))
    out = df.agg(F.count(value).alias("n"), F.coalesce(F.sum(clipped), F.lit(0.0)).alias("s"))
    out = out.select((F.col("n") + laplace(1 / epsilon, seed)).alias("count"), (F.col("s") + laplace(max(abs(low), abs(high)) / epsilon, seed + 1)).alias("sum"))
    return out.withColumn("mean", F.col("sum") / F.greatest(F.col("count"), F.lit(1.0)))


def mask_email(c: Column | str) -> Column:
    c = col(c)
    user, domain = F.split_part(c, F.lit("@"), F.lit(1)), F.split_part(c, F.lit("@"), F.lit(2))
    n = F.length(user)
    long = F.concat(F.substring(user, 1, 1), F.repeat(F.lit("*"), n - 2), F.substring(user, -1, 1))
    short = F.concat(F.substring(user, 1, 1), F.lit("*"))
    return F.when(F.coalesce(c.contains("@"), F.lit(False)), F.concat(F.when(n <= 2, short).otherwise(long), F.lit("@"), domain)).otherwise("***@***.***")


def mask_card(c: Column | str) -> Column:
    c = col(c).cast("string")
    digits = F.regexp_replace(c, r"\D", "")
    hidden = ("*" * 4 + "-") * 3
    last = F.when(F.length(digits) == 0, "0000").otherwise(F.right(digits, F.lit(4)))
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, hidden + "*" * 4).otherwise(F.concat(F.lit(hidden), last))


def mask_phone(c: Column | str) -> Column:
    """All digits but the last two."""
    return F.regexp_replace(col(c), r"\d(?=(?:\D*\d){2})", "*")


def mask(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Columns masked by rule: email, card, phone or full."""
    how = {"email": mask_email, "card": mask_card, "phone": mask_phone, "full": lambda c: F.lit("********")}
    return df.withColumns({name: how[rule](name) for name, rule in rules.items() if name in df.columns})


def redact(c: Column | str) -> Column:
    """Struct of safe, violations, redacted and originalLength; each pattern sees what the ones before it left."""
    text = F.coalesce(col(c), F.lit(""))
    state = F.struct(text.alias("text"), F.array().cast("array<string>").alias("names"))
    for name, pattern in PII:
        state = F.get(F.transform(F.array(state), _redactor(name, pattern)), F.lit(0))  # a lambda evaluates the state once
    done = F.transform(F.array(state), lambda s: F.struct((F.size(s["names"]) == 0).alias("safe"), s["names"].alias("violations"), s["text"].alias("redacted"), F.length(text).alias("originalLength")))
    return F.get(done, F.lit(0))


def _redactor(name: str, pattern: str):
    def step(s: Column) -> Column:
        hit = _MAY_HOLD[name](s["text"]) & s["text"].rlike(pattern)
        new = F.regexp_replace(s["text"], pattern, f"[REDACTED_{name.upper()}]")
        return F.when(hit, F.struct(new.alias("text"), F.concat(s["names"], F.array(F.lit(name))).alias("names"))).otherwise(s)

    return step


def encrypt(c: Column | str, record: Column | str, field: str, key: Column, iv: Column | None = None) -> Column:
    """AES-GCM bound to record and field; the initialisation vector is random unless given."""
    aad = F.concat(col(record).cast("string"), F.lit(f":{field}"))
    iv = F.substring(F.unhex(F.sha2(F.expr("uuid()"), 256)), 1, 12) if iv is None else iv
    return F.aes_encrypt(F.encode(col(c).cast("string"), "UTF-8"), key, F.lit("GCM"), F.lit("DEFAULT"), iv, aad)


def decrypt(c: Column | str, record: Column | str, field: str, key: Column) -> Column:
    """The text, or null with another key, record or field."""
    aad = F.concat(col(record).cast("string"), F.lit(f":{field}"))
    return F.decode(F.try_aes_decrypt(col(c), key, F.lit("GCM"), F.lit("DEFAULT"), aad), "UTF-8")


def derive_key(secret: str, salt: str, rounds: int = 100_000) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", secret.encode(), salt.encode(), rounds, 32)


def encrypt_record(df: DataFrame, policy: dict[str, str], key: bytes, *, record: str = "_id", default: str = "searchable") -> DataFrame:
    """``_enc``, ``_plain``, ``_homo`` and ``_blind`` maps by field policy: plaintext, encrypted, exact, searchable, counter."""
    enc, plain, homo, blind = [], [], [], []
    secret = F.lit(key[:32])
    for name in (c for c in df.columns if c != record):
        how = policy.get(name, default)
        if how == "plaintext":
            plain += [F.lit(name), F.col(name).cast("string")]
            continue
        if how == "counter":
            homo += [F.lit(name), encrypt_additive(name, record, name, key)]
            continue
        enc += [F.lit(name), encrypt(name, record, name, secret)]
        if how == "exact":
            blind += [F.lit(name), F.array(exact_token(name, name, key))]
        elif how == "searchable":
            blind += [F.lit(name), F.concat(F.array(exact_token(name, name, key)), ngram_tokens(name, F.col(name).cast("string"), key))]
    empty = lambda kind: F.create_map().cast(kind)
    return df.select(
        record, (F.create_map(*enc) if enc else empty("map<string,binary>")).alias("_enc"), (F.create_map(*plain) if plain else empty("map<string,string>")).alias("_plain"),
        (F.create_map(*homo) if homo else empty("map<string,decimal(38,0)>")).alias("_homo"), (F.create_map(*blind) if blind else empty("map<string,array<string>>")).alias("_blind"),
    )


def rotate(df: DataFrame, column: str, field: str, old: dict[int, bytes], new: tuple[int, bytes], *, record: str = "_id", version: str = "key_version") -> DataFrame:
    """Values of old key versions encrypted again under the new one; rows of the current version aren't touched."""
    number, key = new
    clear = F.lit(None).cast("string")
    for v, k in old.items():
        clear = F.when(F.col(version) == v, decrypt(column, record, field, F.lit(k))).otherwise(clear)
    stale = F.col(version) != number
    return df.withColumn(column, F.when(stale, encrypt(clear, record, field, F.lit(key))).otherwise(F.col(column))).withColumn(version, F.when(stale, F.lit(number)).otherwise(F.col(version)))


def allowed(requests: DataFrame, user_roles: DataFrame, role_permissions: DataFrame) -> DataFrame:
    """requests (user, collection, action) with ``allowed``; permissions are 'coll:action' with * on either side."""
    granted = user_roles.join(role_permissions, "role").select("user", "permission").distinct()
    wanted = requests.withColumn("permission", F.explode(F.array(*(F.concat_ws(":", a, b) for a in (F.col("collection"), F.lit("*")) for b in (F.col("action"), F.lit("*"))))))
    yes = wanted.join(granted, ["user", "permission"], "left_semi").select("user", "collection", "action").distinct().withColumn("_yes", F.lit(True))
    return requests.join(yes, ["user", "collection", "action"], "left").withColumn("allowed", F.coalesce("_yes", F.lit(False))).drop("_yes")


def export_subject(df: DataFrame, field: str, subject) -> DataFrame:
    return df.where(F.col(field) == F.lit(subject))


def erase_subject(df: DataFrame, field: str, subject, key: bytes, when: str) -> tuple[DataFrame, DataFrame]:
    """(the table without the subject's rows, one signed attestation row)."""
    gone = export_subject(df, field, subject).agg(F.count(F.lit(1)).alias("erased"))
    message = F.concat_ws("|", F.lit(str(subject)), F.col("erased").cast("string"), F.lit(when))
    return df.where(~F.coalesce(F.col(field) == F.lit(subject), F.lit(False))), gone.select(F.lit(str(subject)).alias("subject"), "erased", F.lit(when).alias("at"), hmac_sha256(key, message).alias("signature"))


def order_token(c: Column | str) -> Column:
    """Hex of the IEEE-754 bits, so that texts sort as the numbers do; a plain encoding, not a security feature."""
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        x = values.to_numpy(np.float64, na_value=np.nan) + 0.0
        bits = x.view(np.uint64)
        bits = np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))
        text = bits.astype(">u8").tobytes().hex()
        return pd.Series([None if gone else text[16 * i : 16 * i + 16] for i, gone in enumerate(np.isnan(x).tolist())], dtype=object)

    return run(col(c).cast("double"))
