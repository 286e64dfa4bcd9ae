"""Natural-language prompts by offline rules, to a filter, an order and a limit.

The rules know the words of English, Arabic, French, Spanish, German, Russian,
Chinese, Japanese and Turkish, and digits of Arabic, Persian and Devanagari.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators.query import Collection, Query

_DIGITS = {base + d: str(d) for base in (0x660, 0x6F0, 0x966) for d in range(10)}
_NUMBER = r"(\d+(?:\.\d+)?)"
_MORE = {
    "en": ["more than", "greater than", "above", "over"], "ar": ["أكثر من", "أكبر من", "أعلى من", "فوق"], "fr": ["plus que", "plus de"], "es": ["mayor que", "superior a"],
    "de": ["mehr als"], "ru": ["больше"], "zh": ["大于"], "ja": ["超える"], "tr": ["daha fazla"],
}
_LESS = {
    "en": ["less than", "smaller than", "below", "under"], "ar": ["أقل من", "أصغر من", "تحت"], "fr": ["moins de"], "es": ["menor que", "inferior a"],
    "de": ["weniger als"], "ru": ["меньше"], "zh": ["小于"], "ja": ["未満"], "tr": ["daha az"],
}
_FROM = ["between", "from", "entre", "zwischen", "بين", "من", "от", "从"]
_TO = ["and", "to", "et", "y", "und", "bis", "و", "إلى", "до", "至", "–", "-", r"\.\."]
_INACTIVE = ["inactive", "inactif", "inactivo", "inaktiv", "غير نشط", "معطل", "неактивный", "不活跃", "非アクティブ"]
_ACTIVE = ["active", "actif", "activo", "aktiv", "نشط", "активный", "活跃", "アクティブ"]
_VIP = ["vip", "premium", "مميز", "privilège", "exclusivo", "премиум", "高级", "プレミアム"]
_TOP = ["top", "first", "premiers", "premier", "meilleurs", "meilleur", "erste", "أعلى", "أفضل", "أول", "первые", "前"]
_COUNTED = ["items", "records", "top", "elements", "premiers"]
_AMOUNTS = ["purchases", "ordersCount", "count", "age", "price", "salary", "balance", "score", "rating", "cost", "createdAt", "edad", "alter"]


@dataclass
class Parsed:
    filter: dict = field(default_factory=dict)
    sort: dict | None = None
    limit: int | None = None
    explanation: str = "All documents"


def _any(words: list[str]) -> str:
    return "(?:" + "|".join(sorted((w if "\\" in w else re.escape(w) for w in words), key=len, reverse=True)) + ")"


def _has(words: list[str], text: str) -> bool:
    """Latin words count as whole words only; other scripts needn't have word ends."""
    return any(re.search(rf"(?<![^\W\d_]){re.escape(w)}(?![^\W\d_])" if w.isascii() else re.escape(w), text) for w in words)


def _field(text: str, known: list[str], usual: list[str]) -> str | None:
    for name in known:
        if name.lower() in text:
            return name
    return next((n for n in usual if n.lower() in text), None) or (known[0] if known else usual[0])


def parse(prompt: str, fields: list[str] | None = None) -> Parsed:
    known, out, said = list(fields or []), Parsed(), []
    text = (prompt or "").strip().lower().translate(_DIGITS)
    flat = lambda table: [w for words in table.values() for w in words]

    for signs, words, strict, loose in ((">=|>", flat(_MORE), "$gt", "$gte"), ("<=|<", flat(_LESS), "$lt", "$lte")):
        m = re.search(rf"(?:({signs})|{_any(words)})\s*{_NUMBER}", text)
        if m:
            name, op = _field(text, known, _AMOUNTS if strict == "$gt" else ["price", *_AMOUNTS]), loose if m[1] and m[1].endswith("=") else strict
            out.filter.setdefault(name, {})[op] = _number(m[2])
            said.append(f"{name} {op[1:]} {m[2]}")
    m = re.search(rf"(?:{_any(_FROM)}\s*)?{_NUMBER}\s*{_any(_TO)}\s*{_NUMBER}", text)
    if m:
        name = _field(text, known, ["age", "edad", "alter", *_AMOUNTS])
        low, high = sorted((_number(m[1]), _number(m[2])))
        out.filter[name] = {"$gte": low, "$lte": high}
        said.append(f"{name} between {low} and {high}")
    if _has(_INACTIVE, text):
        out.filter["status"] = "inactive"
    elif _has(_ACTIVE, text):
        out.filter["status"] = "active"
    if "status" in out.filter:
        said.append(f"status = {out.filter['status']}")
    if _has(_VIP, text):
        out.filter["isVIP"] = True
        said.append("isVIP")
    m = re.search(rf"{_any(_TOP)}\s*(\d+)", text) or re.search(rf"(\d+)\s*{_any(_COUNTED)}", text)
    if m:
        by = _field(text, known, ["purchases", "salary", "score", "rating", "price", "createdAt"])
        out.sort, out.limit = {by: -1}, int(m[1])
        said.append(f"top {m[1]} by {by}")
    for name in known:
        if name not in out.filter:
            m = re.search(rf"\b{re.escape(name.lower())}\s*(?:[:=]|\bis\b|\best\b|是)\s*['\"]?([^\s,'\"]+)", text)
            if m:
                out.filter[name] = m[1]
                said.append(f"{name} = {m[1]}")
    if said:
        out.explanation = " AND ".join(said)
    return out


def _number(text: str) -> int | float:
    return float(text) if "." in text else int(text)


def parse_with(prompt: str, fields: list[str], ask: Callable[[str], str]) -> Parsed:
    """A spec from a callable that answers with JSON; the rules where that fails."""
    try:
        spec = json.loads(ask(prompt))
        return Parsed(dict(spec["filter"]), spec.get("sort"), spec.get("limit"), spec.get("explanation", "model"))
    except Exception:
        return parse(prompt, fields)


def query(df: DataFrame, prompt: str, key: str = "_id") -> Query:
    """The prompt as a query over a collection, whose columns are the known fields."""
    spec = parse(prompt, df.columns)
    q = Collection(df, key).find({k: v for k, v in spec.filter.items() if k in df.columns})
    q = q.sort(spec.sort) if spec.sort else q
    return q.limit(spec.limit) if spec.limit else q
