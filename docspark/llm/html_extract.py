"""Operator 10: main text of web pages by site style trees.

The pages of a host are merged into one tree.  An element node is known by its
parent, the child sequence of the parent it is in (a style), its place in that
sequence and its tag; equal neighbours in a sequence count once, so pages with
more or fewer paragraphs share a style.

* Presentation importance of an element on m pages is the entropy, to base m,
  of the pages' styles.  Content importance of a leaf is 1 minus the mean
  entropy, to base m, of its features (texts, link targets, image sources) over
  pages: what is the same on every page has none.  On one page both are 1;
  a leaf without features has none.
* An element's importance is (1 - g^l) * own + g^l * that of its styles, with
  l styles; a style's is the mean of its children's, weighted by pages.
* Branches in which no node reaches an importance of ``least`` are removed from
  each page, and the text of the rest is returned, a line per block.  On a host
  of m pages all importances are drawn towards 1 by the weight of ``strength``
  pages, as what a few pages share may well be content.

Counts are grouped aggregations over all pages; one task a host combines the
aggregated nodes (not pages), and only the tops of removed branches are joined
back.  Pages without a host lose nothing.  Scripts, styles and comments are
never text: a script reaches to its own end tag whatever is in it, an unclosed
one to the end of the page.  A tag ends at the first ``>`` outside quotes, or at
the first at all where quotes don't close; without any it is text.  Pages are
read in linear time.  Unclosed and stray tags are repaired as browsers do for
paragraphs, list items and table cells.

Null and empty HTML gives the empty text.  Rows with a null key, and repeated
rows, are extracted row by row (repeated rows count as pages).  Extra columns
are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, sized, written

_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_MARK = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"\b(href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset("script style noscript template iframe svg".split())
_RAW_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in _RAW}
_BLOCK = frozenset("address article aside blockquote body dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul br".split())
_CLOSES = {"li": ("li",), "p": ("p",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
_LISTS = frozenset("ul ol table dl select body article section div".split())
_PARAGRAPH_ENDS = _BLOCK - {"p", "br", "body", "html", "head", "title"}


def tokens(text: str):
    """(start, end, closing, tag, attributes) of all tags, comments and declarations (tag ''), in linear time."""
    last = {c: text.rfind(c) for c in ">\"'"}
    quotes, at, ended = True, 0, set()

    def upto(mark: str, start: int) -> int:
        """The end of the next mark, or that of the text; a mark that isn't found once isn't looked for again."""
        found = -1 if mark in ended else text.find(mark, start)
        if found < 0:
            ended.add(mark)
        return found + len(mark) if found >= 0 else len(text)

    while (start := text.find("<", at)) >= 0:
        if text.startswith("<!--", start):
            at = upto("-->", start + 4)
            yield start, at, "", "", ""
            continue
        if text.startswith("<![CDATA[", start):
            at = upto("]]>", start + 9)
            yield start, at, "", "", ""
            continue
        if start > last[">"]:
            return
        if text[start + 1 : start + 2] in ("!", "?"):
            at = text.find(">", start) + 1
            yield start, at, "", "", ""
            continue
        name = _NAME.match(text, start + 1)
        if not name:
            at = start + 1
            continue
        end, place = -1, name.end()
        while quotes and (m := _MARK.search(text, place)):
            if m.group() == ">":
                end = m.end()
                break
            if m.start() >= last[m.group()]:
                break
            place = text.find(m.group(), m.end()) + 1
        else:
            quotes = False  # no end outside quotes from here on
        if end < 0:
            end = text.find(">", name.end()) + 1
        at = yield start, end, name.group(1), name.group(2).lower(), text[name.end() : end - 1]
        at = at or end


def parse(text: str):
    """Tags, parents, texts and links of the nodes of a page, in document order; node 0 is the root, text nodes have tag ''."""
    tags, parents, texts, links = ["#root"], [-1], [""], [""]
    stack, at = [0], 0
    opened: dict[str, int] = defaultdict(int)
    unclosed: set[str] = set()

    def add(tag: str, content: str = "", link: str = "") -> int:
        tags.append(tag)
        parents.append(stack[-1])
        texts.append(content)
        links.append(link)
        return len(tags) - 1

    def put(raw: str) -> None:
        content = " ".join(entities.unescape(raw).split())
        if content:
            add("", content, links[stack[-1]] if tags[stack[-1]] == "a" else "")

    def close(depth: int) -> None:
        for node in stack[depth:]:
            opened[tags[node]] -= 1
        del stack[depth:]

    scan = tokens(text)
    token = next(scan, None)
    while token:
        start, end, closing, tag, attributes = token
        jump = None
        if start > at:
            put(text[at:start])
        at = end
        alone = attributes.rstrip().endswith("/")
        if not tag:
            pass
        elif closing:
            if opened[tag]:
                close(next(d for d in range(len(stack) - 1, 0, -1) if tags[stack[d]] == tag))
        else:
            ends = _CLOSES.get(tag, ()) or (("p",) if tag in _PARAGRAPH_ENDS else ())
            if any(opened[t] for t in ends):
                for depth in range(len(stack) - 1, 0, -1):
                    if tags[stack[depth]] in ends:
                        close(depth)
                        break
                    if tags[stack[depth]] in _LISTS:
                        break
            link = ""
            if tag in ("a", "img"):
                found = _ATTRIBUTE.search(attributes)
                link = next((g for g in found.groups()[1:] if g is not None), "") if found else ""
            if tag in _RAW and not alone:
                raw = None if tag in unclosed else _RAW_ENDS[tag].search(text, end)
                if raw:
                    jump = at = raw.end()
                elif tag in ("script", "style"):
                    return tags, parents, texts, links
                else:  # an unclosed one is left out, not what follows it
                    unclosed.add(tag)
            elif tag not in _RAW:
                node = add(tag, "", link)
                if tag not in _VOID and not alone:
                    stack.append(node)
                    opened[tag] += 1
        try:
            token = scan.send(jump)
        except StopIteration:
            token = None
    if at < len(text):
        put(text[at:])
    return tags, parents, texts, links


def _key(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode("utf8", "replace"), digest_size=8).digest(), "little", signed=True)


class Keys:
    """Node and style keys of pages; keys met before aren't hashed again."""

    def __init__(self):
        self.held: dict[tuple, int] = {}

    def key(self, *parts) -> int:
        if parts not in self.held:
            if len(self.held) > 200_000:
                self.held.clear()
            self.held[parts] = _key(*parts)
        return self.held[parts]

    def nodes(self, tags: list[str], parents: list[int]) -> tuple[list[int], list[int]]:
        """The key of each node and of its style (0: no children)."""
        children: list[list[int]] = [[] for _ in tags]
        for i in range(1, len(tags)):
            children[parents[i]].append(i)
        keys, styles = [0] * len(tags), [0] * len(tags)
        keys[0] = self.key("root")
        for i, own in enumerate(children):  # parents come before their children
            if own:
                sequence, place = [], []
                for c in own:
                    if not sequence or sequence[-1] != tags[c]:
                        sequence.append(tags[c])
                    place.append(len(sequence))
                styles[i] = self.key("style", keys[i], ">".join(sequence))
                for c, p in zip(own, place):
                    keys[c] = self.key(styles[i], p, tags[c])
        return keys, styles


def _observe(pages: DataFrame) -> DataFrame:
    """(host, node, parent, style, kind, value, n): pages with each style (kind 0), feature (1) or the node at all (2)."""

    def run(batches):
        keys = Keys()
        for batch in batches:
            counts: dict[tuple, int] = defaultdict(int)
            hosts = batch.column(0).to_pylist()
            for host, text in zip(hosts, batch.column(1).to_pylist()):
                tags, parents, texts, links = parse(text or "")
                own, styles = keys.nodes(tags, parents)
                seen = set()
                for i in range(len(tags)):
                    up, within = (own[parents[i]], styles[parents[i]]) if i else (0, 0)
                    node = (host, own[i], up, within)
                    seen.add((*node, 2, 0))
                    if styles[i]:
                        seen.add((*node, 0, styles[i]))
                    else:
                        if texts[i]:
                            seen.add((*node, 1, _key("text", texts[i])))
                        if links[i]:
                            seen.add((*node, 1, _key("link", links[i])))
                for x in seen:
                    counts[x] += 1
            if counts:
                cols = list(zip(*counts))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), *(pa.array(c, pa.int64()) for c in cols[1:]), pa.array(list(counts.values()), pa.int64())], names=["host", "node", "parent", "style", "kind", "value", "n"])

    rows = pages.mapInArrow(run, "host string, node long, parent long, style long, kind long, value long, n long")
    return rows.groupBy("host", "node", "parent", "style", "kind", "value").agg(F.sum("n").alias("n"))


def importances(nodes: list[dict], gamma: float) -> dict[int, float]:
    """Importance of each node of a host's tree.

    A node has node, style (of the parent, that it is in), pages, styles
    [(style, pages)], features and log_features (sum of the logs of their pages).
    """
    within: dict[int, list[dict]] = defaultdict(list)
    for x in nodes:
        within[x["style"]].append(x)
    by_node = {x["node"]: x for x in nodes}
    order, todo = [], [x["node"] for x in nodes if x["style"] == 0]
    while todo:
        node = todo.pop()
        order.append(node)
        for style, _ in by_node[node]["styles"] or ():
            todo += [c["node"] for c in within[style]]
    value: dict[int, float] = {}
    for node in reversed(order):
        x = by_node[node]
        m = x["pages"]
        if not x["styles"]:
            value[node] = 0.0 if not x["features"] else 1.0 if m < 2 else max(0.0, 1 - x["log_features"] / np.log(m) / x["features"])
            continue
        total = sum(n for _, n in x["styles"])
        share = [n / total for _, n in x["styles"]]
        own = 1.0 if m < 2 else min(1.0, -sum(p * np.log(p) for p in share) / np.log(m))
        below = sum(p * np.mean([value[c["node"]] for c in within[s]]) for p, (s, _) in zip(share, x["styles"]))
        keep = gamma ** len(share)
        value[node] = float((1 - keep) * own + keep * below)
    return value


def noisy(nodes: list[dict], value: dict[int, float], least: float) -> set[int]:
    """Nodes that, with all that is below them, are of less than ``least`` importance."""
    parent = {x["node"]: x["parent"] for x in nodes}
    kept: set[int] = set()
    for node, v in value.items():
        while v >= least and node in parent and node not in kept:
            kept.add(node)
            node = parent[node]
    return {n for n in value if n not in kept}


def host_bound(least: float, pages: int, strength: float) -> float:
    """The importance that is ``least`` when drawn towards 1 by the weight of ``strength`` pages."""
    return 1 - (1 - least) * (pages + strength) / pages


def unimportant(pages: DataFrame, least: float, gamma: float, strength: float) -> DataFrame:
    """(host, removed): the tops of the branches to remove on each host; pages has (host, html)."""
    observed = _observe(pages)
    style, feature = F.col("kind") == 0, F.col("kind") == 1
    nodes = observed.groupBy("host", "node", "parent", "style").agg(
        F.max(F.when(F.col("kind") == 2, F.col("n"))).alias("pages"), F.collect_list(F.when(style, F.struct("value", "n"))).alias("styles"),
        F.sum(feature.cast("long")).alias("features"), F.coalesce(F.sum(F.when(feature, F.log("n"))), F.lit(0.0)).alias("log_features"),
    )

    def run(key, table):
        rows = table.to_pylist()
        for x in rows:
            x["styles"] = [(s["value"], s["n"]) for s in x["styles"]]
        root = next((x for x in rows if x["style"] == 0), None)
        removed: list[int] = []
        bound = root and host_bound(least, root["pages"], strength)
        if root and bound > 0:
            low = noisy(rows, importances(rows, gamma), bound)
            removed = sorted(x["node"] for x in rows if x["node"] in low and x["parent"] not in low)
        return pa.table({"host": pa.array([key[0].as_py()]), "removed": pa.array([removed], pa.list_(pa.int64()))})

    return nodes.groupBy("host").applyInArrow(run, "host string, removed array<long>").where(F.size("removed") > 0)


def page_text(tags: list[str], parents: list[int], texts: list[str], dropped: list[bool]) -> str:
    """Text of the nodes that aren't in a dropped branch, a line per block."""
    out: list[str] = []
    gone = list(dropped)
    block = [0] * len(tags)
    last = -1
    for i in range(1, len(tags)):
        gone[i] = gone[i] or gone[parents[i]]
        block[i] = i if tags[i] in _BLOCK else block[parents[i]]
        if gone[i] or tags[i] or tags[parents[i]] == "title":
            if tags[i] == "br":
                last = -1
            continue
        if out and block[i] == last:
            out[-1] += " " + texts[i]
        else:
            out.append(texts[i])
        last = block[i]
    return "\n".join(out)


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", least: float = 0.65, gamma: float = 0.9, strength: float = 8.0) -> DataFrame:
    """(page_id, text, removed): the main text of every page, and the number of branches removed from it."""
    host = F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    rows = pages.select(F.col(key).alias("page_id"), F.when(host != "", host).alias("host"), F.col(html).alias("html"))
    removed = written(unimportant(rows.where(F.col("host").isNotNull()).select("host", "html"), least, gamma, strength), "style-trees")
    nodes = removed.agg(F.coalesce(F.sum(F.size("removed")), F.lit(0))).first()[0]
    removed = removed.withColumnRenamed("host", "_host")
    joined = rows.join(sized(removed) if nodes <= 1_000_000 else removed, F.col("host") == F.col("_host"), "left").select("page_id", "removed", "html")

    def run(batches):
        keys = Keys()
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts, counts = [], []
                for low, text in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    tags, parents, contents, _ = parse(text or "")
                    low = set(low or ())
                    dropped = [k in low for k in keys.nodes(tags, parents)[0]] if low else [False] * len(tags)
                    texts.append(page_text(tags, parents, contents, dropped))
                    counts.append(sum(dropped))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=["page_id", "text", "removed"])

    return joined.mapInArrow(run, f"page_id {joined.schema[0].dataType.simpleString()}, text string, removed long")
