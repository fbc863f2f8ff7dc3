"""Main text of web pages by consensus host paths.

Every page scores its containers and votes for the generalised path (tags and classes from the root) of the best ones.
Votes are summed per host in Spark; the winning paths then tell each page which container to extract. A page on which no
winning path matches falls back to its own best container.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import staged
from .common import sliced

#: Comments, declarations, raw-text elements up to their end tag, and tags with quoted attributes.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|math|object|canvas)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>",
    re.S | re.I,
)
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub "
    "sup time tt u var wbr br".split()
)
#: Elements that never hold article text.
OUTSIDE = frozenset("nav header footer aside form button select input menu dialog head label".split())
#: Words of class, id or role names that mark parts beside the article.
BESIDE = frozenset(
    "ad ads advert adverts advertisement advertising promo promoted promotion sponsor sponsored banner cookie cookies consent gdpr notice "
    "newsletter subscribe subscription signup share sharing social related recommended recommendations sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs comment comments respond replies disqus footer header masthead popup modal overlay widget pagination pager "
    "toolbar paywall teaser teasers outbrain taboola complementary contentinfo search login".split()
)
#: Containers that a name alone does not exclude, unless it speaks of comments.
SOLID = frozenset("html body main article".split())
CLOSES_P = frozenset(
    "p div section article main ul ol dl table blockquote pre h1 h2 h3 h4 h5 h6 form nav header footer aside figure hr address fieldset".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LEAST_SHARE, MOST_PATHS = 0.2, 3
#: Text with a larger share of links is not part of an article.
MOST_LINKED = 0.3


@dataclass
class Node:
    tag: str
    parent: int
    label: str
    outside: bool
    score: float = 0.0
    chars: int = 0
    linked: int = 0
    blocks: list = field(default_factory=list)


def _label(tag: str, names: list[str]) -> str:
    """Tag and classes, numbers taken out, so that pages of one template agree."""
    some = sorted({re.sub(r"[\d_-]+", "-", n.lower()).strip("-") for n in names} - {""})
    return ".".join([tag, *some[:3]])


def parse(html: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Elements, and the text blocks in page order as (element, text)."""
    nodes, stack, blocks = [Node("#root", -1, "", False)], [0], []
    held: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            at = stack[-1]
            while nodes[at].tag in INLINE and nodes[at].parent >= 0:
                at = nodes[at].parent
            blocks.append((at, text))
            nodes[at].chars += len(text)
            nodes[at].linked += min(linked, len(text))
        linked = 0

    def close(upto: int) -> None:
        nonlocal links
        while len(stack) > upto:
            if nodes[stack.pop()].tag == "a":
                links -= 1

    def open_(tag: str, attributes: str) -> None:
        nonlocal links
        if tag not in INLINE:
            flush()
            if tag in CLOSES_P:
                for i in range(len(stack) - 1, 0, -1):
                    if nodes[stack[i]].tag == "p":
                        close(i)
                        break
                    if nodes[stack[i]].tag not in INLINE:
                        break
            for i in range(len(stack) - 1, 0, -1):
                other = nodes[stack[i]].tag
                if other in SIBLINGS.get(tag, ()):
                    close(i)
                    break
                if other not in INLINE and other != "p":
                    break
        if tag == "br" or tag == "wbr":
            held.append(" " if tag == "br" else "")
            return
        names = [n for m in NAMES.finditer(attributes) for n in (m[1] or m[2] or m[3] or "").split()]
        spoken = {w for n in names for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", n).lower())}
        beside = spoken & BESIDE
        outside = tag in OUTSIDE or bool(HIDDEN.search(attributes))
        outside |= bool(beside) and (tag not in SOLID or bool(spoken & {"comment", "comments"}))
        nodes.append(Node(tag, stack[-1], _label(tag, names), outside or nodes[stack[-1]].outside))
        if tag not in VOID and not attributes.rstrip().endswith("/"):
            stack.append(len(nodes) - 1)
            links += tag == "a"

    at = 0
    for m in MARKUP.finditer(html):
        if m.start() > at:
            text = unescape(html[at : m.start()])
            held.append(text)
            linked += len(text) if links > 0 else 0
        at = m.end()
        tag = (m["tag"] or "").lower()
        if m["raw"] and m["raw"].lower() == "title":
            flush()
        if not tag:
            continue
        if not m["end"]:
            open_(tag, m["attributes"] or "")
            continue
        if tag not in INLINE:
            flush()
        depth = next((i for i in range(len(stack) - 1, 0, -1) if nodes[stack[i]].tag == tag), None)
        if depth is not None and (tag not in INLINE or all(nodes[s].tag in INLINE for s in stack[depth:])):
            close(depth)
    if at < len(html):
        held.append(unescape(html[at:]))
    flush()
    return nodes, blocks


def score(nodes: list[Node], blocks: list[tuple[int, str]]) -> None:
    """Text blocks speak for the elements around them, less with distance; links and names of side parts speak against."""
    for at, text in blocks:
        if nodes[at].outside or len(text) < 25:
            continue
        weight = 1 + text.count(",") + min(len(text) / 100, 3)
        weight *= 1 - min(nodes[at].linked / max(nodes[at].chars, 1), 1)
        above = nodes[at].parent if nodes[at].tag in ("p", "pre", "blockquote", "li", "td", "dd", "h1", "h2", "h3", "h4", "h5", "h6") else at
        for share in (1.0, 0.5, 0.25):
            if above <= 0:
                break
            nodes[above].score += weight * share
            above = nodes[above].parent
    for n in nodes:
        if n.outside:
            n.score = 0.0
        elif n.tag in ("article", "main"):
            n.score = n.score * 1.5 + 1e-9


def path(nodes: list[Node], at: int) -> str:
    labels = []
    while at > 0:
        labels.append(nodes[at].label)
        at = nodes[at].parent
    return ">".join(reversed(labels))


def _inside(nodes: list[Node], at: int, tops: set[int]) -> bool:
    while at >= 0:
        if at in tops:
            return True
        at = nodes[at].parent
    return False


def _whole(nodes: list[Node], tops: set[int]) -> set[int]:
    """The articles around the containers: the nearest article or main element, or else the lowest ancestor that has
    other text outside side parts, unless that text is mostly links."""
    chars, linked = ([0 if n.outside else getattr(n, c) for n in nodes] for c in ("chars", "linked"))
    for i in range(len(nodes) - 1, 0, -1):
        chars[nodes[i].parent] += chars[i]
        linked[nodes[i].parent] += linked[i]
    out = set()
    for top in tops:
        at = top
        while at > 0 and nodes[at].tag not in ("article", "main"):
            at = nodes[at].parent
        if at <= 0:
            at = nodes[top].parent
            while at > 0 and chars[at] == chars[top]:
                at = nodes[at].parent
            if at <= 0 or linked[at] - linked[top] > MOST_LINKED * (chars[at] - chars[top]):
                at = top
        out.add(at)
    return out


def extract(html: str, winners: list[str]) -> str:
    """Text of the articles around the containers on the first winning path that the page has, or around the page's best
    container."""
    nodes, blocks = parse(html)
    score(nodes, blocks)
    tops: set[int] = set()
    if winners:
        paths: dict[str, list[int]] = {}
        for i in range(1, len(nodes)):
            if nodes[i].score > 0:
                paths.setdefault(path(nodes, i), []).append(i)
        for w in winners:
            if w in paths:
                best = max(nodes[i].score for i in paths[w])
                tops = {i for i in paths[w] if nodes[i].score >= LEAST_SHARE * best}
                break
    if not tops:
        best = max(range(len(nodes)), key=lambda i: (nodes[i].score, -i))
        tops = {best} if nodes[best].score > 0 else {0}
    tops = _whole(nodes, tops)
    return "\n".join(text for at, text in blocks if not nodes[at].outside and _inside(nodes, at, tops))


def votes(html: str) -> list[tuple[str, float]]:
    """Paths of the page's best containers; their shares of the best score are the votes."""
    nodes, blocks = parse(html)
    score(nodes, blocks)
    ranked = sorted((i for i in range(1, len(nodes)) if nodes[i].score > 0), key=lambda i: (-nodes[i].score, i))[:MOST_PATHS]
    out: dict[str, float] = {}
    for i in ranked:
        p = path(nodes, i)
        out[p] = max(out.get(p, 0.0), nodes[i].score / nodes[ranked[0]].score)
    return [*out.items()]


def host(url: str = "url"):
    """Lower-cased host of a URL; empty without one."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, paths): at most MOST_PATHS winning paths of every host, the strongest first.

    Votes are added up before the shuffle, so a host with a third of all pages costs one row per path and task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], list] = {}

        def flush():
            rows = [(h, p, v[0], v[1]) for (h, p), v in sums.items()]
            sums.clear()
            columns = zip(*rows, strict=True)
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["host", "path", "vote", "firsts"])

        for batch in sliced(batches, "html", 8_000_000):
            for h, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                for i, (p, v) in enumerate(votes(page or "")):
                    held = sums.setdefault((h, p), [0, 0])
                    held[0] += round(1000 * v)
                    held[1] += i == 0
            if len(sums) > 50_000:
                yield flush()
        if sums:
            yield flush()

    rows = pages.select(host(url).alias("host"), F.col(html).alias("html"))
    counted = rows.mapInArrow(run, "host string, path string, vote long, firsts long").groupBy("host", "path")
    summed = counted.agg(F.sum("vote").alias("vote"), F.sum("firsts").alias("firsts"))
    order = Window.partitionBy("host").orderBy(F.desc("firsts"), F.desc("vote"), "path")
    best = summed.withColumn("rank", F.row_number().over(order)).filter((F.col("rank") <= MOST_PATHS) & (F.col("firsts") > 0))
    listed = F.array_sort(F.collect_list(F.struct("rank", "path")))
    return best.groupBy("host").agg(F.transform(listed, lambda x: x["path"]).alias("paths"))


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars), one row per input row.

    Blocks are in page order, one per line; white space inside a block is one space, character references are decoded.
    NULL, empty and text-free pages have an empty text. Pages without a host vote together. Repeated rows stay apart.
    """
    winners = staged(host_paths(pages, url, html), "host-paths")
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), host(url).alias("host"), F.col(html).alias("html"))
    joined = rows.join(winners, "host", "left").select("_key", "_url", "html", "paths")
    schema = StructType([*joined.schema.fields[:2], *StructType.fromDDL("text string, n_chars long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "html", 8_000_000):
            found = [
                extract(page or "", paths or [])
                for page, paths in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist(), strict=True)
            ]
            lengths = pa.array([len(t) for t in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_url"), pa.array(found, pa.string()), lengths], schema.names)

    return joined.mapInArrow(run, schema).withColumnRenamed("_key", key).withColumnRenamed("_url", "url")
