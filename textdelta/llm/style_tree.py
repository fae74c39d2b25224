"""HTML main text with a site style tree.

Pages of a host are merged into one tree: a node is a path of elements (tag with
class and id), its presentations are the sequences of child elements that pages
show there, its contents the texts. The importance of a node is the entropy of
its presentations or contents over the host's pages, against the greatest that
many pages could have: what is alike on all pages says nothing. A node's
importance is the greater of both, or 1 on a host of fewer than ``min_pages``
different pages. Each element has a prior weight by tag, role, class and id
(STRONG for navigation, header, footer, sidebar, notice, advert, form and
comments, and for what lies outside ``article`` and ``main`` where a page has
these; WEAK for words that content has too; else 1; a branch has its least). A
text goes if importance times weight is below ``threshold``.

Plan: (1) pages are parsed by batch, to counts of (host, node, content), which
are summed, then folded to entropies by (host, node) by partial aggregates;
(2) the nodes of low importance come back to the pages: as a broadcast if they
are at most ``BROADCAST_NODES``, else by a join on (host, salt), with every host's
pages dealt over ``SALTS`` parts. Equal pages of a host count once in the whole
table, however they lie in files and batches, so mirrors weigh nothing.

Edge cases: null html gives the empty text; a page that is not closed, or closes
what it did not open, is read as far as it makes sense; what follows an opening
script or style without end is dropped; a null or hostless URL is the host ``""``;
repeated rows are each returned; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import cut

BROADCAST_NODES, SALTS = 200_000, 16
#: Fixed sets of HTML: elements without content, with raw content, that end a line of text, and that a sibling ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math textarea title select".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
ENDED_BY = {"p": BLOCK - {"br"}, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "option": frozenset({"option"})}
#: The prior of presentation: tags, roles, and words in class or id.
NOISE_TAGS = frozenset("head nav aside footer form button dialog menu input label fieldset legend".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
STRONG_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo banner nav navbar navigation menu menus breadcrumb breadcrumbs footer header masthead topbar sidebar aside rail notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations pager pagination comment comments commentlist respond disqus reply replies discussion reader toolbar".split()
)
WEAK_WORDS = frozenset("more form side foot skip search alert promotion widget widgets".split())
#: The weights of the prior; with the default threshold STRONG always goes, and WEAK at an importance under 0.4.
STRONG, WEAK, THRESHOLD = 0.1, 0.5, 0.2
CONTENT_TAGS = frozenset({"article", "main"})
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]{0,1000}+\"|'[^']{0,1000}+')*+|[^<>]*+)>|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[A-Za-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|\bhidden\b", re.I)


@dataclass
class Node:
    """An open element."""

    tag: str
    path: int
    weight: float
    content: bool
    children: list[str] = field(default_factory=list)


@dataclass
class Page:
    """Blocks of text (node, weight, in an article or main, text), and presentations (node, child sequence)."""

    blocks: list[tuple[int, float, bool, str]]
    presentations: list[tuple[int, int]]
    has_content: bool


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def _name(tag: str, attributes: str, within: bool = False) -> tuple[str, float]:
    """The element's name in the tree, and its own weight; an article's own header is content."""
    weight = STRONG if tag in NOISE_TAGS else 1.0
    if not attributes.strip():
        return tag, weight
    name = tag
    for kind, *values in _ATTR.findall(attributes):
        kind, value = kind.lower(), "".join(values).lower()
        if kind == "hidden" or (kind == "role" and value in NOISE_ROLES):
            weight = STRONG
        elif kind in ("class", "id"):
            name += ("." if kind == "class" else "#") + " ".join(value.split())
            if tag not in ("html", "body", "article", "main"):
                words = set(_WORD.findall(value)) - ({"header"} if within else set())
                weight = min(weight, STRONG if words & STRONG_WORDS else WEAK if words & WEAK_WORDS else 1.0)
    return name, STRONG if tag != "body" and "none" in attributes and _HIDDEN.search(attributes) else weight


def parse(html: str, threshold: float = THRESHOLD) -> Page:
    """The page's tree; texts of a weight below ``threshold`` are left out, as no importance keeps them."""
    root = Node("", 0, 1.0, False)
    opened: Counter = Counter()
    stack, blocks, shown = [root], [], []
    text: list[str] = []
    has_content = False

    def flush() -> None:
        if text:
            joined = " ".join(unescape("".join(text)).split())
            text.clear()
            top = stack[-1]
            if joined and top.weight >= threshold:
                blocks.append((top.path, top.weight, top.content, joined))

    def close() -> None:
        node = stack.pop()
        opened[node.tag] -= 1
        shown.append((node.path, _hash(" ".join(node.children))))

    at = 0
    size = len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        if m is None:
            text.append(html[at:])
            break
        if m.start() > at:
            text.append(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            flush()
        if m[1]:
            if tag in VOID:
                continue
            for depth in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[depth].tag == tag:
                    if tag in BLOCK or stack[-1].weight < 1:
                        flush()
                    while len(stack) > depth:
                        close()
                    break
                if stack[depth].tag in ("article", "main", "body", "td", "section", "div") and tag not in BLOCK:
                    break
            continue
        name, weight = _name(tag, m[3], stack[-1].content)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else size
            stack[-1].children.append(name)
            continue
        while len(stack) > 1 and tag in ENDED_BY.get(stack[-1].tag, ()):
            flush()
            close()
        if tag in BLOCK and tag not in VOID:  # inline elements that were left open end where a block begins
            while len(stack) > 1 and stack[-1].tag not in BLOCK:
                close()
            while len(stack) > 1 and tag in ENDED_BY.get(stack[-1].tag, ()):
                close()
        top = stack[-1]
        top.children.append(name)
        if tag in VOID:
            continue
        if tag not in BLOCK and weight < 1:
            flush()
        content = tag in CONTENT_TAGS or top.content
        inline = tag not in BLOCK and weight == 1
        weight = min(weight, top.weight, STRONG if tag == "header" and not top.content else 1.0)
        has_content |= content and weight >= threshold
        stack.append(Node(tag, top.path if inline else _hash(f"{top.path}>{name}"), weight, content))
        opened[tag] += 1
    flush()
    while len(stack) > 1:
        close()
    return Page(blocks, shown, has_content)


def host_of(urls: pa.Array) -> list[str]:
    out = []
    for url in urls.to_pylist():
        m = re.search(r"://([^/?#]*)", url or "")
        out.append(m[1].lower() if m else "")
    return out


def _host(url: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def _different(pages: DataFrame) -> DataFrame:
    """url, html of the pages that are not empty, equal pages of a host once; only html that repeats is exchanged, unless very much does."""
    own = ["host", "key"]
    keyed = pages.where("html <> ''").select("url", "html", _host("url").alias("host"), F.xxhash64("html").alias("key"))
    copied = cut(keyed.groupBy(*own).agg(F.count("*").alias("c")).where("c > 1").select(*own))
    if copied.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES:
        copied = F.broadcast(copied)
        once = keyed.join(copied, own, "left_anti").select("url", "html")
        return once.union(keyed.join(copied, own, "left_semi").dropDuplicates(own).select("url", "html"))
    return keyed.dropDuplicates(own).select("url", "html")


def _tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (host, node, kind, content hash), a page giving each once."""
    for batch in batches:
        counts: Counter = Counter()
        for host, html in zip(host_of(batch["url"]), batch["html"].to_pylist(), strict=True):
            page = parse(html)
            counts.update({(host, path, 1, _hash(text)) for path, _, _, text in page.blocks})
            counts.update({(host, path, 0, shown) for path, shown in page.presentations})
        rows = list(zip(*counts, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_pydict({"host": pa.array(rows[0], pa.string()), "node": pa.array(rows[1], pa.int64()), "kind": pa.array(rows[2], pa.int32()), "content": pa.array(rows[3], pa.int64()), "n": pa.array(list(counts.values()), pa.int64())})


def importances(pages: DataFrame, min_pages: int) -> DataFrame:
    """host, node, importance of the nodes that have contents."""
    counts = _different(pages).mapInArrow(_tree, "host string, node long, kind int, content long, n long")
    counts = counts.groupBy("host", "node", "kind", "content").agg(F.sum("n").alias("c"))
    nodes = counts.groupBy("host", "node", "kind").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.ln("c")).alias("s"))
    importance = F.when(F.col("n") < F.greatest(F.lit(min_pages), F.lit(2)), 1.0).otherwise((F.ln("n") - F.col("s") / F.col("n")) / F.ln("n"))
    nodes = nodes.select("host", "node", "kind", importance.alias("importance"))
    return nodes.groupBy("host", "node").agg(F.max("importance").alias("importance"), F.max("kind").alias("kind")).where("kind = 1").drop("kind")


def low_nodes(pages: DataFrame, min_pages: int, threshold: float) -> DataFrame:
    """host, node, importance of the nodes that are below the threshold at some weight that does not fall below it itself."""
    return importances(pages, min_pages).where(F.col("importance") * WEAK < threshold)


def main_text(html: str | None, low: dict | None = None, threshold: float = THRESHOLD) -> str:
    """The texts of a page that stay, by the importances of low nodes."""
    if not html:
        return ""
    page, low = parse(html, threshold), low or {}
    outside = STRONG if page.has_content else 1.0
    return " ".join(text for path, weight, content, text in page.blocks if low.get(path, 1.0) * min(weight, 1.0 if content else outside) >= threshold)


RESULT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])


def _extract(low: dict[str, dict[int, float]] | None, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows = [low.get(h) for h in host_of(batch["url"])] if low is not None else [{x["node"]: x["importance"] for x in own or ()} for own in batch["low"].to_pylist()]
            text = [main_text(html, own, threshold) for html, own in zip(batch["html"].to_pylist(), lows, strict=True)]
            yield pa.RecordBatch.from_pydict({"page_id": batch["page_id"], "url": batch["url"], "text": pa.array(text, pa.string())}, schema=RESULT)

    return run


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", min_pages: int = 4, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    pages = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    low = cut(low_nodes(pages, min_pages, threshold))
    if low.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES:
        known: dict[str, dict[int, float]] = {}
        for r in low.collect():
            known.setdefault(r.host, {})[r.node] = r.importance
        found = pages.mapInArrow(_extract(known, threshold), "page_id long, url string, text string")
    else:
        hosts = low.groupBy("host").agg(F.collect_list(F.struct("node", "importance")).alias("low")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = pages.withColumn("host", _host("url")).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        found = salted.join(hosts, ["host", "salt"], "left").select("page_id", "url", "html", "low").mapInArrow(_extract(None, threshold), "page_id long, url string, text string")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
