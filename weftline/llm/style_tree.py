"""Main text of web pages by site style trees.

The pages of a host are merged into one tree whose nodes are the elements that share a path of presentation styles (tag,
class, id). Over the host's distinct pages every node has a distribution of contents and one of presentations (which
children it shows); their entropies, over the largest possible one, are the node's importance: menus and notices that are
the same on every page have none, and those dealt from a small stock have less than the article beside them. A node is
judged by its importance alone and by that of its siblings. Styles are a prior: what calls itself navigation, advert, form or
reader comment has no importance to begin with, nor have branches outside the article of a page that marks one. Branches
of low importance are removed from each page; what is left is its text, block by block.

Parsing and judging take time and memory in proportion to a page's length, however deep or broken its markup is.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import arrow_map, read_table, stored

#: A node is judged by entropy from so many distinct pages on. It is noise when its importance is below LOW, or below
#: RELATIVE of its most important sibling's while it holds less than half of the text of all siblings.
MIN_PAGES, LOW, RELATIVE = 8, 0.35, 0.98
#: Noise nodes up to this number are broadcast (8 bytes each); more are joined to the pages that have them.
BROADCAST_NODES = 2_000_000

#: Fixed values of HTML.
_BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math object canvas audio video".split())
_CLOSES_P = _BLOCKS - {"button", "caption", "option", "optgroup", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "html"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "p": {"p"}}
_BARRIERS = frozenset("table ul ol dl article section main aside nav header footer div form body html blockquote".split())
#: What styles say of themselves: tags, and names (a class or an id) made of these words and of words that only place them.
_NOISE_TAGS = frozenset("nav footer aside form button select fieldset dialog menu search".split())
_NOISE_WORDS = frozenset("ad ads adsbygoogle advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs footer sidebar aside cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription signup login search form comment comments commentlist disqus replies reply respond share sharing social related recommended widget widgets toolbar pagination pager skip".split())
_PLACE_WORDS = frozenset("site page main global top bottom left right center primary secondary first second user reader post posts article articles entry single area list box container wrapper wrap outer inner section block bar item items link links button buttons panel module region group row col column unit slot holder thread body head title text field fields policy icons icon bar".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: Elements that no class or id makes noise, and the names by which an article inside another one is a reader's comment.
_WHOLE_TAGS = frozenset("html body main article".split())
_COMMENTS = frozenset("comment comments reply".split())
_HEADER_NAMES = frozenset("header masthead page-header site-header main-header top-header".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Headings and blocks of text, which entropy does not remove inside an article, and those that it removes nowhere.
_TEXT = _HEADINGS | frozenset("p ul ol li dl dt dd blockquote pre table caption thead tbody tfoot tr td th figure figcaption hgroup".split())
_PLAIN = _HEADINGS | frozenset("p blockquote pre li dt dd td th".split())

_TOKEN = re.compile(r"""<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>?""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


#: What an element's own style says: bits of Page.own.
NOISE, MAIN, HEADER = 1, 2, 4


@dataclass(slots=True)
class Page:
    """Blocks in page order, as (text, innermost element); of each element its tag, parent, hashed path and own style bits."""

    blocks: list[tuple[str, int]] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    paths: list[int] = field(default_factory=list)
    own: list[int] = field(default_factory=list)


def _named_noise(name: str) -> bool:
    """Whether a class or id is, as a whole, the name of noise: its words all name noise or a place, and one names noise."""
    words = [w.lower() for w in _WORDS.findall(name) if not w.isdigit()]
    return any(w in _NOISE_WORDS for w in words) and all(w in _NOISE_WORDS or w in _PLACE_WORDS for w in words)


def _style(tag: str, raw: str, inside: bool) -> tuple[str, int]:
    """An element's presentation style and what it says of itself; ``inside`` an article or not."""
    style, bits = tag, (NOISE if tag in _NOISE_TAGS else 0) | (HEADER if tag == "header" else 0) | (MAIN if tag in ("article", "main") else 0)
    if raw and not raw.isspace():
        said = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)}
        named = f"{said.get('class', '')} {said.get('id', '')}".split()
        role = said.get("role", "").lower()
        if tag == "article" and inside and any(re.sub(r"[-_]*[0-9]+", "", c).lower() in _COMMENTS for c in named):
            bits = NOISE
        elif tag not in _WHOLE_TAGS and any(map(_named_noise, named)):
            bits |= NOISE
        if role in _NOISE_ROLES or "hidden" in raw.lower().split() or "display:none" in said.get("style", "").replace(" ", "").lower():
            bits |= NOISE
        if any(c.lower() in _HEADER_NAMES for c in named):
            bits |= HEADER
        if role == "main" or said.get("itemprop", "") == "articleBody":
            bits |= MAIN
        if named:
            style += "." + ".".join(sorted(re.sub(r"[0-9]+", "#", w.lower()) for w in named))
    return style, bits


def parse(text: str) -> Page:
    """The blocks and elements of a page, however broken its markup is; a tag that never closes ends with its parent."""
    page, stack, buffer, at, n = Page(), [], [], 0, len(text)
    # open elements by tag, and those that stop the search for an element to close, as places in the stack
    opened: dict[str, list[int]] = {}
    walls: list[int] = []
    articles: list[int] = []

    def flush() -> None:
        if buffer:
            joined = "".join(buffer)
            joined = " ".join((html.unescape(joined) if "&" in joined else joined).split())
            if joined:
                page.blocks.append((joined, stack[-1] if stack else -1))
            buffer.clear()

    def close(tags: Iterable[str], far: bool = False) -> None:
        """End the innermost open element with one of ``tags``, if no wall (for ``far``: no body) stands before it."""
        place = max((opened[t][-1] for t in tags if opened.get(t)), default=-1)
        wall = max((opened[t][-1] for t in ("body", "html") if opened.get(t)), default=-1) if far else walls[-1] if walls else -1
        if place < 0 or place < wall:
            return
        for k in range(len(stack) - 1, place - 1, -1):
            opened[page.tags[stack[k]]].pop()
        del stack[place:]
        for held in (walls, articles):
            while held and held[-1] >= place:
                held.pop()

    while at < n:
        m = _TOKEN.search(text, at)
        if not m:
            buffer.append(text[at:])
            break
        if m.start() > at:
            buffer.append(text[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in _RAW:
            if not m[1] and not m[3].endswith("/"):
                end = _end_of(tag).search(text, at)
                at = end.end() if end else n
            continue
        if tag == "br":
            buffer.append(" ")
        if tag not in _BLOCKS:
            continue
        flush()
        if m[1]:
            close((tag,), tag in _BARRIERS)
            continue
        if tag in _CLOSES_P:
            close(("p",))
        if tag in _SIBLINGS and tag != "p":
            close(_SIBLINGS[tag])
        if tag in _HEADINGS:
            close(_HEADINGS)
        if tag in _VOID:
            continue
        up = stack[-1] if stack else -1
        style, bits = _style(tag, m[3], bool(articles))
        page.tags.append(tag)
        page.parents.append(up)
        page.paths.append(_hash(style, page.paths[up] if up >= 0 else 0))
        page.own.append(bits)
        opened.setdefault(tag, []).append(len(stack))
        if tag in _BARRIERS:
            walls.append(len(stack))
        if bits & MAIN:
            articles.append(len(stack))
        stack.append(len(page.tags) - 1)
    flush()
    return page


@lru_cache(maxsize=64)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)[^>]*>?", re.I)


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", (url or "").strip())
    return m[1].lower().rstrip(".") if m else ""


def _hash(x: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), seed)


_ALL = (1 << 64) - 1
_STEP, _TURN = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _mix(x: int) -> int:
    x = (x ^ (x >> 32)) * _TURN & _ALL
    return x ^ (x >> 29)


def node_ids(page: Page, host: str) -> list[int]:
    """The node of each element in the tree of its host."""
    site = _hash(host)
    return [_mix(p ^ site) for p in page.paths]


def flags(page: Page, priors: bool = True) -> tuple[list[bool], list[bool], list[bool]]:
    """(noise, main, header) of each element: its own style's and that of the elements around it.

    Where all of a page's articles stand in branches that styles call noise, or styles leave nothing of it, those styles are
    a wrapper's: they do not count for elements that hold an article, or a heading or another branch called noise.
    """
    n = len(page.tags)
    if not priors:
        return [False] * n, [False] * n, [False] * n
    own = page.own

    def spread(clear: list[bool] | None = None) -> tuple[list[bool], list[bool], list[bool]]:
        noise, main, header = [False] * n, [False] * n, [False] * n
        for k, up in enumerate(page.parents):
            inside = up >= 0 and main[up]
            main[k] = inside or bool(own[k] & MAIN)
            # a header inside the article keeps its headings
            noise[k] = (up >= 0 and noise[up]) or (not (clear and clear[k]) and (bool(own[k] & NOISE) or (bool(own[k] & HEADER) and not main[k])))
            header[k] = bool(own[k] & HEADER) or (inside and header[up])
        return noise, main, header

    noise, main, header = spread()
    if any(main):
        if all(noise[k] for k in range(n) if main[k]):
            holds = [bool(own[k] & MAIN) for k in range(n)]
            noise, main, header = spread(_upwards(page, holds))
    elif page.blocks and all(at >= 0 and noise[at] for _, at in page.blocks):
        holds = [False] * n
        for k in range(n):
            up = page.parents[k]
            if up >= 0 and (page.tags[k] in _HEADINGS or own[k] & (NOISE | HEADER)):
                holds[up] = True
        noise, main, header = spread(_upwards(page, holds))
    return noise, main, header


def _upwards(page: Page, holds: list[bool]) -> list[bool]:
    """``holds`` for every element that has a descendant for which it is true."""
    holds = list(holds)
    for k in range(len(holds) - 1, -1, -1):  # children come after their parents
        if holds[k] and page.parents[k] >= 0:
            holds[page.parents[k]] = True
    return holds


def observe(page: Page, host: str, priors: bool = True) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(node, parent's node, content, presentation, page, characters): what each of the page's nodes shows, all elements of
    one path together. Contents are hashed from the leaves up, so each text is looked at once."""
    n = len(page.tags)
    text, size = [0] * n, [0] * n
    noise, main, _ = flags(page, priors)
    whole = article = 0
    for t, at in page.blocks:
        h = _hash(t)
        whole = (whole * _STEP + h) & _ALL
        if at >= 0:
            text[at] = (text[at] * _STEP + h) & _ALL
            size[at] += len(t)
            if main[at] and not noise[at]:
                article = (article * _STEP + h) & _ALL or 1
    # one article in other wrappers is no other page
    whole = article or whole
    content: dict[int, int] = {}
    shape: dict[int, int] = {}
    chars: dict[int, int] = {}
    above: dict[int, int] = {}
    for k in range(n - 1, -1, -1):
        up, path = page.parents[k], page.paths[k]
        if path not in above:
            above[path] = page.paths[up] if up >= 0 else 0
            if up >= 0:
                shape[above[path]] = (shape.get(above[path], 0) + _mix(path)) & _ALL
        if size[k]:
            content[path] = (content.get(path, 0) * _STEP + _mix(text[k] or 1)) & _ALL
            chars[path] = chars.get(path, 0) + size[k]
            if up >= 0:
                text[up] = (text[up] * _STEP + _mix(text[k] ^ _TURN)) & _ALL
                size[up] += size[k]
    site = _hash(host)
    for path, c in content.items():
        yield _mix(path ^ site), _mix(above[path] ^ site), c, shape.get(path, 0), whole, chars[path]


def main_text(page: Page, low: list[bool], priors: bool = True) -> str:
    """The page's text without its low-importance branches; ``low`` says of each element whether its node is noise."""
    noise, main, header = flags(page, priors)
    gone = list(noise)
    for k, up in enumerate(page.parents):
        if up >= 0 and gone[up]:
            gone[k] = True
        elif low[k] and not gone[k]:
            tag, begins = page.tags[k], main[k] and not (up >= 0 and main[up])
            gone[k] = not (tag in _WHOLE_TAGS and (priors or tag in ("html", "body")) or begins or tag in _PLAIN or (main[k] and tag in _TEXT))
    marked = any(at >= 0 and main[at] and not noise[at] for _, at in page.blocks)
    out = []
    for t, at in page.blocks:
        if at < 0:
            if not marked:
                out.append(t)
        elif not (gone[at] or (marked and not main[at]) or (header[at] and main[at] and page.tags[at] not in _HEADINGS)):
            out.append(t)
    return "\n\n".join(out)


def importances(pages: DataFrame, priors: bool = True) -> DataFrame:
    """(node, up, m, importance, chars): of each node of the site trees its parent, on how many distinct pages it is, its
    importance and the characters it holds.

    Copies of a page count once. Contents of a node are counted per (node, content), so a host with a third of all pages
    is spread over its contents before it is summed. Importance is the larger of the two entropies over the logarithm of
    the number of distinct pages.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for url, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            host = host_of(url)
            rows += observe(parse(text or ""), host, priors) if host else []
        cols = np.array(rows, np.uint64).reshape(-1, 6).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(cols[:, k])) for k in range(6)], ["node", "up", "content", "shape", "page", "chars"])

    seen = arrow_map(pages.select("url", "html"), run, "node long, up long, content long, shape long, page long, chars long")
    once = stored(seen.dropDuplicates(["node", "page"]), "nodes")

    def entropy(column: str, *more: Column) -> DataFrame:
        counts = once.groupBy("node", column).agg(F.count("*").alias("n"), F.min("up").alias("up"), F.sum("chars").alias("chars"))
        sums = counts.groupBy("node").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"), F.min("up").alias("up"), F.sum("chars").alias("chars"))
        return sums.select("node", *more, F.coalesce(F.try_divide(F.log("m") - F.col("s") / F.col("m"), F.log("m")), F.lit(1.0)).alias(f"{column}_h"))

    both = entropy("content", F.col("up"), F.col("m"), F.col("chars")).join(entropy("shape"), "node")
    return both.select("node", "up", "m", F.greatest("content_h", "shape_h").alias("importance"), "chars")


def noise_nodes(pages: DataFrame, min_pages: int = MIN_PAGES, low: float = LOW, relative: float = RELATIVE, priors: bool = True) -> DataFrame:
    """(node): the nodes whose importance is low, by itself or beside their siblings. A node of few pages is not judged."""
    known = stored(importances(pages, priors).where(F.col("m") >= min_pages), "importances")
    beside = known.groupBy("up").agg(F.max("importance").alias("best"), F.sum("chars").alias("all_chars"))
    below = (F.col("importance") < relative * F.col("best")) & (2 * F.col("chars") < F.col("all_chars"))
    return known.join(beside, "up").where((F.col("importance") < low) | below).select("node")


def extract(
    pages: DataFrame, min_pages: int = MIN_PAGES, low: float = LOW, broadcast_nodes: int = BROADCAST_NODES, relative: float = RELATIVE, priors: bool = True
) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html).

    Null html is empty, so its text is. A null or hostless URL has no site: its page is judged by styles alone. Repeated
    rows each get a row. Extra columns are left out. Pages are read whole, whatever their length. Without ``priors`` styles
    and article marks say nothing, and importance alone decides.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    nodes = stored(noise_nodes(pages, min_pages, low, relative, priors), "noise")
    schema = "page_id long, url string, text string, n_chars long"

    def out(batch: pa.RecordBatch, low_of: Callable[[int, list[int]], list[bool]]) -> pa.RecordBatch:
        texts = []
        for k, (u, t) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            page, host = parse(t or ""), host_of(u)
            texts.append(main_text(page, low_of(k, node_ids(page, host)) if host else [False] * len(page.tags), priors))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    if nodes.limit(broadcast_nodes + 1).count() <= broadcast_nodes:
        known = np.sort(nodes.toArrow().column(0).to_numpy().view(np.uint64))
        shared = pages.sparkSession.sparkContext.broadcast(known.tobytes())

        def low_of(k: int, ids: list[int]) -> list[bool]:
            held = np.frombuffer(shared.value, np.uint64)
            x = np.array(ids, np.uint64)
            return (held[np.minimum(np.searchsorted(held, x), len(held) - 1)] == x).tolist() if len(held) else [False] * len(ids)

        return arrow_map(pages, lambda b: out(b, low_of), schema)

    # each page asks for its own nodes, under a key of its content; what comes back is no more than the page has elements
    keys = [F.xxhash64("url", "html").alias("k1"), F.xxhash64("html", "url", F.lit(1)).alias("k2")]

    def ask(batch: pa.RecordBatch) -> pa.RecordBatch:
        k1, k2, ids = [], [], []
        for a, b, u, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            host = host_of(u)
            found = set(node_ids(parse(t or ""), host)) if host else ()
            ids += found
            k1 += [a] * len(found)
            k2 += [b] * len(found)
        return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(np.array(ids, np.uint64).view(np.int64))], ["k1", "k2", "node"])

    asked = arrow_map(pages.select(*keys, "url", "html"), ask, "k1 long, k2 long, node long")
    answers = asked.join(nodes, "node", "left_semi").groupBy("k1", "k2").agg(F.collect_set("node").alias("nodes"))
    joined = pages.select("*", *keys).join(answers, ["k1", "k2"], "left").select("page_id", "url", "html", "nodes")

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        own = [{x & _ALL for x in held or ()} for held in b.column(3).to_pylist()]
        return out(b, lambda k, ids: [x in own[k] for x in ids])

    return arrow_map(joined, each, schema)


def op10_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
