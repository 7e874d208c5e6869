"""Main text of web pages by tag-path ratios.

A page's text nodes are grouped by their root-to-leaf tag path. Each path has the characters and the punctuation of its
nodes; both ratios (per node) are smoothed with those of the paths below the same parent and fused by a product. Paths
of boilerplate stand apart and have a prior: their ratio is multiplied by ``PRIOR``. The paths above a share of the
page's mean ratio are content, all of which is returned. Content also pulls in its surroundings: an article or main
element that holds any gives all its blocks, and the deepest element that holds all of it gives what stands beside
content, or beside what holds content, below one parent. So short paragraphs and headings of the article are kept.
What is boilerplate is never pulled in.

Boilerplate is known by tag, class, id or role: menus, headers, footers, sidebars, notices, adverts, forms, comments of
readers. Class, id and role only mark: a marked element that holds an article or main isn't boilerplate, unless it holds
readers' comments, and neither is one that holds most of the text of a page without an article or main outside such
elements. The contents of scripts and styles are no text. Unclosed tags are tolerated in the manner of browsers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flush_rows, rows_of

#: Elements whose text is never main text.
NOISE_TAGS = frozenset(
    "head nav header footer aside form button select option textarea input label fieldset template dialog menu svg canvas object "
    "iframe noscript audio video map datalist".split()
)
#: Elements whose content is not markup, up to their own end tag.
RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that don't end a block.
INLINE_TAGS = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub "
    "sup time tt u var".split()
)
#: Other tags that don't end a block either, as nothing of them is shown or they stand in a line.
SILENT_TAGS = frozenset("wbr img script style noscript".split())
#: Start tags that end an open paragraph.
CLOSE_P = frozenset(
    "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main nav ol p pre section table ul".split()
)
#: Items that end an open one of their own kind, and where the search for it stops.
CLOSE_OWN = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"},
             "th": {"tr", "table"}, "option": {"select"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}}
#: Words of a class, id or role that mark boilerplate.
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners comment "
    "comments disqus respond replies sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead "
    "cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login social share sharing related "
    "recommended recommendations popup modal overlay widget widgets toolbar pagination pager search contentinfo complementary skip".split()
)
#: Those of them whose articles are readers' comments, and first words that only tell of a layout.
COMMENT_WORDS = frozenset("comment comments disqus respond replies".split())
LAYOUT_WORDS = frozenset("has have no not with without".split())
#: Elements whose ids are often made from their titles; a section's counts outside articles.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Where the search for an open paragraph stops, and items that close each other.
P_STOPS = frozenset("table td th button".split())
ALIKE = (("dt", "dd"), ("td", "th"))
#: Blocks that can't be the container of an article.
LEAF_BLOCKS = frozenset("p pre li dt dd td th tr h1 h2 h3 h4 h5 h6 blockquote".split())
#: Elements nested deeper count as part of the element at this depth, as in browsers.
MAX_DEPTH = 256
#: Elements that a class can't mark as boilerplate, being the page or its article.
KEPT_TAGS = frozenset("html body main article".split())
CONTAINERS = frozenset("article main".split())

#: A path is content where its fused ratio is at least this share of the page's mean, weighted by characters.
THRESHOLD = 0.2
#: What a ratio counts for in boilerplate, and the least ratio of content: a character a node.
PRIOR, LEAST = 1e-6, 1.0
#: What paths of boilerplate start with.
APART = "!"

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?--!?>|.*)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<([a-zA-Z][^\s/<>]*)([^<>]*)>"
    r"|</?[a-zA-Z][^<>]*\Z",  # a tag that the end of the page cuts off
    re.S,
)
_MARKED = re.compile(r"(?:^|[\s/\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|[\s/\"'])hidden(?:[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORDS = re.compile(r"(?<![a-z0-9])[a-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。、،؛؟]")
_SPACE = re.compile(r"\s+")


def _is_noise(tag: str, attrs: str) -> bool:
    if tag in NOISE_TAGS:
        return True
    return bool(attrs) and tag not in KEPT_TAGS and bool(_HIDDEN.search(attrs))


def _noise_words(tag: str, attrs: str, in_article: bool) -> set[str]:
    """The last words of an element's class names, id and role that mark boilerplate; of an article, those of comments, first words too."""
    out: set[str] = set()
    if not attrs or (tag in KEPT_TAGS and tag != "article"):
        return out
    for m in _MARKED.finditer(attrs):
        if m[1].lower() == "id" and (tag in HEADINGS or (tag == "section" and in_article)):
            continue
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            parts = _WORDS.findall(name)
            if tag == "article":
                out.update(COMMENT_WORDS.intersection(parts[:1] + parts[-1:]) if parts and parts[0] not in LAYOUT_WORDS else ())
            elif parts and parts[-1] in NOISE_WORDS and parts[0] not in LAYOUT_WORDS:
                out.add(parts[-1])
    return out


#: In place of stops: nothing stops the search, or any element that isn't inline does.
NO_STOPS: frozenset[str] = frozenset()
BLOCKS: frozenset[str] = frozenset({""})


class _Mark:
    """An element marked as boilerplate by words: the marked one around it, its characters, whether an article lies below."""

    __slots__ = ("up", "comments", "chars", "article", "kept")

    def __init__(self, up, comments):
        self.up, self.comments, self.chars, self.article, self.kept = up, comments, 0, False, False


class _Open:
    """An open element: its tag path, whether it is boilerplate, the nearest mark, and its nearest non-inline node (number, parent, tag)."""

    __slots__ = ("tag", "path", "noise", "mark", "node", "depth", "article")

    def __init__(self, tag, path, noise, mark, node, depth, article):
        self.tag, self.path, self.noise, self.mark, self.node, self.depth, self.article = tag, path, noise, mark, node, depth, article


class _Stack:
    """The open elements. Counts by tag spare the search for an element that isn't open."""

    def __init__(self):
        self.all = [_Open("", "", False, None, (0, None, ""), 0, False)]
        self.count: Counter[str] = Counter()

    @property
    def top(self) -> _Open:
        return self.all[-1]

    def push(self, e: _Open) -> None:
        self.all.append(e)
        self.count[e.tag] += 1

    def close(self, tags: tuple[str, ...], stops: frozenset[str] | set[str]) -> None:
        """Close the nearest element of these tags with all inside it, unless a stop lies nearer."""
        if not any(self.count[t] for t in tags):
            return
        for k in range(len(self.all) - 1, 0, -1):
            tag = self.all[k].tag
            if tag in tags:
                for e in self.all[k:]:
                    self.count[e.tag] -= 1
                del self.all[k:]
                return
            if tag in stops or (stops is BLOCKS and tag not in INLINE_TAGS):
                return


def text_nodes(html: str, max_depth: int | None = MAX_DEPTH) -> Iterator[tuple[int, str, tuple, str]]:
    """(block number, tag path, node, text) of the text nodes in page order; paths of boilerplate start with ``APART``."""
    marks: list[_Mark] = []
    found = list(_unmarked(html, marks, max_depth))
    if marks:
        total, clean = 0, False
        for *_, text, noise, mark, in_article in found:
            if noise:
                continue
            n = len(text.strip())
            total += n
            if mark is not None:
                mark.chars += n
            elif in_article and n:
                clean = True
        for m in reversed(marks):  # those inside come later
            if m.up is not None:
                m.up.chars += m.chars
        for m in marks:
            m.kept = ((m.article and not m.comments) or (not clean and 2 * m.chars > total)) and (m.up is None or m.up.kept)
    for number, path, node, text, noise, mark, _ in found:
        yield number, APART + path if noise or (mark is not None and not mark.kept) else path, node, text


def _unmarked(html: str, marks: list[_Mark], max_depth: int | None) -> Iterator[tuple[int, str, tuple, str, bool, _Mark | None, bool]]:
    """The text nodes with whether they are boilerplate by tag or hidden, their mark, and whether an article holds them.

    ``marks`` takes the marked elements in page order.
    """
    stack = _Stack()
    block, at, serial, n = 0, 0, 0, len(html)
    while at <= n:
        m = _TOKEN.search(html, at)
        end = m.start() if m else n
        top = stack.top
        if end > at:
            yield block, top.path, top.node, html[at:end], top.noise, top.mark, top.article
        if m is None:
            return
        at = m.end()
        close, name, attrs = m[1], m[2] or m[4], m[3] or m[5] or ""
        if close:
            tag = close.lower()
            inline = tag in INLINE_TAGS or tag in SILENT_TAGS
            block += not inline
            stack.close((tag,), BLOCKS if inline else NO_STOPS)
        elif name:
            tag = name.lower()
            inline = tag in INLINE_TAGS or tag in SILENT_TAGS
            block += not inline
            if tag in RAW_TAGS:
                stop = _end_of(tag).search(html, at)
                at = stop.end() if stop else n
                continue
            if tag in VOID_TAGS:
                continue
            if tag in CLOSE_P:
                stack.close(("p",), P_STOPS)
            elif tag in CLOSE_OWN:
                stack.close(next((g for g in ALIKE if tag in g), (tag,)), CLOSE_OWN[tag])
            top = stack.top
            noise, mark = top.noise or _is_noise(tag, attrs), top.mark
            marking = () if noise else _noise_words(tag, attrs, top.article)
            if marking:
                mark = _Mark(mark, not marking.isdisjoint(COMMENT_WORDS))
                marks.append(mark)
            elif not noise and tag in CONTAINERS:
                while mark is not None and not mark.article:
                    mark.article, mark = True, mark.up
                mark = top.mark
            if inline or (max_depth is not None and top.depth >= max_depth):
                path, node, depth = top.path, top.node, top.depth
            else:
                serial += 1
                path, node, depth = f"{top.path}/{tag}", (serial, top.node, tag), top.depth + 1
            stack.push(_Open(tag, path, noise, mark, node, depth, top.article or tag in CONTAINERS))


@lru_cache
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I)


def content_paths(stats: dict[str, list[float]], threshold: float = THRESHOLD) -> set[str]:
    """The paths whose smoothed and fused ratios pass; ``stats``: nodes, characters and punctuation by path.

    The mean is over the characters of all paths, those of boilerplate counting by their prior.
    """
    family: dict[str, list[float]] = {}
    for path, (n, c, p) in stats.items():
        f = family.setdefault(path.rpartition("/")[0], [0, 0, 0])
        f[0] += n
        f[1] += c
        f[2] += p
    fused, weight, mean = {}, 0.0, 0.0
    for path, (n, c, p) in stats.items():
        fn, fc, fp = family[path.rpartition("/")[0]]
        prior = PRIOR if path.startswith(APART) else 1.0
        fused[path] = prior * (0.5 * c / n + 0.5 * fc / fn) * (1 + 0.5 * p / n + 0.5 * fp / fn)
        weight += prior * c
        mean += prior * c * fused[path]
    least = max(LEAST, threshold * mean / weight) if weight else LEAST
    return {k for k, v in fused.items() if v >= least}


def main_text(html: str | None, max_depth: int | None = MAX_DEPTH) -> str:
    """The main text of a page; empty where it has none. Elements nested beyond ``max_depth`` count as that deep; None: any depth."""
    blocks: list[list] = []  # number, path, node, pieces
    last: dict[bool, list] = {}  # boilerplate inside a line doesn't cut the block
    for number, path, node, text in text_nodes(html or "", max_depth):
        here = last.get(path.startswith(APART))
        if here and here[0] == number:
            here[3].append(text)
        elif text.strip():
            blocks.append([number, path, node, [text]])
            last[path.startswith(APART)] = blocks[-1]
    clean = []
    for _, path, node, pieces in blocks:
        text = _SPACE.sub(" ", unescape("".join(pieces))).strip()
        if text:
            clean.append((path, node, text))
    if not clean:
        return ""
    stats: dict[str, list[float]] = {}
    for path, _, text in clean:
        s = stats.setdefault(path, [0, 0, 0])
        s[0] += 1
        s[1] += len(text)
        s[2] += len(_PUNCTUATION.findall(text))
    content = content_paths(stats)
    if not content:
        return ""
    # characters of content below each node: a parent's number is lower than its children's
    held: dict[int, int] = {}
    nodes: dict[int, tuple] = {}
    for path, node, text in clean:
        if path in content:
            held[node[0]] = held.get(node[0], 0) + len(text)
        while node is not None and node[0] not in nodes:
            nodes[node[0]] = node
            node = node[1]
    for k in sorted(nodes, reverse=True):
        if k and k in held:
            up = nodes[k][1][0]
            held[up] = held.get(up, 0) + held[k]
    # nested nodes that hold all content: the last one opened is the deepest
    chosen = max((k for k, v in held.items() if v == held[0] and nodes[k][2] not in LEAF_BLOCKS), default=0)
    inside: dict[int, bool] = {}
    whole: dict[int, bool] = {}
    for k in sorted(nodes):
        up = nodes[k][1][0] if k else 0
        inside[k] = k == chosen or (k > 0 and inside[up])
        whole[k] = (k in held and nodes[k][2] in CONTAINERS) or (k > 0 and whole[up])
    above: set[str] = set()
    for c in content:
        while c and (c := c.rpartition("/")[0]) not in above:
            above.add(c)
    return " ".join(
        text for path, node, text in clean
        if path in content or (not path.startswith(APART) and (whole[node[0]] or (inside[node[0]] and path.rpartition("/")[0] in above)))
    )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row; one pass without a shuffle.

    A null or empty html, or one without main text, gives an empty text; pages of any length are read whole. Repeated
    rows and null ids are kept. An empty table gives no row; columns other than these three aren't read.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for page_id, url, html in rows_of(b, "page_id", "url", "html"):
                    text = main_text(html)
                    yield page_id, url, text, len(text)

        yield from flush_rows(schema, rows(), 500)

    cols = [F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")]
    return pages.select(*cols).mapInArrow(run, "page_id long, url string, text string, n_chars long")
