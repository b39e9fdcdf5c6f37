"""Main text of web pages by tag-path ratios (operator 2).

1. Each page is read once into blocks (text between block-level tags). Elements are nodes with a pointer to their parent,
   root-to-leaf tag paths are numbers (parent's path, tag, first class), so time and memory are linear in the page,
   however deep it nests. Text of elements that are never an article (navigation, footers, forms, scripts, hidden
   ones and the like) is not read.
2. For every path the text length, punctuation and link characters of its blocks are summed; its ratio is text without
   links by block, more with punctuation.
3. The sequence of the blocks' path ratios is smoothed with a Gaussian, and the smoothed ratio and the block's own
   text and punctuation are fused by their geometric mean, weighted by features of the path: inside an article or main
   element, under a class or id that names boilerplate.
4. Paths whose mean score reaches a share of the page's spread, and in them the blocks that reach it, are content; so is
   always the path that scores most.
5. The span of the article is filled: blocks under the article or main element of a content block, blocks that share a
   container with content, blocks between content blocks, headings before it; none of them under a class that names
   boilerplate, and outside article and main none that is mostly links.

Character references are decoded; white space in a block becomes one space; blocks are joined by a line feed in page
order. Null, empty and markup-only pages give an empty text; nothing is cut from long pages. Malformed markup (unclosed or
stray tags, comments and quotes, any depth) never fails. Pages of links alone give all their text. Equal scores are all
kept. One page is one row in and out, so repeated rows come out repeated, and an empty table gives an empty one. Extra
columns of the input are ignored.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridquarry.llm.common import frugal

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCT = re.compile(r"[.,;:!?。，、！？…]")

# ---- fixed HTML and MathML names ----------------------------------------------------------------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea title iframe template select annotation annotation-xml".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br "
    "object svg g text tspan math semantics mi mo mn ms mtext mspace mrow mfrac msqrt mroot msup msub msubsup munder mover munderover mstyle mpadded mphantom".split()
)
EXCLUDED = frozenset("nav footer aside form button dialog menu fieldset head".split())
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre figure figcaption table tr thead tbody tfoot caption td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
HOLDS_P = frozenset("div article section td th li body main button".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
# -------------------------------------------------------------------------------------------------------------------
#: Words of class and id names that mark boilerplate, and words beside them that say nothing of the content.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot adbox banner promo promotion sponsor sponsored sidebar rail menu nav navbar navigation breadcrumb breadcrumbs footer "
    "masthead topbar cookie cookies notice consent gdpr popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus respond reply "
    "replies related recommended share sharing social widget toolbar pagination pager copyright disclaimer alert skip search".split()
)
PLAIN = frozenset("area bar block box bottom button buttons column container content form group header holder icons inner item items left links list main outer page panel right row section site slot text the top unit wrap wrapper".split())
ENDS = ("nav", "menu", "sidebar", "footer", "banner", "comments", "popup")
#: Words of reader comments, and words that only tell what an element has beside it ("with-sidebar").
READERS = frozenset("comment comments reply replies respond".split())
ABOUT = frozenset("has with no without".split())
#: Weights of a block inside an article or main element, and under a class that names boilerplate.
INSIDE, MARKED = 4.0, 0.005
#: Worth of a character of a text without punctuation.
PROSE = 0.25


def _named(value: str, inside: bool) -> tuple[bool, bool]:
    """Whether a class or id names boilerplate, and whether reader comments: a name does whose last word, or all words but plain ones, are marks."""
    marked = readers = False
    for name in value.split():
        words = [w.lower() for w in _WORD.findall(name)]
        if not words or ABOUT & set(words):
            continue
        telling = [w for w in words if w not in PLAIN]
        own = words[-1] in MARKS or bool(telling) and all(w in MARKS for w in telling) or words[-1].endswith(ENDS)
        own |= words[-1] == "header" and not inside and not {"article", "entry", "post", "story"} & set(words)
        marked |= own
        readers |= own and bool(READERS & set(words) or words[-1].endswith("comments"))
    return marked, readers


class Page:
    """Block-level elements as nodes (0 is the page itself; parents come before children) and the blocks of text."""

    def __init__(self, page: str):
        self.tag, self.parent, self.path, self.depth = ["html"], [-1], [0], [0]
        self.excluded, self.article = [False], [-1]  # of the node or above it; the nearest article or main element
        self.mark, self.reader, self.cell = [False], [False], [False]
        self.node: list[int] = []
        self.text: list[str] = []
        self.links: list[int] = []
        self._paths: dict[tuple[int, str, str], int] = {}
        self._read(page)

    def _open(self, up: int, tag: str, attrs: str) -> int:
        inside, name, marked, readers = self.article[up] >= 0, "", False, False
        excluded = self.excluded[up] or tag in EXCLUDED or tag == "header" and not inside
        if attrs:
            excluded |= bool(_HIDDEN.search(attrs)) and tag not in ("html", "body")
            for key, a, b, c in _ATTR.findall(attrs):
                key, value = key.lower(), a or b or c
                if key == "role":
                    excluded |= value.lower() in ROLES
                elif key in ("class", "id") and value:
                    name = name or value.split()[0] if value.split() else name
                    m, r = _named(value, inside)
                    marked, readers = marked or m, readers or r
        if tag in ("html", "body") or tag in ("article", "main") and not readers:
            marked = False
        n = len(self.tag)
        if tag in ("h1", "article", "main") and not marked:  # what holds these is no boilerplate
            e = up
            while e >= 0 and self.mark[e] and not (self.reader[e] and tag != "h1"):
                self.mark[e] = False
                e = self.parent[e]
        if tag not in ("td", "th") and self.tag[up] in ("td", "th") and tag not in ("tr", "tbody"):
            self.cell[up] = True
        self.tag.append(tag)
        self.parent.append(up)
        self.path.append(self._paths.setdefault((self.path[up], tag, name), len(self._paths) + 1))
        self.depth.append(self.depth[up] + 1)
        self.excluded.append(excluded)
        self.article.append(n if tag in ("article", "main") and not marked else self.article[up])
        self.mark.append(marked)
        self.reader.append(readers)
        self.cell.append(False)
        return n

    def _read(self, page: str) -> None:
        stack, count = [0], {"html": 1}
        p_at, li_at = [-1], [-1]  # places in the stack of the p and li that a new element may close
        text: list[str] = []
        links, link_at, hidden, hidden_at, hides = 0, -1, "", 0, 0  # open link and hidden inline element

        def flush() -> None:
            nonlocal links
            if text:
                words = html.unescape("".join(text)).split()
                if words:
                    self.node.append(stack[-1])
                    self.text.append(" ".join(words))
                    self.links.append(links)
                text.clear()
            links = 0

        def add(part: str) -> None:
            nonlocal links
            if not self.excluded[stack[-1]] and not hides:
                text.append(part)
                if link_at >= 0:
                    links += len(part)

        def cut(size: int) -> None:
            nonlocal link_at, hides
            for n in stack[size:]:
                count[self.tag[n]] -= 1
            del stack[size:], p_at[size:], li_at[size:]
            if link_at >= size:
                link_at = -1
            if hidden_at >= size:
                hides = 0

        pos, last = 0, page.rfind(">")  # no tag ends beyond it, so none is looked for
        while pos <= last and (m := _TAG.search(page, pos)):
            if m.start() > pos:
                add(page[pos : m.start()])
            pos = m.end()
            tag = m[2] or m[5]
            if not tag:
                continue
            tag, closing, attrs = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
            if tag in RAW:
                if not closing and not attrs.rstrip().endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(page, pos)
                    pos = end.end() if end else len(page)
                continue
            if tag in INLINE:
                if tag == "br":
                    text.append(" ")
                elif tag == "a":
                    link_at = -1 if closing else len(stack) - 1
                if hides and tag == hidden:
                    hides += -1 if closing else 1
                elif not closing and tag not in VOID and not hides and attrs and _HIDDEN.search(attrs):
                    hidden, hidden_at, hides = tag, len(stack) - 1, 1
                continue
            flush()
            if closing:
                if count.get(tag, 0) and len(stack) > 1:
                    at = len(stack) - 1
                    while at > 0 and self.tag[stack[at]] != tag:
                        at -= 1
                    if at > 0:
                        cut(at)
                continue
            if tag in VOID:
                continue
            if tag in CLOSES_P and p_at[-1] >= 0:
                cut(p_at[-1])
            if tag == "li" and li_at[-1] >= 0:
                cut(li_at[-1])
            at = len(stack)
            p_at.append(at if tag == "p" else -1 if tag in HOLDS_P else p_at[-1])
            li_at.append(at if tag == "li" else -1 if tag in ("ul", "ol") else li_at[-1])
            stack.append(self._open(stack[-1], tag, attrs))
            count[tag] = count.get(tag, 0) + 1
        if pos < len(page):
            rest = page[pos:]
            tail = rest.rfind("<")  # an unfinished tag at the end
            add(rest[:tail] if tail >= 0 and re.match(r"<[/!a-zA-Z]", rest[tail:]) else rest)
        flush()

    def marked(self) -> list[bool]:
        """For each block, whether a class above it names boilerplate."""
        out: list[bool] = []
        for m, up in zip(self.mark, self.parent):
            out.append(m or up >= 0 and out[up])
        return [out[n] for n in self.node]

    def containers(self) -> list[int]:
        """For each block, the nearest element above it that is not one of text alone."""
        out: list[int] = []
        for n, (tag, up) in enumerate(zip(self.tag, self.parent)):
            out.append(out[up] if tag in LEAF and not self.cell[n] else n)
        return [out[n] for n in self.node]

    def meet(self, a: int, b: int) -> int:
        """The deepest element above both; takes as many steps as there are tags between them."""
        while a != b:
            if self.depth[a] >= self.depth[b]:
                a = self.parent[a]
            else:
                b = self.parent[b]
        return a


def scores(page: Page, weights: list[float], sigma: float = 1.0, reach: int = 2) -> list[float]:
    """Fused tag-path ratios of the blocks."""
    sums: dict[int, list[float]] = {}
    paths = [page.path[n] for n in page.node]
    own = []
    for p, text, link in zip(paths, page.text, page.links):
        n, q, ln = len(text), len(_PUNCT.findall(text)), min(link, len(text))
        own.append((n - ln) * (PROSE + math.log1p(q)))
        s = sums.setdefault(p, [0.0, 0.0, 0.0, 0.0])
        s[0] += n
        s[1] += q
        s[2] += ln
        s[3] += 1
    ratio = {p: (n - ln) / k * (PROSE + math.log1p(q / k)) for p, (n, q, ln, k) in sums.items()}
    raw = [ratio[p] for p in paths]
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(raw)):
        lo, hi = max(0, i - reach), min(len(raw), i + reach + 1)
        k = kernel[lo - i + reach : hi - i + reach]
        smooth = sum(w * x for w, x in zip(k, raw[lo:hi])) / sum(k)
        out.append(weights[i] * math.sqrt(smooth * own[i]))
    return out


def content(page: Page, weights: list[float], share: float) -> list[bool]:
    """The blocks that reach the limit, of paths whose mean does: a share of the page's spread, but never above the mean of the path that scores most in all."""
    fused = scores(page, weights)
    sums: dict[int, list[float]] = {}
    for n, x in zip(page.node, fused):
        s = sums.setdefault(page.path[n], [0.0, 0.0])
        s[0] += x
        s[1] += 1
    means = {p: x / n for p, (x, n) in sums.items()}
    mean = sum(fused) / len(fused)
    limit = min(share * math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused)), means[max(sums, key=lambda p: sums[p][0])])
    return [0 < x >= limit <= means[page.path[n]] for n, x in zip(page.node, fused)]


def main_text(text: str | None, share: float = 0.7) -> str:
    """The text of a page's article; see the module's text."""
    page = Page(text or "")
    if not page.node:
        return ""
    marked, holds = page.marked(), page.containers()
    inside = [page.article[n] for n in page.node]
    weights = [(INSIDE if a >= 0 else 1.0) * (MARKED if m else 1.0) for a, m in zip(inside, marked)]
    chosen = content(page, weights, share)
    at = [i for i, c in enumerate(chosen) if c]
    if not at:
        return "\n".join(page.text)
    held, articles = {holds[i] for i in at}, {inside[i] for i in at if inside[i] >= 0}
    keep = set(at)
    for i, m in enumerate(marked):
        if not m and inside[i] in articles:
            keep.add(i)
        elif not m and 2 * page.links[i] <= len(page.text[i]):
            if holds[i] in held or i < at[0] and page.tag[page.node[i]] == "h1":
                keep.add(i)
    for a, b in zip(at, at[1:]):
        if b - a > 1:
            top = page.tag[page.meet(holds[a], holds[b])] in ("html", "body")
            for i in range(a + 1, b):
                if not marked[i] and 2 * page.links[i] <= len(page.text[i]) and (not top or page.tag[page.node[i]] in HEADINGS):
                    keep.add(i)
    return "\n".join(page.text[i] for i in sorted(keep))


def _extract(batches):
    for b in batches:
        ids, urls, pages = (b.column(i) for i in range(3))
        texts = [main_text(p) for p in pages.to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html)."""
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        frugal(_extract), "page_id long, url string, text string, n_chars long"
    )
