"""Main text of web pages by tree scoring (operator 10).

A page is read into a tree of elements in page order. Elements that are never part of an article
(menus, headers, footers, sidebars, notices, adverts, forms, scripts, comments) are left out by tag,
role or class. A name only leaves out what is not the article itself: an element around the page's largest
article or main element stays, as does, on a page without these, one that holds most of the unlinked text; paragraphs, headings, list items
and cells stay whatever their names; and a result that is empty or a
small share of the paragraphs is made again without the names. Inside a block, inline elements go by tag, role, style or a name that says
advert. Every block of text then earns points for its length and its commas, and passes
them to its container in full, to the next ancestor by half and to further ones by less; an
ancestor's sum is discounted by the share of its text that stands in links. The best container
(widened to the article element around it), the text elements and sections that lie next to it without a break, and those siblings that
score like it or read like its paragraphs are kept, and their blocks leave in page order. Inside an article element nothing is judged by its links.

Pages are independent, so the work is one Arrow-batched pass without a shuffle.

Defined results: null or empty html gives an empty text; a page without tags is one block; unclosed
and stray tags are repaired as browsers do; a tag left open at the end of the page is text; where a quoted
value isn't closed before the page ends, quotes count as other characters from there on; the time grows with the length of the page alone; other
columns are not read; null page_id or url stay null; rows that repeat are extracted each.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession

from .common import read_table

# Fixed values of the HTML standard: elements by how they are parsed.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math select object video audio canvas".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary
table tbody td tfoot th thead tr ul option optgroup caption""".split())
CLOSES = {  # an open element (key's value) ends where the key begins, up to the nearest stop element
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}), "body": ({"head"}, {"html"}),
}
# What is no part of an article.
DROP_TAGS = frozenset("nav footer aside form dialog menu fieldset button label head search".split())
DROP_ROLES = frozenset("navigation banner complementary contentinfo search form alert alertdialog dialog menu menubar toolbar".split())
DROP_WORDS = frozenset("""ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation
menu breadcrumb breadcrumbs sidebar side aside footer masthead header topbar toolbar comment comments disqus discussion respond
reply replies notice cookie cookies consent gdpr banner popup modal overlay alert newsletter subscribe subscription signup login
share sharing social related recommended recommendations widget pagination pager skip""".split())
SEMANTIC_DROP_WORDS = frozenset("comment comments ad ads advert advertisement sponsored promo related reply".split())
INLINE_DROP_WORDS = frozenset("ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th tr tbody thead caption figcaption summary".split())   # names don't count on these
BESIDE = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure section".split())   # kept next to the best container
RIGHTS = re.compile(r"\s*(?:©|\(c\)|copyright\b)", re.I)
MODIFIERS = frozenset("has no not with without hide show".split())   # a name's words behind these are not its own
MOST, MOST_SEMANTIC = 0.5, 0.9   # share of the unlinked text from which a named element is the article
SMALL = 0.25                     # share of the paragraphs below which a result is made again without names
START = {"div": 5.0, "article": 10.0, "main": 8.0, "section": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0,
         "ul": -3.0, "ol": -3.0, "dl": -3.0, "th": -5.0}
SHARES = (1.0, 0.5, 1 / 6, 1 / 9)   # of a block's points, from its container upward
PARAGRAPH = 25                      # characters from which a block earns a point for itself
_OTHER = r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*>|</[^a-zA-Z][^>]*>"
TAG = re.compile(_OTHER + r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>""", re.S)
PLAIN_TAG = re.compile(_OTHER + r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)      # quotes don't hide a >
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def _dropped(tag: str, attributes: str, in_article: bool) -> tuple[bool, int]:
    """Whether tag, role or style say that an element is no part of an article; whether its names do (1, or 2 for ``SEMANTIC_DROP_WORDS``)."""
    if tag in DROP_TAGS or tag == "header" and not in_article:
        return True, 0
    if not attributes or tag in ("html", "body"):
        return False, 0
    words = set()
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN.search(value):
            return True, 0
        if name == "role" and value.strip().lower() in DROP_ROLES:
            return True, 0
        if name in ("class", "id"):
            for part in value.split():
                for w in WORDS.findall(part):
                    if (w := w.lower()) in MODIFIERS:
                        break
                    words.add(w)
    if tag not in BLOCK:
        return not words.isdisjoint(INLINE_DROP_WORDS), 0
    if tag in TEXT_TAGS:
        return False, 0
    if not words.isdisjoint(SEMANTIC_DROP_WORDS):
        return False, 2
    return False, int(tag not in ("article", "main", "header") and not words.isdisjoint(DROP_WORDS))


class Page:
    """Elements in page order (so a subtree is a range) and the blocks of text they hold."""

    def __init__(self, source: str):
        self.tag, self.parent, self.end, self.drop = ["#page"], [-1], [0], [False]
        self.named = [0]
        self.blocks: list[tuple[int, str, int]] = []   # container, text, characters in links
        self.links: list[int] = []                     # links, ascending
        self._stack, self._open, self._text = [0], {}, []
        self._block = [0]                              # nearest block element of each element, itself included
        self._in_link = self._articles = 0
        self._read(source)

    def _flush(self) -> None:
        if not self._text:
            return
        pieces, self._text = self._text, []
        here = self._block[self._stack[-1]]
        if not self.drop[here]:                        # else the block goes as a whole, later
            pieces = [(x, link) for x, link, dropped in pieces if not dropped]
        else:
            pieces = [(x, link) for x, link, _ in pieces]
        raw = "".join(x for x, _ in pieces)
        text = " ".join((_html.unescape(raw) if "&" in raw else raw).split())
        if not text:
            return
        linked = sum(len(" ".join((_html.unescape(x)).split())) for x, link in pieces if link)
        self.blocks.append((here, text, min(linked, len(text))))

    def _say(self, text: str) -> None:
        self._text.append((text, self._in_link > 0, self.drop[self._stack[-1]]))

    def _push(self, tag: str, attributes: str) -> None:
        up = self._stack[-1]
        self.tag.append(tag)
        self.parent.append(up)
        self.end.append(0)
        drop, named = _dropped(tag, attributes, self._articles > 0)
        self.drop.append(self.drop[up] or drop)
        self.named.append(named)
        self._block.append(len(self.tag) - 1 if tag in BLOCK else self._block[up])
        self._open.setdefault(tag, []).append(len(self._stack))
        self._stack.append(len(self.tag) - 1)
        if tag == "a":
            self._in_link += 1
            self.links.append(len(self.tag) - 1)
        elif tag in ("article", "main"):
            self._articles += 1

    def _pop(self) -> str:
        node = self._stack.pop()
        tag = self.tag[node]
        self.end[node] = len(self.tag)
        self._open[tag].pop()
        if tag == "a":
            self._in_link -= 1
        elif tag in ("article", "main"):
            self._articles -= 1
        return tag

    def _close(self, tags: set, stop: set) -> None:
        """End the nearest open element of ``tags``, unless one of ``stop`` is nearer."""
        at = max((self._open[t][-1] for t in tags if self._open.get(t)), default=0)
        if at and at > max((self._open[t][-1] for t in stop if self._open.get(t)), default=0):
            while len(self._stack) > at:
                self._pop()

    def _read(self, source: str) -> None:
        pos, size, last, pattern = 0, len(source), source.rfind(">") + 1, TAG
        while pos < size:
            at = source.find("<", pos)
            if at < 0 or at >= last and not source.startswith("<!--", at):     # no tag ends behind the last >
                self._say(source[pos:])
                break
            m = pattern.match(source, at)
            if m is None and pattern is TAG and source[at + 1:at + 2].isalpha() and source[at + 1].isascii():
                pattern = PLAIN_TAG         # a quote isn't closed: looked for once, not from every tag
                m = pattern.match(source, at)
            if m is None:
                self._say(source[pos:at + 1])
                pos = at + 1
                continue
            if at > pos:
                self._say(source[pos:at])
            pos = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag, closing = tag.lower(), bool(m[1])
            if tag in RAW:
                if not closing and not m[3].endswith("/"):
                    done = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, pos, last)
                    pos = done.end() if done else size
                self._say(" ")
                continue
            if tag in VOID:
                self._say(" ") if tag != "hr" else self._flush()
                continue
            if tag in BLOCK:
                self._flush()
            if closing:
                if self._open.get(tag):
                    self._close({tag}, set())
                continue
            if tag in BLOCK and self._open.get("p"):
                self._close({"p"}, {"button", "table", "td", "th", "article", "div", "section"})
            if tag in CLOSES:
                tags, stop = CLOSES[tag]
                if any(self._open.get(t) for t in tags):
                    self._close(tags, stop)
                    if tag == "tr":
                        self._close({"tr"}, stop)
            if tag == "a" and self._in_link:
                self._close({"a"}, set())
            self._push(tag, m[3])
        self._flush()
        while self._stack:
            self.end[self._stack.pop()] = len(self.tag)

    def _of_article(self) -> list[int]:
        """``named``, 0 for the elements that are or hold the article."""
        n = len(self.tag)
        chars = [0] * n                       # not in links
        for node, text, in_links in self.blocks:
            if not self.drop[node]:
                chars[node] += len(text) - in_links
        for node in range(n - 1, 0, -1):
            chars[self.parent[node]] += chars[node]
        articles = [i for i in range(n) if self.tag[i] in ("article", "main") and not self.drop[i] and self.named[i] < 2 and chars[i]]
        if articles:
            up, around = max(articles, key=lambda i: (chars[i], -i)), set()
            while up >= 0:
                around.add(up)
                up = self.parent[up]
            return [k and (0 if i in around and (k == 1 or chars[i] > MOST * chars[0]) else k) for i, k in enumerate(self.named)]
        return [k and (0 if chars[i] > (MOST if k == 1 else MOST_SEMANTIC) * chars[0] else k) for i, k in enumerate(self.named)]

    def main_text(self) -> str:
        if not any(self.named):
            return "\n".join(text for _, text, _ in self._best(self._blocks_without(None)))
        named, found = self._of_article(), []
        for least in (1, 2, 3):               # all names, the semantic ones, none
            blocks = self._blocks_without([k >= least for k in named])
            paragraphs = sum(len(text) - links for _, text, links in blocks if len(text) >= PARAGRAPH)
            kept = sum(len(text) - links for _, text, links in found if len(text) >= PARAGRAPH)
            # Comments may outweigh an article: semantic names fall only where nothing else is left.
            if not found or least == 2 and kept < SMALL * paragraphs:
                again = self._best(blocks)
                if sum(len(text) for _, text, _ in again) > sum(len(text) for _, text, _ in found):
                    found = again
        return "\n".join(text for _, text, _ in found)

    def _blocks_without(self, named: list[bool] | None) -> list[tuple[int, str, int]]:
        """Blocks outside what is left out, by names too."""
        drop = self.drop
        if named is not None:
            drop = list(drop)
            for node in range(1, len(drop)):
                drop[node] = drop[node] or named[node] or drop[self.parent[node]]
        return [b for b in self.blocks if not drop[b[0]]]

    def _best(self, blocks: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
        """The blocks of the best container and of what reads like it."""
        n = len(self.tag)
        if not blocks:
            return []
        own, linked = [0] * n, [0] * n
        score = [START.get(t, 0.0) for t in self.tag]
        scored = [False] * n
        for node, text, in_links in blocks:
            own[node] += len(text)
            linked[node] += in_links
            if self.tag[node][:1] == "h" and self.tag[node][1:].isdigit():
                continue
            points = (len(text) >= PARAGRAPH) + text.count(",") + text.count("，") + min(len(text) / 100, 3.0)
            up = self.parent[node] if self.tag[node] in ("p", "pre", "li", "dd", "dt", "blockquote", "figcaption", "summary") else node
            for share in SHARES:
                if up < 0:
                    break
                score[up] += points * share
                scored[up] = True
                up = self.parent[up]
        for node in range(n - 1, 0, -1):      # parents come before their children
            own[self.parent[node]] += own[node]
            linked[self.parent[node]] += linked[node]
        density = [l / o if o else 0.0 for l, o in zip(linked, own)]
        value = [s * (1 - d) if k else 0.0 for s, d, k in zip(score, density, scored)]
        best = max(range(n), key=lambda i: (scored[i], value[i], -i))
        up = best
        while up > 0:
            if self.tag[up] in ("article", "main"):
                best = up
                break
            up = self.parent[up]
        in_article = self.tag[best] in ("article", "main")
        keep = [(best, self.end[best])]
        if best and self.tag[best] not in ("body", "html"):
            least = max(10.0, 0.2 * value[best])
            children, node = [], self.parent[best] + 1
            while node < self.end[self.parent[best]]:
                children.append(node)
                node = self.end[node]
            here, beside = children.index(best), set()
            if not in_article:
                rights = {node for node, text, _ in blocks if RIGHTS.match(text)}
                for way in (children[here + 1:], children[:here][::-1]):
                    for node in way:
                        if own[node]:
                            if self.tag[node] not in BESIDE or density[node] >= 0.25 or node in rights:
                                break
                            beside.add(node)
            for node in children:
                if node != best and own[node] and (
                        node in beside or value[node] >= least and self.tag[node] == self.tag[best]
                        or self.tag[node] == "p" and (own[node] > 80 and density[node] < 0.25)):
                    keep.append((node, self.end[node]))
        kept = bytearray(n)
        for a, b in keep:
            kept[a:b] = b"\1" * (b - a)
        # Outside an article element, containers that hold little but two or more links go.
        kinds = ("ul", "ol", "dl", "div", "section", "table", "p", "center")
        for node in range(best + 1, n if not in_article else 0):
            if kept[node] and self.tag[node] in kinds and density[node] > 0.8 and \
                    bisect_left(self.links, self.end[node]) - bisect_left(self.links, node) >= 2:
                kept[node:self.end[node]] = bytes(self.end[node] - node)
        return [b for b in blocks if kept[b[0]]]


def main_text(source: str | None) -> str:
    return Page(source).main_text() if source else ""


def extract_main_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, text and n_chars (code points) of each page."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            texts = [main_text(x) for x in batch.column(html_col).to_pylist()]
            cols = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, type=pa.string()), pa.array([len(x) for x in texts], type=pa.int64())],
                                             names=[*keep, "text", "n_chars"])

    rows = pages.select(*keep, html_col)
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kinds}, text string, n_chars long")


def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read_table(spark, sf_dir, "pages"))


QUERIES = {"op10_page_text": op10_page_text}
ORACLES: dict[str, str] = {}
