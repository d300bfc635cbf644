"""Operator 10: main text of web pages by composite text density.

A page becomes a flat node table (parent, tag, own text). Scripts, styles,
navigation, forms, adverts, notices, sidebars, footers and reader comments are
left out by element and by the usual names in class, id and role: a name counts
if all of its words are such names or say only a place (``cookie-notice``,
``site-footer``, but not ``has-sidebar``). A form, a header or a named node that
holds more than half of the page's text outside links is kept, unless an
``article`` or ``main`` with text lies elsewhere. For the rest the composite density of a node is its characters per tag, adjusted for the
share of characters and tags in links (Sun, Song and Liao, 2011). The node with
the largest sum of its children's densities is the core. The smallest density
on the path from the body to the core is the threshold: every node that reaches
it gives its own largest-sum subtree, and the page's text is the smallest
subtree that holds them all. A core inside ``main`` is widened to all of it; if it
lies in an article there, parts beside the article that have links and do not reach
the threshold are left out. A core in an article outside ``main`` gives that article
and all others that reach the threshold.

Blocks are joined by one newline; white space ``[\\x20\\x09-\\x0D]+`` inside a
block becomes one space. A null or empty page, or one without text, gives ''.
Repeated rows each get their row. Each page is read whole, by itself, in one
Arrow batch of a narrow map: no shuffle, no state.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML and the common names of page furniture.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table
    tbody td tfoot th thead tr ul""".split())
RAW = set("script style textarea title noscript template iframe xmp noframes".split())
NO_TEXT = RAW | set("head button select option input svg canvas object audio video map datalist".split())
FURNITURE = set("nav footer aside form menu dialog".split())
INSIDE = {"article", "main"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
CLOSES |= {t: {"p"} for t in BLOCK - {"br", "body", "html", "li", "dt", "dd", "tr", "td", "th"}}
KEEPS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
NAMED = re.compile(r"""(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|
    sidebar\w*|footer|cookies?|consent|notices?|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|
    related|recommended|comments?|commentlist|disqus|replies|respond|widgets?|toolbar|pagination|pager|navigation|
    contentinfo|complementary|search|alert|dialog)""", re.I | re.X)
TOP = re.compile("header|masthead|topbar", re.I)
PLACE = re.compile("""(?:site|page|post|posts|article|articles|main|global|primary|secondary|top|bottom|left|right|list|box|bar|
    block|container|wrapper|wrap|section|area|inner|links?|items?|icons?|buttons?|form|slot|unit|\\d+)""", re.I | re.X)
WORD = re.compile(r"[^\W_]+")

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>"""
                   r"""|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPACE = re.compile(r"[\x20\x09-\x0D]+")


class Page:
    """Flat nodes in page order; a text is a node without a tag."""

    def __init__(self, source: str):
        self.tag, self.parent, self.text, self.out, self.inside = ["#page"], [-1], [None], [False], [False]
        self.size, self.link, soft = [0], [False], []
        stack, at = [0], 0
        places: dict[str, list[int]] = {}  # of the open nodes of each tag in the stack

        def close(k):
            for node in stack[k:]:
                places[self.tag[node]].pop()
            del stack[k:]

        while at < len(source):
            m = TOKEN.search(source, at)
            if m is None:
                self._words(stack[-1], source[at:])
                break
            if m.start() > at:
                self._words(stack[-1], source[at:m.start()])
            at = m.end()
            closing, name, rest = m.group(1, 2, 3) if m[2] else m.group(4, 5, 6)
            if not name:
                continue
            name = name.lower()
            if closing:
                if places.get(name):
                    close(places[name][-1])
                continue
            if name in CLOSES:
                # the innermost open one that this tag ends, unless something between keeps it open
                ends = max((places[t][-1] for t in CLOSES[name] if places.get(t)), default=0)
                keeps = KEEPS[name] if name in KEEPS else BLOCK - {"p"} - CLOSES[name]
                if ends and ends > max((places[t][-1] for t in keeps if places.get(t)), default=0):
                    close(ends)
            node = self._add(stack[-1], name, None, name in NO_TEXT)
            if not self.out[node] and self._is_furniture(stack[-1], name, rest):
                soft.append(node)
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])|\Z", re.I).search(source, at)
                at = end.start()
                if at < len(source):
                    at = (source.find(">", at) + 1) or len(source)
            elif name not in VOID and not rest.endswith("/"):
                places.setdefault(name, []).append(len(stack))
                stack.append(node)
        if soft:
            self._leave_out(soft)

    def _leave_out(self, soft) -> None:
        """Furniture is out, unless it holds most of the text outside links and every article with text."""
        plain = [0 if link else size for size, link in zip(self.size, self.link)]
        for k in range(len(plain) - 1, 0, -1):
            plain[self.parent[k]] += plain[k]
        last = list(range(len(plain)))
        for k in range(len(plain) - 1, 0, -1):
            last[self.parent[k]] = max(last[self.parent[k]], last[k])
        parts = [k for k in range(len(plain)) if self.tag[k] in INSIDE and plain[k]]
        for k in soft:
            self.out[k] = self.tag[k] in FURNITURE - {"form"} or 2 * plain[k] <= plain[0] or any(
                not k <= p <= last[k] and not p < k <= last[p] for p in parts)
        for k in range(1, len(plain)):
            self.out[k] = self.out[k] or self.out[self.parent[k]]

    def _add(self, parent, tag, text, out) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.text.append(text)
        self.out.append(out or self.out[parent])
        self.inside.append(tag in INSIDE or self.inside[parent])
        self.link.append(tag == "a" or self.link[parent])
        self.size.append(len(SPACE.sub(" ", text).strip(" ")) if text else 0)
        return len(self.tag) - 1

    def _words(self, parent, raw) -> None:
        if not self.out[parent]:
            self._add(parent, "", html.unescape(raw) if "&" in raw else raw, False)

    def _is_furniture(self, parent, name, rest) -> bool:
        if name in FURNITURE:
            return True
        within = self.inside[parent]
        if name == "header":
            return not within
        if name in ("body", "html", "br") or not rest:
            return False
        for token in " ".join(a or b or c for a, b, c in NAMES.findall(rest)).split():
            left = [w for w in WORD.findall(token) if not PLACE.fullmatch(w)]
            if left and all(NAMED.fullmatch(w) or not within and TOP.fullmatch(w) for w in left):
                return True
        return False

    def main(self) -> list[tuple[int, int]]:
        """The chosen subtrees: root and the node after the last of each."""
        n = len(self.tag)
        chars, tags, in_links, links = [0] * n, [0] * n, [0] * n, [0] * n
        last = self.last = list(range(n))  # of the subtree
        for k in range(n - 1, 0, -1):
            up = self.parent[k]
            last[up] = max(last[up], last[k])
            if self.out[k]:
                continue
            if self.text[k] is not None:
                chars[k] = self.size[k]
            elif self.tag[k] == "a":
                in_links[k], links[k] = chars[k], links[k] + 1
            chars[up] += chars[k]
            in_links[up] += in_links[k]
            links[up] += links[k]
            tags[up] += tags[k] + (self.text[k] is None)
        if not chars[0]:
            return []
        share = in_links[0] / chars[0]
        density = [0.0] * n
        for k in range(n):
            c, t, lc = chars[k], max(1, tags[k]), max(1, in_links[k])
            if c and self.text[k] is None and not self.out[k]:
                base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
                density[k] = c / t * max(0.0, math.log(c / lc * t / max(1, links[k]))) / max(1e-9, math.log(base))
        sums = [0.0] * n
        for k in range(1, n):
            sums[self.parent[k]] += density[k]
        best = list(range(n))  # largest sum within the subtree; the outer, earlier node wins ties
        for k in range(n - 1, 0, -1):
            up = self.parent[k]
            if not self.out[k] and sums[best[k]] > sums[best[up]]:
                best[up] = best[k]
        core = best[0]
        path = [core]
        while path[-1]:
            path.append(self.parent[path[-1]])
        least = min((density[k] for k in path if self.tag[k] not in ("#page", "html") and density[k]), default=0.0)
        main = next((k for k in reversed(path) if self.tag[k] == "main"), None)
        article = next((k for k in reversed(path) if self.tag[k] == "article"), None)
        if main is not None and (article is None or article < main):
            return [(main, last[main] + 1)]
        if main is not None:
            spans, above, k = [], set(path), main + 1
            while k <= last[main]:
                if k in above and k < article:  # on the way to the article: its parts one by one
                    k += 1
                    continue
                if k == article or not in_links[k] or density[k] >= least:
                    spans.append((k, last[k] + 1))
                k = last[k] + 1
            return spans
        if article is not None:
            spans, k = [], 1
            while k < n:
                if self.tag[k] == "article" and not self.out[k]:
                    if k == article or chars[k] and density[k] >= least:
                        spans.append((k, last[k] + 1))
                    k = last[k]
                k += 1
            return spans
        chosen = {best[k] for k in range(1, n) if density[k] >= least and density[k] and not self.out[k]} | {core}
        first, final, root = min(chosen), max(chosen), core
        while not root <= first <= final <= last[root]:
            root = self.parent[root]
        return [(root, last[root] + 1)]

    def blocks(self) -> str:
        lines, now, ends, at = [], [], [], 0  # ends: the last nodes of the open blocks
        for first, after in self.main():
            if first != at:  # something is left out between
                lines.append("".join(now))
                now = []
            at = after
            for k in range(first, after):
                while ends and k > ends[-1]:
                    ends.pop()
                    lines.append("".join(now))
                    now = []
                if self.text[k] is not None:
                    if not self.out[k]:
                        now.append(self.text[k])
                elif self.tag[k] in BLOCK:
                    lines.append("".join(now))
                    now = []
                    ends.append(self.last[k])
        lines.append("".join(now))
        return "\n".join(x for x in (SPACE.sub(" ", line).strip(" ") for line in lines) if x)


def main_text(source: str | None) -> str:
    return Page(source).blocks() if source else ""


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row; more columns are ignored."""
    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")) \
        .mapInArrow(run, "page_id long, url string, text string, n_chars long")
