"""Main text of web pages by composite text density.

Every node of a page's tree gets a density: its characters for each tag, raised or lowered by how much
of them are links. The node whose child blocks' densities have the largest sum holds the main text (an inline
element's density tells of a phrase, and a paragraph with one could outweigh the article around it). What hangs
beside the way from there to the body is added where its density reaches the smallest one on that way.

What is no text by nature (scripts, styles, what is hidden) and the elements and roles that are named as no
article (menus, headers, footers, asides, forms' fields, dialogs) are taken out of the tree. Everything else only
weighs: a class or id that speaks of adverts, notices, sidebars or comments, or a form, lowers the density of its
element, unless that holds an article, a main element or, on a page with neither, most of the text; at or
in the only article (or main element) of a page a sum counts twice.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<[A-Za-z/!?][^>]*\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_words = lambda s: frozenset(s.split())

#: Elements without content or end tag; with content that is no markup; that begin and end a block of text.
_VOID = _words("area base br col embed hr img input link meta param source track wbr")
_RAW = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
_BLOCK = _words(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "legend li main menu nav ol optgroup option p pre section summary table caption tbody td tfoot th thead tr ul"
)
_HEADINGS = _words("h1 h2 h3 h4 h5 h6")
#: A start tag of the key closes the nearest open element of those named, unless one of the bounds comes first.
_CLOSES = {
    "li": (_words("li"), _words("ul ol menu dir")), "dt": (_words("dt dd"), _words("dl")), "dd": (_words("dt dd"), _words("dl")), "option": (_words("option"), _words("select")),
    "tr": (_words("tr"), _words("table")), "td": (_words("td th"), _words("tr table")), "th": (_words("td th"), _words("tr table")), "body": (_words("head"), frozenset()),
}
_SCOPE = _words("table td th caption button object html")
#: Elements and roles that are no article, and words of a class or id that lower a density.
_AWAY = _words("head script style noscript template iframe object embed svg canvas audio video nav aside footer button select textarea datalist dialog menu title xmp noembed noframes")
_ROLES = _words("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar")
_MARKS = _words(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter "
    "subscribe signup login sidebar widget menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar masthead footer comment comments disqus respond reply "
    "replies discussion share sharing social related recommended skip"
)
#: Weight of a sum of densities at or in the only article, or else the only main element, of a page.
_EVIDENCE = 2.0
#: Weight of the density of an element whose class or id speaks against it.
_DOUBT = 1 / 16
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Page:
    """A page's tree as parallel lists in page order; node 0 stands above all elements."""

    def __init__(self, source: str):
        self.parent, self.tag, self.gone, self.marked, self.inside = [-1], ["#"], [False], [False], [False]
        self.open: dict[str, list[int]] = {}  # of each name the places of its open elements in the stack
        self.text: list[tuple[int, str]] = []  # node and piece of text; a piece None is a block's edge
        stack, at = [0], 0
        for m in iter(lambda: _MARKUP.search(source, at), None):
            if m.start() > at:
                self._add(stack[-1], source[at : m.start()])
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if m[1] or m[4]:
                self._close(stack, name)
                continue
            rest = m[3] if m[2] else m[6]
            node = self._open(stack, name, rest)
            if name in _VOID or rest.endswith("/") and name in ("svg", "path"):
                self._cut(stack, len(stack) - 1)
            elif name in _RAW:
                end = _RAW[name].search(source, at)
                at = end.start() if end else len(source)
                if not self.gone[node]:
                    self._add(node, source[m.end() : at])
        if at < len(source):
            self._add(stack[-1], source[at:])
        self._weigh_marked()

    def _add(self, node: int, piece: str) -> None:
        if not self.gone[node]:
            self.text.append((node, html.unescape(piece) if "&" in piece else piece))

    def _edge(self, node: int, name: str) -> None:
        if name in _BLOCK:
            self.text.append((node, None))
        elif name == "br":
            self.text.append((node, " "))

    def _cut(self, stack: list[int], at: int) -> None:
        """Closes the open elements from a place of the stack on."""
        for node in stack[at:]:
            self.open[self.tag[node]].pop()
        del stack[at:]

    def _last(self, names) -> int:
        """The place in the stack of the innermost open element of these names, 0 if there is none."""
        return max((self.open[n][-1] for n in names if self.open.get(n)), default=0)

    def _open(self, stack: list[int], name: str, rest: str) -> int:
        closes, bounds = _CLOSES.get(name, ((), ()))
        if name in _BLOCK:
            closes, bounds = closes or {"p"}, bounds or _SCOPE
        at = self._last(closes)
        if at and at > self._last(bounds):
            self._cut(stack, at)
        node, above = len(self.parent), stack[-1]
        self.parent.append(above)
        self.tag.append(name)
        self.inside.append(self.inside[above] or name in ("article", "main"))
        away, marked = self._away(name, rest, above)
        self.gone.append(self.gone[above] or away)
        self.marked.append(marked)
        self._edge(node, name)
        self.open.setdefault(name, []).append(len(stack))
        stack.append(node)
        return node

    def _away(self, name: str, rest: str, above: int) -> tuple[bool, bool]:
        """Whether an element is no article whatever it holds, and whether its name, class or id only hints at it."""
        if name in _AWAY:
            return True, False
        if name in ("html", "body", "main"):
            return False, False
        inside = name == "article" or self.inside[above]
        if name == "header" and not inside:
            return True, False
        if not rest or "=" not in rest and "hidden" not in rest:
            return False, name == "form"
        own = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)}
        role = own.get("role", "").lower()
        if "hidden" in own or role in _ROLES or own.get("aria-hidden") == "true" or _HIDDEN.search(own.get("style", "")):
            return True, False
        # a class or id counts as a whole: every word of it is a mark
        names = [{w.lower() for w in _PARTS.findall(x)} for x in f"{own.get('class', '')} {own.get('id', '')}".split()]
        return False, name == "form" or role == "form" or any(x and x <= _MARKS or not inside and x == {"header"} for x in names)

    def _weigh_marked(self) -> None:
        """Takes the mark from elements that hold an article, a main element or, on a page without either, half of the text."""
        n = len(self.parent)
        if not any(self.marked):
            return
        holds, chars = [False] * n, [0] * n
        live = [i for i in range(n) if self.tag[i] in ("article", "main") and not self.gone[i]]
        # articles marked themselves (comments, say) only count where no other article, and no main element elsewhere, is there
        for i in [i for i in live if not self.marked[i]] or live:
            holds[i] = True
        if not any(holds[i] and self.tag[i] == "article" for i in live):
            in_main = [False] * n
            for i in range(1, n):
                in_main[i] = self.tag[i] == "main" or in_main[self.parent[i]]
            for i in live:
                holds[i] = holds[i] or in_main[i]
        some = any(holds)
        for node, piece in self.text:
            if piece is not None and not self.gone[node]:
                chars[node] += len(piece.strip())
        for i in range(n - 1, 0, -1):
            chars[self.parent[i]] += chars[i]
            holds[self.parent[i]] = holds[self.parent[i]] or holds[i]
        for i in range(1, n):
            self.marked[i] = self.marked[i] and not holds[i] and (some or 2 * chars[i] < chars[0])

    def _close(self, stack: list[int], name: str) -> None:
        if at := self._last((name,)):
            self._edge(stack[at], name)
            self._cut(stack, at)

    def root(self) -> int:
        """Where the search begins: the body."""
        found = [i for i, t in enumerate(self.tag) if t == "body" and not self.gone[i]]
        return found[0] if len(found) == 1 else 0

    def named(self) -> int:
        """The one article of the page, else its one main element, else -1."""
        for name in ("article", "main"):
            found = [i for i, t in enumerate(self.tag) if t == name and not self.gone[i]]
            if len(found) == 1:
                return found[0]
        return -1

    def densities(self, root: int) -> tuple[list[float], list[float]]:
        """Composite density of every node below the root, and the sum of its child blocks' ones.

        C / T * log_b(C / L * T / K), b = ln(C / (C - L) * L + share * C + e): C characters and T tags below the node, L and
        K those of links, share that of linked characters below the root; a number that would be 0 counts as 1.
        """
        n = len(self.parent)
        chars, linked, tags, links = [0] * n, [0] * n, [0] * n, [0] * n
        for node, piece in self.text:
            if piece is not None:
                chars[node] += len(piece.strip())
        for i in range(n - 1, 0, -1):
            if not self.gone[i]:
                if self.tag[i] == "a":
                    linked[i], links[i] = chars[i], links[i] + 1
                up = self.parent[i]
                chars[up] += chars[i]
                linked[up] += linked[i]
                tags[up] += tags[i] + 1
                links[up] += links[i]
        share = linked[root] / max(1, chars[root])
        density, below, doubted = [0.0] * n, [0.0] * n, [False] * n
        for i in range(1, n):
            doubted[i] = self.marked[i] or doubted[self.parent[i]]
        for i in range(n - 1, 0, -1):
            if chars[i] and not self.gone[i]:
                c, t, lc, lt = chars[i], max(1, tags[i]), max(1, linked[i]), max(1, links[i])
                base = math.log(c / max(1, c - linked[i]) * lc + share * c + math.e)
                density[i] = c / t * math.log(max(1.0, c / lc * t / lt)) / math.log(base) * (_DOUBT if doubted[i] else 1.0)
                if self.tag[i] in _BLOCK:
                    below[self.parent[i]] += density[i]
        return density, below

    def kept(self) -> list[bool]:
        """Which nodes hold main text."""
        root = self.root()
        density, below = self.densities(root)
        n = len(self.parent)
        inside, named = [False] * n, [False] * n
        inside[root], one = True, self.named()
        for i in range(root + 1, n):
            inside[i] = inside[self.parent[i]] and not self.gone[i]
            named[i] = i == one or named[self.parent[i]]
        best = max((i for i in range(n) if inside[i]), key=lambda i: below[i] * (_EVIDENCE if named[i] else 1.0), default=root)
        way = [best]
        while way[-1] != root:
            way.append(self.parent[way[-1]])
        least = min(density[i] for i in way)
        keep, on, said = [False] * n, set(way), {node for node, piece in self.text if piece and piece.strip()}
        keep[best] = True
        for i in way[1:]:
            keep[i] = True  # the text of the nodes on the way themselves
        for i in range(root + 1, n):
            if inside[i] and not keep[i]:
                up = self.parent[i]
                # beside the way, and for what is in doubt, density decides, but not over a part of a sentence; below a node that was decided, its decision holds
                sure = up == best or up not in on
                keep[i] = keep[up] and (sure and not self.marked[i] or density[i] >= least or not self.marked[i] and (self.tag[i] in _HEADINGS or self.tag[i] not in _BLOCK and up in said))
        return keep

    def main_text(self) -> str:
        keep, blocks, block = self.kept(), [], []
        for node, piece in self.text:
            if piece is None:
                blocks.append(block)
                block = []
            elif keep[node]:
                block.append(piece)
        return "\n".join(s for b in [*blocks, block] if b and (s := " ".join("".join(b).split())))


def main_text(source: str | None) -> str:
    return Page(source).main_text() if source else ""


def _texts(batches):
    for batch in batches:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def page_texts(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row: the blocks of the main text joined by line feeds.

    Character references are decoded, white space inside a block is one space, a block without other
    characters is none. A null or empty page has the empty text. Pages are read whole, of any length
    and nesting; broken markup is repaired by closing what a browser would close. Rows repeat as in the
    input; columns besides the three named are not read.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(source).alias("html"))
    return rows.mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
