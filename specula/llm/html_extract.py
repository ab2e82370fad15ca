"""Main-text extraction by composite text density.

A page becomes a flat list of DOM nodes (parents before children, so one backward sweep sums every subtree). The density
of a node is its characters per tag, adjusted by how much of it is link text; a node's score is the sum of its children's
densities. The subtree with the largest score wins, on every page, whatever its elements are called. The smallest density on
the path from the body to it is the threshold: the choice grows to a parent as long as a further child of that parent
reaches it, and what lies in the choice, is mostly links and stays below the threshold is left out.

Elements that are no article by the standard's meaning (scripts, menus, asides, forms ...) or hidden have no text. Classes, ids
and data attributes are a hint only: an element that they call an advert, a menu, a notice or reader comments goes unless
most of the page's text, or the main element, is in it.
"""

from __future__ import annotations

import functools
import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A tag whose attributes hold neither < nor > is told by the pattern, of any other only its head.
_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']++|\"[^<>\"]*+\"|'[^<>']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)",
    re.S,
)
_SPECIAL = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"([a-zA-Z][-\w]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")

# HTML element names by their role in the standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
NO_TEXT = frozenset(
    "script style noscript template head title meta link iframe object embed svg canvas nav footer aside form button select textarea input"
    " menu dialog audio video map datalist noembed noframes xmp".split()
)
CLOSED_BY_BLOCK = BLOCK - frozenset("body html dd dt li td th tr tbody tfoot thead option legend caption".split())
#: An open element (key) that a start tag (value) ends, up to the elements in SCOPE.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = frozenset("ul ol dl table select body html div section article main".split())
ROLES = frozenset("navigation banner complementary contentinfo search dialog alertdialog alert menu menubar form toolbar".split())
#: Words of classes and ids for what is no article. A class or id tells of it if it consists of such words and NEUTRAL ones.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr"
    " notice notices alert popup modal overlay sidebar nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead comment comments"
    " commentlist responses replies respond discussion reactions disqus related recommended recommendations share sharing social newsletter"
    " subscribe subscription login signup search searchbox toolbar pagination skip siteheader pageheader".split()
)
NEUTRAL = frozenset(
    "site page top bottom left right main box block wrapper wrap container content list section area unit slot bar panel group item items link links"
    " button buttons icons widget form thread posts articles stories news js id global sticky fixed primary secondary inner outer".split()
)
#: The same, but only outside article and main.
HEADS = frozenset(("header", "head"))
_PART = re.compile(r"[a-z]+|\d+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Of these elements those are left out that are links by more than that share and below the threshold.
LINKED, LINKS = frozenset("ul ol dl div section table".split()), 0.8
#: What ends the look for an open paragraph, and what is looked at for the elements of ENDS.
_STOPS = BLOCK | {"button"}
_ENDABLE = SCOPE | frozenset(ENDS)


@functools.lru_cache(4096)
def _named(token: str, inside: bool) -> bool:
    """Whether a class or id says that an element is no article."""
    parts = _PART.findall(_CAMEL.sub(" ", token).lower())
    hint = any(x in NAMES or x in HEADS and not inside for x in parts)
    return hint and all(x in NAMES or x in NEUTRAL or x in HEADS or x.isdigit() for x in parts)


class _Page:
    """Nodes by number: tag, parent, whether it counts, and its text and child nodes in page order."""

    def __init__(self, source: str):
        self.tag, self.parent, self.skip, self.inside = ["html"], [0], [0], [[]]
        # Of the open nodes: how many of each tag, and the place at or below each where a look for an end may stop.
        self.open, self.count, self.stop, self.endable = [0], {"html": 1}, [0], [0]
        at = 0
        self.tag_ends: dict[int, int] = {}
        self.last_quote = {q: source.rfind(q) for q in "\"'"}
        last = source.rfind(">") + 1  # no tag ends behind it; searching there would cost the square of a run of "<"
        for m in iter(lambda: _TOKEN.search(source, at, last), None):
            if m.start() > at:
                self.inside[self.open[-1]].append(source[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                if m[0].startswith("<![CDATA["):
                    self.inside[self.open[-1]].append(entities.escape(m[0][9:].removesuffix("]]>")))
                continue
            name, attributes = name.lower(), m[3]
            if not m[2]:
                end = self._tag_end(source, at)
                attributes, at = source[at:end], end + 1
            if m[1] or m[4]:
                self._end(name)
                continue
            self._make_room(name)
            if name == "html" or name == "body" and self.count.get("body"):
                continue
            node = len(self.tag)
            self.tag.append(name), self.parent.append(self.open[-1]), self.inside.append([])
            self.skip.append(self._not_article(name, attributes))
            self.inside[self.open[-1]].append(node)
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = close.end() if close else len(source)
            elif name not in VOID and not attributes.rstrip().endswith("/") or name in BLOCK and name not in VOID:
                k = len(self.open)
                self.open.append(node)
                self.count[name] = self.count.get(name, 0) + 1
                self.stop.append(k if name in _STOPS else self.stop[-1])
                self.endable.append(k if name in _ENDABLE else self.endable[-1])
        if at < len(source):
            self.inside[self.open[-1]].append(source[at:])
        self._inherit()

    def _tag_end(self, source: str, at: int) -> int:
        """Place of the > that ends a tag: the first one outside quotes, or the first of all if quotes never end.

        What follows from a quote on is remembered, so that looks for ends, which may reach to the page's end, cost it once.
        """
        passed, end, here = [], -1, at
        while (m := _SPECIAL.search(source, here)) and m[0] != ">":
            k = m.start()
            if k in self.tag_ends:
                end = self.tag_ends[k]
                break
            passed.append(k)
            if k >= self.last_quote[m[0]]:
                break
            here = source.index(m[0], k + 1) + 1
        else:
            end = m.start() if m else -1
        self.tag_ends.update(dict.fromkeys(passed, end))
        return end if end >= 0 else source.index(">", at)

    def _close(self, k: int) -> None:
        """End the k-th open node and all in it."""
        for node in self.open[k:]:
            self.count[self.tag[node]] -= 1
        del self.open[k:], self.stop[k:], self.endable[k:]

    def _inherit(self) -> None:
        """Skip what is inside skipped nodes; a class or form around the page's own text is its wrapper and stays."""
        n = len(self.tag)
        if 1 in self.skip:
            chars, held = [0] * n, [0] * n  # held: 1 with an article inside, 2 with a main
            for k in range(n - 1, -1, -1):
                if self.skip[k] == 2:
                    continue
                chars[k] += sum(len(x.strip()) for x in self.inside[k] if type(x) is str)
                if k:
                    up = self.parent[k]
                    chars[up] += chars[k]
                    held[up] = max(held[up], held[k], (self.tag[k] == "article") + 2 * (self.tag[k] == "main"))
            # Reader comments may be articles and the larger part of a page, so a class needs more than one of both.
            self.skip = [
                s == 2 or s == 1 and not (held[k] == 2 or chars[k] > (0.5 if held[k] else 0.8) * chars[0]) for k, s in enumerate(self.skip)
            ]
        for k in range(1, n):
            self.skip[k] = bool(self.skip[k] or self.skip[self.parent[k]])

    def _end(self, name: str) -> None:
        if not self.count.get(name) or name == "html":
            return  # an end without a start costs no look at what is open
        k = len(self.open) - 1
        while self.tag[self.open[k]] != name:
            k -= 1
        self._close(k)

    def _make_room(self, name: str) -> None:
        """End tags that the standard lets a page leave out."""
        if name in CLOSED_BY_BLOCK:
            if self.tag[self.open[self.stop[-1]]] == "p":
                self._close(self.stop[-1])
        elif name in ENDS:
            k = self.endable[-1]
            while k > 0 and (held := self.tag[self.open[k]]) not in SCOPE:
                if held in ENDS[name]:
                    self._close(k)
                    return
                k = self.endable[k - 1]

    def _not_article(self, name: str, attributes: str) -> int:
        """0 for what counts, 2 for what never does, 1 for a form or a class or id, which may be the whole page's."""
        if name in NO_TEXT and name != "form":
            return 2
        inside = bool(self.count.get("article") or self.count.get("main"))
        if name == "header":
            return 0 if inside else 2
        found = int(name == "form")
        if not attributes.strip() or name in ("body", "html", "article", "main"):
            return found
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "role" and value.strip().lower() in ROLES:
                return 2
            if key in ("class", "id") and any(_named(t, inside) for t in value.split()):
                found = 1
            if key == "aria-hidden" and value.strip().lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                return 2
        bare = _ATTRIBUTE.sub("", attributes).lower()
        if re.search(r"(?:^|\s)hidden(?:\s|$)", bare):
            return 2
        if "data-" in attributes.lower() and any(_named(x, True) for x in re.findall(r"(?:^|\s)data-([-\w]+)", _ATTRIBUTE.sub(lambda m: m[1] + " ", attributes).lower())):
            found = 1
        return found

    def densities(self) -> tuple[list[float], list[float], list[float], list[float]]:
        """Of every node the density, the sum of its children's, its characters and its link characters."""
        n = len(self.tag)
        chars, tags, links, link_tags = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
        for k in range(n - 1, -1, -1):
            if self.skip[k]:
                continue
            chars[k] += sum(len(x.strip()) for x in self.inside[k] if type(x) is str)
            if self.tag[k] == "a":
                links[k], link_tags[k] = chars[k], link_tags[k] + 1
            if k:
                up = self.parent[k]
                chars[up] += chars[k]
                tags[up] += tags[k] + 1
                links[up] += links[k]
                link_tags[up] += link_tags[k]
        body = self.body()
        ratio = links[body] / chars[body] if chars[body] else 0.0
        density, score = [0.0] * n, [0.0] * n
        for k in range(n - 1, -1, -1):
            if self.skip[k] or not chars[k]:
                continue
            c, t, lc, lt = chars[k], max(tags[k], 1.0), links[k], link_tags[k]
            base = math.log(c * lc / max(c - lc, 1.0) + ratio * c + math.e)
            density[k] = c / t * max(math.log(max(c * t / (max(lc, 1.0) * max(lt, 1.0)), 1.0)) / max(math.log(base), 1.0), 0.0)
            if k:
                score[self.parent[k]] += density[k]
        return density, score, chars, links

    def body(self) -> int:
        return next((k for k in range(len(self.tag)) if self.tag[k] == "body"), 0)

    def article(self) -> tuple[int, float, list[float], list[float], list[float]]:
        """(node of the article, threshold, and of every node the density, its characters and its link characters)."""
        density, score, chars, links = self.densities()
        body = self.body()
        best = max(range(len(self.tag)), key=lambda k: (score[k], density[k]))
        if not score[best]:
            best = body
        path = [best]
        while path[-1] not in (body, 0):
            path.append(self.parent[path[-1]])
        threshold = min(density[k] for k in path)
        # Up to the article element around it, which the page says is one piece, and to every parent with more of the kind.
        around = next((k for k, x in enumerate(path) if self.tag[x] == "article"), 0)
        root = best
        for k, up in enumerate(path[1:], 1):
            others = [x for x in self.inside[up] if type(x) is int and x != root]
            if k > around and not any(density[x] >= threshold > 0 or x < root and self._is_title(x) for x in others):
                break
            root = up
        while root and self.tag[root] not in BLOCK:  # inline elements are no article by themselves
            root = self.parent[root]
        return root, threshold, density, chars, links

    def _is_title(self, k: int) -> bool:
        """A main heading, or what holds nothing but one."""
        while self.tag[k] != "h1" and not self.skip[k]:
            held = [x for x in self.inside[k] if type(x) is int or x.strip()]
            if len(held) != 1 or type(held[0]) is not int:
                return False
            k = held[0]
        return self.tag[k] == "h1" and not self.skip[k]

    def text(self) -> str:
        root, threshold, density, chars, links = self.article()
        blocks: list[str] = []
        parts: list[str] = []

        def flush():
            if parts:
                block = "".join(parts)
                if line := " ".join((entities.unescape(block) if "&" in block else block).split()):
                    blocks.append(line)
                parts.clear()

        todo: list = [root]
        while todo:
            x = todo.pop()
            if type(x) is str:
                parts.append(x)
            elif x < 0:
                flush()
            elif self.tag[x] == "br":
                parts.append(" ")
            elif x == root or not self.skip[x] and not (self.tag[x] in LINKED and links[x] > LINKS * chars[x] and density[x] < threshold):
                if self.tag[x] in BLOCK:
                    flush()
                    todo.append(-1)
                todo.extend(reversed(self.inside[x]))
        flush()
        return "\n\n".join(blocks)


def main_text(source: str | None) -> str:
    """The main text of one page; null, empty and text-free pages give an empty string, broken markup is read leniently."""
    return _Page(source).text() if source else ""


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, text and n_chars (code points) of every page.

    Null and empty pages give an empty text. Repeated rows give repeated results, an empty table an empty result; other
    columns are not read. Pages are read whole, one at a time, so a task holds one page beside its Arrow batch.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string())], [*keep, "text"])

    rows = pages.select(*keep, F.col(html_col).alias("source_html"))
    schema = rows.schema
    schema = schema.__class__([*schema.fields[:-1]]).add("text", "string")
    return rows.mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))


def op1_html_extract(pages: DataFrame) -> DataFrame:
    return extract(pages).select("page_id", "url", "text", "n_chars")
