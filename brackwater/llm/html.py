"""Main text of web pages by composite text density.

For each element: C characters of text, LC of them in links, T elements below it, LT
of them links. Its density is C / T times the logarithm of (C / LC) (T / LT), to a base
that grows with its share of link text, so links count against it. The element whose
children's densities sum highest is the heart of the page; the least density on the
way from it to the body is the threshold. From the body down, each element that reaches
it, as all above it do, gives the text of its subtree of the highest sum.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from brackwater.llm.words import bound_batches
from brackwater.sources.shared import spread

TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*)(?:[^>"']*+(?:"[^"]*+"|'[^']*+')?+)*+>""")
LOOSE = re.compile(r"</?([a-zA-Z][^\s/>]*)[^>]*>")
SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template textarea svg iframe object head title".split())
RAW = {name: re.compile("</" + name, re.I) for name in "script style textarea title iframe noscript".split()}
BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "li main nav ol option p pre section summary table tbody td tfoot th thead tr ul br".split()
)
#: An opening tag ends open elements of these names, up to the nearest of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: What may stand in a head; anything else, text too, ends it.
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
FENCE = frozenset("table td th article section div main body html li".split())


class Page:
    """Elements in document order, each after its parent, with what counts for density."""

    def __init__(self, html: str):
        self.name, self.parent, self.last = ["#root"], [0], [0]
        self.own, self.own_link = [0], [0]
        self.implied = 0  # the body that no tag began
        self.open: dict[str, int] = {}  # how many elements of a name are open
        self.pieces: list[tuple[int, str]] = []  # (element, text or a line break)
        self._parse(html)

    def _parse(self, html: str) -> None:
        stack, links, hidden, at, n = [0], 0, 0, 0, len(html)
        last_end = html.rfind(">")
        while at < n:
            open_at = html.find("<", at)
            if open_at < 0:
                open_at = n
            if open_at > at:
                if self.name[stack[-1]] == "head" and not html[at:open_at].isspace():
                    links, hidden = self._end_head(stack, links, hidden)
                self._text(stack[-1], html[at:open_at], links, hidden)
            if open_at == n:
                break
            if html.startswith("<!--", open_at):
                end = html.find("-->", open_at + 4)
                at = n if end < 0 else end + 3
                continue
            if html.startswith(("<!", "<?"), open_at):
                end = html.find(">", open_at)
                at = n if end < 0 else end + 1
                continue
            found = (TAG.match(html, open_at) or LOOSE.match(html, open_at)) if open_at < last_end else None
            if not found:
                self._text(stack[-1], "<", links, hidden)
                at = open_at + 1
                continue
            at, name = found.end(), found[1].lower()
            if html[open_at + 1] == "/":
                if name in BLOCK:
                    self.pieces.append((stack[-1], "\n"))
                if self.open.get(name):
                    while True:
                        closed = self.name[stack.pop()]
                        self.open[closed] -= 1
                        links -= closed == "a"
                        hidden -= closed in HIDDEN
                        if closed == name:
                            break
                continue
            if name == "body":
                links, hidden = self._close(stack, {"head"}, frozenset(), links, hidden)
                if self.implied and self.open.get("body"):
                    continue
            elif name not in HEAD and self.name[stack[-1]] == "head":
                links, hidden = self._end_head(stack, links, hidden)
            if name in BLOCK and name != "br":
                links, hidden = self._close(stack, {"p"}, FENCE, links, hidden)
            if name in ENDS:
                links, hidden = self._close(stack, *ENDS[name], links, hidden)
            if name in BLOCK:
                self.pieces.append((stack[-1], "\n"))
            k = self._element(name, stack[-1])
            if name in VOID or html[at - 2] == "/":
                continue
            if name in RAW:
                end = RAW[name].search(html, at)
                close = html.find(">", end.start()) if end else -1
                at = n if close < 0 else close + 1
                continue
            self._push(stack, k)
            links += name == "a"
            hidden += name in HIDDEN

    def _element(self, name: str, parent: int) -> int:
        self.name.append(name)
        self.parent.append(parent)
        self.own.append(0)
        self.own_link.append(0)
        return len(self.name) - 1

    def _end_head(self, stack: list[int], links: int, hidden: int) -> tuple[int, int]:
        """End an open head where its end tag and the body's tag are left out, and begin the body, which a tag further on only repeats."""
        links, hidden = self._close(stack, {"head"}, frozenset(), links, hidden)
        if "body" not in self.name:
            self.implied = self._element("body", stack[-1])
            self._push(stack, self.implied)
        return links, hidden

    def _push(self, stack: list[int], k: int) -> None:
        stack.append(k)
        self.open[self.name[k]] = self.open.get(self.name[k], 0) + 1

    def _close(self, stack: list[int], names: set, fence: set | frozenset, links: int, hidden: int) -> tuple[int, int]:
        if not any(self.open.get(name) for name in names):
            return links, hidden
        for depth in range(len(stack) - 1, 0, -1):
            name = self.name[stack[depth]]
            if name in names:
                for k in stack[depth:]:
                    self.open[self.name[k]] -= 1
                    links -= self.name[k] == "a"
                    hidden -= self.name[k] in HIDDEN
                del stack[depth:]
                break
            if name in fence:
                break
        return links, hidden

    def _text(self, element: int, text: str, links: int, hidden: int) -> None:
        if hidden:
            return
        if "&" in text:
            text = unescape(text)
        size = len(text) - text.count(" ") if not text.isspace() else 0
        self.own[element] += size
        if links:
            self.own_link[element] += size
        self.pieces.append((element, text))

    def body(self) -> int:
        """The first body, else the root."""
        return self.name.index("body") if "body" in self.name else 0

    def densities(self) -> tuple[list[float], list[float], list[int]]:
        """(composite density, sum of the children's, characters outside links) of each element."""
        n = len(self.name)
        chars, link_chars = self.own[:], self.own_link[:]
        tags, link_tags = [0] * n, [0] * n
        for k in range(n - 1, 0, -1):
            p = self.parent[k]
            chars[p] += chars[k]
            link_chars[p] += link_chars[k]
            tags[p] += tags[k] + 1
            link_tags[p] += link_tags[k] + (self.name[k] == "a")
        b = self.body()
        share = link_chars[b] / max(1, chars[b])
        density, total = [0.0] * n, [0.0] * n
        for k in range(n):
            c, lc = chars[k], link_chars[k]
            if not c:
                continue
            t, lt = max(1, tags[k]), max(1, link_tags[k])
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            value = math.log(c / max(1, lc) * t / lt)
            density[k] = max(0.0, c / t * (value / math.log(base) if base > 1.001 else value))
        for k in range(1, n):
            total[self.parent[k]] += density[k]
        return density, total, [c - lc for c, lc in zip(chars, link_chars)]

    def chosen(self) -> list[int]:
        """The elements whose text is the content, in document order, none within another."""
        density, total, _ = self.densities()
        b, n = self.body(), len(self.name)
        best = list(range(n))  # the element of the highest sum in each subtree, the first of several
        for k in range(n - 1, 0, -1):
            p = self.parent[k]
            best[p] = max(best[p], best[k], key=lambda e: (total[e], -e))
        heart = best[b]
        if heart == b or total[heart] == 0:
            return [b]
        threshold, k = density[heart], heart
        while k != b:
            k = self.parent[k]
            threshold = min(threshold, density[k])
        reached, wanted = [k == b for k in range(n)], {heart}
        for k in range(b + 1, n):
            if reached[self.parent[k]] and density[k] >= threshold:
                reached[k] = True
                wanted.add(best[k])
        within = [False] * n
        for k in range(1, n):
            within[k] = within[self.parent[k]] or self.parent[k] in wanted
        return sorted(k for k in wanted if not within[k])

    def text(self) -> str:
        """The content, a line for each block."""
        wanted = set(self.chosen())
        keep = [k in wanted for k in range(len(self.name))]
        for k in range(1, len(self.name)):
            keep[k] = keep[k] or keep[self.parent[k]]
        joined = "".join(t if t == "\n" else SPACE.sub(" ", t) for k, t in self.pieces if keep[k])
        return "\n".join(x for x in (line.strip() for line in joined.split("\n")) if x)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, text, chars) of each page.

    A null html gives a null text, a page without text an empty one. Broken markup is
    read as far as it goes, a page of any size whole and in time that grows with it. Of
    elements of one density sum the first is taken. Null ids and repeated rows are
    carried along, an empty table gives an empty one, other columns are not read.
    """
    bound_batches(pages.sparkSession)
    out = T.StructType([T.StructField("page_id", pages.schema["page_id"].dataType), T.StructField("text", T.StringType()), T.StructField("chars", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [None if h is None else Page(h).text() for h in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array([None if t is None else len(t) for t in texts], pa.int32())], out.names)

    return pages.select("page_id", "html").mapInArrow(run, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content of the whole pages table."""
    return extract(spread(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id"))
