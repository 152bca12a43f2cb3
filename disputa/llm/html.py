"""Main text of web pages: what a page's parts are called and what recurs across a host's pages both go.

A page is read into a flat list of elements and texts by one tokeniser. Each element hashes its subtree; Spark counts
on how many distinct pages of a host a hash occurs, and elements that recur on most of them are template and are
deleted, outside of the article and inside it. Elements whose names or roles say navigation, footer, sidebar, form, script, style or
the like are deleted on any page, and so are those whose classes or ids say so: outside of the article by parts of
names, inside it only containers with exactly such a class. What is left in all articles of the page (in the main element if it
has more text outside of them, in the body if there is neither) is the main text: a line for each block.

The tokeniser goes through a page once. A tag ends at the first ">" outside of quotes; from the first tag on whose quotes
don't close, quotes are ignored. Elements below ``DEPTH`` open ones have no children, as in browsers.

Counting distinct pages: pages of a host with the same whole html count once, so copies of an article don't make it
template. Inside an article or main element, pages whose main part is the same count once, whole blocks (not headings,
inline elements, or parts of lists and tables) are candidates, and a host needs ``LEAST_MAIN`` different main parts; the
share is the same, as passages of near copies recur too (measured on the tables at hand: on up to 28 % of a host's).

Defined results: null or empty html gives an empty text; a null url counts as host ''; a host with fewer than
``LEAST_PAGES`` distinct pages has no template; repeated rows give repeated rows; extra columns do not matter.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from disputa.llm.common import Scratch, bounded, steps, table

#: A subtree is template from this share of a host's distinct pages on, if the host has this many; inside main parts, this many of them.
TEMPLATE_SHARE, LEAST_PAGES, LEAST_MAIN = 0.5, 5, 10
#: Most open elements.
DEPTH = 512

# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Blocks that stand for themselves inside a main part: no headings, no parts of lists and tables.
WHOLE = BLOCKS - frozenset("h1 h2 h3 h4 h5 h6 hgroup header caption tbody td tfoot th thead tr li dd dt legend option optgroup summary".split())
#: Elements whose open paragraph ends when they begin, and those that end an earlier one of the same kinds.
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "body", "html", "li", "dd", "dt"} | {"table"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}, "optgroup": {"select"}}
#: Names of elements that never hold main text.
DROPPED = frozenset("head script style noscript template nav footer aside form button select textarea input label fieldset iframe object embed svg canvas audio video map dialog menu title xmp noembed noframes search".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist status".split())
#: Words of classes and ids that say the same.
_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|banner\w*|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice\w*|notification\w*|alert\w*|popup|modal|overlay|newsletter|subscri\w*|signup|sign-up|login|paywall|"
    r"nav|navbar|navigation|menu\w*|breadcrumb\w*|pagination|pager|sidebar\w*|side-bar|aside|widget\w*|related\w*|recommend\w*|share|sharing|social\w*|comments?|comment-\w+|commentlist|disqus\w*|respond|replies|reply|discussion|"
    r"footer\w*|foot|header|masthead|topbar|toolbar|site-header|page-header|skip-link|search\w*|tags|tagcloud|byline-ad|disclaimer|copyright)(?=$|[\s_-])",
    re.I,
)
#: Classes that say the same of a container inside an article; longer names may be the article's own words.
_INSIDE = frozenset("ad ads advert adverts advertisement adsbygoogle banner promo sponsored sponsor cookie-notice cookie-banner newsletter subscribe paywall nav navigation menu breadcrumb breadcrumbs pagination sidebar widget related related-posts related-articles share sharing share-bar share-buttons social social-share comments comment-list comment-section commentlist site-footer site-header".split())
_CONTAINERS = frozenset("div section ul ol dl table".split())
_NAME = re.compile(r"[A-Za-z][^\s/>\x00]*")
_INNER = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"

OPEN, CLOSE, TEXT = 0, 1, 2


def host_of(url: str) -> Column:
    """The lower-case host of a URL column; '' without one."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), _HOST, 1))


class Page:
    """Events in page order, as (kind, name or text, index of the element): elements have name, dropped, start, end."""

    def __init__(self, source: str):
        self.events: list[tuple[int, str, int]] = []
        self.names: list[str] = []
        self.dropped: list[bool] = []
        self.spans: list[list[int]] = []
        self._main = 0  # open article and main elements
        self._read(source)

    def _begin(self, name: str, attributes: str) -> int:
        index = len(self.names)
        drop = name in DROPPED
        if not drop and attributes and "=" in attributes or attributes and "hidden" in attributes:
            for key, *values in _ATTRIBUTE.findall(attributes):
                key, value = key.lower(), next((v for v in values if v), "")
                if key in ("class", "id") and name not in ("body", "html", "main"):
                    drop |= (name in _CONTAINERS and not _INSIDE.isdisjoint(value.lower().split())) if self._main else bool(_WORDS.search(value))
                elif key == "role" and value.lower() in DROPPED_ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    drop = True
        self.names.append(name)
        self.dropped.append(drop)
        self.spans.append([len(self.events), -1])
        self.events.append((OPEN, name, index))
        self._main += name in ("article", "main")
        return index

    def _end(self, index: int) -> None:
        self.spans[index][1] = len(self.events)
        self.events.append((CLOSE, self.names[index], index))
        self._main -= self.names[index] in ("article", "main")

    def _read(self, source: str) -> None:
        stack: list[int] = []
        opened: Counter[str] = Counter()
        names, events = self.names, self.events

        def close_to(depth: int) -> None:
            while len(stack) > depth:
                opened[names[stack[-1]]] -= 1
                self._end(stack.pop())

        at, size, last, quoted = 0, len(source), source.rfind(">"), True
        text = 0  # where the text that no event has begins
        while at < size:
            start = source.find("<", at)
            if start < 0:
                break
            closing = source.startswith("/", start + 1)
            found = _NAME.match(source, start + 1 + closing)
            if found:
                if found.end() > last:  # no tag ends here or later
                    size = start
                    break
                end = _INNER.match(source, found.end()).end() if quoted else 0
                if not quoted or end >= len(source) or source[end] != ">":
                    quoted, end = False, source.find(">", found.end())
                name, attributes, stop = found[0].lower(), source[found.end() : end], end + 1
            elif source.startswith("!--", start + 1):
                end = source.find("-->", start + 4)
                name, stop = None, end + 3 if end >= 0 else len(source)
            elif source[start + 1 : start + 2] in ("!", "?") and source[start + 1 : start + 2]:
                end = source.find(">", start)
                name, stop = None, end + 1 if end >= 0 else len(source)
            else:
                at = start + 1
                continue
            if start > text:
                events.append((TEXT, source[text:start], -1))
            at = text = stop
            if name is None:
                continue
            if closing:
                for k in range(len(stack) - 1, -1, -1) if opened[name] else ():
                    if names[stack[k]] == name:
                        close_to(k)
                        break
                    if name not in BLOCKS and names[stack[k]] in BLOCKS and name != "p":
                        break
                continue
            if name in CLOSES_P:
                for k in range(len(stack) - 1, -1, -1):
                    here = names[stack[k]]
                    if here == "p":
                        close_to(k)
                        break
                    if here in BLOCKS:
                        break
            elif name in SAME:
                for k in range(len(stack) - 1, -1, -1):
                    here = names[stack[k]]
                    if here in SCOPE[name]:
                        break
                    if here in SAME[name]:
                        close_to(k)
            index = self._begin(name, attributes)
            if name in VOID or attributes.endswith("/") and name not in BLOCKS and name not in RAW and name not in ("b", "i", "em", "strong", "span", "a"):
                self._end(index)
            elif name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                stop = end.start() if end else len(source)
                if stop > at:
                    events.append((TEXT, source[at:stop], -1))
                at = text = end.end() if end else len(source)
                self._end(index)
            elif len(stack) >= DEPTH:
                self._end(index)
            else:
                stack.append(index)
                opened[name] += 1
        if size > text:
            events.append((TEXT, source[text:size], -1))
        close_to(0)

    def parts(self) -> list[tuple[int, int]]:
        """The events of the main parts in page order: all outermost articles, or the outermost main elements if these hold more text outside of articles, else all.

        Parts inside dropped elements don't count; an article whose class says boilerplate only does where no other one is.
        """
        whole = [(0, len(self.events))]
        if "article" not in self.names and "main" not in self.names:
            return whole
        found: dict[str, list[tuple[int, int]]] = {"article": [], "main": []}
        named: list[tuple[int, int]] = []
        until, skipped = {"article": 0, "main": 0}, 0
        for index, name in enumerate(self.names):
            a, b = self.spans[index]
            if a < skipped:
                continue
            if name in found and a >= until[name]:
                if self.dropped[index]:
                    named += [(a, b + 1)] * (name == "article")
                    skipped = b
                else:
                    found[name].append((a, b + 1))
                    until[name] = b
            elif self.dropped[index]:
                skipped = b
        sizes = np.concatenate(([0], np.cumsum([len(t) if k == TEXT else 0 for k, t, _ in self.events])))
        held = lambda spans: int(sum(sizes[b] - sizes[a] for a, b in spans))
        articles, mains = found["article"] or ([] if found["main"] else sorted(named, key=lambda x: held([x]))[-1:]), found["main"]
        inner = [(a, b) for a, b in articles if any(x <= a and b <= y for x, y in mains)]
        if articles and held(mains) - held(inner) <= held(articles):
            return articles
        return mains or whole

    def subtrees(self) -> tuple[dict[int, int], dict[int, int], int]:
        """Hashes of the elements that hold text, by index: those outside of the main parts and whole blocks inside them; and the hash of the main parts.

        The same subtree has different hashes outside and inside.
        """
        parts, n = self.parts(), len(self.events)
        whole = parts == [(0, n)]
        within, begun = np.zeros(n + 1, np.int8), np.zeros(n + 1, np.int64)
        for a, b in [] if whole else parts:
            within[a:b], begun[a + 1] = 1, 1
        within, begun, ends = within.tolist(), np.cumsum(begun).tolist(), {} if whole else dict(parts)
        outside, inside, mains, open_hashes = {}, {}, [], []
        for place, (kind, value, index) in enumerate(self.events):
            if kind == OPEN:
                open_hashes.append([f"<{value}"])
            elif kind == TEXT:
                if open_hashes and (text := _SPACE.sub(" ", value).strip()):
                    open_hashes[-1].append(text)
            else:
                held = open_hashes.pop()
                if len(held) > 1:
                    got = xxhash.xxh3_64_intdigest("\x01".join(held)) - (1 << 63)
                    if open_hashes:
                        open_hashes[-1].append(f"{got:x}")
                    start = self.spans[index][0]
                    if ends.get(start) == place + 1:
                        mains.append(got)
                    elif within[place]:
                        if value in WHOLE and not self.dropped[index]:
                            inside[index] = ~got
                    elif (whole or begun[place + 1] == begun[start]) and value not in ("html", "body", "head"):
                        outside[index] = got
        main = mains[0] if len(mains) == 1 else xxhash.xxh3_64_intdigest(repr(mains)) - (1 << 63) if mains else 0
        return outside, inside, main

    def text(self, template: set[int] | frozenset[int] = frozenset()) -> str:
        """The blocks of the main parts without dropped and template elements."""
        parts = self.parts()
        outside, inside, _ = self.subtrees() if template else ({}, {}, 0)
        hashes = outside | inside
        blocks, line, skip = [], [], 0
        names, dropped = self.names, self.dropped
        header_ok = parts != [(0, len(self.events))]

        def flush() -> None:
            if line:
                if text := _SPACE.sub(" ", entities.unescape("".join(line))).strip():
                    blocks.append(text)
                line.clear()

        for a, b in parts:
            own = self.events[a][2] if header_ok else -1  # a part is kept, whatever its own class says
            for place in range(a, b):
                kind, value, index = self.events[place]
                if kind == TEXT:
                    if not skip:
                        line.append(value)
                    continue
                gone = index != own and (dropped[index] or value == "header" and not header_ok or index in hashes and hashes[index] in template)
                if kind == OPEN:
                    if not skip and names[index] in BLOCKS:
                        flush()
                    if not skip and value == "br":
                        line.append(" ")
                    skip += gone
                else:
                    skip -= gone
                    if not skip and value in BLOCKS:
                        flush()
            flush()
        return "\n".join(blocks)


def _subtree_rows(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(host, inside, page hash, subtree hash) of distinct subtrees by page or, inside, by main part; subtree 0 stands for the page or main part itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "html"):
                hosts, sides, keys, hashes = [], [], [], []
                for host, source in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                    outside, inside, main = Page(source or "").subtrees()
                    for side, held, key in ((False, outside, xxhash.xxh3_64_intdigest(source or "") - (1 << 63)), (True, inside, main)):
                        if main or not side:
                            found = {*held.values(), 0}
                            hosts += [host] * len(found)
                            sides += [side] * len(found)
                            keys += [key] * len(found)
                            hashes += found
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(sides, pa.bool_()), pa.array(keys, pa.int64()), pa.array(hashes, pa.int64())], names=["host", "inside", "page", "subtree"])

    return bounded(pages).select(host_of(url).alias("host"), F.col(html).alias("html")).mapInArrow(run, "host string, inside boolean, page long, subtree long")


def templates(pages: DataFrame, url: str = "url", html: str = "html", share: float = TEMPLATE_SHARE, least: int = LEAST_PAGES, least_main: int = LEAST_MAIN) -> DataFrame:
    """(host, subtrees): the hashes that recur on at least ``share`` of a host's distinct pages or, inside, main parts.

    At most (subtrees of a page) / share hashes can reach the share, so a host's list has the size of a few pages.
    """
    rows = _subtree_rows(pages, url, html).distinct().groupBy("host", "inside", "subtree").agg(F.count("*").alias("n"))
    scratch = Scratch(pages.sparkSession)
    counted = scratch.keep(rows.filter("n >= 2"), "subtrees")
    total = counted.filter(F.expr(f"subtree = 0 AND n >= IF(inside, {least_main}, {least})")).select("host", "inside", F.col("n").alias("pages"))
    chosen = counted.filter("subtree <> 0").join(total, ["host", "inside"]).filter(F.col("n") >= share * F.col("pages"))
    out = scratch.keep(chosen.groupBy("host").agg(F.collect_list("subtree").alias("subtrees")), "templates")
    scratch.drop(counted)
    return out


def main_text(pages: DataFrame, url: str = "url", html: str = "html", out: str = "text") -> DataFrame:
    """All columns of ``pages`` with the main text.

    Templates join by host. They are a written table, so the planner knows their size: it sends them to all tasks if
    they are small and else shuffles both sides, where a hot host's pages may be split.
    """
    from pyspark.sql import types as T

    keep = [c for c in pages.columns if c != out]
    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField(out, T.StringType())])
    joined = pages.select(F.struct(*keep).alias("page"), host_of(url).alias("host"), F.col(html).alias("html")).join(templates(pages, url, html), "host", "left").select("page", "html", "subtrees")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "html"):
                texts, last, known = [], None, frozenset()
                for source, subtrees in zip(part.column("html").to_pylist(), part.column("subtrees").to_pylist()):
                    if subtrees != last:
                        last, known = subtrees, frozenset(subtrees or ())
                    texts.append(Page(source or "").text(known))
                yield pa.RecordBatch.from_arrays([*part.column("page").flatten(), pa.array(texts, pa.string())], names=[*keep, out])

    return joined.mapInArrow(run, schema)


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
