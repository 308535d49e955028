"""Main text of web pages by consensus paths of their hosts.

Every page's containers are scored by the text in their blocks, less what lies in links.
The best one's path of tags and classes, with digits generalised and places dropped, is
the page's vote; votes are added up per host and path in Spark. Each page is then read
again at its host's winning path, or at its own best container where it has no such
path. Menus, headers, footers, sidebars, notices, adverts, forms, scripts and comments
never count as text, by tag, role or class, inside the container too.

Votes are partial sums before the shuffle, so a host with a third of all pages is no hot
key; the winning paths are broadcast while their number is small and joined by host above.

Defined results: null, empty and text-less pages give an empty text; repeated rows give a
row each; broken or unclosed markup is read as far as it goes; a url without a host votes
under the empty host; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.shared import chunks, ship
from loomline.llm.similar import small

TEXT_BYTES = 4 << 20
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style noscript template svg iframe textarea select title".split()}
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_REST = re.compile(r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_PLAIN_REST = re.compile(r"([^>]*+)>")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CONTAINER = frozenset("article main section div body td center".split())
_NOISE_TAG = frozenset("nav footer aside button head menu dialog object map".split())
_NOISE_WORD = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar side nav navbar navigation menu breadcrumb breadcrumbs footer header masthead topbar comment comments disqus reply replies respond notice notices cookie cookies consent gdpr newsletter subscribe subscription signup login share sharing social related recommended popup modal overlay widget toolbar pagination pager".split()
)
#: Words that may stand beside a noise word in a class without changing what it says.
_BESIDE = frozenset(
    "site main page global top bottom left right upper lower box bar list section wrap wrapper container block area button buttons link links post posts article articles inner outer content primary secondary form slot unit item items panel group body text title image img icon icons row col column mobile desktop fixed sticky js v el m".split()
)
_NOISE_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
_IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CLOSES_P = _BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt"} | {"li"}


def tokens(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Start, end, tag name, whether it ends an element, and attributes of all tags in order.

    Comments and elements of raw text are one token without a name. A tag ends at the first
    ``>`` outside quoted values; once a page has a tag that never ends so, at the first
    ``>`` whatsoever, so that each character is looked at a bounded number of times.
    """
    at, rest = 0, _REST
    while (at := html.find("<", at)) >= 0:
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            end = len(html) if end < 0 else end + 3
            yield at, end, "", False, ""
            at = end
            continue
        name = _NAME.match(html, at)
        if not name:
            if html.startswith(("<!", "<?"), at) and (end := html.find(">", at)) >= 0:
                yield at, end + 1, "", False, ""
                at = end
            at += 1
            continue
        m = rest.match(html, name.end())
        if not m and rest is _REST:
            rest = _PLAIN_REST
            m = rest.match(html, name.end())
        if not m:
            return  # no tag ends any more
        tag, closing = name.group(1).lower(), html[at + 1] == "/"
        if tag in _RAW and not closing:
            end = _RAW[tag].search(html, m.end())
            to = end.end() if end else len(html)
            yield at, to, "", False, ""
            at = to
            continue
        yield at, m.end(), tag, closing, m.group(1)
        at = m.end()


def is_noise(name: str) -> bool:
    """Whether one class or id says that an element is no part of the text.

    ``site-footer`` or ``comments`` do; ``has-sidebar``, ``comments-open``, ``share-price`` don't.
    """
    words = [w for w in re.split("[^a-z]+", name) if w]
    return any(w in _NOISE_WORD for w in words) and all(w in _NOISE_WORD or w in _BESIDE for w in words)


class Node:
    """An element: its path, whether it is noise, and where its blocks begin and end."""

    __slots__ = ("tag", "path", "noise", "link", "first", "last", "article")

    def __init__(self, tag: str, path: str, noise: bool, link: bool, first: int, article: bool) -> None:
        self.tag, self.path, self.noise, self.link, self.first, self.last, self.article = tag, path, noise, link, first, -1, article


class Page:
    """Blocks of a page in order, without noise, and its containers.

    A form is noise, but for one round paragraphs that are more than half of the page's text.
    """

    def __init__(self, html: str, kept: frozenset[int] = frozenset()) -> None:
        forms: list[list] = []  # characters and paragraphs in each form
        open_forms: list[tuple[Node, list]] = []
        total = 0
        self.blocks: list[str] = []
        self.plain: list[int] = []
        self.containers: list[Node] = []
        root = Node("", "", False, False, 0, False)
        stack, parts, outside = [root], [], 0
        at = 0

        def flush() -> None:
            nonlocal outside
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.blocks.append(text)
                    self.plain.append(min(outside, len(text)))
                parts.clear()
            outside = 0

        def close() -> None:
            node = stack.pop()
            if open_forms and open_forms[-1][0] is node:
                open_forms.pop()
            if node.tag in _BLOCK:
                flush()
            node.last = len(self.blocks)

        def words(raw: str) -> None:
            nonlocal outside, total
            if raw:
                total += len(raw)
                for _, held in open_forms:
                    held[0] += len(raw)
            if raw and not stack[-1].noise:
                text = unescape(raw) if "&" in raw else raw
                parts.append(text)
                if not stack[-1].link:
                    outside += len(text)

        for start, end, tag, closing, attributes in tokens(html):
            words(html[at:start])
            at = end
            if not tag:
                continue
            if closing:
                if any(n.tag == tag for n in stack[1:]):
                    # an end tag closes what is open inside, but no table cell or body from inside
                    while stack[-1].tag != tag:
                        close()
                    close()
                elif tag in _BLOCK:
                    flush()
                continue
            if tag == "br":
                words(" ")
                continue
            if tag in _BLOCK:
                flush()
                if tag in _CLOSES_P:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].tag == "p":
                            while len(stack) > k:
                                close()
                            break
                        if stack[k].tag in _BLOCK:
                            break
                if tag in _IMPLIED:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].tag in _IMPLIED[tag]:
                            while len(stack) > k:
                                close()
                            break
                        if stack[k].tag in _BLOCK and stack[k].tag not in _IMPLIED[tag]:
                            break
            if tag in _VOID:
                continue
            top = stack[-1]
            name, noise = tag, top.noise or tag in _NOISE_TAG or (tag == "header" and not top.article)
            for k, *values in _ATTRIBUTE.findall(attributes):
                value = next(filter(None, values), "").lower()
                k = k.lower()
                if k == "class" and value:
                    name += "." + ".".join(sorted(re.sub(r"\d+", "#", c) for c in value.split()))
                if k == "hidden" or (k == "role" and value in _NOISE_ROLE):
                    noise = True
                elif k in ("class", "id") and tag not in ("body", "html", "article", "main"):
                    noise = noise or any(map(is_noise, value.split()))
            if tag == "form":
                noise = noise or len(forms) not in kept
                forms.append([0, 0])
            if tag in ("p", "article", "main", "h1", "h2"):
                for _, held in open_forms:
                    held[1] += 1
            node = Node(tag, f"{top.path}/{name}" if tag in _BLOCK else top.path, noise, top.link or tag == "a", len(self.blocks), top.article or tag in ("article", "main"))
            stack.append(node)
            if tag == "form":
                open_forms.append((node, forms[-1]))
            if tag in _CONTAINER and not noise:
                self.containers.append(node)
        words(html[at:])
        while len(stack) > 1:
            close()
        flush()
        root.last = len(self.blocks)
        self.root = root
        round_text = frozenset(i for i, (n, paragraphs) in enumerate(forms) if paragraphs and 2 * n > total)
        if round_text and not kept:
            self.__init__(html, round_text)

    def best(self) -> tuple[Node, float]:
        """The container with most text of its own kind: deep ones win over those around them."""
        total = sum(self.plain) or 1
        best, most = self.root, -1.0
        for node in [self.root, *self.containers]:
            held = sum(self.plain[node.first : node.last])
            all_ = sum(map(len, self.blocks[node.first : node.last])) or 1
            weight = {"article": 1.5, "main": 1.3}.get(node.tag, 1.0)
            score = held / total * (held / all_) * weight * (1 + 0.01 * node.path.count("/"))
            if score > most and held > 0:
                best, most = node, score
        return best, max(most, 0.0) * total

    def text(self, path: str | None) -> str:
        """Blocks below ``path``, or below the page's own best container."""
        nodes = [n for n in self.containers if n.path == path] if path else []
        if not any(n.last > n.first for n in nodes):
            nodes = [self.best()[0]]
        places = sorted({i for n in nodes for i in range(n.first, n.last)})
        return "\n\n".join([self.blocks[i] for i in places])


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "html", TEXT_BYTES):
        paths, scores = [], []
        for html in batch.column("html").to_pylist():
            node, score = Page(html or "").best()
            paths.append(node.path)
            scores.append(int(score))
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(paths, pa.string()), pa.array(scores, pa.int64())], ["host", "path", "score"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "html", TEXT_BYTES):
        texts = [Page(h).text(p) if h else "" for h, p in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("url"), pa.array(texts, pa.string())], ["key", "url", "text"])


def winning_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``host`` and the ``path`` that its pages voted for with most text; ties go to the first path."""
    ship(pages.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    votes = pages.select(host.alias("host"), F.col(html).cast("string").alias("html")).mapInArrow(_votes, "host string, path string, score long")
    counted = votes.where("path != ''").groupBy("host", "path").agg(F.sum("score").alias("score"))
    return counted.groupBy("host").agg(F.min(F.struct((-F.col("score")).alias("least"), "path"))["path"].alias("path"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Key, url and ``text`` of every page."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    kind = pages.schema[key].dataType.simpleString()
    own = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"), host.alias("host"))
    joined = own.join(small(winning_paths(pages, url, html)), "host", "left").select("key", "url", "html", "path")
    return joined.mapInArrow(_texts, f"key {kind}, url string, text string").withColumnRenamed("key", key).withColumnRenamed("url", url)
