"""HTML extraction by consensus host paths.

Each page's containers get a score from the running text in them (a paragraph counts for its container, half for the one above); the
best one votes with its generalised path of tags and classes (digits dropped); a path is a number that leads to the path above it and its own
part, so deep pages take no more than long ones. Spark counts votes per host, pre-aggregated before the shuffle;
pages are then extracted again from what matches their host's winning path, from their own best container where nothing does.
Menus, headers outside article and main elements, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out by tag,
role or name: a class or id each of whose words says what is left out or where it stands, as in site-nav, ad-1 or comments-list, not in
social-history; or one that says who wrote and what, as in reader-opinions. An element is never left out for its name that holds the page's main, all its articles or, without
either, most of its text, nor for a name such as social or related where it holds running text rather than links.
Winning paths are looked up by broadcast while their measured size allows, else by host and salt, so that a hot host's pages are dealt out.
Character references are decoded, white space inside a block becomes one space, blocks are joined by one space.

Defined cases: a null or empty page gives the empty text; pages without a host share the host ''; ties between paths go to the higher
score, then to the smaller path; repeated rows are extracted each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _words
from ._shared import look_up, save, small_batches, table

# HTML's elements by their role.
RAW = "script|style|noscript|template|svg|math|iframe|object|canvas|textarea|select|title"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CONTAINERS = frozenset("article main section div td body blockquote center".split())
DROPPED = frozenset("nav footer aside form head button dialog menu".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus footer gdpr masthead menu modal nav navbar navigation "
    "newsletter notice notices notification overlay pagination popup promo promoted related recommended replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
#: Of DROPPED_WORDS those that an article's own part may be named by, too: such a part stays if it holds PROSE characters outside links, and fewer in them.
WEAK_WORDS = frozenset("promoted recommended related share sharing social widget widgets".split())
PROSE = 200
#: A name with a word of each is one of readers' comments.
READERS = frozenset("reader readers user users visitor visitors".split())
SAYINGS = frozenset("comments feedback letters opinions replies responses reviews thoughts".split())
CLOSES = {"li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+(?:/>|>.*?(?:</\1\s*+[^>]*+>|\Z)|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>|<[!?][^>]*+>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
_PARTS = re.compile(r"[^A-Za-z]+")
#: Words that may stand beside one of DROPPED_WORDS in a name: they tell of place, order or make of an element.
PLACES = frozenset(
    "aside bar bars block blocks body bottom box boxes btn button buttons center col column columns container content element feed first footer form frame global group header heading icon icons inline inner item "
    "items js last layer left link links list lists lower main message messages mobile module outer page panel post posts primary region right row section secondary site slot small sticky stories strip thread title "
    "top unit upper wrap wrapper zone articles this now us".split()
)
_NUMBER = re.compile(r"[0-9]+")


def _named(name: str) -> int:
    """Whether a class or id tells of what is left out: 2 if its words are DROPPED_WORDS, one at least, and PLACES, or say that readers wrote it; 1 if
    all of the former are WEAK_WORDS; else 0."""
    parts = {x for x in _PARTS.split(name.lower()) if x}
    if parts & READERS and parts & SAYINGS:
        return 2
    told = parts & DROPPED_WORDS
    if not told or parts - DROPPED_WORDS - PLACES:
        return 0
    return 1 if told <= WEAK_WORDS else 2


class Page:
    """Elements that are not inline, in page order, and the pieces of text with the element that holds each."""

    def __init__(self, source: str):
        self.tags, self.above, self.dropped = ["#page"], [-1], [False]
        self.path = [0]  # of each element the number of its path
        self.parts: list[tuple[int, str]] = [(-1, "")]  # of each path the one above it and its own part
        self.numbers: dict[tuple[int, str], int] = {}
        self.held = [0]  # the container that is or holds an element
        self.named = [0]  # to be dropped for its class or id
        self.in_article = [False]
        self.pieces: list[tuple[int, str, bool]] = []  # element, text, in a link
        stack, link, at, open_ = [0], 0, 0, Counter()
        for m in _TOKEN.finditer(source):
            if m.start() > at:
                self._text(stack[-1], source[at : m.start()], link > 0)
            at = m.end()
            tag = m[3] and m[3].lower()
            if not tag:
                continue
            if tag in INLINE:
                if tag == "a":
                    link = 0 if m[2] else 1
                continue
            self.pieces.append((stack[-1], " ", False))
            if tag in VOID:
                continue
            if m[2] and not open_[tag]:
                pass
            elif m[2]:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tags[stack[k]] == tag:
                        open_.subtract(self.tags[x] for x in stack[k:])
                        del stack[k:]
                        break
            else:
                if self.tags[stack[-1]] == "p":
                    open_[self.tags[stack.pop()]] -= 1
                if self.tags[stack[-1]] in CLOSES.get(tag, ()):
                    open_[self.tags[stack.pop()]] -= 1
                stack.append(self._element(tag, m[4], stack[-1]))
                open_[tag] += 1
                link = 0
            self.pieces.append((stack[-1], " ", False))
        if at < len(source):
            self._text(stack[-1], source[at:], link > 0)
        self._drop_named()

    def _drop_named(self) -> None:
        """Drop named elements with all in them, but for those that hold the page's main, all its articles or, without either, most of its text, and for
        those with a weak name that hold running text."""
        if not any(self.named):
            return
        n = len(self.tags)
        mains, articles, size, linked = [0] * n, [0] * n, [0] * n, [0] * n
        for element, text, link in self.pieces:
            (linked if link else size)[element] += len(text.strip())
        for k in range(n - 1, -1, -1):
            if not self.dropped[k]:
                mains[k] += self.tags[k] == "main"
                articles[k] += self.tags[k] == "article"
                if k:
                    for held in (mains, articles, size, linked):
                        held[self.above[k]] += held[k]
        for k in range(1, n):
            if self.named[k]:
                holds = mains[k] or (articles[0] and articles[k] == articles[0]) or (not mains[0] and not articles[0] and 2 * size[k] > size[0])
                holds = holds or (self.named[k] == 1 and size[k] >= PROSE and size[k] > linked[k])
                self.dropped[k] = self.dropped[k] or not holds
            self.dropped[k] = self.dropped[k] or self.dropped[self.above[k]]

    def _text(self, element: int, text: str, link: bool) -> None:
        if not self.dropped[element]:
            self.pieces.append((element, entities.unescape(text) if "&" in text else text, link))

    def _element(self, tag: str, attributes: str, above: int) -> int:
        found: dict[str, str] = {}
        for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
            found.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
        names = found.get("class", "").split()
        drop = self.dropped[above] or tag in DROPPED or found.get("role", "").lower() in DROPPED_ROLES or "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true"
        drop = drop or (tag == "header" and not self.in_article[above])
        self.in_article.append(tag in ("article", "main") or self.in_article[above])
        self.named.append(0 if tag in ("html", "body", "article", "main") else max(map(_named, (*names, found.get("id", "")))))
        self.tags.append(tag)
        self.above.append(above)
        self.dropped.append(drop)
        part = (self.path[above], ".".join([tag, *sorted({_NUMBER.sub("", x).lower().replace(">", "") for x in names})]))
        if part not in self.numbers:
            self.numbers[part] = len(self.parts)
            self.parts.append(part)
        self.path.append(self.numbers[part])
        self.held.append(len(self.tags) - 1 if tag in CONTAINERS else self.held[above])
        return len(self.tags) - 1

    def path_text(self, element: int) -> str:
        """An element's path from the page down."""
        k, out = self.path[element], []
        while k > 0:
            k, part = self.parts[k]
            out.append(part)
        return ">".join(reversed(out))

    def path_number(self, text: str) -> int | None:
        """The number of a path, or None if the page has no such element."""
        k: int | None = 0
        for part in text.split(">"):
            k = self.numbers.get((k, part))
            if k is None:
                return None
        return k

    def best(self) -> tuple[str, float]:
        """The path of the best container, raised to the article or main that holds it, and its score; '' and 0 without text."""
        blocks: dict[int, list[float]] = {}
        for element, text, link in self.pieces:
            if text != " " and not self.dropped[element]:
                x = blocks.setdefault(element, [0, 0, 0])
                x[0] += len(text)
                x[1] += len(text) * link
                x[2] += text.count(",")
        scores: dict[int, float] = {}
        for element, (size, linked, commas) in blocks.items():
            worth = (1 + commas + min(size / 100, 10)) * (1 - linked / size) if size >= 25 else 0.1 * (1 - linked / size)
            own = self.held[element]
            scores[own] = scores.get(own, 0) + worth
            if own > 0:
                over = self.held[self.above[own]]
                scores[over] = scores.get(over, 0) + worth / 2
        if not scores:
            return "", 0.0
        top = max(scores, key=lambda k: (scores[k], -k))
        k = top
        while k > 0:
            if self.tags[k] in ("article", "main"):
                return self.path_text(k), scores[top]
            k = self.above[k]
        return self.path_text(top), scores[top]

    def text(self, path: str) -> str | None:
        """All text under elements of the path, without what is dropped; None if there is no such element."""
        number = self.path_number(path) if path else 0
        if number is None:
            return None
        inside = [False] * len(self.tags)
        for k, own in enumerate(self.path):
            inside[k] = own == number or (k > 0 and inside[self.above[k]])
        return " ".join("".join(text for element, text, _ in self.pieces if inside[element] and not self.dropped[element]).split())


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def votes(pages: DataFrame) -> DataFrame:
    """host, path, score: each page's best container. pages: host, html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _words.slices(batches, "html"):
            best = [Page(t.decode("utf-8", "replace")).best() for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("host"), pa.array([b[0] for b in best], pa.string()), pa.array([b[1] for b in best], pa.float64())], names=["host", "path", "score"])

    return pages.mapInArrow(run, "host string, path string, score double")


def winning_paths(voted: DataFrame) -> DataFrame:
    """host, path: by votes, then by summed score (to a thousandth), then the smaller path."""
    counted = voted.where("path != ''").groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(F.round(F.col("score") * 1000).cast("long")).alias("score"))
    most = Window.partitionBy("host").orderBy(F.desc("n"), F.desc("score"), "path")
    return counted.withColumn("rank", F.row_number().over(most)).where("rank = 1").select("host", "path")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text. pages: page_id, url, html."""
    source = small_batches(pages).select(pages["page_id"], pages["url"], pages["html"], _host(pages["url"]).alias("host"))
    paths = save(winning_paths(votes(source.select("host", "html"))), "paths")
    schema = T.StructType([source.schema["page_id"], source.schema["url"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _words.slices(batches, "html"):
            out = []
            for raw, path in zip(texts, part.column("path").to_pylist(), strict=True):
                page = Page(raw.decode("utf-8", "replace"))
                text = page.text(path) if path else None
                out.append(text or page.text(page.best()[0]) or "")
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    return look_up(source, paths, ["host"], "left").select("page_id", "url", "html", "path").mapInArrow(run, schema)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op9_html_extraction": op9_html_extraction}
