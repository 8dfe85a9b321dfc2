"""Main text of web pages by container paths that the pages of a host agree on.

Each page's containers are scored by the running text that they hold. A
container is named by its generalised path, tags with classes in which digits
are all alike, and the pages of a host vote on paths with their scores. Every
page is then read again, and its text is taken from the path that won on its
host, or from its own best container where that path holds no running text or the page has no host. A container is widened to those around it that add a headline or
further parts of the text.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .urls import host_of

#: Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CONTAINERS = frozenset("body article main section div td blockquote center root".split())
DROPPED = frozenset("nav footer aside form button select option menu dialog object canvas audio video map math head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Words in a class or id that mark what isn't the article.
BOILERPLATE = frozenset(
    "nav navbar navigation menu menubar topbar toolbar masthead footer sidebar aside widget widgets breadcrumb breadcrumbs pagination pager"
    " ad ads adv advert adverts advertisement advertisements advertising adsbygoogle adsense adbox adblock adslot adunit adspace banner sponsor sponsored promo promotion"
    " notice notices alert alerts announcement disclaimer paywall cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login search"
    " social share sharing related recommended comment comments commentlist reply replies respond responses reactions disqus discussion".split()
)

#: Words that stand beside those in names of the parts of a page. Inside an article an element goes only if a class
#: or id is made of both kinds alone: related-links goes, related-work stays.
PARTS = frozenset(
    "area articles aside bar block blocks body bottom box btn button buttons center column container content count div footer form head header icon icons inline"
    " inner input item items label left link links list main module new news outer page panel post posts right row section site slot slots small stories text thread"
    " title toggle top unit user users view wrap wrapper".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title|noscript|iframe|template|svg|xmp|noframes)(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*>?"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[/a-zA-Z][^>]*>"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_DIGITS, _WORDS, _STATE = re.compile(r"\d+"), re.compile(r"[A-Z]?[a-z]+|[A-Z]+"), re.compile(r"^(?:has|no|with|without|is|not)[-_]")
#: A path spells so many of a container's innermost levels; a digest of all its levels stands for the rest.
SPELT = 8
#: Votes are whole numbers, so that sums don't depend on their order.
VOTES = 1000
#: What a wider container has to add of running text unless it adds a headline.
PART = 0.1


def _generalised(tag: str, classes: list[str]) -> str:
    return ".".join([tag, *sorted({_DIGITS.sub("#", c) for c in classes})])


def _named(names: str, article: bool) -> tuple[bool, bool]:
    """Whether a class or id attribute marks what isn't the article, and whether it says header."""
    marked = header = False
    for name in names.split():
        if _STATE.match(name.lower()):
            continue
        words = {w.lower() for w in _WORDS.findall(name)}
        header = header or "header" in words
        marked = marked or bool(words & BOILERPLATE) and (not article or words <= BOILERPLATE | PARTS)
    return marked, header


#: Why an element is dropped: it isn't, by a class or id alone, for sure.
KEPT, NAMED, SURE = 0, 1, 2


class Page:
    """Blocks of text in page order, each with the container that holds it."""

    def __init__(self, source: str):
        self.paths: list[str] = ["root"]  # by container
        digests, levels = [0], [("root",)]
        self.tags = ["root"]
        self.parents = [-1]
        self.articles = [-1]  # by container: the nearest article or main element, itself included
        self.blocks: list[tuple[int, str, int]] = []  # container, text, characters in links
        self.headlines: set[int] = set()  # numbers of blocks
        # open elements: tag, container, dropped, in a link, in an article
        stack = [("root", 0, KEPT, False, False)]
        parts: list[str] = []
        linked = 0

        def flush() -> None:
            nonlocal linked
            if parts:
                text = " ".join(html.unescape("".join(parts)).split())
                if text:
                    if any(e[0] in ("h1", "h2") for e in stack):
                        self.headlines.add(len(self.blocks))
                    self.blocks.append((stack[-1][1], text, min(linked, len(text))))
                parts.clear()
            linked = 0

        for m in _TOKEN.finditer(source):
            text = m["text"]
            if text is not None:
                if not stack[-1][2]:
                    parts.append(text)
                    if stack[-1][3]:
                        linked += len(text)
                continue
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            inline = tag in INLINE
            if tag == "br":
                parts.append(" ")
                continue
            if not inline:
                flush()
            if m["end"]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
                    if inline and stack[i][0] not in INLINE:
                        break
                continue
            if tag in VOID:
                continue
            if not inline:
                closes, scope = CLOSES.get(tag, {"p"}), SCOPES.get(tag, CONTAINERS)
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in closes:
                        del stack[i:]
                        break
                    if stack[i][0] in scope:
                        break
            if tag in ("article", "main"):  # a menu or page header that was never closed ends here
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in ("nav", "header", "footer"):
                        del stack[i:]
            _, at, dropped, link, article = stack[-1]
            attrs = m["attrs"]
            classes: list[str] = []
            article = article or tag in ("article", "main")
            if tag in ("article", "main") and dropped == NAMED:
                dropped = KEPT  # what is around an article isn't furniture, whatever its name
            marked = header = False
            if attrs and "=" in attrs or "hidden" in attrs:
                for a in _ATTR.finditer(attrs):
                    name, written_ = a[1].lower(), a[2] or a[3] or a[4] or ""
                    value = written_.lower()
                    if name == "class":
                        classes = value.split()
                    if name in ("class", "id"):
                        by_name, as_header = _named(written_, article)
                        marked, header = marked or by_name, header or as_header
                    elif name == "role":
                        dropped = SURE if value.strip() in ROLES else dropped
                    elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                        dropped = SURE
            if tag in DROPPED or tag == "header" and not article:
                dropped = SURE
            elif tag not in ("html", "body", "main", "article") and (marked or header and not article):
                dropped = dropped or NAMED
            if tag in CONTAINERS:
                own = _generalised(tag, [] if tag == "body" else classes)  # a body's classes tell pages apart, not parts
                digests.append(xxhash.xxh64_intdigest(own, digests[at]))
                levels.append((*levels[at], own)[-SPELT:])
                self.paths.append("/".join(levels[-1]) + f"#{digests[-1]:016x}")
                self.tags.append(tag)
                self.parents.append(at)
                self.articles.append(len(self.paths) - 1 if tag in ("article", "main") else self.articles[at])
                at = len(self.paths) - 1
            stack.append((tag, at, dropped, link or tag == "a", article))
        flush()

    def scores(self) -> dict[str, float]:
        """By path: running text of the blocks in it, half of that for the container around it,
        and a little more than all of it for the nearest article or main element around it."""
        found: dict[str, float] = defaultdict(float)
        for at, text, linked in self.blocks:
            worth = len(text) - 2 * linked
            if worth > 0:
                shares = {at: 1.0}
                if self.parents[at] >= 0:
                    shares[self.parents[at]] = 0.5
                if self.articles[at] >= 0:
                    shares[self.articles[at]] = 1.25
                for node, share in shares.items():
                    found[self.paths[node]] += worth * share
        return found

    def best(self) -> str | None:
        found = self.scores()
        return max(found, key=lambda k: (found[k], k)) if found else None

    def text(self, path: str | None) -> str:
        """The blocks in all containers of that path, or of the page's own best one where it holds no running text, widened."""
        count, last = len(self.paths), len(self.blocks)
        # by container, with all that is in it: running text, characters in links, the first block and headline
        prose, links, first, headline = [0] * count, [0] * count, [last] * count, [last] * count
        for k, (at, text, linked) in enumerate(self.blocks):
            prose[at] += max(0, len(text) - 2 * linked)
            links[at] += linked
            first[at] = min(first[at], k)
            if k in self.headlines:
                headline[at] = min(headline[at], k)
        for i in range(count - 1, 0, -1):  # a container's parent comes before it
            up = self.parents[i]
            prose[up] += prose[i]
            links[up] += links[i]
            first[up], headline[up] = min(first[up], first[i]), min(headline[up], headline[i])

        def widened(node: int) -> int:
            around, least = self.parents[node], max(0, self.articles[node])
            while around >= least:
                more, linked = prose[around] - prose[node], links[around] - links[node]
                if more or linked:
                    headed = headline[around] < first[node]
                    # all of a page is its article only under a headline, and if that doesn't add more than there is
                    whole = self.tags[around] in ("root", "body")
                    if more <= linked or not headed and (whole or more < PART * prose[node]) or whole and more > prose[node]:
                        break
                    node = around
                around = self.parents[around]
            return node

        for wanted in (path, self.best()):
            if wanted is None:
                continue
            tops: set[int] = set()
            inside: list[bool] = []
            for i, p in enumerate(self.paths):
                within = self.parents[i] >= 0 and inside[self.parents[i]]
                inside.append(within or p == wanted)
                if inside[i] and not within:
                    tops.add(i)
            wide = {widened(i) for i in tops if prose[i]} or (set() if prose[0] else tops)
            if wide:
                inside = []
                for i in range(count):
                    inside.append(self.parents[i] >= 0 and inside[self.parents[i]] or i in wide)
                return " ".join(text for at, text, _ in self.blocks if inside[at])
        return ""


def votes(pages: DataFrame) -> DataFrame:
    """(host, path) rows: the path with most votes of each host, by name among equals."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total: dict[tuple[str, str], int] = defaultdict(int)  # summed before the shuffle
            for host, source in zip(b.column("host").to_pylist(), b.column("html"), strict=True):
                found = Page(source.as_py()).scores()
                whole = sum(found.values())
                for path, x in found.items():
                    total[host, path] += round(VOTES * x / whole)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.string()), pa.array(total.values(), pa.int64())], names=["host", "path", "votes"])

    counted = pages.where("host <> ''").select("host", "html").mapInArrow(score, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return counted.groupBy("host").agg(F.max_by("path", F.struct("votes", "path")).alias("path"))


#: Bytes of hosts and paths up to which they are broadcast, and parts that a host's pages are dealt in beyond that.
BROADCAST_BYTES, SALTS = 8 << 20, 32


def main_text(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text, n_chars and the path of each row of ``pages`` (page_id, url, html).

    A null html counts as empty and gives an empty text; so does a page with
    nothing but menus and the like. A page with a null url, or one without a host, goes by
    its own best container. Rows stay one to one, repeated ones too; an
    empty table stays empty; other columns aren't read. Up to
    ``broadcast_bytes`` the hosts and their winning paths are broadcast, beyond that they
    are joined by a shuffle that deals a host's pages in parts. Each page is worked on alone, so that memory is
    bounded by the longest page and the paths of one batch.
    """
    rows = pages.select("page_id", "url", host_of("url").alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    won, _ = written(votes(rows), "host-paths")
    size = won.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 16).alias("n")).first()["n"] or 0
    if size <= broadcast_bytes:
        joined = rows.join(F.broadcast(won), "host", "left")
    else:
        salted = won.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    joined = joined.select("page_id", "url", "html", "path")
    kind = dict(pages.dtypes)["page_id"]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [Page(s.as_py()).text(p) for s, p in zip(b.column("html"), b.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), b.column("path")], names=["page_id", "url", "text", "n_chars", "path"])

    return joined.mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long, path string")
