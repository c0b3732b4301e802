"""Main text of web pages by consensus host paths.

Each page is walked once as a stream of tags. Elements that can hold an article are containers; a
container is named by its generalised path (tags with classes, digits and hashed names folded).
Elements and roles that say what they are (nav, footer, aside, dialog, scripts, styles, ...) are left
out. Class and id words (ad, menu, comments, ...) and forms only make an element suspect: it is scored
by how much of its name such words are, by its share of the page's text and by its share of links. A
name that is mostly such words loses unless the element holds MOST of the text; a name that has one
among others loses only if most of it is links.

A page votes for the deepest container that still holds most of its remaining text, but for none
inside one with text of its own, with the title, with several sections, or named as the main content
(main, or a class or id made of words like article and content) with several parts; and, for each path of
suspects, whether it stays. Spark adds the votes by host; every page is then read again with its
host's verdict on suspects, from the best winning path of its host that it has, or from its own vote
where it has none or where the path lies in a container that such a rule keeps whole.

Defined results: null, empty or text-free html gives ''. A page without a host votes alone. Tags
left open end with their parents or the page; a tag cut off by the end of the page is no text. If a
page has only elements of the left-out kinds, its text is ''. Votes that tie go to the path with more
text, then to the first in sort order; suspects that tie stay. Repeated rows vote each and give the
same text each. A page is held whole, with some 30 times its size; nothing else grows with its length.
All columns ride along in ``row``, or those that ``carry`` names.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvata.llm.spool import spool
from corvata.llm.textblocks import carried

#: A child with this share of its parent's text is the better container.
MOST = 0.7
#: A path names this many of the innermost containers; deeper ones differ by chance more than by kind.
STEPS = 8
#: Winning paths kept by host, each with at least this share of the host's pages.
PATHS, LEAST_SHARE = 3, 0.1
#: From this share of a name on, left-out words outweigh the rest of it; of a suspect's text, links outweigh the rest.
MOSTLY = 0.5
#: Paths of suspects that a host passes a verdict on, those with most votes; on others each page decides for itself.
SUSPECTS = 64

#: Raw-text elements are matched whole, with their content.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style|noscript|template|iframe|textarea|title|svg|math|select|button|object|canvas|video|audio)\b[^>]*>.*?(?:</\1\s*>|$)|<[!?][^>]*>"
    # a value is quoted only where the quote follows the equals sign; a quote that nothing closes is an ordinary character
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)>|<[a-zA-Z/][^>]*$",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s/>=]+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?", re.I)
_NAMED = frozenset(("class", "id", "role", "hidden"))
_CONTAINERS = frozenset("html body div article main section td center figure".split())
_INNER = frozenset("table tbody thead tr ul ol dl blockquote details fieldset th dd".split())
_LEFT_OUT = frozenset("nav footer aside dialog menu head".split())
_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre br hr figcaption address caption summary option th td tr legend".split()) | _CONTAINERS | _INNER | _LEFT_OUT | {"header", "form"}
_ENDS_P = _BLOCKS - {"br", "td", "th", "tr", "caption", "option", "legend", "summary"}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion promoted nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside rail footer foot"
    " masthead cookie cookies consent gdpr notice notices popup modal overlay subscribe subscription newsletter signup signin login register comment comments commentlist disqus reply replies respond"
    " share sharing sharebar social socials related recommended recommendations widget widgets toolbar pagination pager copyright disclaimer search searchbox alert toast teaser outbrain taboola".split()
)
_HEADS = frozenset(("header", "topbar", "siteheader"))
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_NEGATES = frozenset("has with without no not is".split())
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPLIT = re.compile(r"[^a-z0-9]+")


_OWN = frozenset("main content article post entry story body text".split())


def left_out(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    """Whether element or role alone say that this is not the article."""
    if tag in _LEFT_OUT or (tag == "header" and not in_article):
        return True
    return "hidden" in attrs or attrs.get("role", "").lower() in _ROLES


def suspicion(tag: str, attrs: dict[str, str], in_article: bool) -> float:
    """The largest share of left-out words in a class or id; 1 for a form."""
    if tag == "form":
        return 1.0
    if tag in ("html", "body", "article", "main"):
        return 0.0
    worst, own = 0.0, False
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = [w for w in _SPLIT.split(_CAMEL.sub("-", name).lower()) if w and not w.isdigit()]
        bad = sum((w in _WORDS or (w in _HEADS and not in_article)) and before not in _NEGATES for before, w in zip(["", *words], words, strict=False))
        own = own or (bool(words) and all(w in _OWN for w in words))
        if bad:
            worst = max(worst, bad / len(words))
    return min(worst, MOSTLY / 2) if own else worst


def announced(tag: str, attrs: dict[str, str]) -> bool:
    """Whether tag, class or id say that this is the page's main content."""
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}".split()
    return tag == "main" or any(words and all(w in _OWN for w in words) for words in ([w for w in _SPLIT.split(_CAMEL.sub("-", n).lower()) if w] for n in names))


def generalise(tag: str, attrs: dict[str, str]) -> str:
    classes = sorted({re.sub(r"\d+", "#", c) for c in attrs.get("class", "").split() if not re.fullmatch(r"(?=.*\d)[0-9a-zA-Z_-]{8,}", c)})
    name = attrs.get("id", "")
    return tag + "".join(f".{c}" for c in classes) + (f"#{re.sub(r'[0-9]+', '#', name)}" if name and not re.search(r"\d{3}", name) else "")


class Page:
    """Containers in page order, and the text pieces that stand in them."""

    def __init__(self, html: str, verdicts: dict[str, bool] | None = None):
        """verdicts: by path of a suspect, whether it stays."""
        self.names, self.tags, self.parent, self.end = ["html"], ["html"], [-1], [0]
        self.chars, self.h1, self.own = [0], [0], [False]  #: own: text that stands in no inner container
        self.linked, self.odd = [0], [0.0]  #: text in links, and how suspect the name is
        self.mine = [False]  #: whether the name says that this is the main content
        self.pieces: list[tuple[int, str]] = []
        self.kept = -1  #: what best() chose so that nothing beside the largest container is lost
        self._walk(html)
        self._judge(verdicts or {})
        self._add_up()

    def _walk(self, html: str) -> None:
        pieces, add = self.pieces, self.pieces.append
        stack: list[tuple[str, int]] = []  # open containers, and inner elements as (tag, -1)
        open_ = Counter()
        node, skip, skip_tag, depth, links, at, article = 0, False, "", 0, 0, 0, 0
        unescape = htmllib.unescape
        for m in _TOKEN.finditer(html):
            if m.start() > at and not skip:
                text = html[at : m.start()]
                if "&" in text:
                    text = unescape(text)
                add((node, text))
                if links:
                    self.linked[node] += len(text)
                else:
                    self.chars[node] += len(text)
                    self.own[node] = self.own[node] or not text.isspace()
            at = m.end()
            tag = m[3]
            if tag is None:
                continue
            tag = tag.lower()
            if skip:  # inside an element that is left out, only its own end counts
                if tag == skip_tag and tag not in _VOID:
                    depth += -1 if m[2] else not m[4].endswith("/")
                    skip = depth > 0
                elif skip_tag == "p" and tag in _ENDS_P and not m[2]:
                    skip = False
                elif m[2] and open_[tag]:
                    skip = False
                if skip or tag == skip_tag:
                    continue
            if tag == "a":
                links = 0 if m[2] else 1
                if m[2]:
                    continue
            if tag in _BLOCKS:
                add((node, " "))
                links = 0
            # an end tag ends all that stands open inside; a block ends an open p, an li an open li
            implied = stack[-1][0] if not m[2] and stack and ((stack[-1][0] == "p" and tag in _ENDS_P) or (stack[-1][0] == tag == "li")) else ""
            ends = tag if m[2] else implied
            if ends and open_[ends]:
                while True:
                    t, k = stack.pop()
                    open_[t] -= 1
                    if k >= 0:
                        self.end[k] = len(self.tags)
                        article -= self.tags[k] in ("article", "main")
                        node = self.parent[k]
                    if t == ends:
                        break
                if implied:
                    add((node, " "))
            if m[2]:
                continue
            if tag in _VOID:
                continue
            attrs = {}
            if m[4]:
                attrs = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in reversed(list(_ATTR.finditer(m[4]))) if a[1].lower() in _NAMED}
            odd = suspicion(tag, attrs, article > 0) if attrs or tag == "form" else 0.0
            if left_out(tag, attrs, article > 0) or (tag == "a" and odd >= MOSTLY):
                if not m[4].endswith("/"):
                    skip, skip_tag, depth = True, tag, 1
                continue
            if tag == "h1":
                self.h1[node] += 1
            if (tag in _CONTAINERS and tag != "html") or (odd and tag != "a"):
                k = len(self.tags)
                self.names.append(generalise(tag, attrs) if tag != "body" else "body")
                self.tags.append(tag)
                self.parent.append(node)
                self.end.append(0)
                self.chars.append(0)
                self.h1.append(0)
                self.own.append(False)
                self.linked.append(0)
                self.odd.append(odd)
                self.mine.append(announced(tag, attrs))
                stack.append((tag, k))
                open_[tag] += 1
                article += tag in ("article", "main")
                node = k
            elif tag in _INNER or tag == "header":
                stack.append((tag, -1))
                open_[tag] += 1
        if at < len(html) and not skip:
            text = unescape(html[at:])
            add((node, text))
            self.chars[node] += len(text)
            self.own[node] = self.own[node] or not text.isspace()
        n = len(self.tags)
        self.end = [e or n for e in self.end]
        self.end[0] = n

    def _judge(self, verdicts: dict[str, bool]) -> None:
        """Take suspects that lose off the page; all of them, with their paths and how they were judged, stand in suspects."""
        self.suspects: list[tuple[str, bool]] = []
        self.out = [False] * len(self.tags)
        if not any(self.odd):
            return
        chars, linked = list(self.chars), list(self.linked)
        for k in range(len(self.tags) - 1, 0, -1):
            chars[self.parent[k]] += chars[k]
            linked[self.parent[k]] += linked[k]
        for k in range(1, len(self.tags)):
            self.out[k] = self.out[self.parent[k]]
            if self.odd[k] and not self.out[k]:
                path = self.path(k)
                stays = chars[k] >= MOST * chars[0] if self.odd[k] >= MOSTLY else linked[k] <= MOSTLY * (chars[k] + linked[k])
                self.suspects.append((path, stays))
                self.out[k] = not verdicts.get(path, stays)
            if self.out[k]:
                self.chars[k] = self.h1[k] = self.linked[k] = 0
                self.own[k] = False

    def _add_up(self) -> None:
        n = len(self.tags)
        self.kids: list[list[int]] = [[] for _ in range(n)]
        self.articles, self.article = [0] * n, [0] * n  #: inside each container, how many with text, and the last of them
        for k in range(n - 1, 0, -1):
            up = self.parent[k]
            self.kids[up].append(k)
            self.chars[up] += self.chars[k]
            self.linked[up] += self.linked[k]
            self.h1[up] += self.h1[k]
            own = self.tags[k] == "article" and self.chars[k] > 0
            self.articles[up] += self.articles[k] + own
            self.article[up] = k if own else self.article[k] or self.article[up]

    def path(self, k: int) -> str:
        out: list[str] = []
        while k >= 0 and len(out) < STEPS:
            out.append(self.names[k])
            k = self.parent[k]
        return ">".join(reversed(out))

    def whole(self, k: int, top: int) -> bool:
        """Whether going down from k to top would lose text of k itself, its title, another section, or, of a container named as the main one, any part that isn't mostly links."""
        if self.mine[k] and any(i != top and self.chars[i] and self.linked[i] <= MOSTLY * (self.chars[i] + self.linked[i]) for i in self.kids[k]):
            return True
        sections = self.tags[top] == "section" and any(i != top and self.tags[i] == "section" and self.chars[i] for i in self.kids[k])
        return self.own[k] or self.h1[top] < self.h1[k] or sections

    def best(self) -> int:
        """The deepest container with most of the text; an article is not cut further, nor are its own text, title and sections lost."""
        k = 0
        while self.tags[k] != "article":
            if self.articles[k] == 1 and self.chars[self.article[k]] >= 0.3 * self.chars[k]:
                return self.article[k]
            top = max(self.kids[k], key=lambda i: (self.chars[i], -i), default=-1)
            if top < 0 or not self.chars[top]:
                return k
            if self.whole(k, top):
                self.kept = k
                return k
            if self.chars[top] < MOST * self.chars[k]:
                return k
            k = top
        return k

    def text(self, chosen: list[int]) -> str:
        """Text of containers in page order; those inside another add nothing."""
        take = bytearray(len(self.tags))
        last = 0
        for k in chosen:
            if k >= last:
                last = self.end[k]
                take[k:last] = b"\x01" * (last - k)
        return " ".join("".join([t for i, t in self.pieces if take[i] and not self.out[i]]).split())

    def main(self, wanted: list[str] | None) -> str:
        paths = [self.path(k) for k in range(len(self.tags))] if wanted else []
        for path in wanted or ():
            found = [k for k, p in enumerate(paths) if p == path]
            if found and sum(self.chars[k] for k in found) > 0:
                own = self.best()
                inside = own == self.kept and all(own <= k < self.end[own] for k in found)
                return self.text([own] if inside else found)
        return self.text([self.best()])


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


_VOTES = "host string, path string, kind string, votes long, chars long"


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Votes for containers (kind main), and for suspects that stay or go."""
    votes: Counter = Counter()
    chars: Counter = Counter()

    def out():
        keys = list(votes)
        cols = [pa.array([k[i] for k in keys], pa.string()) for i in range(3)]
        return pa.RecordBatch.from_arrays([*cols, pa.array([votes[k] for k in keys], pa.int64()), pa.array([chars[k] for k in keys], pa.int64())], names=["host", "path", "kind", "votes", "chars"])

    for batch in batches:
        for host, html in zip(batch["host"], batch["html"], strict=True):
            page, host = Page(html.as_py()), host.as_py()
            k = page.best()
            if page.chars[k]:
                key = (host, page.path(k), "main")
                votes[key] += 1
                chars[key] += page.chars[k]
            for path, stays in set(page.suspects):
                votes[host, path, "stays" if stays else "goes"] += 1
        if len(votes) > 10_000:
            yield out()
            votes.clear()
            chars.clear()
    yield out()


def winning_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, paths (up to PATHS with the most votes, best first), stay and go (paths of suspects)."""
    rows = pages.select(host_of(F.col(url)).alias("host"), F.col(html).cast("string").alias("html")).where("host <> '' and html is not null")
    is_main = F.col("kind") == "main"
    votes = rows.mapInArrow(_vote, _VOTES).groupBy("host", "path", is_main.alias("main")).agg(F.sum("votes").alias("votes"), F.sum("chars").alias("chars"), F.sum(F.when(F.col("kind") == "goes", F.col("votes")).otherwise(0)).alias("goes"))
    host = Window.partitionBy("host", "main")
    ranked = votes.withColumn("k", F.row_number().over(host.orderBy(F.desc("votes"), F.desc("chars"), "path"))).withColumn("all", F.sum("votes").over(host))
    kept = ranked.where((F.col("main") & (F.col("k") <= PATHS) & (F.col("votes") >= LEAST_SHARE * F.col("all"))) | (~F.col("main") & (F.col("k") <= SUSPECTS)))
    goes = 2 * F.col("goes") > F.col("votes")
    listed = lambda which: F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("k", "path")))), lambda x: x["path"])
    return kept.groupBy("host").agg(listed(F.col("main")).alias("paths"), listed(~F.col("main") & ~goes).alias("stay"), listed(~F.col("main") & goes).alias("go"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for h, p, stay, go in zip(batch["html"], batch["paths"], batch["stay"], batch["go"], strict=True):
            verdicts = dict.fromkeys(stay.as_py() or (), True) | dict.fromkeys(go.as_py() or (), False)
            out.append(Page(h.as_py() or "", verdicts).main(p.as_py()))
        yield pa.RecordBatch.from_arrays([batch["row"], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["row", "text", "n_chars"])


def extract(pages: DataFrame, url: str = "url", html: str = "html", carry: list[str] | None = None) -> DataFrame:
    """Columns: row (struct of all columns, or of those in carry), text, n_chars."""
    winners, _ = spool(winning_paths(pages, url, html), "paths")  # its size is then known, so Catalyst may broadcast it or not
    state = pages.select(carried(pages, carry), host_of(F.col(url)).alias("host"), F.col(html).cast("string").alias("html")).join(winners, "host", "left")
    state = state.select("row", "html", "paths", "stay", "go")
    return state.mapInArrow(_extract, state.select("row", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema)
