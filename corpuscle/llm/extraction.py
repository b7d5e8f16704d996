"""Main text of pages by equivalence-class template deduction.

Tokens of a page are its tags, told apart by their path (with class names, and their number among like siblings; a path is
a number made of its parent's and its own name), and its blocks of text.  For every host and token the occurrence vector over
the host's pages is kept as a fingerprint (sums over pages of a hash of page and count, with the numbers of pages and
occurrences), so tokens with equal vectors fall into one equivalence class by grouping.  A class is valid if it is on
nearly all pages of its host and has several tokens.  The class that is on most pages once, in one order, is the template's
root; every other valid class is nested in the class that holds its nearest ancestor, in the gap between two of that
class's tokens.

The elements of the template delimit its slots; what lies in a slot on a page is its value.  A block of text is constant if
it is a template token itself, of a valid class or on every page of its host.  Of the slots are extracted:
1. those in an article or main element, where the template has one;
2. else those in the innermost container that holds nearly all of the host's varying text (text outside of links that is not
   constant, summed over its pages) and its main heading, but for elements there that hold hardly anything but links, and
   containers there that hold nothing but constant text.
What a wanted slot holds is kept, constant or not: articles repeat headings.

Beside the template, fixed tags and roles tell menus, forms, comments and the like, and so do class names that are such a
name as a whole or a compound of one (site-footer, sidebar-left; not has-sidebar, ad-hoc).  Names are the weaker sign: those of
elements around the container, or around an article where no other is, count for nothing.  Tags and names decide alone on
hosts of a single page, which have nothing to compare, and for a page on which its host's template does not fit.

Fingerprints are added up before anything is shuffled, so a host with a third of all pages is no hot spot; templates are
joined to pages by host in a join that adaptive execution can split.  A page takes time and memory in proportion to its length,
however deep it is nested and whatever in it never ends.

Defined results: a null or empty html has an empty text; a null url is a host of its own; a null page_id is kept;
repeated rows count as often as they are there and give equal texts; of classes that are on equally many pages the one with
more tokens is the root, then the first on the page; tags that never end, broken markup and very long pages are read to
their end; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections import Counter, defaultdict
from html import unescape
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm.common import materialize, slices

LEAST_PAGES = 2  # that can be compared
NEARLY_ALL = 0.8
LEAST_TOKENS = 3
HOSTS_KEPT = 256  # of templates that a task has at hand
MOST = 0.8  # of a host's running text that the main container holds; of an element's text that links are in a menu

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S)
_OPENS = re.compile(r"<[a-zA-Z/!?]")
_CLASS = re.compile(r"(?<![\w-])(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_ROLE = re.compile(r"\brole\s*=\s*[\"']?([a-z]+)", re.I)
_PARTS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
# fixed values: HTML element names by kind
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_PHRASING = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "img"}
_ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
_SIDE_TAGS = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "head"} | _RAW
_SIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert"}
_SIDE_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "respond", "disqus", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "footer", "menu", "nav", "navbar", "navigation",
    "sidebar", "aside", "widget", "widgets", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "subscription", "signup", "login", "popup", "modal", "overlay", "promo", "promotion", "sponsor", "sponsored", "masthead", "topbar", "toolbar", "pagination", "pager", "skip",
}
_COMMENT_NAMES = {"comment", "comments", "respond", "disqus"}
_MAIN_NAMES = {"article", "main"}
# of compounds: what may follow a side name, and what makes it a mere mention of one
_HOLDERS = {"container", "wrapper", "wrap", "list", "section", "area", "box", "block", "bar", "left", "right", "top", "bottom", "inner", "outer", "content", "item", "items", "links", "main", "primary", "secondary", "slot", "unit", "panel", "group", "holder", "row", "col", "column", "form", "title", "header", "text", "body", "buttons", "icons", "message"}
_MENTIONS = {"has", "have", "had", "no", "not", "non", "with", "without", "is", "hide", "hides", "hidden", "show", "shows", "open", "opened", "closed", "after", "before", "under", "below", "above", "beside", "next", "to", "full", "one", "two", "three"}
_NONE: frozenset[str] = frozenset()
_HOLD_SIBLINGS = ("ul", "ol", "dl", "table", "select")
_CONTAINERS = {"html", "body", "div", "section", "td", "center"}
_LISTS = {"ul", "ol", "dl", "div", "section", "table", "p"}


@functools.lru_cache(1 << 16)
def side_name(name: str) -> str:
    """'comment', 'side' or '' for a class name or id: a side name as a whole, as a compound's head (site-footer), or before its holder (ad-slot)."""
    parts = _PARTS.findall(_CAMEL.sub("-", name).lower())
    if not parts or _MENTIONS.intersection(parts):
        return ""
    head = [parts[-1], *(p for p, after in zip(parts, parts[1:], strict=False) if after in _HOLDERS)]
    if _COMMENT_NAMES.intersection(head):
        return "comment"
    return "side" if _SIDE_NAMES.intersection(head) else ""


@functools.lru_cache(1 << 14)
def signs(tag: str, attributes: str) -> tuple[str, str, frozenset[str]]:
    """Of a tag: its name with class names, its role, and the kinds of side that its names are."""
    names = [n for g in _CLASS.findall(attributes) for n in unescape("".join(g)).split()]
    role = (_ROLE.search(attributes) or [None, ""])[1].lower()
    own = "".join([tag, *("." + n for n in sorted({"-".join(_PARTS.findall(n.lower())) for n in names} - {""}))])
    return own, role, frozenset(side_name(n) for n in names if tag not in ("html", "body", "article", "main"))


@functools.lru_cache(1 << 16)
def child(path: str, own: str) -> str:
    """The number of an element's path."""
    return xxhash.xxh3_64_hexdigest(f"{path}/{own}")


def named(path: str) -> str:
    """The number of a path that is written out, as /html/body."""
    out = ""
    for own in path.split("/")[1:]:
        out = child(out, own)
    return out


class Element(NamedTuple):
    tag: str
    path: str
    hard: bool  # a menu, form, comment and the like by tag or role, or inside of one
    soft: str  # the innermost element around, or this one, that is a side by name; within an article only those inside it
    main: bool
    under: bool  # an article's: it lies in a side by name itself
    like: dict[str, int]  # children by name


class Block(NamedTuple):
    path: str
    text: str
    hard: bool
    soft: str
    main: bool
    under: bool


class Page:
    """blocks in page order; tokens: of tags, how often; first: their first place; parent, kind: of paths, the path around and the tag; elements: of paths (running text, text of links, hard, main)."""

    def __init__(self, html: str | None) -> None:
        self.blocks: list[Block] = []
        self.tokens: Counter[str] = Counter()
        self.first: dict[str, int] = {}
        self.parent: dict[str, str] = {}
        self.kind: dict[str, str] = {}
        self.elements: dict[str, list] = {}
        stack = [Element("", "", False, "", False, False, {})]
        places: dict[str, list[int]] = defaultdict(list)  # of open tags in the stack
        parts: list[str] = []
        linked: list[str] = []
        link = 0  # the depth at which a link has begun
        html = html or ""
        at, end, last = 0, len(html), html.rfind(">") if html else -1

        def flush() -> None:
            if parts:
                text = " ".join(unescape("".join(parts)).split())
                parts.clear()
                if text:
                    e = stack[-1]
                    self.blocks.append(Block(e.path, text, e.hard, e.soft, e.main, e.under))
                    if not e.hard and e.path:
                        of_links = len(" ".join(unescape("".join(linked)).split())) if linked else 0
                        sums = self.elements[e.path]
                        sums[0] += max(len(text) - of_links, 0)
                        sums[1] += of_links
            linked.clear()

        def seen(token: str) -> None:
            self.first.setdefault(token, len(self.first))
            self.tokens[token] += 1

        def close(k: int) -> None:
            nonlocal link
            flush()
            for e in reversed(stack[k:]):
                seen("/" + e.path)
                places[e.tag].pop()
            del stack[k:]
            if link > len(stack):
                link = 0

        def innermost(tags) -> int:
            return max((places[t][-1] for t in tags if places.get(t)), default=0)

        while at < end:
            m = _TOKEN.match(html, at)
            if m is None:
                parts.append(html[at])
                at += 1
                continue
            at = m.end()
            slash, tag, attributes, text = m.groups()
            if text == "<" and at - 1 > last and _OPENS.match(html, at - 1):
                break  # the page ends within a tag
            if text is not None:
                parts.append(text)
                if link:
                    linked.append(text)
                continue
            if not tag:
                continue
            tag = tag.lower()
            if tag == "a":
                link = 0 if slash else len(stack)
                linked.append(" ")
            if slash:
                if tag not in _PHRASING:
                    k = innermost((tag,))
                    if k:
                        close(k)
                    elif tag == "p":
                        flush()
                continue
            if tag in _PHRASING:
                if tag in ("br", "img"):
                    parts.append(" ")
                continue
            if tag in _ENDS_P and (k := innermost(("p",))):
                close(k)
            if tag in _SIBLINGS:
                k = innermost(_SIBLINGS[tag])
                if k and k > innermost(_HOLD_SIBLINGS):
                    close(k)
            flush()
            own, role, sides = signs(tag, attributes) if attributes else (tag, "", _NONE)
            e = stack[-1]
            e.like[own] = n = e.like.get(own, 0) + 1
            path = child(e.path, own if n == 1 else f"{own}[{n}]")
            hard = e.hard or "comment" in sides or tag in _SIDE_TAGS or role in _SIDE_ROLES or (tag == "header" and not e.main)
            main = e.main or tag in _MAIN_NAMES or role in _MAIN_NAMES
            under = e.under or (main and not e.main and e.soft != "")
            soft = path if "side" in sides else "" if main and not e.main else e.soft
            seen(path)
            self.parent.setdefault(path, e.path)
            self.kind.setdefault(path, tag)
            self.elements.setdefault(path, [0, 0, hard, main])
            if tag in _RAW:
                stop = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                at = stop.end() if stop else end
            elif tag not in _VOID and not attributes.endswith("/"):
                places[tag].append(len(stack))
                stack.append(Element(tag, path, hard, soft, main, under, {}))
        close(1)
        for path in reversed(self.parent):  # children come after their parents
            above = self.elements.get(self.parent[path])
            if above:
                above[0] += self.elements[path][0]
                above[1] += self.elements[path][1]


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


SEEN = "host string, token string, text long, pages long, total long, high long, low long, place double, chars long, links long, hard boolean, main boolean, parent string, kind string"


def _hash(*x) -> int:
    return xxhash.xxh3_64_intdigest(repr(x)) - (1 << 63)


def occurrences(pages: DataFrame) -> DataFrame:
    """Fingerprints of all tokens' occurrence vectors, by host.  pages: (page_id, host, html).

    chars, links: of a tag, the running text and the text of links inside; of a text, its own length.
    """

    def run(batches):
        for batch in batches:
            ids, hosts, htmls = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for i, j in slices(htmls, 1 << 23):
                sums: dict = defaultdict(lambda: [0, 0, 0, 0, 0.0, 0, 0, False, False, None, None])
                for page_id, host, html in zip(ids[i:j], hosts[i:j], htmls.slice(i, j - i).to_pylist(), strict=True):
                    page = Page(html)
                    n, key = max(len(page.first), 1), f"{page_id}/{xxhash.xxh3_64_hexdigest((html or '').encode('utf-8', 'surrogatepass'))}"
                    none = [0, 0, False, False]
                    rows = [(t, None, c, page.first[t] / n, *page.elements.get(t, none), page.parent.get(t), page.kind.get(t)) for t, c in page.tokens.items()]
                    texts = Counter((b.path, b.text, b.hard, b.main) for b in page.blocks)
                    rows += [(path, _hash(text), c, 0.0, c * len(text), 0, hard, main, None, None) for (path, text, hard, main), c in texts.items()]
                    rows.append(("", None, 1, 0.0, *none, None, None))
                    marks = {}
                    for token, text, c, place, chars, links, hard, main, parent, kind in rows:
                        mark = marks.get(c)
                        if mark is None:
                            mark = marks[c] = xxhash.xxh3_64_intdigest(f"{c}/{key}")
                        s = sums[host, token, text]
                        s[0] += 1
                        s[1] += c
                        s[2] += mark >> 32
                        s[3] += mark & 0xFFFFFFFF
                        s[4] += place
                        s[5] += chars
                        s[6] += links
                        s[7], s[8], s[9], s[10] = s[7] or hard, s[8] or main, parent, kind
                kinds = [pa.string(), pa.string(), *[pa.int64()] * 5, pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.string()]
                columns = list(zip(*((*k, *v) for k, v in sums.items()), strict=True)) if sums else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in SEEN.split(", ")])

    added = [F.sum(c).alias(c) for c in ("pages", "total", "high", "low", "place", "chars", "links")] + [F.bool_or("hard").alias("hard"), F.bool_or("main").alias("main"), F.max("parent").alias("parent"), F.max("kind").alias("kind")]
    return pages.mapInArrow(run, SEEN).groupBy("host", "token", "text").agg(*added)


TEMPLATE = "host string, classes array<struct<tokens:array<string>,parent:int,gap:int>>, slots array<struct<element:string,wanted:boolean>>, around array<string>"


def nest(classes: list[list[dict]]) -> list[dict]:
    """Classes in the order of the template, each with the number of its parent and the gap it lies in (-1 for the root)."""
    of = {t["token"]: k for k, c in enumerate(classes) for t in c}
    parents = {t["token"]: t["parent"] for c in classes for t in c}
    out = []
    for k, c in enumerate(classes):
        parent, gap, path = -1, -1, c[0]["token"].removeprefix("/")
        while k and path:
            path = parents.get(path)
            if of.get(path, k) != k:
                parent = of[path]
                gap = sum(t["place"] <= c[0]["place"] for t in classes[parent]) - 1
                break
        out.append({"tokens": [t["token"] for t in c], "parent": parent, "gap": gap})
    return out


def wanted_slots(tags: list[dict], still: list[dict]) -> tuple[dict[str, bool], list[str]]:
    """Whether what lies in an element, and in no other of tags inside, is to be extracted; the elements around the container, itself included.

    tags: opening tags in their order on the page, parents first.
    """
    if any(e["main"] and not e["hard"] for e in tags):
        return {e["token"]: e["main"] and not e["hard"] for e in tags}, []
    parent = {e["token"]: e["parent"] for e in tags}
    constant, depth = defaultdict(int), {"": 0}
    for t in still:
        constant[t["token"]] += t["chars"]
    for e in reversed(tags):
        constant[e["parent"]] += constant[e["token"]]
    for e in tags:
        depth[e["token"]] = depth.get(e["parent"], 0) + 1
    text = {e["token"]: e["chars"] - constant[e["token"]] for e in tags}
    every = max(text.values(), default=0)
    if every <= 0:  # pages that are copies of each other tell nothing
        return {e["token"]: not e["hard"] for e in tags}, [e["token"] for e in tags]

    def around(token: str) -> set[str]:
        out = set()
        while token:
            out.add(token)
            token = parent.get(token, "")
        return out

    once = [e for e in tags if e["total"] == e["pages"] and not e["hard"]]
    heading = next((e["token"] for e in sorted(once, key=lambda e: (e["kind"], e["place"])) if e["kind"] in ("h1", "h2") and text[e["token"]] > 0), "")
    over_heading = around(heading)
    holding = [e["token"] for e in once if e["kind"] in _CONTAINERS and text[e["token"]] >= MOST * every and (not heading or e["token"] in over_heading)]
    container = max(holding, key=lambda t: depth[t], default="")
    over = around(container)
    inside, out = {"": not container}, {}
    for e in tags:
        t = e["token"]
        menu = e["kind"] in _LISTS and e["links"] >= MOST * (e["chars"] + e["links"]) > 0
        template = e["kind"] in _LISTS - {"p"} and e["chars"] > 0 and text[t] <= 0
        inside[t] = t == container or (inside.get(e["parent"], not container) and not e["hard"] and (t in over or t in over_heading or not (menu or template)))
        out[t] = inside[t]
    return out, sorted(over)


def deduce(tokens: list[dict], pages: int) -> tuple[list[dict], dict[str, bool], list[str]]:
    """The nested classes, the elements with whether they are wanted, and those around the container; no classes without a root."""
    vector = lambda t: (t["high"], t["low"], t["pages"], t["total"])
    tags = sorted((t for t in tokens if t["text"] is None), key=lambda t: (t["place"], t["token"]))
    classes = defaultdict(list)
    for t in tags:
        classes[vector(t)].append(t)
    valid = sorted((c for c in classes.values() if len(c) >= LEAST_TOKENS), key=lambda c: c[0]["place"])
    once = [c for c in valid if c[0]["total"] == c[0]["pages"]]
    if not once:
        return [], {}, []
    root = max(once, key=lambda c: (c[0]["pages"], len(c)))
    members = Counter(map(vector, tokens))
    still = [t for t in tokens if t["text"] is not None and (t["pages"] == pages or members[vector(t)] >= LEAST_TOKENS)]
    held = {t["token"] for c in valid for t in c} | {t["token"] for t in tags if t["pages"] == pages}
    opening = [t for t in tags if not t["token"].startswith("/")]
    wanted, over = wanted_slots(opening, still)
    parent = {t["token"]: t["parent"] for t in opening}
    slots = {t: w for t, w in wanted.items() if t in held or w != wanted.get(parent[t], w)}
    return nest([root, *(c for c in valid if c is not root)]), slots, over


def templates(seen: DataFrame) -> DataFrame:
    """A row for each host with enough pages."""
    hosts = seen.filter("token = '' AND text IS NULL").select("host", F.col("pages").alias("all")).filter(F.col("all") >= LEAST_PAGES)
    often = seen.filter(F.col("pages") >= NEARLY_ALL * LEAST_PAGES).filter("token != ''")  # most texts are on one page
    own = often.join(hosts, "host").filter(F.col("pages") >= NEARLY_ALL * F.col("all"))
    # what is on nearly all pages of a host is bounded by the length of its pages
    token = F.struct("token", "text", "pages", "total", "high", "low", (F.col("place") / F.col("pages")).alias("place"), "chars", "links", "hard", "main", "parent", "kind")
    grouped = own.groupBy("host").agg(F.first("all").alias("all"), F.collect_list(token).alias("tokens"))

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                classes, slots, over = deduce(r["tokens"], r["all"])
                if classes:
                    out.append((r["host"], classes, [{"element": e, "wanted": w} for e, w in slots.items()], over))
            kinds = [pa.string(), pa.list_(pa.struct([("tokens", pa.list_(pa.string())), ("parent", pa.int32()), ("gap", pa.int32())])), pa.list_(pa.struct([("element", pa.string()), ("wanted", pa.bool_())])), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 4, kinds, strict=True)], ["host", "classes", "slots", "around"])

    return grouped.mapInArrow(run, TEMPLATE)


class Template:
    """A host's template: its root class, slots and what is around the container, out of a row of templates()."""

    def __init__(self, root: list[str], slots: list[dict], around: list[str]) -> None:
        self.root = root
        self.wanted = {s["element"]: s["wanted"] for s in slots}
        self.around = set(around)

    def fits(self, page: Page) -> bool:
        """Whether the root class is on the page once each, in its order."""
        places = [page.first.get(t, -1) for t in self.root]
        return all(page.tokens[t] == 1 for t in self.root) and all(a < b for a, b in zip(places, places[1:], strict=False))

    def extracts(self, page: Page) -> dict[str, bool]:
        """Whether the slot that a path lies in, that of the innermost template element around it, is wanted."""
        out = {"": True}
        for path, above in page.parent.items():
            out[path] = self.wanted.get(path, out[above])
        return out


def main_blocks(page: Page, template: Template | None = None) -> list[str]:
    """The blocks of a page's wanted slots, in page order."""
    open_ = [b for b in page.blocks if not b.hard]
    mains = [b for b in open_ if b.main and not b.soft]
    kept = [b for b in mains if not b.under]
    if not kept:
        kept = [b for b in open_ if not b.main and not b.soft]
        length = lambda blocks: sum(len(b.text) for b in blocks)
        if length(mains) > length(kept):  # an article in a wrapper that is named like a side
            kept = mains
    if template and template.fits(page):
        wanted = template.extracts(page)
        # of elements that are sides by name, those that the container lies in are none
        slots = [b for b in open_ if b.main and not b.soft and not b.under or wanted[b.path] and (not b.soft or b.soft in template.around)]
        if kept and kept[0].main:
            slots = [b for b in slots if b.main]
        kept = slots or kept
    return [b.text for b in kept]


EXTRACTED = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of pages (page_id, url, html)."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    seen = materialize(occurrences(own.select("page_id", "host", "html")), "tokens-seen")
    learnt = materialize(templates(seen), "templates")
    joined = own.join(learnt, "host", "left").select("page_id", "url", "html", "host", F.col("classes")[0]["tokens"].alias("root"), "slots", "around")

    def run(batches):
        known: dict[str, Template | None] = {}
        for batch in batches:
            ids, urls, htmls, hosts, *learnt = (batch.column(k) for k in range(7))
            for i, j in slices(htmls, 1 << 23):
                texts = []
                for k, html in zip(range(i, j), htmls.slice(i, j - i).to_pylist(), strict=True):
                    host = hosts[k].as_py()
                    if host not in known:
                        if len(known) >= HOSTS_KEPT:
                            known.clear()
                        row = [c[k].as_py() for c in learnt]
                        known[host] = Template(*row) if row[0] else None
                    texts.append("\n\n".join(main_blocks(Page(html), known[host])))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), urls.slice(i, j - i), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [x.split()[0] for x in EXTRACTED.split(", ")])

    return joined.mapInArrow(run, EXTRACTED)


def op3_template_deduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


# for pages with one article whose blocks are headings and paragraphs, as the driver's all are
ORACLE = """
WITH a AS (SELECT page_id, url, split_part(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)', 1), '<[a-zA-Z/][^<>]*$', ''), '</article>', 1) AS x FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(x, '</?(h1|p)>'), lambda t: trim(regexp_replace(
  replace(replace(replace(regexp_replace(regexp_replace(t, '<br>', ' ', 'g'), '</?b>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '[ \t\n\r\x0B\f]+', ' ', 'g'))) AS raw FROM a),
c AS (SELECT page_id, url, array_to_string(list_filter(list_transform(raw, lambda t: regexp_replace(t, '&amp;?', '&', 'g')), lambda t: t <> ''), chr(10) || chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM c
"""
