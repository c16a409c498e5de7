"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its opening and closing tags, told apart by the chain of containers that they stand in (and like
containers of one element by their number), and its runs of text. Over the distinct pages of a host each token has an occurrence vector: how often it stands on each page. Tokens
with equal vectors form an equivalence class. A class is valid if on nearly all pages its tokens come in rounds of one
order and no round crosses one of a larger class: valid classes nest, and that nesting is the host's template. The
places between consecutive tokens of a round are its slots; a run of text belongs to the innermost slot around it, and so
to one slot of the template whatever else stands on the page.

The slots of a host are judged together, by the text that all of its pages hold there. Tag names and whole names of class,
id and role are labels of that text: whether it stands in a menu, header, footer, sidebar, notice, advert, form or comment
(furniture), and whether in the page's article or main element. A slot is main text if most of its text isn't
furniture and most of it lies in the articles; on hosts without any, if it is neither mostly links nor mostly the same
text on every page (the largest slot always stays). Inside articles a slot of unchanging text goes if a part of
a class name speaks against it. A page's text is that of its main slots, less elements labelled as furniture there,
which are those that the template lacks.

Labels alone decide on hosts with few distinct pages, for text in no slot, and for pages without any text in the main slots of
their host; ``by_template`` is false for pages that have most of their text so. html, body and an article or main
element that isn't inside another article are never furniture, nor are elements that enclose all of a page's articles, nor the
header of an article.

Copies of a page count once. Vectors are compared by a commutative hash, a sum of marks, so that a host with any number of
pages takes one small row per token; a host's template is bounded by five times the tokens of a page, because each
token of it stands on at least a fifth of the pages. Pages are parsed once, in linear time for any input, and kept as tokens.

Defined results: null or empty html gives the empty text; a null url is a host of its own; rows that repeat are
extracted each; unclosed elements end with their container, an unclosed comment, script or tag with the page; an empty
table gives an empty result; own columns named text, n_chars or by_template are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, scratch

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""[\s/]*(?:([^\s/>=][^\s/>=]*|=[^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?)?""")
# Elements whose content is no markup, or never text of the page.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg"}
ENDS = {name: re.compile(f"</{name}(?=[\\s/>])[^>]*>?", re.I) for name in RAW}
# Elements that hold nothing, that stand inside a line, and that close an open one of their kind.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
SIBLINGS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = {"html", "head", "body", "article", "main", "section", "div", "nav", "header", "footer", "aside", "form", "ul", "ol", "dl", "table"}
# Elements and words of class, id or role that mark furniture.
FURNITURE = {"nav", "header", "footer", "aside", "form", "head", "button", "select", "dialog", "menu", "object", "canvas", "audio", "video", "label", "fieldset"}
MARKED = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "masthead", "cookie", "cookies", "consent", "notice", "notices", "alert",
    "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "comment", "comments", "reply", "replies", "respond", "disqus", "discussion", "related", "recommended", "share", "sharing", "social", "widget", "toolbar", "pagination", "pager", "copyright", "complementary", "contentinfo", "search", "outbrain", "taboola",
}
# Those of them whose furniture says the same on every page of a host; where the text differs from page to page it is none.
QUIET = {"discussion", "search", "notice", "notices", "alert", "banner", "overlay", "modal", "popup", "widget", "social", "copyright", "consent", "subscription", "login", "signup", "masthead", "complementary", "toolbar"}
HEADERS = {"header", "site-header", "page-header", "global-header", "main-header", "top-header"}
# Compounds of these words that are furniture as whole names.
COMPOUNDS = {
    "site-footer", "page-footer", "main-nav", "main-menu", "site-nav", "site-navigation", "nav-menu", "cookie-banner", "cookie-notice", "cookie-consent", "comment-list", "comments-area", "comment-form", "related-posts", "related-articles", "share-buttons", "social-share", "social-links", "newsletter-signup",
    "ad-container", "ad-slot", "ad-banner", "search-form",
}
#: Elements that hold the page or its main text and are never furniture for their name or words.
KEPT = {"html", "body", "main", "article"}
PARTS = re.compile(r"[a-z0-9]+")
#: A tag of the template stands on this part of a host's pages, a text that counts as unchanging on that one.
TAG_SHARE, TEXT_SHARE = 0.2, 0.5
TEMPLATE_PAGES, TEMPLATE_SUPPORT, VALID_SHARE = 4, 3, 0.9
#: Containers alike below one element are told apart by number, from this one on no more.
TWINS = 8
#: A text of so many characters that stands once on so large a part of a host's pages is no main text, wherever it stands.
NOTICE_CHARS, NOTICE_SHARE = 40, 0.9
#: An element is no furniture, so by a part of a class name, furniture by a word that a template can overrule, furniture, or hidden.
PLAIN, PERHAPS, QUIETLY, FURNISHED, HIDDEN = range(5)
#: What is known of a run of text: a space or block boundary before it, and its labels.
SPACED, FURNITURE_RUN, REGION_RUN, LINK_RUN, PERHAPS_RUN, QUIET_RUN, QUIET_START = 1, 2, 4, 8, 16, 32, 64
PARSED = "host string, page long, tokens array<long>, found array<long>, times array<int>, at array<int>, sizes array<int>, flags array<int>, texts array<string>"
SLOT_SUMS = ["chars", "furnished", "region", "linked", "perhaps", "constant", "quiet", "quiet_constant"]


def furniture(name: str, attrs: dict[str, str], in_article: bool = False) -> int:
    if name in {"html", "body"}:
        return PLAIN
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", ""):
        return HIDDEN
    if name == "main" or attrs.get("role") == "main" or (name == "article" and not in_article):
        return PLAIN
    if name in FURNITURE and not (name == "header" and in_article):
        return FURNISHED
    marks = f"{attrs.get('class', '')} {attrs.get('id', '')} {attrs.get('role', '')}".lower().split()
    found = [x for x in marks if x in MARKED or x in COMPOUNDS or (x in HEADERS and not in_article)]
    if found:
        return QUIETLY if QUIET.issuperset(found) else FURNISHED
    return PERHAPS if any(x in MARKED for m in marks for x in PARTS.findall(m)) else PLAIN


class Element(NamedTuple):
    parent: int
    kind: str
    furniture: int


class Page(NamedTuple):
    """Tokens in page order; runs of text as (place among the tokens, text, innermost element, spaced); elements, each after its parent."""

    tokens: list[int]
    runs: list[tuple[int, str, int, bool]]
    elements: list[Element]


def token(kind: str, text: str, seed: int = 1) -> int:
    """A signed hash; it is odd for runs of text and even for tags."""
    h = xxhash.xxh64_intdigest(f"{kind}{text}".encode("utf-8", "surrogatepass"), seed)
    return ((h | 1) if kind == "text" else (h & ~1)) - (1 << 63)


def start_tag(page: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes from ``at`` on, and where the tag ends: -1 if it never does."""
    attrs: dict[str, str] = {}
    while True:
        m = ATTRIBUTE.match(page, at)
        at = m.end()
        if m[1]:
            attrs.setdefault(m[1].lower(), entities.unescape(next((v for v in m.group(2, 3, 4) if v is not None), "")))
        elif at >= len(page):
            return attrs, -1
        elif page[at] == ">":
            return attrs, at + 1


def parse(page: str | None) -> Page:
    """One scan from left to right; every character is looked at a bounded number of times."""
    page = page or ""
    tokens: list[int] = []
    runs: list[tuple[int, str, int, bool]] = []
    elements = [Element(0, "", PLAIN)]
    stack: list[tuple[str, int, int]] = []  # name, hash of the chain of containers, element
    opened: Counter = Counter()
    twins: list[dict[str, int]] = [{}]  # containers by mark, of the page and of each open element
    spaced, at, end = False, 0, len(page)

    def text(raw: str) -> None:
        nonlocal spaced
        decoded = entities.unescape(raw)
        if decoded.isspace():
            spaced = True
        elif decoded:
            runs.append((len(tokens), decoded, stack[-1][2] if stack else 0, spaced))
            tokens.append(token("text", " ".join(decoded.split())))
            spaced = False

    def pop() -> None:
        opened[stack.pop()[0]] -= 1
        twins.pop()

    held = 0  # start of the text that isn't handed on yet
    unclosed: set[str] = set()
    while (at := page.find("<", at)) >= 0:
        after = page[at + 1 : at + 2]
        closing = after == "/"
        m = NAME.match(page, at + 1 + closing)
        if not m and after not in {"!", "?", "/"}:
            at += 1  # a sign, not a tag
            continue
        if at > held:
            text(page[held:at])
        if not m:
            comment = page.startswith("<!--", at)
            stop = page.find("-->", at + 2) if comment else page.find(">", at)
            at = held = end if stop < 0 else stop + (3 if comment else 1)
            continue
        name = m[0].lower()
        if closing:
            stop = page.find(">", m.end())
            at = held = end if stop < 0 else stop + 1
            if opened[name]:
                while stack[-1][0] != name:
                    pop()
                tokens.append(token("close", name, stack[-1][1]))
                pop()
        else:
            attrs, stop = start_tag(page, m.end())
            if stop < 0:
                held = end  # a tag without an end takes the rest with it
                break
            at = held = stop
            while stack and stack[-1][0] in SIBLINGS.get(name, ()):
                pop()
            outer, parent = (stack[-1][1], stack[-1][2]) if stack else (0, 0)
            mark = "main" if attrs.get("role") == "main" else ".".join([name, *attrs.get("class", "").split()])
            role = mark
            if name in CONTAINERS:
                n = twins[-1][mark] = twins[-1].get(mark, 0) + 1
                role = mark if n == 1 else f"{mark}#{min(n, TWINS)}"
            tokens.append(token("open", role, outer))
            if name in RAW:
                spaced = spaced or name not in INLINE
                if (name == "svg" and page[at - 2] == "/") or name in unclosed:
                    continue
                close = ENDS[name].search(page, at)
                if close is not None:
                    at = held = close.end()
                elif name in {"script", "style"}:
                    at = held = end
                else:
                    unclosed.add(name)  # without its end the tag alone goes, and no later one of its name can have an end
                continue
            if name not in VOID:
                in_article = bool(opened["article"])
                elements.append(Element(parent, "article" if name == "article" and not in_article else "main" if mark == "main" or name == "main" else "a" if name == "a" else "form" if name == "form" else "", furniture(name, attrs, in_article)))
                twins.append({})
                stack.append((name, tokens[-1] & 0xFFFFFFFFFFFFFFFF if name in CONTAINERS else outer, len(elements) - 1))
                opened[name] += 1
        if name not in INLINE:
            spaced = True
    if held < end:
        text(page[held:])
    return Page(tokens, runs, elements)


def inside(elements: list[Element], marked: list[bool]) -> list[bool]:
    """Whether each element or one that encloses it is marked."""
    found = list(marked)
    for i in range(1, len(elements)):
        found[i] = found[i] or found[elements[i].parent]
    return found


def held(elements: list[Element], own: list[int]) -> list[int]:
    """Sums over each element with all that it encloses."""
    total = list(own)
    for i in range(len(elements) - 1, 0, -1):
        total[elements[i].parent] += total[i]
    return total


def labels(page: Page) -> list[int]:
    """Flags of each run: furniture, the page's article or main text, link. An element that holds the page's only articles, its only
    main element or, lacking both, most of its text as a form is no furniture."""
    elements = page.elements
    own = [0] * len(elements)
    for _, text, at, _ in page.runs:
        own[at] += len(text.strip())
    length = held(elements, own)
    hidden = inside(elements, [e.furniture == HIDDEN for e in elements])
    bad = [e.furniture >= QUIETLY for e in elements]
    within = inside(elements, bad)
    kinds = {e.kind for e in elements}
    for kind in ("article", "main"):
        whole = [i for i, e in enumerate(elements) if e.kind == kind and length[i] and not hidden[i]] if kind in kinds else []
        if whole:
            if all(within[i] for i in whole):
                at = max(whole, key=lambda i: (length[i], -i))
                while at:
                    bad[at], at = False, elements[at].parent
            break
    else:
        bad = [x and not (e.kind == "form" and 2 * length[i] > length[0] and not hidden[i]) for i, (x, e) in enumerate(zip(bad, elements))]
    quiet = [0] * len(elements)  # the outermost element of a quiet word that holds each
    for i in range(1, len(elements)):
        quiet[i] = quiet[elements[i].parent] or (i if bad[i] and elements[i].furniture == QUIETLY else 0)
    hard = inside(elements, [x and e.furniture != QUIETLY for x, e in zip(bad, elements)])
    bad = inside(elements, bad)
    article, main, link = (inside(elements, [e.kind == kind for e in elements]) if kind in kinds else None for kind in ("article", "main", "a"))
    perhaps = inside(elements, [e.furniture == PERHAPS for e in elements])
    clean = [0 if bad[i] else n for i, n in enumerate(own)]
    mass = lambda x: sum(n for n, y in zip(clean, x) if y) if x else 0
    in_article, in_main = mass(article), mass(main)
    region = article if in_article else main if in_main else None
    if in_article and in_main:
        both = [a and b for a, b in zip(article, main)]
        region = both if 2 * mass(both) >= in_main else main
    before = [0, *(quiet[at] for _, _, at, _ in page.runs)]
    return [(QUIET_START if quiet[at] and quiet[at] != last else 0) | (SPACED if spaced else 0) | (FURNITURE_RUN if bad[at] else 0) | (REGION_RUN if region and region[at] else 0) | (LINK_RUN if link and link[at] else 0) | (PERHAPS_RUN if perhaps[at] else 0) | (QUIET_RUN if bad[at] and not hard[at] else 0) for (_, _, at, spaced), last in zip(page.runs, before)]


def page_order(tokens: list[int], classes: dict[int, int], sizes: dict[int, int]) -> dict[int, tuple[int, ...] | None]:
    """The order of each class's tokens on a page; None for a class that comes in no rounds of one order or whose rounds are
    crossed by those of a class no smaller."""
    rows: dict[int, list[int]] = {}
    for t in tokens:
        if (name := classes.get(t)) is not None:
            rows.setdefault(name, []).append(t)
    orders: dict[int, tuple[int, ...] | None] = {}
    for name, row in rows.items():
        n = sizes[name]
        orders[name] = tuple(row[:n]) if len(row) % n == 0 and len(set(row[:n])) == n and all(row[i] == row[i - n] for i in range(n, len(row))) else None
    places = {t: (name, i) for name, order in orders.items() if order and len(order) > 1 for i, t in enumerate(order)}
    stack: list[int] = []
    for t in tokens:
        if t not in places:
            continue
        name, i = places[t]
        if i == 0:
            stack.append(name)
            continue
        if name not in stack:
            continue
        while stack[-1] != name and sizes[stack[-1]] <= sizes[name]:
            orders[stack.pop()] = None
        if stack[-1] != name:
            orders[name] = None
            stack.remove(name)
        elif i == sizes[name] - 1:
            stack.pop()
    return orders


def slots(tokens: list[int], at: list[int], places: dict[int, tuple[int, int, int]]) -> list[tuple[int, int] | None]:
    """The innermost slot (class, place in its round) of each run; ``places`` has class, place and size for each token of a valid class."""
    out: list[tuple[int, int] | None] = []
    stack: list[tuple[int, int]] = []
    open_: Counter = Counter()
    runs = iter([*at, -1])
    nearest = next(runs)
    for n, t in enumerate(tokens):
        if n == nearest:
            out.append(stack[-1] if stack else None)
            nearest = next(runs)
        found = places.get(t)
        if found is None or found[2] < 2:
            continue
        name, i, size = found
        if i == 0:
            stack.append((name, 0))
            open_[name] += 1
        elif open_[name]:
            while stack[-1][0] != name:
                open_[stack.pop()[0]] -= 1
            if i == size - 1:
                stack.pop()
                open_[name] -= 1
            else:
                stack[-1] = (name, i)
    return out


def compose(texts: list[str], flags: list[int], kept: list[bool]) -> str:
    out, space = [], False
    for text, flag, keep in zip(texts, flags, kept):
        space = space or bool(flag & SPACED)
        if keep:
            out.append(" " + text if space else text)
            space = False
    return " ".join("".join(out).split())


def by_labels(flags: list[int]) -> list[bool]:
    """Which runs are main text by labels alone."""
    region = any(f & REGION_RUN and not f & FURNITURE_RUN for f in flags)
    return [not f & FURNITURE_RUN and (not region or bool(f & REGION_RUN)) for f in flags]


def choose(flags: list[int], own: list[tuple[int, int] | None], main: dict[tuple[int, int], tuple[bool, bool]], notice: list[bool] | None = None) -> list[bool]:
    """Which runs are main text: those of the host's main slots less furniture and notices, and with all that a quiet word marks if some
    of it differs there from page to page. Runs in no judged slot go by their labels."""
    plain = by_labels(flags)
    kept = [main[s][0] and not f & FURNITURE_RUN if s in main else p for f, s, p in zip(flags, own, plain)]
    area: list[int] = []
    for i, f in enumerate([*flags, QUIET_START]):
        if f & QUIET_START:
            if any(own[k] in main and all(main[own[k]]) for k in area):
                for k in area:
                    kept[k] = True
            area = []
        if f & QUIET_RUN:
            area.append(i)
    return [k and not n for k, n in zip(kept, notice)] if notice else kept


def main_text(page: str | None) -> str:
    """The main text by labels alone, as for a host with few pages."""
    seen = parse(page)
    flags = labels(seen)
    return compose([r[1] for r in seen.runs], flags, by_labels(flags))


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def parsed(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` without its html, with ``__p``: tokens, their numbers of occurrences, and runs of text with their labels."""

    @F.pandas_udf(PARSED.removeprefix("host string, "))
    def run(html: pd.Series) -> pd.DataFrame:
        rows = []
        for page in html:
            seen = parse(page)
            counts = Counter(seen.tokens)
            h = xxhash.xxh64_intdigest((page or "").encode("utf-8", "surrogatepass"), 2) - (1 << 63)
            rows.append((h, seen.tokens, list(counts), list(counts.values()), [r[0] for r in seen.runs], [len(r[1].strip()) for r in seen.runs], labels(seen), [r[1] for r in seen.runs]))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in PARSED.split(", ")[1:]])

    return pages.withColumn("__host", host(F.col(url_col))).withColumn("__p", run(html_col)).drop(html_col)


def classes(contents: DataFrame, *, least_pages: int = TEMPLATE_PAGES, least_support: int = TEMPLATE_SUPPORT) -> DataFrame:
    """host, token, class, everywhere: tokens of frequent equivalence classes over a host's distinct pages, and which are a text that
    stands once on nearly all of them."""
    each = contents.select("host", "page", F.explode(F.arrays_zip(F.col("found").alias("token"), F.col("times").alias("n"))).alias("x")).select("host", F.col("x.token").alias("token"), F.col("x.n").alias("n"), F.xxhash64("page", "x.n").alias("mark"))
    # the vector is a sum in two halves, which can't overflow
    halves = F.sum(F.col("mark").bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), F.sum(F.shiftright("mark", 32)).alias("high")
    by_token = each.groupBy("host", "token").agg(F.count("*").alias("support"), F.sum("n").alias("total"), *halves).filter(F.col("support") >= least_support)
    hosts = contents.groupBy("host").agg(F.count("*").alias("pages")).filter(F.col("pages") >= least_pages)
    is_text = F.col("token").bitwiseAND(F.lit(1)) == 1
    frequent = by_token.join(hosts, "host").filter(F.col("support") >= F.when(is_text, TEXT_SHARE).otherwise(TAG_SHARE) * F.col("pages"))
    everywhere = is_text & (F.col("support") >= NOTICE_SHARE * F.col("pages")) & (F.col("total") == F.col("support"))
    return frequent.select("host", "token", F.xxhash64("low", "high", "support", "total").alias("class"), everywhere.alias("everywhere"))


def _orders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pages by host, class and order of the class; an empty order where it is broken."""
    seen: Counter = Counter()
    known: dict[str, tuple] = {}
    for pdf in batches:
        for name, own, of, tokens in zip(pdf["host"], pdf["own"], pdf["of"], pdf["tokens"]):
            if name not in known:
                if len(known) > 200:
                    known.clear()
                known[name] = dict(zip(own.tolist(), of.tolist())), Counter(of.tolist())
            for label, order in page_order(tokens.tolist(), *known[name]).items():
                seen[(name, label, order or ())] += 1
        if len(seen) > 50_000:
            yield _counted(seen)
            seen = Counter()
    if seen:
        yield _counted(seen)


def _counted(seen: Counter) -> pd.DataFrame:
    return pd.DataFrame([(*k[:2], list(k[2]), n) for k, n in seen.items()], columns=["host", "class", "order", "pages"])


def template(contents: DataFrame, found: DataFrame) -> DataFrame:
    """host, token, class, place, size, everywhere: tokens of the valid classes, in order."""
    arrays = found.groupBy("host").agg(F.collect_list(F.struct("token", "class")).alias("t")).select("host", F.col("t.token").alias("own"), F.col("t.class").alias("of"))
    told = contents.select("host", "tokens").join(arrays, "host").mapInPandas(_orders, "host string, class long, order array<long>, pages long")
    told = told.groupBy("host", "class", "order").agg(F.sum("pages").alias("pages")).groupBy("host", "class").agg(F.max_by("order", F.struct("pages", "order")).alias("order"), F.max("pages").alias("most"), F.sum("pages").alias("pages"))
    valid = told.filter((F.size("order") > 0) & (F.col("most") >= VALID_SHARE * F.col("pages")))
    placed = valid.select("host", "class", F.size("order").alias("size"), F.posexplode("order").alias("place", "token"))
    return placed.join(found.select("host", "token", "everywhere"), ["host", "token"])


def _slot_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Characters by host and slot: all, furniture, in articles, in links, perhaps furniture, unchanging, under quiet words, unchanging among these."""
    sums: dict[tuple, list[int]] = {}
    known: dict[str, dict] = {}

    def rows() -> pd.DataFrame:
        return pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=["host", "class", "place", *SLOT_SUMS])

    for pdf in batches:
        for name, own, of, place, size, tokens, at, sizes, flags in zip(*(pdf[c] for c in ("host", "own", "of", "place", "size", "tokens", "at", "sizes", "flags"))):
            if name not in known:
                if len(known) > 200:
                    known.clear()
                known[name] = {t: x for t, *x in zip(own.tolist(), of.tolist(), place.tolist(), size.tolist())}
            places, tokens = known[name], tokens.tolist()
            for slot, where, n, f in zip(slots(tokens, at.tolist(), places), at.tolist(), sizes.tolist(), flags.tolist()):
                if slot is not None:
                    x = sums.setdefault((name, *slot), [0] * len(SLOT_SUMS))
                    plain, quiet, fixed = 0 if f & FURNITURE_RUN else n, n if f & QUIET_RUN else 0, tokens[where] in places
                    told = plain + quiet
                    for i, v in enumerate((n, n - told, told if f & REGION_RUN else 0, told if f & LINK_RUN else 0, plain if f & PERHAPS_RUN else 0, plain if fixed else 0, quiet, quiet if fixed else 0)):
                        x[i] += v
        if len(sums) > 50_000:
            yield rows()
            sums = {}
    if sums:
        yield rows()


def judged(contents: DataFrame, told: DataFrame) -> DataFrame:
    """host, class, place, main, loud: whether each slot of a host's template is main text, by the text of all its pages there, and whether
    what quiet words mark in it differs from page to page, so that it is none of the furniture they mean."""
    t = told.groupBy("host").agg(F.collect_list(F.struct("token", "class", "place", "size")).alias("t")).select("host", F.col("t.token").alias("own"), F.col("t.class").alias("of"), F.col("t.place").alias("place"), F.col("t.size").alias("size"))
    sums = contents.select("host", "tokens", "at", "sizes", "flags").join(t, "host").mapInPandas(_slot_sums, "host string, class long, place int, " + ", ".join(f"{c} long" for c in SLOT_SUMS))
    sums = sums.groupBy("host", "class", "place").agg(*[F.sum(c).alias(c) for c in SLOT_SUMS])
    loud = (F.col("quiet") > 0) & (2 * F.col("quiet_constant") < F.col("quiet")) & (2 * F.col("linked") < F.col("quiet")) & (2 * F.col("region") >= F.col("quiet"))
    sums = sums.withColumn("loud", loud).withColumn("furnished", F.col("furnished") + F.when(loud, 0).otherwise(F.col("quiet"))).withColumn("plain", F.col("chars") - F.col("furnished"))
    whole = sums.groupBy("host").agg((F.sum("region") > 0).alias("regions"), F.max(F.col("plain") - F.col("linked")).alias("largest"))
    unchanging = F.col("constant") >= 0.8 * F.col("plain")
    outside = (F.col("plain") - F.col("linked") >= F.col("largest")) | ((F.col("linked") < 0.6 * F.col("plain")) & ~unchanging)
    inner = (2 * F.col("region") >= F.col("plain")) & ~(unchanging & (2 * F.col("perhaps") >= F.col("plain")))
    return sums.join(whole, "host").select("host", "class", "place", ((2 * F.col("furnished") < F.col("chars")) & F.when(F.col("regions"), inner).otherwise(outside)).alias("main"), "loud")


def extract(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with text, n_chars and by_template in place of the html."""
    spark = pages.sparkSession
    bounded_batches(spark)

    def written(df: DataFrame, name: str) -> DataFrame:
        # as a table its size is known: where it is small Spark broadcasts it and no page moves, else a hot host's pages are split
        path = scratch(spark, name)
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.parquet(path)

    kept = written(parsed(pages.drop(*[c for c in ("text", "n_chars", "by_template") if c in pages.columns and c not in (url_col, html_col)]), url_col=url_col, html_col=html_col), "parsed")
    fields = ["page", "tokens", "found", "times", "at", "sizes", "flags"]
    contents = written(kept.select(F.col("__host").alias("host"), *[F.col(f"__p.{c}").alias(c) for c in fields]).dropDuplicates(["host", "page"]), "contents")
    told = written(template(contents, written(classes(contents), "classes")), "template")
    verdicts = judged(contents, told).groupBy("host").agg(F.collect_list(F.struct("class", "place", "main", "loud")).alias("v"))
    by_host = told.groupBy("host").agg(F.collect_list(F.struct("token", "class", "place", "size", "everywhere")).alias("t")).join(verdicts, "host", "left")
    learnt = written(by_host.select(F.col("host").alias("__host"), *[F.col(f"t.{c}").alias(f"__{c}") for c in ("token", "class", "place", "size", "everywhere")], *[F.col(f"v.{c}").alias(f"__v_{c}") for c in ("class", "place", "main", "loud")]), "slots")

    @F.pandas_udf("text string, by_template boolean")
    def chosen(hosts: pd.Series, tokens: pd.Series, at: pd.Series, sizes: pd.Series, flags: pd.Series, texts: pd.Series, *learnt_: pd.Series) -> pd.DataFrame:
        known: dict[str, tuple] = {}
        out = []
        for name, tokens_, at_, sizes_, flags_, texts_, *t in zip(hosts, tokens, at, sizes, flags, texts, *learnt_):
            flags_ = flags_.tolist()
            if t[0] is None or t[5] is None:
                out.append((compose(texts_, flags_, by_labels(flags_)), False))
                continue
            if name not in known:
                x = [y.tolist() for y in t]
                known[name] = {a: b for a, *b in zip(*x[:4])}, {(a, b): (c, d) for a, b, c, d in zip(*x[5:])}, {a for a, e in zip(x[0], x[4]) if e}
            places, main, notices = known[name]
            tokens_, at_ = tokens_.tolist(), at_.tolist()
            own = slots(tokens_, at_, places)
            keep = choose(flags_, own, main, [n >= NOTICE_CHARS and tokens_[where] in notices for where, n in zip(at_, sizes_.tolist())])
            in_slots = sum(n for n, s in zip(sizes_.tolist(), own) if s in main)
            if any(keep):
                out.append((compose(texts_, flags_, keep), 2 * in_slots >= sum(sizes_)))
            else:
                out.append((compose(texts_, flags_, by_labels(flags_)), False))
        return pd.DataFrame(out, columns=["text", "by_template"])

    runs = [F.col(f"__p.{c}") for c in ("tokens", "at", "sizes", "flags", "texts")]
    names = [c for c in learnt.columns if c != "__host"]
    done = kept.join(learnt, "__host", "left").withColumn("__x", chosen("__host", *runs, *names))
    return done.withColumn("text", F.col("__x.text")).withColumn("n_chars", F.length("text").cast("long")).withColumn("by_template", F.col("__x.by_template")).drop("__host", "__p", "__x", *names)
