"""HTML extraction by equivalence-class template deduction.

A token is an element's place: the path of element names with the words of their class, id and role, as far as they build
structure. Its occurrence vector on a host says how often it comes on each of the host's pages; tokens with equal vectors form
an equivalence class. A class is valid if it is frequent (on at least SUPPORT of the host's pages) and large (at least two tokens),
and nests in the class its parents are in. The nested valid classes are the host's template; what lies between its tokens are the
slots. The main slot is inside an article or main element (or one whose words say so) that the template holds once a page. Menus,
headers, footers and forms inside or around it are left out by their element; blocks whose words say sidebar, notice, advert or reader
comments where the host's template shows them; and, whatever its name, any place that holds the same text on every page of the host.
Pages without a main slot give all their other slots. Words never hide the page, an article, a heading or what holds most of the main slot.

Vectors are never gathered: a token's vector is the XOR of hashes of (page, count) over its pages, so it is combined in each task
before it is shuffled, and a host may hold any share of the pages.

A form is chrome unless it holds more than half of the slot's text and less than half of that directly or in labels; then it only wraps the page.

Cases: null or empty html gives an empty text; markup that is broken or unclosed is read as far as it goes, in linear time: a button ends where a
paragraph, heading, list, table or section opens, places deeper than 512 elements count as their ancestor there; scripts, styles, templates, titles,
drawings and fields are left out with all they hold; a host with one page
has only that page's template; a null URL counts as host ''; equal pages repeat; extra columns are not read. Words of one block stay
in one piece over inline elements, blocks and line breaks part them.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchmark.llm.url_filter import host_of
from catchmark.operators.lineage import cut

SUPPORT, KEPT_SHARE, MIN_PAGES = 0.5, 0.2, 5
BROADCAST_HOSTS, SALTS = 20_000, 16
OPENING = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
TAG_END = re.compile(r"(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+>")
#: Elements left out with all they hold, and those of them that run to the end of the page where they are never closed.
UNREAD = frozenset("script style noscript template textarea title svg iframe select".split())
RAW = frozenset("script style noscript textarea title iframe".split())
#: Places deeper than this count as their ancestor at this depth.
DEPTH = 512
#: Paths hold at most so many characters of an element's words, then a hash of them.
WORDS_CHARS = 200
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Element names of the HTML standard (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that hold the page or name its text: words never make them chrome.
UNWORDED = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
CHROME = frozenset("nav header footer aside dialog menu button head".split())
#: A button ends where one of these opens in it; in a form, text directly in it or in these labels is the form's own.
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 section article main ul ol table blockquote pre".split())
LABELS = frozenset("form label legend fieldset option".split())
#: Words in class, id or role that tell what an element is for (fixed values).
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies consent discussion disqus "
    "footer form header menu menubar modal nav navbar navigation newsletter notice notices popup promo promoted promotion related reply replies respond search share sharing "
    "sidebar social sponsor sponsored subscribe toolbar widget widgets".split()
)
MAIN_WORDS = frozenset("article main post entry story content articlebody maincontent".split())
WORD = re.compile(r"[a-z]+")


def _words(attributes: str) -> list[str]:
    out = []
    for m in ATTRIBUTE.finditer(attributes):
        out += WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", m[2] or m[3] or m[4] or "").lower())
    return out


def slots(html: str | None) -> Iterator[tuple[str, bool, bool, str, bool]]:
    """(path, in chrome, in a main element, text or break, element opens here) of each piece in page order. A break is ''."""
    for path, chrome, worded, main, text, opens in pieces_of(html):
        yield path, chrome or bool(worded), main, text, opens


def markup(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, element name, closing, attributes) of each tag in page order; comments, declarations and elements that are left out come
    with an empty name and the closing flag telling that they break the text. Every character is looked at a bounded number of times: after one tag
    whose quotes never end, tags end at their first '>', and a name whose end isn't found is not looked for again."""
    at, quoted, endless = 0, True, set()
    while m := OPENING.search(page, at):
        start, name = m.start(), (m[2] or "").lower()
        if not name:
            comment = m[0] == "<!--"
            end = page.find("-->" if comment else ">", m.end())
            at = end + (3 if comment else 1) if end >= 0 else len(page)
            yield start, at, "", False, ""
            continue
        if name in UNREAD and not m[1] and name not in endless:
            closing = re.compile(rf"</{name}\s*+>", re.I).search(page, m.end())
            if closing or name in RAW:
                at = closing.end() if closing else len(page)
                yield start, at, "", True, ""
                continue
            endless.add(name)
        found = TAG_END.match(page, m.end()) if quoted else None
        quoted = quoted and found is not None
        end = found.end() if found else page.find(">", m.end()) + 1
        at = end or len(page)
        yield start, at, name if end else "", bool(m[1]) and bool(end), page[m.end() : at - 1] if end else ""


def pieces_of(html: str | None) -> Iterator[tuple[str, bool, tuple[tuple[str, bool], ...], bool, str, bool]]:
    """As ``slots``, with chrome by element name apart from the elements around that are chrome by their words alone, or forms: their
    paths, and whether they lie inside a main element."""
    stack: list[tuple[str, str, bool, tuple[tuple[str, bool], ...], bool]] = []  # name, path, chrome, worded, main
    opened: Counter = Counter()
    at, page = 0, html or ""

    def here() -> tuple[str, bool, tuple[tuple[str, bool], ...], bool]:
        return stack[-1][1:] if stack else ("", False, (), False)

    def close(depth: int) -> None:
        opened.subtract(x[0] for x in stack[depth:])
        del stack[depth:]

    for start, end, name, closing, attributes in markup(page):
        if start > at:
            yield (*here(), page[at:start], False)
        at = end
        if not name:
            if closing:
                yield (*here(), "", False)
            continue
        if name in INLINE or name in UNREAD:
            continue
        yield (*here(), "", False)
        if closing:
            if opened[name] > 0:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            continue
        if name in VOID:
            continue
        if stack and (name in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and stack[-1][0] == name or name in BLOCKS and stack[-1][0] == "button"):
            close(len(stack) - 1)
        words = _words(attributes)
        path, chrome, worded, main = here()
        if len(stack) < DEPTH:
            said = ".".join(words)
            if len(said) > WORDS_CHARS:
                said = ".".join([*sorted(set(words) & (CHROME_WORDS | MAIN_WORDS)), f"{xxhash.xxh64_intdigest(said):016x}"])
            path = f"{path}/{name}.{said}" if words else f"{path}/{name}"
            if name == "form" or name not in UNWORDED and not CHROME_WORDS.isdisjoint(words):
                worded = (*worded, (path, main))
        opened[name] += 1
        stack.append((name, path, chrome or name in CHROME, worded, main or name in ("article", "main") or not MAIN_WORDS.isdisjoint(words)))
        yield (*here(), "", True)
    if at < len(page):
        yield (*here(), page[at:], False)


def _name(path: str) -> str:
    return path.rpartition("/")[2].partition(".")[0]


def tidy(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def page_tokens(html: str | None) -> tuple[Counter, dict[str, int]]:
    """How often each place is opened on the page, and a hash of the text directly in it."""
    counts: Counter = Counter()
    texts: dict[str, list[str]] = {}
    for path, _, _, _, text, opens in pieces_of(html):
        if text:
            texts.setdefault(path, []).append(text)
        counts[path] += opens
    return counts, {p: xxhash.xxh64_intdigest(tidy(" ".join(x))) >> 1 for p, x in texts.items()}


def templates(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """host, n_pages, main (some valid class holds a main element once a page), fixed (paths whose text is the same on every page), shown (paths
    with chrome words that are the template's own)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found: dict[tuple[str, str], list[int]] = {}
            for page, host, text in zip(pdf["page"], pdf["host"], pdf["html"]):
                counts, texts = page_tokens(text)
                counts[""] = 1
                for path, n in (+counts).items():
                    mark = xxhash.xxh64_intdigest(f"{page}:{n}") >> 1
                    said = texts.get(path, 0)
                    own = found.setdefault((host, path), [0, 0, n, n, said, said])
                    own[0] += 1
                    own[1] ^= mark
                    own[2], own[3], own[4], own[5] = min(own[2], n), max(own[3], n), min(own[4], said), max(own[5], said)
            if found:
                yield pd.DataFrame([(*k, *v) for k, v in found.items()], columns=["host", "path", "n", "vector", "least", "most", "low", "high"])

    rows = pages.select(F.col(page_id).cast("string").alias("page"), host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    tokens = rows.mapInPandas(run, "host string, path string, n bigint, vector bigint, least bigint, most bigint, low bigint, high bigint")
    vectors = tokens.groupBy("host", "path").agg(
        F.sum("n").alias("n"), F.bit_xor("vector").alias("vector"), F.min("least").alias("least"), F.max("most").alias("most"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    # Paths on a fifth of the pages or more: no more of them than five times what a page has.
    sizes = vectors.filter("path = ''").select("host", F.col("n").alias("n_pages"))
    kept = vectors.filter("path <> ''").join(sizes, "host").filter(F.col("n") >= KEPT_SHARE * F.col("n_pages"))
    token = F.struct("path", "n", "vector", "least", "most", "low", "high")
    grouped = kept.groupBy("host").agg(F.first("n_pages").alias("n_pages"), F.collect_list(token).alias("tokens"))

    @F.pandas_udf("struct<main: array<string>, fixed: array<string>, shown: array<string>>")
    def deduce(tokens: pd.Series, pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(*template_of(own := [dict(t) for t in ts], int(n)), shown_of(own, int(n))) for ts, n in zip(tokens, pages)], columns=["main", "fixed", "shown"])

    return grouped.select("host", "n_pages", deduce("tokens", "n_pages").alias("t")).select("host", "n_pages", "t.main", "t.fixed", "t.shown")


def template_of(tokens: list[dict], n_pages: int) -> tuple[list[str], list[str]]:
    """(main paths, fixed paths) of a host's template: valid classes are frequent, large, and nest."""
    frequent = [t for t in tokens if t["n"] >= SUPPORT * n_pages]
    classes: dict[int, list[dict]] = {}
    for t in frequent:
        classes.setdefault(t["vector"], []).append(t)
    valid = {t["path"] for own in classes.values() if len(own) >= 2 for t in own}
    nested: set[str] = set()
    for path in sorted(valid, key=lambda p: p.count("/")):
        above = path.rpartition("/")[0]
        if not above or above in nested:
            nested.add(path)
    once = [t["path"] for t in frequent if t["path"] in nested and t["least"] == t["most"] == 1]
    names = {p: set(re.split("[./]", p.rpartition("/")[2])) for p in once}
    main = [p for p in once if names[p] & (MAIN_WORDS | {"article", "main"}) and not names[p] & (CHROME | CHROME_WORDS)]
    fixed = [t["path"] for t in frequent if n_pages >= MIN_PAGES and t["n"] == n_pages and t["low"] == t["high"] != 0]
    return sorted(main), sorted(fixed)


def shown_of(tokens: list[dict], n_pages: int) -> list[str]:
    """Paths with chrome words that stand on SUPPORT of the host's pages, and on two at least."""
    return sorted(t["path"] for t in tokens if t["n"] >= max(2, SUPPORT * n_pages) and not CHROME_WORDS.isdisjoint(t["path"].rpartition("/")[2].split(".")[1:]))


def main_text(html: str | None, main: list[str] | None = None, fixed: list[str] | None = None, shown: list[str] | None = None) -> str:
    """The text of the main slot: of the template's main paths if the page has one, else of its own main elements, else of all its
    slots. Left out are chrome elements, places whose text the host fixes, and elements with chrome words: those that the template
    shows, or any where there is no template (``shown`` is None). Words do not hide what holds, outside a main element, more than half
    of the slot's text.
    Where nothing remains, fixed places come back first, then elements with chrome words."""
    pieces = list(pieces_of(html))
    roots = tuple(p for p in main or ())
    under = lambda path: any(path == r or path.startswith(r + "/") for r in roots)
    if roots and any(t.strip() and not chrome and under(path) for path, chrome, _, _, t, _ in pieces):
        slot = [under(path) and not chrome for path, chrome, *_ in pieces]
    elif any(inside and t.strip() and not chrome for _, chrome, _, inside, t, _ in pieces):
        slot = [inside and not chrome for _, chrome, _, inside, *_ in pieces]
    else:
        slot = [not chrome for _, chrome, *_ in pieces]
    still, own_slots = set(fixed or ()), None if shown is None else set(shown)
    # Sizes are summed for each tuple of elements first: pieces share them.
    sums: dict[int, list] = {}
    for (path, _, worded, _, text, _), take in zip(pieces, slot):
        if take and path not in still and (size := len(text.strip())):
            of = sums.setdefault(id(worded), [worded, 0, 0])
            of[1] += size
            of[2] += size if _name(path) in LABELS else 0
    held: Counter = Counter()
    labels: Counter = Counter()
    for worded, size, own in sums.values():
        held[None] += size
        for w, inside in dict(worded).items():
            form = _name(w) == "form"
            held[w] += size if form or not inside else 0
            labels[w] += own if form else 0

    def hides(worded: tuple[tuple[str, bool], ...]) -> bool:
        return any(
            2 * held[w] <= held[None] and (own_slots is None or w in own_slots or _name(w) == "form") or _name(w) == "form" and 2 * labels[w] >= held[w]
            for w, _ in worded
        )

    def in_form(worded: tuple[tuple[str, bool], ...]) -> bool:
        return any(_name(w) == "form" and (2 * held[w] <= held[None] or 2 * labels[w] >= held[w]) for w, _ in worded)

    tuples = {id(p[2]): p[2] for p in pieces}
    hidden = {k: hides(worded) for k, worded in tuples.items()}
    formed = {k: in_form(worded) for k, worded in tuples.items()}
    for chosen in (
        [take and p[0] not in still and not hidden[id(p[2])] for p, take in zip(pieces, slot)],
        [take and not hidden[id(p[2])] for p, take in zip(pieces, slot)],
        [take and not formed[id(p[2])] for p, take in zip(pieces, slot)],
    ):
        if said := _joined([p[4] for p in pieces], chosen):
            return said
    return ""


def _joined(texts: list[str], chosen: list[bool]) -> str:
    blocks, own = [], []
    for text, take in zip(texts, chosen):
        if not text or not take:
            blocks.append("".join(own))
            own = []
        else:
            own.append(text)
    return " ".join(b for b in map(tidy, [*blocks, "".join(own)]) if b)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row. A host's template is broadcast while there are at most BROADCAST_HOSTS of them (each is
    bounded by what a page holds); beyond that pages and templates meet by host and a salt."""
    own = cut(templates(pages, page_id, url, html), "templates")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    slim = own.select("host", "main", "fixed", "shown")
    if own.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        joined = rows.join(F.broadcast(slim), "host", "left")
    else:
        salted = slim.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    @F.pandas_udf("string")
    def run(html: pd.Series, main: pd.Series, fixed: pd.Series, shown: pd.Series) -> pd.Series:
        as_list = lambda x: None if x is None else list(x)
        return pd.Series([main_text(h, as_list(m), as_list(f), as_list(s)) for h, m, f, s in zip(html, main, fixed, shown)], dtype=object)

    out = joined.select("page_id", "url", run("html", "main", "fixed", "shown").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("bigint"))
