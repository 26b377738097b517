"""Main text of web pages by equivalence-class template deduction.

Pages of a host share a template. A token is an element in its place (the chain
of elements above it) or a run of text in its place. Its occurrence vector says
how often it occurs on each page of the host; tokens with equal vectors form an
equivalence class. Vectors are never built: the sum of a random number per page,
times the count, is equal exactly for equal vectors (but for 64-bit collisions)
and is added up before the shuffle, so a host of any size costs one row per task
and token. The classes of tokens that occur equally often on nearly all pages,
and those of repeated tokens that come in one order between the others, are the
template; its text is boilerplate, its elements say which one
holds the pages' own text, and what is left in that element's slots is the text.
Article marks count where the template chooses that element; alone they decide
only on pages without a valid template or without its main element.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import small_batches

#: Share of a host's pages that a template token is on, share of the text in the main element, and in one with an article mark.
ON_PAGES, MAIN_SHARE, MARKED_SHARE = 0.8, 0.8, 0.5
#: Share of template text in the main element from which it is a copied article and no boilerplate.
COPIED = 0.8
#: Share of linked characters from which a block outside an article is a menu.
LINKED = 0.5
#: Tokens that a task adds up before it hands them on.
HELD_TOKENS = 300_000
MASK = (1 << 64) - 1

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp noembed noframes iframe".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that an opening tag of the first kind closes when they are open in the same container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
BOILERPLATE = set("nav footer aside form script style noscript template iframe svg canvas dialog menu button select textarea input object applet head title header".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "toolbar", "dialog", "alert", "alertdialog", "status"}
MAIN = {"article", "main"}
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|side|footers?|masthead|topbar|header|"
    r"cookies?|consent|gdpr|notices?|alerts?|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommend\w*|comments?|commentlist|disqus|"
    r"respond|replies|reply|popup|modal|overlay|widgets?|toolbar|pagination|pager|skip|disclaimer|copyright)(?:$|[\s_-])", re.I)

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
SPACE = re.compile(r"\s+")


class Element:
    """An open element: its name, whether it or one above it is boilerplate, an article, a link, and the hash of its place."""

    __slots__ = ("name", "place", "boiler", "main", "link", "shut", "at")

    def __init__(self, name: str, attributes: dict[str, str], above: Element | None):
        label = f"{attributes.get('class', '')} {attributes.get('id', '')}".strip()
        role = attributes.get("role", "").lower()
        own = name in BOILERPLATE and not (name == "header" and above is not None and above.main) or role in ROLES
        named = name not in ("html", "body", "article", "main", "p", "h1") and bool(label) and bool(NAMES.search(label))
        comment = name == "article" and bool(re.search(r"(?:^|[\s_-])comments?(?:$|[\s_-])", label, re.I))
        notice = name == "p" and bool(label) and bool(NAMES.search(label))
        self.name = name
        self.boiler = bool(above and above.boiler) or own or named or comment or notice or "hidden" in attributes
        self.main = bool(above and above.main) or name in MAIN or role == "main" or attributes.get("itemprop", "").lower() == "articlebody"
        self.link = bool(above and above.link) or name == "a"
        self.place = xxhash.xxh64_intdigest(f"{above.place if above else 0}/{name}.{attributes.get('class', '')}#{role}")
        self.shut = name in INLINE


class Block:
    """A run of text between two block boundaries, with the elements it stands in and its number among elements and blocks."""

    __slots__ = ("parts", "chain", "linked", "at")

    def __init__(self, chain: tuple[Element, ...], at: int):
        self.at = at
        self.parts: list[str] = []
        self.chain = chain
        self.linked = 0

    def text(self) -> str:
        return SPACE.sub(" ", "".join(self.parts)).strip()


def read_page(source: str) -> tuple[list[Element], list[Block]]:
    """Elements in order of opening and blocks in page order, of any markup, however broken."""
    elements: list[Element] = []
    blocks: list[Block] = []
    stack: list[Element] = []
    block: Block | None = None

    def chars(raw: str) -> None:
        nonlocal block
        if not raw:
            return
        if block is None:
            if raw.isspace():
                return
            block = Block(tuple(stack), len(elements) + len(blocks))
            blocks.append(block)
        text = html.unescape(raw)
        block.parts.append(text)
        if stack and stack[-1].link:
            block.linked += len(text.strip())

    def close(name: str) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].name == name:
                del stack[i:]
                return

    at, n = 0, len(source)
    while at < n:
        m = MARKUP.search(source, at)
        if not m:
            chars(source[at:])
            break
        chars(source[at : m.start()])
        at = m.end()
        name = (m[2] or m[6] or "").lower()
        if not name:
            continue
        closing, inside, ended = m[1] if m[2] else m[5], m[3] if m[2] else m[7], m[4] if m[2] else m[8]
        if not ended:
            continue  # cut off inside a tag
        if name not in INLINE:
            block = None
        elif name == "br" and block is not None:
            block.parts.append(" ")
        if closing:
            close(name)
            continue
        if name not in INLINE and any(e.name == "p" for e in stack):
            close("p")
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].name in HOLDS.get(name, ()):
                break
            if stack[i].name in CLOSES.get(name, ()):
                del stack[i:]
                break
        attributes = {a[1].lower(): html.unescape(a[2] or a[3] or a[4] or "") for a in ATTRIBUTE.finditer(inside)}
        if re.search(r"(?:^|\s)hidden(?:$|[\s/])", inside):
            attributes["hidden"] = ""
        element = Element(name, attributes, stack[-1] if stack else None)
        element.at = len(elements) + len(blocks)
        elements.append(element)
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(source, at)
            if end is None and name in ("title", "textarea", "xmp"):
                end = re.compile(r"(?=<body\b|\Z)", re.I).search(source, at)
            at = end.end() if end else n
        elif name not in VOID and not inside.rstrip().endswith("/"):
            if block is not None and element.boiler and not (stack and stack[-1].boiler):
                block = None  # a boilerplate element inside a line of text
            stack.append(element)
    return elements, blocks


def run_token(block: Block, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{block.chain[-1].place if block.chain else 0}|{text}")


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def tokens(pages: DataFrame) -> DataFrame:
    """host, token, vector, once, first, pages, times, chars, depth, main, text: occurrence sums of every token over the pages of a host.

    ``once`` is the vector with every page counted once: a token that occurs k times
    on each of its pages has k times this vector. ``first`` adds up first places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}

        def told() -> pa.RecordBatch:
            rows = [(host, signed(t), signed(v[0]), signed(v[1]), *v[2:]) for (host, t), v in held.items()]
            held.clear()
            kinds = (pa.string(), *[pa.int64()] * 7, pa.int32(), pa.bool_(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(kinds), kinds)],
                                              names=["host", "token", "vector", "once", "first", "pages", "times", "chars", "depth", "main", "text"])

        for batch in batches:
            for host, page, source in zip(*(batch.column(c).to_pylist() for c in ("host", "page_id", "html"))):
                elements, blocks = read_page(source or "")
                random = xxhash.xxh64_intdigest(f"{page}:{source}")
                own: dict[int, list] = {0: [1, 0, 0, False, False, 0]}  # the page itself: its vector is one everywhere
                for e in elements:
                    own.setdefault(e.place, [0, 0, 0, e.main and not e.boiler, False, e.at])[0] += 1
                for b in blocks:
                    text = b.text()
                    if not text or (b.chain and b.chain[-1].boiler):
                        continue
                    own.setdefault(run_token(b, text), [0, 0, 0, False, True, b.at])[0] += 1
                    for depth, e in enumerate(b.chain):
                        own[e.place][1] += len(text)
                        own[e.place][2] = depth
                for token, (times, chars, depth, main, is_text, first) in own.items():
                    v = held.setdefault((host, token), [0, 0, 0, 0, 0, 0, depth, main, is_text])
                    v[0] = (v[0] + times * random) & MASK
                    v[1] = (v[1] + random) & MASK
                    v[2] += first
                    v[3] += 1
                    v[4] += times
                    v[5] += chars
                if len(held) > HELD_TOKENS:
                    yield told()
        yield told()

    parts = pages.select("host", "page_id", "html").mapInArrow(
        run, "host string, token long, vector long, once long, first long, pages long, times long, chars long, depth int, main boolean, text boolean")
    wrapped = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)  # noqa: E731  # added without overflow, compared modulo 2^64
    return parts.groupBy("host", "token").agg(
        wrapped("vector"), wrapped("once"), *[F.sum(c).alias(c) for c in ("first", "pages", "times", "chars")], F.max("depth").alias("depth"),
        F.max("main").alias("main"), F.max("text").alias("text"))


def templates(pages: DataFrame) -> DataFrame:
    """host, frame (array of token, vector, once, first, pages, times, chars, depth, main, text): tokens on nearly all pages of the host, however often.

    At most one page's tokens over ON_PAGES per host, so the array is bounded by a page.
    """
    found = stage(tokens(pages).filter(F.col("pages") >= 2), "page_tokens")
    whole = found.filter("token = 0").select("host", F.col("pages").alias("n"))
    frame = found.join(whole, "host").filter(F.col("pages") >= ON_PAGES * F.col("n"))
    entry = F.struct("token", F.col("vector").cast("string").alias("vector"), F.col("once").cast("string").alias("once"), "first", "pages", "times", "chars", "depth", "main", "text")
    return frame.groupBy("host").agg(F.collect_list(entry).alias("frame"))


class Template:
    """What the classes of a host say: the main element's place, None where there is none, template texts, and those of repeated parts by class.

    A text that occurs equally often on all its pages is template. One whose count
    differs between pages is so only as part of a repeated piece of template, with
    elements in its class; whether it keeps the order of the class and nests in the
    page's own class is tested on each page, and a text that does not is a page's own.
    """

    def __init__(self, frame: list[dict]):
        classes: dict[int, list[dict]] = defaultdict(list)
        for t in frame:
            classes[int(t["vector"]) & MASK].append(t)
        root = next((own for own in classes.values() if any(t["token"] == 0 for t in own)), [])
        single = [[t for t in c if t["times"] == t["pages"]] for c in classes.values() if c is not root]
        # the class of the page itself first; where pages are cut off, large classes of nearly all of them
        ordered = [root, *sorted(filter(None, single), key=lambda c: (-c[0]["pages"], -len(c)))]
        steady = lambda t: t["times"] % t["pages"] == 0 and (int(t["vector"]) - t["times"] // t["pages"] * int(t["once"])) & MASK == 0
        self.texts = {t["token"] for t in frame if t["text"] and steady(t)}
        parts = [c for c in classes.values() if not steady(c[0]) and any(t["text"] for t in c) and not all(t["text"] for t in c)]
        self.parts = [([t["token"] for t in sorted(c, key=lambda t: t["first"])], {t["token"] for t in c if t["text"]}) for c in parts]
        self.root = {t["token"] for t in root}
        most = max((t["chars"] for own in ordered for t in own if not t["text"] and t["token"] != 0), default=0)
        held = [m for choose in (self.marked, self.holder) for own in ordered if (m := choose(own, most)) is not None]
        self.main = held[0] if held else None

    def texts_of(self, elements: list[Element], blocks: list[tuple[Block, str]]) -> set[int]:
        """Template texts of one page."""
        if not self.parts:
            return self.texts
        page = sorted([(e.at, signed(e.place)) for e in elements] + [(b.at, signed(run_token(b, t))) for b, t in blocks])
        fixed = [at for at, token in page if token in self.root]
        found = set(self.texts)
        for order, texts in self.parts:
            own, n = set(order), len(order)
            seen = [(at, token) for at, token in page if token in own]
            in_order = [token for _, token in seen] == order * (len(seen) // n)
            if in_order and all(bisect(fixed, seen[k][0]) == bisect(fixed, seen[k + n - 1][0]) for k in range(0, len(seen), n)):
                found |= texts
        return found

    @staticmethod
    def marked(own: list[dict], most: int) -> int | None:
        """Place of the outermost element with an article mark that holds enough of the text: a teaser does not."""
        fit = [t for t in own if not t["text"] and t["main"] and t["chars"] > 0 and t["chars"] >= MARKED_SHARE * most]
        return min(fit, key=lambda t: t["depth"])["token"] if fit else None

    @staticmethod
    def holder(own: list[dict], most: int) -> int | None:
        """Place of the innermost element that holds most of the text."""
        full = [t for t in own if not t["text"] and t["token"] != 0 and t["chars"] > 0 and t["chars"] >= MAIN_SHARE * most]
        return max(full, key=lambda t: t["depth"])["token"] if full else None


def main_text(source: str, template: Template | None) -> str:
    """The page's own blocks in order, joined by an empty line.

    They are those in the template's main element, without template text. A page
    that lacks that element, or whose host has none, falls back on article marks.
    """
    elements, blocks = read_page(source)
    real = [(b, t) for b in blocks if (t := b.text()) and not (b.chain and b.chain[-1].boiler)]
    held = [(b, t) for b, t in real if any(signed(e.place) == template.main for e in b.chain)] if template and template.main is not None else []
    marked = held or [(b, t) for b, t in real if b.chain and b.chain[-1].main]
    chosen = marked or real
    if template:
        texts = template.texts_of(elements, real)
        own = [(b, t) for b, t in chosen if signed(run_token(b, t)) not in texts]
        if sum(len(t) for _, t in own) > (1 - COPIED) * sum(len(t) for _, t in chosen):
            chosen = own
    return "\n\n".join(t for b, t in chosen if b.chain and b.chain[-1].main or b.linked < LINKED * len(t))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row; null html and pages without text of their own have an empty text.

    The host is the url's part between // and the next /; pages without one share
    a template like those of a host. Blocks are cut at the borders of block elements,
    white space inside one becomes a space. Equal rows are answered each for itself.
    """
    small_batches(pages.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[^/]*//([^/?#]*)", 1)), F.lit(""))
    own = pages.select("page_id", "url", "html", host.alias("host"))
    frames = stage(templates(own), "templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Template | None] = {}
        for batch in batches:
            texts = []
            for host, source, frame in zip(*(batch.column(c) for c in ("host", "html", "frame"))):
                host = host.as_py()
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[host] = Template(frame.as_py()) if frame.is_valid else None
                texts.append(main_text(source.as_py() or "", known[host]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    joined = own.join(frames, "host", "left").select("page_id", "url", "html", "host", "frame")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
