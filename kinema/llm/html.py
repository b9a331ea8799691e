"""Main text of web pages by template deduction from tokens with equal occurrence vectors across a host's pages."""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, staged, texts, unused

TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*>|<[!?/a-zA-Z][^>]*\Z", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)

#: Fixed values of HTML: elements without content, elements whose content is no markup, elements that are part of a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: A start tag of the second kind ends an open element of the first.
ENDS = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
BARRIER = frozenset("ul ol dl table article section div body main nav aside footer header form".split())

#: Elements, ARIA roles, and words of class or id that mark what isn't main text.
NOT_MAIN = frozenset("head nav footer aside form script style noscript template select button dialog menu".split())
NOT_MAIN_ROLES = frozenset("navigation banner complementary contentinfo search form menu menubar dialog alert".split())
NOT_MAIN_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs notice notices cookie cookies consent gdpr comment comments disqus reply replies share sharing social related "
    "newsletter subscribe signup login popup modal overlay widget footer masthead pagination pager toolbar skip".split()
)

#: First parts of compound names that say something of the page around: has-sidebar, no-cookies.
ABOUT = frozenset("has with no without js is not".split())
#: An element that such a word marks holds the page's text, and stays, if what is outside all marks is less than this share of it.
OUTSIDE = 0.25

#: A template token occurs in this share of a host's distinct pages, and in this many of them.
FREQUENT, LEAST_PAGES = 0.5, 3
#: Pages whose longest text blocks are equal as far as this share of their text are copies of one page.
MOST = 0.8


def label(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """A token for a start tag, whether its element isn't main text, and whether a word of its class or id says so."""
    if not attributes.strip():
        return tag, tag in NOT_MAIN, False
    found = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}
    named = f"{found.get('class', '')} {found.get('id', '')}".lower()
    parts = [re.split(r"[^a-z]+", x) for x in named.split()]
    words = {w for x in parts if not (len(x) > 1 and x[0] in ABOUT) for w in x}
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "").lower())
    name = tag + "".join(f".{x}" for x in sorted(re.sub(r"\d+", "0", named).split()))
    apart = bool(tag in NOT_MAIN or found.get("role", "").lower() in NOT_MAIN_ROLES or hidden)
    return name, apart, not apart and tag not in ("html", "body") and bool(words & NOT_MAIN_WORDS)


def token_id(parent: int, name: str) -> int:
    """A token's number, from its parent's and its own label or text; ROOT is above all."""
    return xxhash.xxh3_64_intdigest(name.encode("utf-8", "surrogatepass"), parent & (1 << 64) - 1) - (1 << 63)


ROOT = 0


class Block:
    """A run of text under one element, with that element's token and the innermost mark around it."""

    __slots__ = ("parent", "apart", "mark", "raw", "_text")

    def __init__(self, parent: int, apart: bool, mark: int):
        self.parent, self.apart, self.mark, self.raw, self._text = parent, apart, mark, [], None

    @property
    def text(self) -> str:
        if self._text is None:
            self._text = " ".join(entities.unescape("".join(self.raw)).split())
        return self._text


class Marks:
    """The elements of a page that words of class or id mark, each with the one around it; which of them hold is told at the end.

    Where an article or main element lies outside all marks, all hold. Else, a mark holds no more than a name may say of
    what is around: those around an unmarked article or main element, those around nearly all text, and of marked article and
    main elements the one of most text don't hold.
    """

    def __init__(self):
        self.around: list[int] = []
        self.is_content: list[bool] = []  # of an article or main element itself
        self.has_content: list[bool] = []  # around an unmarked one
        self.content_outside = False

    def add(self, around: int, is_content: bool) -> int:
        self.around.append(around)
        self.is_content.append(is_content)
        self.has_content.append(False)
        return len(self.around) - 1

    def see_content(self, mark: int) -> None:
        if mark < 0:
            self.content_outside = True
        else:
            self.has_content[mark] = True

    def settle(self, blocks: list[Block]) -> None:
        """Set apart the blocks inside of marks that hold."""
        if not self.around:
            return
        n = len(self.around)
        size, outside = [0] * n, 0
        for b in blocks:
            if not b.apart and b.mark >= 0:
                size[b.mark] += len(b.text)
            elif not b.apart:
                outside += len(b.text)
        own = list(size)
        for i in range(n - 1, -1, -1):  # marks inside come after those around
            if (up := self.around[i]) >= 0:
                size[up] += size[i]
                self.has_content[up] |= self.has_content[i]
        largest = max((i for i in range(n) if self.is_content[i]), key=size.__getitem__, default=-1)
        cut = [False] * n
        for i in sorted(range(n), key=lambda i: (-size[i], i)):  # those around come before those inside
            stays = not self.content_outside and (i == largest or self.has_content[i] or outside < OUTSIDE * size[i])
            cut[i] = not stays or (self.around[i] >= 0 and cut[self.around[i]])
            outside += 0 if cut[i] else own[i]
        for b in blocks:
            b.apart = b.apart or (b.mark >= 0 and cut[b.mark])


class Elements:
    """The open elements of a page; every step takes the same time, however deep and broken the page is."""

    def __init__(self):
        self.tags: list[str] = []
        self.tokens: list[int] = []  # of the element, or of the one around it if it is part of a line
        self.apart: list[bool] = []  # whether it, or one around it, isn't main text
        self.inside: list[int] = []  # the innermost mark around it, or its own
        self.places: dict[str, list[int]] = {}  # where the open elements of a tag are
        self.barriers: list[int] = [-1]
        self.content = 0  # open article and main elements
        self.marks = Marks()

    @property
    def token(self) -> int:
        return self.tokens[-1] if self.tokens else ROOT

    @property
    def is_apart(self) -> bool:
        return bool(self.apart) and self.apart[-1]

    @property
    def mark(self) -> int:
        return self.inside[-1] if self.inside else -1

    def open(self, tag: str, name: str, apart: bool, marked: bool) -> None:
        if tag in BARRIER:
            self.barriers.append(len(self.tags))
        content = tag in ("article", "main")
        self.content += content
        if content and not marked and not apart and not self.is_apart:
            self.marks.see_content(self.mark)
        self.places.setdefault(tag, []).append(len(self.tags))
        self.tokens.append(self.token if tag in INLINE else token_id(self.token, name))
        self.apart.append(self.is_apart or apart)
        self.inside.append(self.marks.add(self.mark, content) if marked else self.mark)
        self.tags.append(tag)

    def last(self, tag: str) -> int:
        at = self.places.get(tag)
        return at[-1] if at else -1

    def close_from(self, at: int) -> None:
        while len(self.tags) > at:
            tag = self.tags.pop()
            self.places[tag].pop()
            self.content -= tag in ("article", "main")
            self.tokens.pop()
            self.apart.pop()
            self.inside.pop()
        while self.barriers[-1] >= at:
            self.barriers.pop()

    def close(self, tag: str) -> None:
        at = self.last(tag)
        if at >= 0 and (at > self.barriers[-1] or tag not in INLINE and tag not in ("p", "li")):
            self.close_from(at)

    def end_siblings(self, tags) -> None:
        """Close the innermost open one of these tags that no barrier is inside of."""
        at = max(map(self.last, tags))
        if at > self.barriers[-1]:
            self.close_from(at)


def blocks_of(page: str) -> tuple[list[Block], list[tuple[int, int]]]:
    """The page's text blocks, and its start tags as (token, parent), both in order.

    A start tag's token is told apart by its path. Inline elements don't end a block; unclosed elements end as HTML has
    it, at their siblings or their parent's end.
    """
    opened = Elements()
    starts: list[tuple[int, int]] = []
    blocks: list[Block] = []
    block: Block | None = None
    at, n = 0, len(page)

    def put(raw: str) -> None:
        nonlocal block
        if not raw:
            return
        if block is None or block.parent != opened.token or block.apart != opened.is_apart or block.mark != opened.mark:
            block = Block(opened.token, opened.is_apart, opened.mark)
            blocks.append(block)
        block.raw.append(raw)

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in RAW and not m[1]:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            starts.append((token_id(opened.token, tag), opened.token))
            at = n if end is None else end.end()
            block = None if tag not in INLINE else block
            continue
        if tag == "br" or tag == "hr":
            put(" ")
        if tag in VOID:
            continue
        if tag not in INLINE:
            block = None
        if m[1]:
            opened.close(tag)
            continue
        if tag not in INLINE:
            opened.end_siblings(("p",))
        if ENDS.get(tag):
            opened.end_siblings(ENDS[tag])
        name, apart, marked = label(tag, m[3])
        around = opened.token
        opened.open(tag, name, apart or tag == "header" and not opened.content, marked)
        if tag not in INLINE:
            starts.append((opened.token, around))
    opened.marks.settle(blocks)
    return blocks, starts


OCCURRENCE = T.ArrayType(T.StructType([T.StructField("token", T.LongType()), T.StructField("parent", T.LongType()), T.StructField("n", T.IntegerType())]))


def occurrences(page: str) -> tuple[list[dict], int]:
    """The page's distinct tokens in the order of their first occurrence, and a hash of its longest texts, MOST of them.

    Tokens are start tags told apart by their path, and whole text blocks told apart by path and text.
    """
    blocks, starts = blocks_of(page)
    found = [(b, b.text) for b in blocks]
    rows: dict[int, dict] = {}
    for token, parent in [*starts, *((token_id(b.parent, f"\x01{text}"), b.parent) for b, text in found if text)]:
        rows.setdefault(token, {"token": token, "parent": parent, "n": 0})["n"] += 1
    content = sorted({text for b, text in found if text and not b.apart}, key=lambda x: (-len(x), x))
    size, total, most = 0, sum(map(len, content)), []
    for text in content:
        if size >= total * MOST:
            break
        most.append(text)
        size += len(text)
    return list(rows.values()), token_id(ROOT, "\x01".join(most) or page)


def host_of(url) -> F.Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def order_of(tokens: list[int], classes: dict[int, int]) -> dict[int, int]:
    """By class, a hash of the order in which a page has its members."""
    made: dict[int, int] = {}
    for token in tokens:
        c = classes.get(token)
        if c is not None:
            made[c] = token_id(made.get(c, ROOT), str(token))
    return made


MEMBERS = T.ArrayType(T.StructType([T.StructField("token", T.LongType()), T.StructField("class", T.LongType())]))
ORDER = T.ArrayType(T.StructType([T.StructField("host", T.StringType()), T.StructField("class", T.LongType()), T.StructField("order", T.LongType())]))


def templates(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, tokens): each host's template tokens; host '' stands for all hosts.

    A token's occurrence vector holds its number of occurrences in each distinct page of the host. Tokens with equal
    vectors form a class; vectors are compared by a sum over pages that is taken in parts, and those of all hosts are
    the sums of each host's. A class is valid if it is frequent, if all its members stand under template tokens, those
    of a class of its own or of one that it is nested in, and if all pages that have it have its members in one order.
    Copies of a page count once on a host, so that they don't make a template of their text.
    """
    rows = pages.select(host_of(F.col(url)).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))

    def run(batch: pa.RecordBatch) -> list:
        made = [occurrences(x) for x in texts(batch.column(batch.schema.names.index("html")))]
        return [[x for x, _ in made], [x for _, x in made]]

    seen = staged(append_columns(rows, [T.StructField("tokens", OCCURRENCE), T.StructField("page", T.LongType())], run, ["host"]), "html-tokens")
    once = seen.select("host", "page", F.explode("tokens").alias("x")).groupBy("host", "page", "x.token").agg(F.max("x.n").alias("n"), F.first("x.parent").alias("parent"))
    part = F.xxhash64("page", "n").cast("decimal(38,0)")
    vectors = staged(once.groupBy("host", "token").agg(F.first("parent").alias("parent"), F.sum(part).alias("vector"), F.count("*").alias("pages")), "html-vectors")
    whole = vectors.groupBy(F.lit("").alias("host"), "token").agg(F.first("parent").alias("parent"), F.sum("vector").alias("vector"), F.sum("pages").alias("pages"))
    counts = seen.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("total"))
    counts = staged(counts, "html-hosts")  # its size on disk decides how it is joined
    totals = counts.where("host <> ''").unionByName(counts.groupBy(F.lit("").alias("host")).agg(F.sum("total").alias("total")))
    frequent = vectors.where("host <> ''").unionByName(whole).join(totals, "host").where((F.col("pages") >= F.col("total") * FREQUENT) & (F.col("pages") >= LEAST_PAGES))
    frequent = staged(frequent.select("host", "token", "parent", F.xxhash64(F.col("vector").cast("string"), "pages").alias("class")), "html-frequent")
    parents = frequent.select("host", F.col("token").alias("parent"), F.lit(True).alias("known"))
    nested = frequent.join(parents, ["host", "parent"], "left").withColumn("under", F.coalesce("known", F.col("parent") == ROOT))
    classes = nested.groupBy("host", "class").agg(F.bool_and("under").alias("valid"), F.collect_set("token").alias("tokens")).where("valid").drop("valid")
    classes = staged(classes, "html-classes")
    members = classes.select("host", "class", F.explode("tokens").alias("token")).groupBy("host").agg(F.collect_list(F.struct("token", "class")).alias("members"))
    members = staged(members, "html-members")
    found = members.where("host = ''").select("members").first()  # tokens that half of all pages have
    general = {m["token"]: m["class"] for m in found.members} if found else {}
    checked = seen.join(members.where("host <> ''"), "host", "left").select("host", F.col("tokens.token").alias("tokens"), "members")

    def ordered(batch: pa.RecordBatch) -> list:
        out = []
        for host, tokens, own in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            pairs = [("", order_of(tokens, general)), (host, order_of(tokens, {m["token"]: m["class"] for m in own or ()}))]
            out.append([{"host": h, "class": c, "order": o} for h, made in pairs for c, o in made.items()])
        return [out]

    orders = append_columns(checked, [T.StructField("orders", ORDER)], ordered, []).select(F.explode("orders").alias("o")).select("o.*")
    mixed = orders.groupBy("host", "class").agg(F.min("order").alias("p"), F.max("order").alias("q")).where("p <> q").select("host", "class")
    valid = classes.join(mixed, ["host", "class"], "left_anti")
    return valid.groupBy("host").agg(F.flatten(F.collect_list("tokens")).alias("tokens"))


def main_text(page: str, template) -> str:
    """Text of the page's slots, joined in page order: blocks that are no template token and not inside menus and the like."""
    out = [(b, b.text) for b in blocks_of(page)[0] if not b.apart]
    return " ".join(text for b, text in out if text and token_id(b.parent, f"\x01{text}") not in template)


def extract_main_text(pages: DataFrame, url: str = "url", html: str = "html", out: str = "text") -> DataFrame:
    """Add the main text of every page, and n_chars, its code points.

    The deduced templates of the page's host and of all hosts tell constant text from slots. Slots inside navigation,
    footers, asides, forms, adverts, notices, comments and the like, by element, role, class or id, are left out. No
    element is needed to mark the main text. Character references are decoded, white space inside a block is one space,
    blocks are joined by one space. A null or empty html gives an empty text; broken and cut pages are read as far as
    they go, in time that grows with their length; a null url or one without :// has the template of all hosts alone. A
    host of fewer than LEAST_PAGES distinct pages has no template of its own. Repeated rows and extra columns stay, but
    for clashing names of the computed columns.
    """
    deduced = staged(templates(pages, url, html), "html-templates")  # its size on disk decides how it is joined
    whole = deduced.where("host = ''").select("tokens").first()
    general = frozenset(whole.tokens) if whole else frozenset()
    of, known = unused(pages, "host", "tokens")
    own = deduced.where("host <> ''").select(F.col("host").alias(of), F.col("tokens").alias(known))
    rows = pages.join(own, host_of(F.col(url)) == F.col(of), "left")

    def run(batch: pa.RecordBatch) -> list:
        get = lambda c: batch.column(batch.schema.names.index(c))
        made, last, template = [], None, general
        for page, tokens in zip(texts(get(html)), get(known).to_pylist(), strict=True):
            if tokens != last:
                last, template = tokens, general.union(tokens or ())
            made.append(main_text(page, template))
        return [made, [len(x) for x in made]]

    keep = [c for c in pages.columns if c not in (out, "n_chars")]
    return append_columns(rows, [T.StructField(out, T.StringType()), T.StructField("n_chars", T.LongType())], run, keep)
