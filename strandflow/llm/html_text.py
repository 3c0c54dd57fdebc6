"""Main text of web pages by site template removal.

A page is read once into its element tree. All its subtrees, whatever their labels, are hashed by their
source; Spark counts on how many pages of a host each hash occurs; subtrees that recur on many pages of
the host are templates and are deleted. So are elements that are no main text by their kind
(navigation, forms, scripts) or by their class, id or role (adverts, notices, comments), which may
differ from page to page; inside article and main only a container's unmistakable class or role tells
so, and ids tell nothing. The text of formulas stays. Of what is left, the text of the page's article or
main elements is taken; a page without such elements gives its body's text.

Inside an article only containers (sections, lists, boxes) on half of the host's pages count as
templates, so a sentence or heading that many articles of a host repeat stays; elsewhere a container
counts that is on MIN_PAGES pages and on OUTER_SHARE of them, so one of several boxes that a host shows
in turn goes too, and a heading, paragraph or list item on half of them. Comments, adverts and notices
inside articles differ in their text from page to page, but not in their mark-up: there an element whose
class or id is made of words for such things is hashed as a skeleton, its tag, classes and id's words
without text, and goes where the host's skeletons recur on MIN_PAGES pages and on OUTER_SHARE of them;
one that is on fewer stays. A subtree is counted wherever it stands and judged where it stands. The
share bounds a host's templates by what 1 / OUTER_SHARE of its pages hold. Pages of one host are
counted by grouped sums with map-side partial sums, each distinct page (host and digest of the whole
html) sending a hash once, and the templates, a few per host, are broadcast while there are fewer than
BROADCAST_ROWS; beyond that, they are joined to the pages by host.

Null and empty html give an empty text, and an empty table an empty one; columns but page_id, url and
html are left out. Rows without a url, or of one that names no host, are pages of one host of no name.
Broken markup is read leniently: an end tag closes the nearest open element of its name or nothing, and
a new block ends an open paragraph. Rows of a host with equal html, whatever their page_id or path,
count as one page for templates and are extracted one by one. Character references are decoded, and all
white space inside and between blocks becomes one space. A very long page takes memory in proportion to
its own size.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import cut, small_batches

#: A subtree is a template if it is on so many pages of its host, and on such a share of them: the
#: first share holds inside article and main, the second elsewhere.
MIN_PAGES, MIN_SHARE = 5, 0.5
OUTER_SHARE = 0.005
BROADCAST_ROWS = 200_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!\[CDATA\[|[!?])[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_LABELS = re.compile(r"""\b(class|id|role|style|aria-hidden|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)(?=[\s/]|$)""", re.I)
#: Elements by kind, as the HTML standard names them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp template".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
CONTAINERS = frozenset("aside center details dialog div dl fieldset figure footer form header menu nav ol section table ul".split())
HASHED = CONTAINERS | frozenset("blockquote h1 h2 h3 h4 h5 h6 iframe li object p pre select td".split())
DROPPED = frozenset("annotation annotation-xml aside audio button canvas datalist dialog footer form head iframe map menu nav noembed noframes noscript object script select style svg template textarea video".split())
ROOTS = frozenset(("article", "main"))
#: Words in a class, an id or a role that tell an element is no main text.
NO_TEXT = frozenset(
    "ad ads adbox advert advertisement advertisements adverts adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar "
    "sidebar sidebars aside widget widgets footer contentinfo complementary breadcrumb breadcrumbs pagination pager cookie cookies consent gdpr notice notices alert "
    "newsletter subscribe subscription signup login popup modal overlay dialog share sharing social related recommended recommendations comment comments "
    "commentlist disqus reply replies respond search toolbar copyright masthead disclaimer form".split()
)
#: Inside article and main a role of these, or a class whose words are all of SURE or PARTS, one of SURE at least, or that is named whole.
ROLES = frozenset("navigation banner complementary contentinfo search menu menubar toolbar dialog alertdialog form".split())
SURE = frozenset(
    "ad ads adbox advert advertisement advertisements adverts adsense sponsored promo nav navbar navigation menubar sidebar sidebars breadcrumb breadcrumbs "
    "pagination newsletter popup comments commentlist disqus".split()
)
PARTS = frozenset("area bar block body bottom box container footer form header inner left link links list main right section slot top unit widget wrap wrapper".split())
WHOLE = frozenset("comment-list comment-form comment-respond related-posts related-articles share-buttons sharing-buttons social-share cookie-notice cookie-banner".split())
_CLOSES_P = BLOCKS - {"br", "body", "html", "head", "title", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
_SIBLINGS = {"li": {"li"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


def label_tells(tag: str, name: str, value: str, inside: bool) -> bool:
    """Whether a class, an id or a role tells that an element is no main text.

    An id is often made from a heading's words: inside article and main it tells nothing, elsewhere
    only on a container and if all its words are labels. A class or role inside must be unmistakable
    and stand on a container.
    """
    words = [x for x in re.split(r"[^a-z0-9]+", value) if x]
    if inside:
        if tag not in CONTAINERS and tag != "article":
            return False
        if name == "role":
            return not ROLES.isdisjoint(value.split())
        if name == "class":
            for token in value.split():
                own = {x for x in re.split(r"[^a-z0-9]+", token) if x and not x.isdigit()}
                if token in WHOLE or (own and own <= SURE | PARTS and not own.isdisjoint(SURE)):
                    return True
        return False
    if name == "id":
        own = {x for x in words if not x.isdigit()}
        return tag in CONTAINERS and bool(own) and own <= NO_TEXT | PARTS and (not own.isdisjoint(NO_TEXT) or "header" in own)
    return not NO_TEXT.isdisjoint(words) or ("header" in words and tag in CONTAINERS)


def no_text(tag: str, attributes: str, in_root: bool) -> bool:
    """Whether an element is no main text by its kind or its labels."""
    if tag in DROPPED or (tag == "header" and not in_root):
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for name, *values, hidden in _LABELS.findall(attributes):
        value = (values[0] or values[1] or values[2]).lower()
        name = name.lower()
        if hidden or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True
        if name in ("class", "id", "role") and label_tells(tag, name, value, in_root or tag in ROOTS):
            return True
    return False


def skeleton(tag: str, attributes: str) -> int | None:
    """The hash of an element's mark-up without its text, if its class or id is made of words for what is no main text."""
    found, told = [tag], False
    for name, *values, _ in _LABELS.findall(attributes):
        name, value = name.lower(), (values[0] or values[1] or values[2]).lower()
        if name in ("class", "id"):
            for token in sorted(value.split()):
                words = [x for x in re.split(r"[^a-z]+", token) if x]
                told = told or (bool(words) and set(words) <= NO_TEXT | PARTS and not NO_TEXT.isdisjoint(words))
                found.append(f"{name} {' '.join(words)}")
    return xxhash.xxh64_intdigest("\n".join(found), 1) - (1 << 63) if told else None


class Page:
    """The element tree of a page: for each element its tag, source span, parent, root and label flags."""

    def __init__(self, source: str):
        self.source = source
        self.tags: list[str] = []
        self.spans: list[list[int]] = []
        self.inner: list[int] = []
        self.parents: list[int] = []
        self.in_root: list[bool] = []
        self.out: list[bool] = []
        self.skeletons: dict[int, int] = {}  # of elements inside article and main
        self.texts: list[tuple[int, int, int]] = []  # element, start, end; element ~e marks a break in e
        self._read()

    def _read(self) -> None:
        source, stack, at = self.source, [], 0
        counts: dict[str, int] = {}

        def text(a: int, b: int) -> None:
            if a < b:
                self.texts.append((stack[-1] if stack else -1, a, b))

        def close(depth: int, end: int) -> None:
            while len(stack) > depth:
                e = stack.pop()
                self.spans[e][1] = end
                counts[self.tags[e]] -= 1
                if self.tags[e] in BLOCKS:
                    self.texts.append((-2, end, end))

        def nearest(tags: set[str] | frozenset[str], stops: frozenset[str]) -> int:
            for d in range(len(stack) - 1, -1, -1):
                if self.tags[stack[d]] in tags:
                    return d
                if self.tags[stack[d]] in stops:
                    return -1
            return -1

        while True:
            m = _TOKEN.search(source, at)
            if not m:
                text(at, len(source))
                break
            text(at, m.start())
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if counts.get(tag):
                    close(nearest({tag}, frozenset()), at)
                continue
            if counts.get("p") and tag in _CLOSES_P:
                d = nearest({"p"}, CONTAINERS | {"td", "th", "button", "li", "article", "main"})
                if d >= 0:
                    close(d, m.start())
            if tag in _SIBLINGS:
                d = nearest(_SIBLINGS[tag], frozenset(("ul", "ol", "dl", "select", "table", "menu")))
                if d >= 0:
                    close(d, m.start())
            if tag in BLOCKS:
                self.texts.append((-2, at, at))
            if tag in VOID or m[3].endswith("/"):
                continue
            parent = stack[-1] if stack else -1
            root = parent >= 0 and self.in_root[parent]
            e = len(self.tags)
            self.tags.append(tag)
            self.spans.append([m.start(), len(source)])
            self.inner.append(at)
            self.parents.append(parent)
            out = (parent >= 0 and self.out[parent]) or no_text(tag, m[3], root)
            self.out.append(out)
            if root and not out and m[3] and (h := skeleton(tag, m[3])) is not None:
                self.skeletons[e] = h
            self.in_root.append(root or (not out and (tag in ROOTS or 'role="main"' in m[3] or 'itemprop="articleBody"' in m[3])))
            stack.append(e)
            counts[tag] = counts.get(tag, 0) + 1
            if tag in RAW:
                end = _ENDS[tag].search(source, at)
                stop = end.start() if end else len(source)
                text(at, stop)
                at = stop
        close(0, len(source))

    def hashes(self) -> dict[int, int]:
        """The hash of each subtree that may be a template."""
        out = {}
        for e, tag in enumerate(self.tags):
            if tag in HASHED and (tag in CONTAINERS or not self.in_root[e]):
                a, b = self.spans[e]
                out[e] = xxhash.xxh64_intdigest(self.source[a:b].strip()) - (1 << 63)
        return out

    def main_text(self, templates: frozenset[int] | set[int], strict: frozenset[int] | set[int] = frozenset()) -> str:
        """The text without `templates` outside article and main, and without `strict` ones inside."""
        out = list(self.out)
        if templates or strict:
            for e, h in self.hashes().items():
                out[e] = out[e] or h in (strict if self.in_root[e] or self.tags[e] not in CONTAINERS else templates)
            for e, h in self.skeletons.items():
                out[e] = out[e] or h in templates
        for e, p in enumerate(self.parents):
            out[e] = out[e] or (p >= 0 and out[p])
        rooted = any(r and not o for r, o in zip(self.in_root, out, strict=True))
        parts = []
        for e, a, b in self.texts:
            if e == -2:
                parts.append(" ")
            elif e == -1:
                if not rooted:
                    parts.append(self.source[a:b])
            elif not out[e] and (self.in_root[e] or not rooted) and self.tags[e] != "title":
                parts.append(self.source[a:b])
        return " ".join(entities.unescape("".join(parts)).split())


def host_column(url: str = "url") -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, outer_share: float = OUTER_SHARE) -> DataFrame:
    """`host` and `hash` of subtrees that recur on many distinct pages of their host; `strict` ones reach min_share."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sources = [h or "" for h in b.column(1).to_pylist()]
            digests = [xxhash.xxh3_128_digest(h) for h in sources]
            read = [Page(h) if h else None for h in sources]
            found = [sorted({*p.hashes().values(), *p.skeletons.values()}) if p else [] for p in read]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["host", "digest", "hashes"])

    found = pages.select(host_column().alias("host"), "html").mapInArrow(run, "host string, digest binary, hashes array<long>")
    distinct = found.dropDuplicates(["host", "digest"])  # equal pages have equal hashes
    each = distinct.select("host", F.explode(F.array_append("hashes", F.lit(None).cast("long"))).alias("hash"))  # a null for the page itself
    n = cut(each.groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("hash").isNull() | (F.col("n") >= min_pages)))
    hosts = n.where("hash is null").select("host", F.col("n").alias("pages"))
    met = n.where("hash is not null").join(hosts, "host").where(F.col("n") >= F.col("pages") * min(min_share, outer_share))
    return met.select("host", "hash", (F.col("n") >= F.col("pages") * min_share).alias("strict"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, outer_share: float = OUTER_SHARE) -> DataFrame:
    """page_id, url and `text`, the main text, for every page."""
    templates = cut(site_templates(pages, min_pages, min_share, outer_share))
    page = pages.select("page_id", "url", "html", host_column().alias("host"))
    few = templates.count() <= BROADCAST_ROWS
    shared = None
    if few:
        known: dict[str, tuple[set[int], set[int]]] = {}
        for row in templates.collect():  # of a checked size
            every, strict = known.setdefault(row["host"], (set(), set()))
            every.add(row["hash"])
            if row["strict"]:
                strict.add(row["hash"])
        shared = pages.sparkSession.sparkContext.broadcast(known)
    else:
        page = page.join(templates.groupBy("host").agg(F.collect_list("hash").alias("hashes"), F.collect_list(F.when(F.col("strict"), F.col("hash"))).alias("strict")), "host", "left").select("page_id", "url", "html", "host", "hashes", "strict")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none: tuple[frozenset[int], frozenset[int]] = (frozenset(), frozenset())
        for b in batches:
            hosts = b.column(3).to_pylist()
            own = [shared.value.get(h, none) for h in hosts] if shared else [(set(x or ()), set(y or ())) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)]
            texts = [Page(h).main_text(*t) if h else "" for h, t in zip(b.column(2).to_pylist(), own, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return page.mapInArrow(run, f"page_id {kind}, url string, text string")


def texts(pages: DataFrame) -> DataFrame:
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
