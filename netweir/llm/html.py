"""Main text of web pages by site template removal.

Element subtrees are hashed, counted per host in Spark over distinct pages, and those that recur on many pages
of a host are deleted: by their names and texts, and, for what surrounds the frame that holds most of a host's
text, by their shape, whatever the text.  What is left of the article, without parts that are never prose, is the text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, small
from .urls import parsed

#: A subtree is template if it is on at least this many distinct pages of a host, and on this share of them.
LEAST_PAGES = 5
LEAST_SHARE = 0.1
#: Prose is template only on this share of pages and up to this many words, so passages that pages share stay.
PROSE_SHARE = 0.5
PROSE_WORDS = 40
#: The shape of an element (names of it and of what holds it) belongs to the site's frame on this share of pages.  The
#: frame with so much of its parent's text is followed; others with at most so much, and no headings alone, are template.
FRAME_SHARE, MAIN_SHARE, MINOR_SHARE = 0.5, 0.5, 0.2
#: Siblings of one name beyond so many have one shape.
PLACES = 9
#: Hosts' templates are broadcast up to this many hashes; beyond, pages are joined to them by host.
BROADCAST_HASHES = 200_000

#: Element names by what HTML makes of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt figcaption caption tr tbody article main body html".split())
NEVER = frozenset("aside button canvas datalist dialog embed footer form head iframe input label map math menu nav noscript object option optgroup script search select style svg template textarea title audio video".split())
RAW = frozenset("script style textarea title iframe noscript xmp noembed noframes".split())
#: Parts of class and id names, and roles, of what is not the article.
NOISE = frozenset("ad ads adslot adunit adv advert adverts advertisement advertising adsense adbox alert alerts announcement banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer discussion disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices outbrain pager pagination paywall popup promo promoted promotion recommended recommendations related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola toast toolbar topbar widget widgets".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: First parts of names that tell of a layout around the article.
LAYOUT = frozenset("has no not with without".split())
#: An open element of the right side's kinds ends when an element of the left side begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Every ``<`` is read once: nothing is tried again.  A quoted value goes to its end, over any ``>``; a quote that never
#: ends is no quote; a tag that never ends takes the rest of the page with it, as it is markup.
TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?+""")
NAME = re.compile(r"""\b(?:class|id)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++)""", re.I)
MODULUS, BASE = (1 << 61) - 1, 0x1F3A5C7E9B2D4F61 % ((1 << 61) - 1)


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    drop: bool
    start: int
    names: str = ""
    end: int = -1
    #: whether only a word of its class or id says that it is to be dropped
    named: bool = False


@dataclass(slots=True)
class Page:
    elements: list[Element] = field(default_factory=list)
    #: (element, text) in page order
    blocks: list[tuple[int, str]] = field(default_factory=list)
    #: names and texts in page order; an element's subtree is a slice
    tokens: list[str] = field(default_factory=list)
    #: the token of each block
    places: list[int] = field(default_factory=list)


def noisy(tag: str, raw: str) -> str:
    """How attributes say that an element is not part of an article or not shown: by a ``role``, a ``name`` or not at all."""
    said = ""
    for m in ATTRIBUTE.finditer(raw):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name in ("class", "id"):
            for word in value.split():
                parts = re.split(r"[-_]+", word)
                if parts[0] not in LAYOUT and (word in NOISE or any(part in NOISE for part in parts)) or word in ("header", "site-header", "page-header") and tag != "header":
                    said = "name"
        elif name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "role"
    return said


def parse(source: str) -> Page:
    """Elements, blocks and tokens of a page, for any input, in time linear in it; unclosed elements end where HTML ends them."""
    page = Page()
    elements, blocks, tokens = page.elements, page.blocks, page.tokens
    elements.append(Element("html", -1, False, 0))
    #: open elements; depths of those that own text; depths of each tag's
    stack, owners, depths, text, articles = [0], [0], {}, [], 0

    def flush() -> None:
        if text:
            words = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if words:
                blocks.append((stack[owners[-1]], words))
                page.places.append(len(tokens))
                tokens.append(words)

    def close(depth: int) -> None:
        """End open elements down to and including the one at ``depth``."""
        nonlocal articles
        if owners and owners[-1] >= depth:
            flush()
        for i in reversed(stack[depth:]):
            e = elements[i]
            e.end = len(tokens)
            articles -= e.tag in ("article", "main")
            if i:
                depths[e.tag].pop()
        while owners and owners[-1] >= depth:
            owners.pop()
        del stack[depth:]

    deepest = lambda tags: max((depths[t][-1] for t in tags if depths.get(t)), default=0)
    at = 0
    while m := TOKEN.search(source, at):
        if m.start() > at:
            text.append(source[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        if source[at - 1] != ">":
            break
        tag = m[2].lower()
        if m[1]:
            if depths.get(tag):
                close(depths[tag][-1])
            elif tag == "p":
                flush()
            elif tag == "br":
                text.append(" ")
            continue
        if tag in ("br", "wbr", "img", "td", "th"):
            if tag != "wbr":
                text.append(" ")
            if tag in VOID:
                continue
        if tag == "hr":
            flush()
        if tag in VOID:
            continue
        if tag in BLOCK and elements[stack[owners[-1]]].tag == "p":  # a block ends an open paragraph
            close(owners[-1])
        if tag in ENDS and (d := deepest(ENDS[tag])) > deepest(SCOPE[tag]):
            close(d)
        never = tag in NEVER or tag == "header" and not articles
        said = "" if never or tag in ("html", "body") or not m[3].strip() else noisy(tag, m[3])
        drop = never or bool(said)
        if tag in BLOCK or drop:
            flush()
            owners.append(len(stack))
        tokens.append("<" + tag)
        names = " ".join(x.strip("\"'") for x in NAME.findall(m[3])) if m[3] else ""
        elements.append(Element(tag, stack[-1], drop, len(tokens) - 1, "".join(c for c in names if not c.isdigit()), named=said == "name"))
        depths.setdefault(tag, []).append(len(stack))
        stack.append(len(elements) - 1)
        articles += tag in ("article", "main")
        if tag in RAW:
            ending = RAW_END[tag].search(source, at)
            if tag != "title" and tag != "textarea":
                tokens.append(source[at : ending.start()])
            at = ending.end()
            close(len(stack) - 1)
            if at >= len(source):
                break
    else:
        if at < len(source):
            text.append(source[at:])
    flush()
    close(0)
    return page


RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*+(?:>|\Z)|\Z", re.I) for tag in RAW}


def subtrees(page: Page) -> list[tuple[int, int]]:
    """(element, hash of names and texts of its subtree) for blocks and for what is never prose, but for long prose.

    A running hash of the page's tokens gives that of any slice, so nested elements are not read again.
    """
    total, power = [0], [1]
    for t in page.tokens:
        total.append((total[-1] * BASE + xxhash.xxh64_intdigest(t)) % MODULUS)
        power.append(power[-1] * BASE % MODULUS)
    words = [0] * (len(page.tokens) + 1)
    for at, (_, text) in zip(page.places, page.blocks, strict=True):
        words[at + 1] = text.count(" ") + 1
    words = list(accumulate(words))
    out = []
    for i, e in enumerate(page.elements):
        if i and (e.tag in BLOCK or e.drop) and e.end > e.start + 1 and (e.tag not in PROSE or words[e.end] - words[e.start] <= PROSE_WORDS):
            out.append((i, (total[e.end] - total[e.start] * power[e.end - e.start]) % MODULUS))
    return out


def shapes(page: Page) -> list[int]:
    """For each element the hash of its tag, class and id without digits, its place among siblings of those names, and
    the same of all that hold it; prose has no place, and elements within a line have the shape of what holds them."""
    out, seen, kinds = [0], {}, {}
    for e in page.elements[1:]:
        shape = above = out[e.parent]
        if e.tag in BLOCK or e.drop:
            kind = e.tag, e.names
            key = e.parent, kind
            place = seen[key] = 0 if e.tag in PROSE else min(seen.get(key, 0) + 1, PLACES)
            if kind not in kinds:
                kinds[kind] = xxhash.xxh64_intdigest(f"{e.tag} {e.names}")
            # a polynomial of the names from the page down, below zero, where no subtree's hash is
            shape = -1 - ((1 - above) * BASE + kinds[kind] * (place + 1)) % MODULUS
        out.append(shape)
    return out


def frames(page: Page) -> dict[int, tuple]:
    """shape -> (shape above, times, characters, whether it holds blocks, is only headings, is prose) for shapes with text."""
    text, titles = [0] * (len(page.tokens) + 1), [0] * (len(page.tokens) + 1)
    for at, (owner, words) in zip(page.places, page.blocks, strict=True):
        text[at + 1] = len(words)
        titles[at + 1] = len(words) * (page.elements[owner].tag in HEADINGS)
    text, titles = list(accumulate(text)), list(accumulate(titles))
    own = shapes(page)
    found: dict[int, list] = {}
    for e, shape in zip(page.elements, own, strict=True):
        above = own[e.parent] if e.parent >= 0 else 1
        if shape == above or text[e.end] == text[e.start]:
            continue
        x = found.setdefault(shape, [above, 0, 0, False, 0, e.tag in PROSE])
        x[1] += 1
        x[2] += text[e.end] - text[e.start]
        x[4] += titles[e.end] - titles[e.start]
    for shape, x in found.items():
        if x[0] in found:
            found[x[0]][3] = True
    return {shape: (above, n, size, block, title == size, prose) for shape, (above, n, size, block, title, prose) in found.items()}


def surroundings(pages: int, seen: list[dict]) -> list[int]:
    """Shapes of a host's frame that are template, from its shapes: what lies beside the frames that hold most of the text.

    From the page down, the shape that comes once a page, holds blocks and has most of the text is followed; beside it,
    shapes with little text go, unless they are prose or headings.
    """
    below: dict[int, list[dict]] = {}
    size = {x["shape"]: x["size"] for x in seen}
    for x in seen:
        if x["n"] >= max(LEAST_PAGES, FRAME_SHARE * pages):
            below.setdefault(x["above"], []).append(x)
    out, at = [], 0
    while at in below:
        beside = below.pop(at)
        main = [x for x in beside if x["once"] >= 0.9 * x["n"] and x["blocks"] >= 0.5 * x["n"] and x["size"] >= MAIN_SHARE * size[at]]
        if not main:
            break
        at = main[0]["shape"]
        out += [x["shape"] for x in beside if x["shape"] != at and not x["prose"] and x["titles"] < 0.5 * x["n"] and x["size"] <= MINOR_SHARE * size[main[0]["above"]]]
    return out


def lasting(page: Page, bad: list[bool]) -> list[bool]:
    """For each element whether its names drop it, after ``bad`` ones are gone."""
    elements = page.elements
    gone, under = list(bad), [False] * len(elements)
    for i, e in enumerate(elements[1:], 1):
        gone[i] |= gone[e.parent]
        under[i] = under[e.parent] or e.named
    text, left = [0] * (len(page.tokens) + 1), 0
    for at, (owner, words) in zip(page.places, page.blocks, strict=True):
        if not gone[owner]:
            text[at + 1] = len(words)
            left += 0 if under[owner] else len(words)
    text = list(accumulate(text))
    if left >= MINOR_SHARE * text[-1]:
        return [e.named for e in elements]
    return [e.named and text[e.end] - text[e.start] < MAIN_SHARE * text[-1] for e in elements]


def main_text(page: Page, template: frozenset[int] | set[int], lists: bool = True) -> str:
    """Blocks of the article that no template subtree and, with ``lists``, no dropped one holds, two line ends between them.

    Templates go first.  The names of a class or id decide last, and never over the page's text itself: where they would
    leave less than ``MINOR_SHARE`` of it, elements that hold ``MAIN_SHARE`` or more stay.  The article is all outermost article elements, with a first heading beside them in a main element; without one,
    all outermost main elements; without either, the page.
    """
    elements = page.elements
    n = len(elements)
    bad = [lists and e.drop and not e.named for e in elements]
    if template:
        for i, h in subtrees(page):
            bad[i] |= h in template
        for i, shape in enumerate(shapes(page)):
            bad[i] |= i > 0 and shape in template and (elements[i].tag in BLOCK or elements[i].drop)
    if lists and any(e.named for e in elements):
        named = lasting(page, bad)
        bad = [b or x for b, x in zip(bad, named, strict=True)]
    inside = {"article": [False] * n, "main": [False] * n}
    for i, e in enumerate(elements[1:], 1):
        bad[i] |= bad[e.parent]
        for tag, own in inside.items():
            own[i] = own[e.parent] or e.tag == tag
    open_ = [(owner, words) for owner, words in page.blocks if not bad[owner]]
    for tag, own in inside.items():
        if any(own[owner] for owner, _ in open_):
            also = inside["main"] if tag == "article" else own
            open_ = [(owner, words) for owner, words in open_ if own[owner] or also[owner] and elements[owner].tag == "h1"]
            break
    return "\n\n".join(words for _, words in open_)


def host_templates(pages: DataFrame) -> DataFrame:
    """host, templates (hashes of subtrees and of shapes), n_templates from all of ``pages`` (host, html).

    A page counts once for each distinct text of its article, so copies of one page make no template.  A host can
    have at most 1 / ``LEAST_SHARE`` times as many templates as its pages have subtrees on average.
    """
    names = ["host", "kind", "tree", "sign", "prose", "above", "once", "size", "blocks", "titles"]
    kinds = (pa.string(), pa.int8(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int8(), pa.int64(), pa.int8(), pa.int8())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            rows = []
            for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                page = parse(source or "")
                sign = xxhash.xxh64_intdigest(main_text(page, frozenset())) - 2**63
                rows.append((host, 0, None, sign, False, None, 0, 0, 0, 0))  # counts the page itself
                own = {h: page.elements[i].tag in PROSE for i, h in subtrees(page)}
                rows += [(host, 1, h, sign, prose, None, 0, 0, 0, 0) for h, prose in own.items()]
                rows += [(host, 2, shape, sign, prose, above, int(n == 1), size, int(block), int(title)) for shape, (above, n, size, block, title, prose) in frames(page).items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*rows, strict=True)) or [[]] * len(kinds), kinds, strict=True)], names=names)

    seen = pages.filter("host <> ''").select("host", "html").mapInArrow(run, "host string, kind byte, tree long, sign long, prose boolean, above long, once byte, size long, blocks byte, titles byte")
    once = seen.groupBy("host", "kind", "tree", "sign").agg(F.max("prose").alias("prose"), *[F.max(c).alias(c) for c in names[5:]])
    counts = once.groupBy("host", "kind", "tree").agg(F.count("*").alias("n"), F.max("prose").alias("prose"), F.max("above").alias("above"), *[F.sum(c).alias(c) for c in names[6:]])
    # what is on few pages is left out before it is written
    counts = durable(counts.filter(f"kind = 0 OR n >= {LEAST_PAGES}"))
    totals = counts.filter("kind = 0").select("host", F.col("n").alias("pages"))
    often = counts.filter("kind > 0").join(totals, "host")
    least = F.when(F.col("kind") == 2, FRAME_SHARE).when(F.col("prose"), PROSE_SHARE).otherwise(LEAST_SHARE)
    often = often.filter(F.col("n") >= F.col("pages") * least)
    shape = F.when(F.col("kind") == 2, F.struct(F.col("tree").alias("shape"), "above", "n", "once", "size", "blocks", "titles", "prose"))
    each = often.groupBy("host", "pages").agg(F.collect_list(F.when(F.col("kind") == 1, F.col("tree"))).alias("trees"), F.collect_list(shape).alias("shapes"))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [trees + surroundings(n, seen) for n, trees, seen in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64())), pa.array(list(map(len, found)), pa.int64())], names=["host", "templates", "n_templates"])

    return each.mapInArrow(follow, "host string, templates array<long>, n_templates long")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row of ``pages`` (page_id, url, html).

    Null or empty html gives an empty text; pages without a host, and hosts with few pages, have no templates: what is
    never prose and lists of names decide there alone.  Equal rows each get a row; an empty table gives an empty result.
    """
    hosted = parsed(pages.select("page_id", "url", "html")).drop("path")
    templates = durable(host_templates(hosted))
    total = templates.agg(F.sum("n_templates")).first()[0] or 0
    side = templates.select("host", "templates")
    joined = hosted.join(F.broadcast(side) if total <= BROADCAST_HASHES else side, "host", "left").select("page_id", "url", "html", "templates")
    kinds = {f.name: f.dataType for f in joined.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            texts = []
            for source, known in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                texts.append(main_text(parse(source or ""), set(known or ())))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"page_id {kinds['page_id'].simpleString()}, url {kinds['url'].simpleString()}, text string, n_chars long")
