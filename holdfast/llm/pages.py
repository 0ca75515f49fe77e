"""Main text of web pages by equivalence-class template deduction.

1. *Occurrence vectors.* Every page gives its tokens: opening tags and runs of
   text, each under its path of elements, with how often it occurs and where
   first. Per (host, token) Spark sums a hash of (page, count), which stands for the
   token's occurrence vector over the host's pages. A host with a third of all
   pages is many keys, each summed map-side.
2. *Classes.* Tokens of a host that share a vector found on at least
   ``LEAST_PAGES`` pages and half of the host's pages form a class. From the most
   frequent on, a class is valid if its tokens nest with the classes already
   taken (each lies in one gap of the other). The valid classes are the host's
   template; it is no longer than two average pages.
3. *Slots.* Whatever runs of text the template does not hold are slots. A text
   that stands on every page of a host is template text once copied articles would
   bring that about with a chance below ``CHANCE``. Of the slots, those inside the article (or the main element, or where a
   page has neither, the smallest element that holds all of the prose) are the main
   text, without navigation, headers, footers, sidebars, notices, adverts, forms,
   scripts, styles and reader comments inside it. Prose is what stands in paragraphs,
   headings, items and the like, and any other block of more than one sign that is no link.

A part is told by its element (nav, footer, form ...), its role, or a class or id that
is a part's name as a whole. A paragraph, item or heading of such a name is a part only
if its tag belongs to the host's template; a name that merely holds such a word is none.
Where an article and a main element lie apart, the one with more text is taken.

If a template leaves a page without any text, its pages are copies of each
other, and the article's text stays.

Blocks follow block elements; blank space inside a block is one space; blocks are
joined by a line end; character references are decoded once.

Rows: every row gives one row. A NULL page counts as empty and has an empty text.
A NULL address is a host of its own. Repeated rows stay repeated (as one page of
a vector).
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from holdfast.llm.common import quoted, sized, slices, staged, without

LEAST_PAGES = 3
COPIED = 0.5         # chance that a page shares a text of its article with the one before
CHANCE = 0.01        # of a text on all pages of a host, the chance to be taken for the template's by mistake
TEXT, NAMED = 1, 2   # kinds of tokens: a text; the tag of a text element that is named like a part
MOST_SENT = 32_000_000  # bytes of templates that are sent to every task
BATCH_BYTES = 2_000_000

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style)(?=[\s/>])[^>]*+>.*?(?:</\1(?=[\s/>])[^>]*+>|\Z)"
    r"|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|[^<]++|<", re.S | re.I)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACE = re.compile(r"\s+")

# Fixed values of the HTML language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p "
    "pre search section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - frozenset("body caption head html legend optgroup option tbody td tfoot th thead tr".split())
ENDED_BY = {  # an element that an opening tag ends, and what that search stops at
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "option": (("option",), ("select",)),
    "body": (("head",), ()),
}
# Elements whose content is no markup; one that is not closed holds nothing.
RAW = frozenset("iframe textarea title".split())
DRAWN = frozenset("svg template select annotation annotation-xml".split())  # no text of the page; nor if not closed
NEVER = RAW | DRAWN | frozenset("head nav footer aside form dialog button menu input label datalist".split())
# Elements that may hold an article; "" is the page itself.
HOLDERS = frozenset(("", *"html body main section article div center table tbody tr td".split()))
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption caption address summary".split())
# What pages call their parts that are no main text.
PARTS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner banners breadcrumb breadcrumbs "
    "comment comments commentlist consent cookie cookies disclaimer disqus footer gdpr login masthead menu menus modal "
    "nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promos promoted "
    "related replies respond search share sharebar sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription toolbar widget widgets".split())
# Words that say no more about a part than where or how it is set.
SETTING = frozenset(
    "area articles bar block bottom box button buttons card cards center col column container content entry footer form "
    "group header heading holder icons inner item items left link links list main module outer pane panel post posts "
    "reader readers reading right row section site slot stories strip text title top unit user wrap wrapper zone".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())


@dataclass
class Run:
    """A run of text: its block, its path, and where it stands."""

    text: str
    block: int
    path: str
    shut: bool       # inside a part that is no main text
    article: bool
    main: bool
    linked: bool
    prose: bool      # inside an element that is made for text
    holders: tuple[int, ...]
    order: int


@dataclass
class Page:
    runs: list[Run] = field(default_factory=list)
    tags: list[tuple[str, int, bool]] = field(default_factory=list)  # path, order, text named like a part


@dataclass
class _Open:
    name: str
    path: str
    number: int
    shut: bool
    article: bool
    main: bool
    linked: bool
    prose: bool
    drawn: bool      # inside an element that is none of the page's text, whose blocks part nothing


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}


def _is_part(name: str, given: dict[str, str], within: bool) -> bool:
    if name in NEVER or name == "header" and not within:
        return True
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none", given.get("style", ""), re.I) or given.get("role", "").lower() in ROLES:
        return True
    if name in ("html", "body", "article", "main") and not within and "comment" not in given.get("class", ""):
        return False
    return name not in PROSE and _named(given)


def _named(given: dict[str, str]) -> bool:
    """A class or id that is the name of such a part and nothing else: ``comment-list``
    is one, ``share-of-votes`` and ``related-work`` are names of their own."""
    for name in f"{given.get('class', '')} {given.get('id', '')}".lower().split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        if not PARTS.isdisjoint(words) and all(w in PARTS or w in SETTING for w in words):
            return True
    return False


def parse(source: str, template: frozenset[int] = frozenset()) -> Page:
    """``template``: tokens of the host's template. A paragraph, item or heading that
    is named like a part is one if its tag is among them."""
    page, stack, block, order, made = Page(), [_Open("", "", 0, False, False, False, False, False, False)], 0, 0, 1
    at, last = 0, {}
    while at < len(source):
        m = MARKUP.match(source, at)
        at = m.end()
        order += 1
        piece = m[0]
        if piece[0] != "<" or piece == "<":
            top = stack[-1]
            # Text that only looks like markup goes on in the same run.
            if page.runs and page.runs[-1].order == order - 1 and page.runs[-1].path == top.path:
                page.runs[-1].text += piece
                page.runs[-1].order = order
                continue
            page.runs.append(Run(piece, block, top.path, top.shut, top.article, top.main, top.linked,
                                 top.prose, _holders(stack), order))
            continue
        if m[3] is None:
            continue
        name = m[3].lower()
        if name == "br":
            page.runs.append(Run(" ", block, stack[-1].path, stack[-1].shut, stack[-1].article, stack[-1].main,
                                 stack[-1].linked, stack[-1].prose, _holders(stack), order))
            continue
        if m[2]:
            within = stack[-1].drawn
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    within = stack[i].drawn
                    del stack[i:]
                    break
            block += name in BLOCK and not within
            continue
        if name in ENDS_P and name != "hr" and stack[-1].drawn:
            _end(stack, ("svg", "select"), ("foreignobject", "template"))
        block += name in BLOCK and not stack[-1].drawn
        if name in ENDS_P:
            _end(stack, ("p",), ("template", "object", "table", "td", "th", "article", "section", "div", "li", "body", "blockquote"))
        if name in ENDED_BY:
            _end(stack, *ENDED_BY[name])
        given = _attributes(m[4]) if m[4] and m[4].strip("/ ") else {}
        top = stack[-1]
        path = f"{top.path}/{name}" + "".join(f".{given[k]}" for k in ("class", "id") if k in given)
        named = name in PROSE and _named(given)
        page.tags.append((path, order, named))
        if name in VOID or m[4].endswith("/") and name not in BLOCK:
            continue
        if name in RAW or name in DRAWN:
            if name not in last:
                last[name] = _closings(source, name)
            if not last[name] or last[name][-1][0] < at:
                continue
            if name in RAW:
                at = last[name][bisect_left(last[name], (at, at))][1]
                continue
        within = top.article or top.main
        shut = top.shut or _is_part(name, given, within) or named and _key("tag", path) in template
        stack.append(_Open(
            name, path, made, shut, top.article or name == "article" and not shut,
            top.main or name == "main" or given.get("role", "").lower() == "main"
            or given.get("itemprop", "").lower() == "articlebody",
            top.linked or name == "a", top.prose or name in PROSE, top.drawn or name in DRAWN,
        ))
        made += 1
    return page


def _closings(source: str, name: str) -> list[tuple[int, int]]:
    """Where the closing tags of a name stand."""
    return [m.span() for m in re.finditer(rf"</{name}(?=[\s/>])[^>]*+>", source, re.I)]


def _holders(stack: list[_Open]) -> tuple[int, ...]:
    return tuple(o.number for o in stack if o.name in HOLDERS)


def _end(stack: list[_Open], names: tuple[str, ...], stops: tuple[str, ...]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].name in stops:
            return
        if stack[i].name in names:
            del stack[i:]
            return


def plain(text: str) -> str:
    return SPACE.sub(" ", entities.unescape(text)).strip()


def _key(kind: str, path: str, text: str = "") -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(f"{kind}\0{path}\0{text}".encode("utf-8", "replace"))).astype(np.int64))


def tokens(page: Page) -> dict[int, list[int]]:
    """Each token's count, its first place, and its kind: ``TEXT``, ``NAMED`` or 0."""
    out: dict[int, list[int]] = {}
    for path, order, named in page.tags:
        out.setdefault(_key("tag", path), [0, order, NAMED * named])[0] += 1
    for run in page.runs:
        text = plain(run.text)
        if text:
            out.setdefault(_key("text", run.path, text), [0, run.order, TEXT])[0] += 1
    return out


# --- templates -------------------------------------------------------------

def host_of(url: str):
    return F.coalesce(F.lower(F.regexp_extract(quoted(url).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)), F.lit(""))


def templates(rows: DataFrame) -> DataFrame:
    """(host, template): text and named tag tokens that the host's template holds.

    ``rows``: (host, html).
    """
    counted = rows.mapInArrow(_occurrences, "host string, token bigint, vec bigint, place int, is_text int")
    # A row without a token counts the host's pages.
    per_token = counted.groupBy("host", "token").agg(
        F.count(F.lit(1)).alias("pages"), F.sum(F.col("vec").cast("decimal(20,0)")).alias("vec"),
        F.sum("place").alias("places"), F.max("is_text").alias("is_text"),
    )
    # Tokens of one or two pages, by far the most, end here.
    per_token = staged(per_token.where(f"token is null or pages >= {LEAST_PAGES}"), "tokens")
    pages = per_token.where("token is null").select(F.col("host").alias("h"), F.col("pages").alias("all"))
    common = per_token.where(f"token is not null and pages >= {LEAST_PAGES}").join(
        pages.where(f"all >= {LEAST_PAGES}"), F.col("host") == F.col("h")
    ).where("2 * pages >= all")
    return common.groupBy("host").agg(F.first("all").alias("all"), F.collect_list(F.struct(
        "token", F.col("vec").cast("string").alias("vec"), "pages",
        (F.col("places") / F.col("pages")).alias("place"), "is_text",
    )).alias("common")).mapInArrow(_nested, "host string, template array<bigint>")


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html", BATCH_BYTES):
        out: list[list] = [[], [], [], [], []]
        for host, source in zip(*[batch.column(c).to_pylist() for c in range(2)]):
            name = xxhash.xxh64_intdigest(source.encode())
            found = tokens(parse(source))
            out[0] += [host] * (len(found) + 1)
            out[1] += [None, *found]
            # 52 bits: sums of many pages stay exact.
            out[2] += [0, *(xxhash.xxh64_intdigest(f"{name}:{n}") >> 12 for n, _, _ in found.values())]
            out[3] += [0, *(p for _, p, _ in found.values())]
            out[4] += [0, *(t for _, _, t in found.values())]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        yield pa.record_batch({n: pa.array(v, k) for n, v, k in zip(("host", "token", "vec", "place", "is_text"), out, kinds)})


def _nested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, alls, rows = (batch.column(c).to_pylist() for c in range(3))
        yield pa.record_batch({
            "host": pa.array(hosts, pa.string()),
            "template": pa.array([template_text(a, r) for a, r in zip(alls, rows)], pa.list_(pa.int64())),
        })


def template_text(pages: int, common: list[dict]) -> list[int]:
    """Of the valid classes, the tags named like a part, and the texts that stand on
    every page, if that is no chance of copied articles."""
    classes: dict[str, list[dict]] = {}
    for token in common:
        classes.setdefault(token["vec"], []).append(token)
    ranked = sorted(classes.values(), key=lambda c: (-c[0]["pages"], -len(c), min(t["token"] for t in c)))
    taken: list[list[float]] = []
    out: list[int] = []
    for members in ranked:
        places = sorted(t["place"] for t in members)
        if all(_nests(places, other) for other in taken):
            taken.append(places)
            sure = members[0]["pages"] == pages and COPIED ** (pages - 1) < CHANCE
            out += [t["token"] for t in members if t["is_text"] == NAMED or sure and t["is_text"] == TEXT]
    return sorted(out)


def _nests(a: list[float], b: list[float]) -> bool:
    """All places of one class lie in one gap of the other."""
    def one_gap(inner: list[float], outer: list[float]) -> bool:
        gaps = np.searchsorted(outer, inner)
        return bool((gaps == gaps[0]).all())

    return one_gap(a, b) or one_gap(b, a)


# --- slots -----------------------------------------------------------------

def main_text(source: str, template: frozenset[int] = frozenset()) -> str:
    page = parse(source, template)
    runs = [r for r in page.runs if not r.shut]
    article, main = [r for r in runs if r.article], [r for r in runs if r.main]
    # A stub of an article outside the main element gives way to a longer main text.
    apart = not any(r.article for r in main)
    if article and not (apart and _signs(main) > _signs(article)):
        runs = article
    elif main:
        runs = main
    else:
        runs = _prose(runs)
    slots = [r for r in runs if not template or _key("text", r.path, plain(r.text)) not in template]
    return _blocks(slots) or _blocks(runs)


def _signs(runs: list[Run]) -> int:
    return sum(len(plain(r.text)) for r in runs)


def _prose(runs: list[Run]) -> list[Run]:
    """The runs in the smallest element that holds all prose."""
    signs: dict[int, int] = {}
    for run in runs:
        if not run.linked:
            signs[run.block] = signs.get(run.block, 0) + len(plain(run.text))
    free = [r for r in runs if not r.linked and r.text.strip()]
    prose = [r for r in free if r.prose or signs[r.block] > 1] or free
    if not prose:
        return runs
    # Elements are numbered as they open, so of nested ones the last is innermost.
    holder = max(set(prose[0].holders).intersection(*(r.holders for r in prose)))
    return [r for r in runs if holder in r.holders]


def _blocks(runs: list[Run]) -> str:
    blocks: dict[int, list[str]] = {}
    for run in runs:
        blocks.setdefault(run.block, []).append(entities.unescape(run.text))
    lines = (SPACE.sub(" ", "".join(parts)).strip() for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame, url: str, html: str, into: str = "text") -> DataFrame:
    """All columns but the source, and the page's main text."""
    kept = without(pages, [html, into])
    # Inside, the input's columns go by number, so that no name is in the way.
    numbered = [f"c{i}" for i in range(len(kept))]
    rows = pages.select(
        *[quoted(c).alias(n) for c, n in zip(kept, numbered)], host_of(url).alias("__host"),
        F.coalesce(quoted(html).cast("string"), F.lit("")).alias("__html"),
    )
    found = templates(rows.select(F.col("__host").alias("host"), F.col("__html").alias("html")))
    # A few numbers for each host, sent to the pages while they are few in all.
    found = sized(found, "templates", MOST_SENT, F.octet_length("host") + 8 * F.size("template") + 64)
    joined = rows.join(found, F.col("__host") == F.col("host"), "left").select(
        *numbered, F.col("template").alias("__template"), F.col("__html")
    )
    schema = T.StructType([*[pages.schema[c] for c in kept], T.StructField(into, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__html", BATCH_BYTES):
            held, source = (batch.column(batch.num_columns - i).to_pylist() for i in (2, 1))
            texts = [main_text(s, frozenset(t or ())) for s, t in zip(source, held)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(texts, pa.string())], names=[*kept, into]
            )

    return joined.mapInArrow(run, schema)
