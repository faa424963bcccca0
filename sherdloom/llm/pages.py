"""Main text of web pages by nearest-URL page differencing.

Pages are cut into text lines, one per block element.  Within a host pages are
ordered by URL path; each is aligned with its nearest neighbours by longest common
subsequence, and the lines that both share are deleted: what a site repeats from page
to page is not the article.  The markup tells what needs no second page: menus,
headers, footers, forms, adverts, notices and comments go, and lines inside an
article element stay even where another page repeats them.  Article elements that
hold fewer words than the unmarked rest of their page are teasers: such a page is
left to differencing as a whole.

A neighbour that shares nearly all lines outside marked elements is a copy, not a
sibling, and is passed over; a page whose neighbours are all copies asks twice as far
each time, at last the ends of its host.  Pages of one path and the same lines are folded to one before pairing.

Defined results: null and empty html give an empty text; a null url is its own host
with an empty path; repeated rows give the same text; unclosed elements end with
their parent; a page is read whole, however long, and lines that it repeats many
times are aligned in bounded memory; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.ordering import with_global_rank
from ..session import materialize
from .common import col, fresh, url_parts

# Fixed values of HTML: elements without content, with raw content, and block elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe textarea title svg object canvas audio video".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section select summary table tbody td tfoot th thead tr ul".split()
)
# Elements that hold no article text, wherever they stand.
ASIDE = set("nav footer aside form header menu dialog head button select search label".split())
ASIDE_ROLE = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
# Class and id names that mark what surrounds an article.
ASIDE_NAME = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus feedback footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice "
    "notices pager pagination popup promo promoted promotion recommended related replies respond share sharing "
    "sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
ARTICLE = set("article main".split())
ARTICLE_NAME = set("articlebody".split())
# Words that make longer names of those (site-header, ad-slot, related-posts); a name
# with any other word (share-price, related-work, comments-open) marks nothing.
PLACE_NAME = set(
    "area articles bar block body bottom box btn button buttons card cards container content desktop fixed floating "
    "form global group icon icons inner item items large left link links list main mobile outer page pages panel "
    "posts primary right row secondary section site slot small sticky stories thread top unit wrap wrapper x".split()
)
OWN_NAME = set("article entry post story".split())  # post-footer surrounds, post-header is the article's own heading
# An opening tag of the first closes an open element of the second.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
NEIGHBOURS = 2  # pages before and after a page that it may be aligned with
COPY_SHARE = 0.8  # a neighbour that shares so much of the shorter page's open lines is a copy
ALIGNED = 4096  # lines of either page that one table of an alignment holds

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<rest>[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>"
    r"|<(?P<end2>/?)(?P<tag2>[A-Za-z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)",
    re.S,
)
# Raw content ends with its own closing tag.
_RAW_END = {tag: re.compile(rf"</{tag}\s*[^>]*>|\Z", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_NAME = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|$)", re.I)
_SPACE = re.compile(r"\s+")


def _surrounds(name: str, inside: bool) -> bool:
    """Whether a class or id name marks what surrounds an article."""
    words = set(_NAME.findall(_CAMEL.sub("-", name).lower()))
    marks = words & ASIDE_NAME
    if not marks or not all(w in PLACE_NAME or w in OWN_NAME or w.isdigit() for w in words - marks):
        return False
    return marks != {"header"} or not (inside or words & OWN_NAME)


def _marks(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element surrounds the article, and whether it is the article.

    ``inside`` says that it stands inside an article element, whose headers are its own.
    """
    aside, article = tag in ASIDE and not (tag == "header" and inside), tag in ARTICLE
    if "=" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "role":
                role = value.strip().lower()
                aside |= role in ASIDE_ROLE
                article |= role in ARTICLE
            elif name in ("class", "id") and tag not in ("body", "html", *ARTICLE):
                aside |= any(_surrounds(word, inside) for word in value.split())
            elif name == "itemprop":
                article |= value.strip().lower() in ARTICLE_NAME
            elif name in ("aria-hidden", "hidden") and value.lower() in ("true", "hidden"):
                aside = True
    if "hidden" in attributes and _HIDDEN.search(attributes):
        aside = True
    return aside, article and not aside


OPEN, INSIDE, ASIDE_LINE = 0, 1, 2


def lines(page: str | None) -> list[tuple[str, int]]:
    """(text, standing) of every text block of a page.

    A block stands INSIDE an article element, ASIDE of it (what surrounds an article),
    or OPEN.  Beside article elements that hold the most words of these two, only a
    main heading (h1) before the first of them is open, and the other lines are aside;
    where the open lines hold more, the elements are teasers and their lines are open.
    """
    page = page or ""
    found: list[tuple[str, int]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, surrounds, article, h1: these inherited
    headings: set[int] = set()  # lines of h1 elements
    standing, heading = OPEN, False
    at = 0

    def flush():
        if held:
            text = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
            held.clear()
            if text:
                if heading:
                    headings.add(len(found))
                found.append((text, standing))

    while True:
        m = _TOKEN.search(page, at)
        held.append(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        closing, rest = bool(m["end"] or m["end2"]), m["rest"] or m["rest2"] or ""
        if tag in RAW and not closing:
            if not rest.endswith("/"):
                # Raw content ends with its own closing tag and holds no other.
                at = _RAW_END[tag].search(page, at).end()
            continue
        if tag == "br":
            held.append(" ")
            continue
        block = tag in BLOCKS
        if block:
            flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if not block and stack[k][0] in BLOCKS:  # inline ends do not leave a block
                    break
        elif tag not in VOID:
            if block:
                # A paragraph ends where the next block begins, also with inline elements open.
                k = len(stack) - 1
                while k >= 0 and stack[k][0] not in BLOCKS:
                    k -= 1
                if k >= 0 and (stack[k][0] == "p" or stack[k][0] in CLOSES.get(tag, ())):
                    del stack[k:]
            _, aside, article, h1 = stack[-1] if stack else ("", False, False, False)
            own_aside, own_article = _marks(tag, rest, article and not aside)
            stack.append((tag, aside or own_aside, article or own_article, h1 or tag == "h1"))
        _, aside, article, h1 = stack[-1] if stack else ("", False, False, False)
        now = ASIDE_LINE if aside else INSIDE if article else OPEN
        if now != standing:
            flush()
            standing = now
        heading = h1
    flush()
    inside = [k for k, (_, x) in enumerate(found) if x == INSIDE]
    if inside:
        words = [0, 0]
        for t, x in found:
            if x != ASIDE_LINE:
                words[x] += len(t.split())
        if words[OPEN] > words[INSIDE]:
            return [(t, OPEN if x == INSIDE else x) for t, x in found]
        own = {k for k in headings if k < inside[0]}
        found = [(t, ASIDE_LINE if x == OPEN and k not in own else x) for k, (t, x) in enumerate(found)]
    return found


def line_keys(found: list[tuple[str, int]]) -> list[int]:
    return [int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big", signed=True) for t, _ in found]


def _masks(lines_: list[int]) -> dict[int, int]:
    """One number per distinct line, with a bit for every place that holds it."""
    masks: dict[int, int] = {}
    for k, x in enumerate(lines_):
        masks[x] = masks.get(x, 0) | 1 << k
    return masks


def _prefix_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence with ``b``, for every prefix of ``a``.

    A column of the alignment table is a number with one bit a line of ``a``, clear
    where the length grows; sums carry from one stretch of ``a`` into the next.
    """
    carries, grows = bytearray(len(b)), [np.zeros(1, np.int64)]
    for first in range(0, len(a), ALIGNED):
        part = a[first : first + ALIGNED]
        masks, width = _masks(part), len(part)
        full = column = (1 << width) - 1
        for j, x in enumerate(b):
            met = column & masks.get(x, 0)
            total = column + met + carries[j]
            carries[j] = total >> width
            column = (total & full) | (column - met)
        bits = np.frombuffer(column.to_bytes((width + 7) // 8, "little"), np.uint8)
        grows.append(1 - np.unpackbits(bits, bitorder="little")[:width].astype(np.int64))
    return np.concatenate(grows).cumsum()


def _common(a: list[int], b: list[int], at: int) -> list[int]:
    """Positions, plus ``at``, in ``a`` of a longest common subsequence with ``b``."""
    if not a or not b:
        return []
    if len(b) == 1:
        return [at + a.index(b[0])] if b[0] in a else []
    if max(len(a), len(b)) > ALIGNED:
        # Halves of b meet the two parts of a between which the lengths add up to most.
        half = len(b) // 2
        cut = int((_prefix_lengths(a, b[:half]) + _prefix_lengths(a[::-1], b[: half - 1 : -1])[::-1]).argmax())
        return _common(a[:cut], b[:half], at) + _common(a[cut:], b[half:], at + cut)
    masks = _masks(a)
    full = (1 << len(a)) - 1
    columns = [full]
    for x in b:
        column = columns[-1]
        met = column & masks.get(x, 0)
        columns.append(((column + met) & full) | (column - met))
    run, i, j = [], len(a) - 1, len(b)
    while i >= 0 and j:
        if columns[j] >> i & 1:  # no longer with this line of a
            i -= 1
        else:
            j -= 1
            if columns[j] >> i & 1:  # grows by this pair of lines
                run.append(at + i)
                i -= 1
    return run[::-1]


def shared_lines(mine: list[int], other: list[int]) -> list[int]:
    """Positions in ``mine`` of a longest common subsequence with ``other``."""
    head = 0
    while head < min(len(mine), len(other)) and mine[head] == other[head]:
        head += 1
    tail = 0
    while tail < min(len(mine), len(other)) - head and mine[-1 - tail] == other[-1 - tail]:
        tail += 1
    # Lines without a partner on the other page cannot be part of it.
    there = set(other[head : len(other) - tail])
    places = [k for k in range(head, len(mine) - tail) if mine[k] in there]
    a = [mine[k] for k in places]
    here = set(a)
    b = [x for x in other[head : len(other) - tail] if x in here]
    run = [places[k] for k in _common(a, b, 0)]
    return [*range(head), *run, *range(len(mine) - tail, len(mine))]


def repeated_lines(profiles: DataFrame) -> DataFrame:
    """(key, repeated): lines of each distinct page that a nearest neighbour shares.

    ``profiles`` has (key, host, path, hashes, open: which of them are), one row per
    distinct page.  Pages lie in order of host and path over all tasks; every page with
    open lines asks for the positions of its neighbours, so a host of any size is
    spread like others.
    """
    ranked = with_global_rank(profiles, ["host", "path", "key"], "place")
    size = F.aggregate("open", F.lit(0), lambda n, x: n + x.cast("int"))
    others = ranked.select(F.col("place").alias("at"), F.col("hashes").alias("other"), size.alias("other_open"))
    ends = ranked.groupBy("host").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    asks = materialize(ranked.where(F.exists("open", lambda x: x)).join(ends, "host").drop("host"), "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, shared = [], []
            for r in b.to_pylist():
                mine, open_ = r["hashes"], r["open"]
                for n in sorted(r["others"], key=lambda n: (abs(n["step"]), n["step"])):
                    both = shared_lines(mine, n["other"])
                    least = min(sum(open_), n["other_open"] or len(mine))
                    if sum(open_[k] for k in both) < COPY_SHARE * least:
                        key.append(r["key"])
                        shared.append(sorted({mine[k] for k in both}))
                        break
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, b.schema.field("key").type), pa.array(shared, pa.list_(pa.int64()))],
                names=["key", "repeated"],
            )

    found, far = [], NEIGHBOURS
    steps = [k for n in range(1, NEIGHBOURS + 1) for k in (-n, n)]
    while True:
        near = asks.select("*", F.explode(F.array(*[F.lit(k).cast("long") for k in steps])).alias("ask"))
        at = F.col("place") + F.col("ask")
        if far > NEIGHBOURS:  # past the end of the host its last page answers
            at = F.greatest(F.least(at, F.col("high")), F.col("low"))
        near = near.withColumn("at", at).where("at between low and high and at <> place")
        met = near.withColumn("step", F.col("at") - F.col("place")).join(others, "at")
        grouped = met.groupBy("place", "key", "hashes", "open").agg(
            F.collect_list(F.struct("step", "other", "other_open")).alias("others")
        )
        answer = grouped.select("key", "hashes", "open", "others").mapInArrow(run, "key string, repeated array<bigint>")
        found.append(materialize(answer, "repeated"))
        reach = F.greatest(F.col("place") - F.col("low"), F.col("high") - F.col("place")) > far
        asks = materialize(asks.where(reach).join(found[-1].select("key"), "key", "left_anti").select(*asks.columns), "asks")
        if asks.isEmpty():
            break
        far *= 2
        steps = [-far, far]
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return whole


def extract(pages: DataFrame, keep: list[str]) -> tuple[DataFrame, str]:
    """The kept columns and the main text of every page."""
    out = fresh(pages, "main_text")
    host, path = url_parts(col(pages, "url").cast("string"))
    html = col(pages, "html").cast("string")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, hashes, opens, digests = [], [], [], []
            for h, p, t in zip(b.column(1), b.column(2), b.column(3)):
                found = lines(t.as_py())
                keys = line_keys(found)
                kept.append([
                    {"text": x, "open": s == OPEN, "hash": k}
                    for (x, s), k in zip(found, keys) if s != ASIDE_LINE
                ])
                hashes.append(keys)
                opens.append([s == OPEN for _, s in found])
                digests.append(hashlib.md5(repr((h.as_py(), p.as_py(), keys, opens[-1])).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(kept, line), pa.array(hashes, pa.list_(pa.int64())), pa.array(opens, pa.list_(pa.bool_())), pa.array(digests, pa.string())],
                names=["row", "host", "path", "lines", "hashes", "open", "key"],
            )

    line = pa.list_(pa.struct([("text", pa.string()), ("open", pa.bool_()), ("hash", pa.int64())]))
    frame = pages.select(
        F.struct(*[col(pages, c) for c in keep]).alias("row"), host.alias("host"), path.alias("path"), html.alias("html")
    )
    rest = T.StructType.fromDDL(
        "host string, path string, lines array<struct<text:string,open:boolean,hash:bigint>>, hashes array<bigint>, open array<boolean>, key string"
    )
    schema = T.StructType([frame.schema["row"], *rest])
    parsed = materialize(frame.mapInArrow(parse, schema), "parsed")
    profiles = parsed.where(F.size("hashes") > 0).groupBy("key", "host", "path").agg(
        F.first("hashes").alias("hashes"), F.first("open").alias("open")
    )
    repeated = repeated_lines(profiles.select("host", "path", "hashes", "open", "key"))
    # Only pages with open lines can lose one: the others skip the join, texts and all.
    asks = F.exists("lines", lambda x: x["open"])
    none = F.lit(None).cast("array<bigint>")
    joined = parsed.where(asks).join(repeated, "key", "left").select("row", "lines", "repeated").unionByName(
        parsed.where(~asks).select("row", "lines", none.alias("repeated"))
    )
    kept = F.filter(
        "lines", lambda x: ~(x["open"] & F.coalesce(F.array_contains("repeated", x["hash"]), F.lit(False)))
    )
    text = F.array_join(F.transform(kept, lambda x: x["text"]), "\n\n")
    return joined.select("row.*", text.alias(out)), out
