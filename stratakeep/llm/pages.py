"""Main text of HTML pages (operator 2): a host suffix array decides on every block, landmarks say how strictly.

Repetition alone can't find the article: the same passage may stand in the articles of several
pages, and an advert or a footer may be unlike any other. So every page goes through the array of
its host, and an <article> or <main> element, where the parser finds one that isn't excluded, is a
hint: what stands outside of it doesn't count as article, and what stands inside goes only by strong
evidence. A block is boilerplate if long substrings that many of the host's pages have cover all of
it: REPEAT tokens or more, outside of landmarks on at least LEAST_PAGES pages of different content
and LEAST_SHARE of all; or inside, on INSIDE_PAGES pages of different articles and INSIDE_SHARE of
all. The latter holds for blocks in landmarks alone, and not for copies of an article: where more
than half of a page's landmarks is in blocks that begin with such substrings, they all stay.

What longer substrings cover is what their stretches of REPEAT tokens cover, so the array is needed
to that depth only: suffixes that agree so far stand next to each other in it, and these runs are
found by a hash aggregate, so that a host of any size needs no task of its own. A block that repeats
cover begins with one. So of the suffixes in landmarks those are counted first that agree with the
beginning of some block, and then those of blocks whose beginning is repeated; bitmaps of bounded
size pick them, and let some others through that change nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratakeep.llm.store import materialise, observed
from stratakeep.llm.wanted import MOST_BITS, asked_for, bitmap, bits_for
from stratakeep.llm.words import Words, chunks, mix

REPEAT, LEAST_PAGES, LEAST_SHARE = 6, 3, 0.2
#: Of what is inside of landmarks.
INSIDE_PAGES, INSIDE_SHARE = 5, 0.5

#: Fixed values of HTML: elements without an end tag, with raw text, and that begin and end blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that hold no article text.
EXCLUDED = frozenset("head nav header footer aside form menu dialog button select datalist object audio video canvas map".split()) | RAW
LANDMARK = frozenset(("article", "main"))
#: Words of class, id or role that mark an element as no article text.
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist complementary consent "
    "contentinfo cookie cookies dialog discussion disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices "
    "cta pager pagination popup promo promoted promotion reactions related replies respond search share sharing sidebar signup skip social sponsor "
    "sponsored subscribe toolbar widget".split()
)
#: Words that may stand beside a marking word in one class token (site-footer, related-posts); with others (has-sidebar) it marks nothing.
BESIDE = frozenset(
    "area bar block box button buttons card container feed form global google group holder icons inner item items link links list main module outer page "
    "panel post posts primary reader readers row section user visitor site slot stories story title top unit wrap wrapper zone".split()
)

_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?", re.I)
_SPACE = re.compile(r"\s+")
_CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _is_hidden(attributes: str) -> bool:
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" and value != "until-found" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _is_marked(attributes: str) -> bool:
    """Whether a whole token of class, id or role is made of marking words, and of words that may stand beside them."""
    for name, value in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role"):
            for token in value.strip("\"'").split():
                # siteFooter and site-footer are the same
                words = {w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", token).lower()) if len(w) > 1}
                if not MARKED.isdisjoint(words) and words <= MARKED | BESIDE:
                    return True
    return False


def blocks(html: str | None) -> tuple[list[tuple[str, int]], bool]:
    """The text blocks in page order, each with where it stands: 2 in a landmark, 1 outside, 0 excluded;
    and whether the page has a landmark. White space inside a block is one space; empty blocks are left out.

    A marking class never excludes <main> or what surrounds it. An <article> that is marked or inside of
    what is marked (a reader's comment, a teaser) is excluded, unless the page has no other text."""
    out, landmark, passed = _parse(html or "", False)
    if passed and not landmark and all(where == 0 for _, where in out):
        out, landmark, _ = _parse(html or "", True)
    return out, landmark


def _parse(html: str, every: bool) -> tuple[list[tuple[str, int]], bool, bool]:
    """What blocks gives, and whether an <article> was passed over for its marks; every: none is."""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements: name, where their text stands (-1: excluded by a mark alone)
    place, landmark, passed, at, raw_end = 1, False, False, 0, 0

    def flush() -> None:
        if text:
            block = _SPACE.sub(" ", unescape("".join(text))).strip()
            text.clear()
            if block:
                out.append((block, max(place, 0)))

    low = None
    for m in _PIECE.finditer(html):
        if m.start() < raw_end:
            continue
        if m.start() > at:
            text.append(html[at : m.start()])
        at = m.end()
        if m["name"] is None:
            if m[0].startswith("<![CDATA["):
                text.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        name = m["name"].lower()
        if m["end"]:
            if any(n == name for n, _ in stack):
                if name in BLOCK or name in EXCLUDED:
                    flush()
                while stack.pop()[0] != name:
                    pass
                new = stack[-1][1] if stack else 1
                if new != place:
                    flush()
                    place = new
            elif name in BLOCK or name == "br":
                flush() if name != "br" else text.append(" ")
            continue
        if name == "br":
            text.append("\n")
            continue
        if name in BLOCK:
            flush()
            closes = _CLOSES.get(name, ()) if name not in BLOCK or name in _CLOSES else {"p"}
            while stack and stack[-1][0] in closes:
                stack.pop()
                place = stack[-1][1] if stack else 1
        if name in VOID or m["attributes"].endswith("/"):
            continue
        if name in RAW:
            # raw text ends at its end tag alone; none of it is text of the page
            low = html.lower() if low is None else low
            end = low.find(f"</{name}", at)
            close = html.find(">", end) + 1 if end >= 0 else 0
            at = raw_end = close or len(html)
            continue
        inside = place
        if place and name not in ("html", "body"):
            if name in EXCLUDED or _is_hidden(m["attributes"]):
                inside = 0
            elif name in LANDMARK and (every or name == "main" or place > 0 and not _is_marked(m["attributes"])):
                inside, landmark = 2, True
            elif name in LANDMARK:
                inside, passed = -1, True
            elif place > 0 and _is_marked(m["attributes"]):
                inside = -1
        if inside != place:
            flush()
            place = inside
        stack.append((name, inside))
    if at < len(html):
        text.append(html[at:])
    flush()
    return out, landmark, passed


def _host():
    return F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _suffixes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(block, position, prefix, long) of each suffix of blocks that has REPEAT tokens; prefix is the hash of the first
    REPEAT of them. A shorter block is one suffix, at position 0, and not long."""
    words = Words(pa.array(texts, pa.string()))
    hashes = words.hashes()
    grams, whole = words.grams(hashes, REPEAT)
    line, length = words.rows(), np.diff(words.first)
    short = np.flatnonzero((length > 0) & (length < REPEAT))
    at = np.flatnonzero(whole)
    lone = np.array([np.bitwise_xor.reduce(hashes[words.first[s] : words.first[s + 1]] * np.arange(1, 2 * length[s], 2, dtype=np.uint64)) for s in short], np.uint64)
    position = np.r_[at - words.first[line[at]], np.zeros(len(short), np.int64)].astype(np.int64)
    is_long = np.arange(len(position)) < len(at)
    return np.r_[line[at], short].astype(np.int64), position, np.r_[grams[at], lone].astype(np.uint64), is_long


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


_STORED = [("site", pa.int64()), ("page", pa.int64()), ("outside", pa.int64()), ("inside", pa.int64()), ("places", pa.binary()), ("text", pa.string())]


def _parsed(batches: Iterator[pa.RecordBatch]):
    """Each page parsed: its host's hash, its own, those of what stands outside and inside of landmarks (null: it has none),
    of each block where it stands, and all blocks, which hold no line feeds, joined by them."""
    for batch in chunks(batches, "html"):
        rows = []
        for html, host, page in zip(*(c.to_pylist() for c in batch.columns[:3])):
            found, landmark = blocks(html)
            of = ["\n".join(b for b, where in found if (where == 2) == inside) for inside in (False, True)]
            rows.append((_hash(host), page, _hash(of[0]), _hash(of[1]) if landmark else None, bytes(where for _, where in found), "\n".join(b for b, _ in found)))
        columns = [pa.array(c, kind) for c, (_, kind) in zip(zip(*rows), _STORED)]
        yield pa.RecordBatch.from_arrays([*columns, *batch.columns[3:]], [*(n for n, _ in _STORED), *batch.schema.names[3:]])


class _Array:
    """The suffixes of a batch of parsed pages: of each its page's row, block's number on the page, position, prefix (of its host alone), and kinds."""

    def __init__(self, batch: pa.RecordBatch):
        of = lambda name: batch.column(batch.schema.get_field_index(name))
        texts, row, number = [], [], []
        for k, text in enumerate(of("text").to_pylist()):
            found = text.split("\n") if text else []
            texts += found
            row += [k] * len(found)
            number += range(len(found))
        block, self.position, prefix, self.long = _suffixes(texts)
        place = np.frombuffer(b"".join(of("places").to_pylist()), np.uint8)[block]
        self.site, self.page, self.outside = (np.asarray(of(c)) for c in ("site", "page", "outside"))
        self.has_landmark = np.asarray(of("inside").is_valid())
        self.article = np.asarray(of("inside").fill_null(0))
        self.row, self.number = np.array(row, np.int64)[block], np.array(number, np.int64)[block]
        self.prefix = mix(prefix ^ self.site.view(np.uint64)[self.row]).view(np.int64)
        # shorter blocks aren't long substrings: in landmarks they stay
        self.inside = (place == 2) & self.long
        self.around = place < 2
        self.body = (place == 1) & ~self.has_landmark[self.row]
        self.block = block

    def begun_by(self, repeated: Broadcast) -> np.ndarray:
        """Whether a suffix in landmarks is of a block whose beginning may be repeated."""
        first = self.inside & (self.position == 0)
        blocks_ = np.unique(self.block[first][asked_for(repeated, self.prefix[first])])
        return self.inside & np.isin(self.block, blocks_)


def _beginnings(batches: Iterator[pa.RecordBatch]):
    """Prefixes of blocks in landmarks."""
    for batch in chunks(batches, "text"):
        a = _Array(batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(a.prefix[a.inside & (a.position == 0)]))], ["prefix"])


def _of_begun(repeated: Broadcast):
    """Prefixes of all suffixes of the blocks in landmarks whose beginning may be repeated."""

    def run(batches):
        for batch in chunks(batches, "text"):
            a = _Array(batch)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(a.prefix[a.begun_by(repeated)]))], ["prefix"])

    return run


_SEEN = "site long, prefix long, content long, inside boolean"


def _seen(asked: Broadcast):
    """(site, prefix, content, inside), each prefix once a page: of suffixes outside of landmarks, and of those asked for inside;
    and a row with no prefix for each content."""

    def run(batches):
        for batch in chunks(batches, "text"):
            a = _Array(batch)
            for inside, content in ((False, a.outside), (True, a.article)):
                at = np.flatnonzero(a.inside if inside else a.around)
                at = at[asked_for(asked, a.prefix[at])] if inside else at
                pairs = np.unique(np.stack([a.row[at], a.prefix[at]], axis=1), axis=0)
                pages = np.flatnonzero(a.has_landmark) if inside else np.arange(batch.num_rows)
                rows = np.r_[pairs[:, 0], pages]
                prefix = pa.array(np.r_[pairs[:, 1], np.zeros(len(pages), np.int64)], mask=np.arange(len(rows)) >= len(pairs))
                columns = [pa.array(a.site[rows]), prefix, pa.array(content[rows]), pa.array(np.full(len(rows), inside))]
                yield pa.RecordBatch.from_arrays(columns, ["site", "prefix", "content", "inside"])

    return run


def _open(repeated: Broadcast):
    """(page, block, position, prefix, inside) of suffixes that may be repeated, of blocks that await a verdict."""

    def run(batches):
        for batch in chunks(batches, "text"):
            a = _Array(batch)
            at = np.flatnonzero(a.body | a.begun_by(repeated))
            at = at[asked_for(repeated, a.prefix[at])]
            columns = [a.page[a.row[at]], a.number[at], a.position[at], a.prefix[at], a.inside[at]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["page", "block", "position", "prefix", "inside"])

    return run


def _touched(pages: Broadcast, wanted: bool):
    """The parsed pages that may have repeats, or the others."""

    def run(batches):
        for batch in chunks(batches, "text"):
            has = asked_for(pages, np.asarray(batch.column(batch.schema.get_field_index("page"))))
            yield batch.filter(pa.array(has == wanted))

    return run


def _texts(batches: Iterator[pa.RecordBatch]):
    """The main text of parsed pages: their blocks less those that repeats cover."""
    for batch in chunks(batches, "text"):
        texts = []
        for text, places, landmark, covered in zip(*(c.to_pylist() for c in batch.columns[:4])):
            gone: dict[int, set[int]] = {}
            for c in covered or ():
                gone.setdefault(c["block"], set()).update(range(c["position"], c["position"] + REPEAT))
            found = [(j, b) for j, (b, where) in enumerate(zip(text.split("\n"), places)) if where == (1 if landmark is None else 2)]
            if gone and landmark is not None:
                size = {j: b.count(" ") + 1 for j, b in found}
                if 2 * sum(n for j, n in size.items() if 0 in gone.get(j, ())) > sum(size.values()):
                    gone = {}  # a copy of an article
            texts.append("\n".join(b for j, b in found if j not in gone or not gone[j].issuperset(range(b.count(" ") + 1))))
        yield pa.RecordBatch.from_arrays([*batch.columns[4:], pa.array(texts, pa.string())], [*batch.schema.names[4:], "text"])


def _repeated(seen: DataFrame) -> DataFrame:
    """(prefix, inside) of what enough different contents of a host have."""
    counts = seen.distinct().groupBy("site", "prefix", "inside").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts.where(f"prefix is null or n >= if(inside, {INSIDE_PAGES}, {LEAST_PAGES})"), "repeats")
    totals = counts.where("prefix is null").select("site", "inside", F.col("n").alias("total"))
    share = F.when(F.col("inside"), INSIDE_SHARE).otherwise(LEAST_SHARE)
    return counts.where("prefix is not null").join(totals, ["site", "inside"]).where(F.col("n") >= share * F.col("total")).select("prefix", "inside")


def _bitmap(ids: DataFrame, column: str, name: str) -> tuple[Broadcast, int]:
    """A bitmap of a column's distinct values, and their number."""
    ids, seen = observed(ids.select(column).distinct(), name)
    return bitmap(ids, F.col(column), min(MOST_BITS, bits_for(seen["n"]) + 2)), seen["n"]


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row for each row of pages (page_id, url, html).

    The parser cuts a page into blocks and leaves out what is excluded (navigation, headers,
    footers, asides, forms, comments, adverts, notices, hidden parts, scripts and styles). Where it
    finds <article> or <main> elements (not in comments or scripts, nor in excluded parts) their
    blocks are open, else those of the body. Of these go the ones that substrings of REPEAT tokens
    or more cover which LEAST_PAGES pages of different content, and LEAST_SHARE of all, of the host
    have outside landmarks (on a page without landmarks a shorter block too: if they have all of
    it), or, for blocks in landmarks, which INSIDE_PAGES different articles and INSIDE_SHARE of all
    have inside. Copies of an article, of which more than half is in blocks that begin so, stay.
    Blocks stay or go whole, and an article under several urls is one content, so it stays.
    Character references are decoded, white space inside a block is one space, blocks are joined by
    line feeds.

    Null and empty pages give an empty text. Pages without a host form one group. Rows alike in
    page_id, url and html are the same page.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    ids = [pages.schema["page_id"], pages.schema["url"]]
    base = pages.select(html.alias("html"), _host().alias("host"), F.xxhash64("page_id", "url", html).alias("page"), "page_id", "url")
    kinds = [T.LongType(), T.LongType(), T.LongType(), T.LongType(), T.BinaryType(), T.StringType()]
    stored = T.StructType([*(T.StructField(n, kind) for (n, _), kind in zip(_STORED, kinds)), *ids])
    parsed = materialise(base.mapInArrow(_parsed, stored), "pages", compression="zstd")
    array = parsed.select("site", "page", "outside", "inside", "places", "text")

    starts, _ = _bitmap(array.mapInArrow(_beginnings, "prefix long"), "prefix", "beginnings")
    repeated = materialise(_repeated(array.mapInArrow(_seen(starts), _SEEN)), "repeated")
    # inside of landmarks only beginnings of blocks are counted by now: the rest of those blocks follows
    map_, _ = _bitmap(repeated, "prefix", "repeated-beginnings")
    rest, n = _bitmap(array.mapInArrow(_of_begun(map_), "prefix long"), "prefix", "begun")
    if n:
        inside = _repeated(array.mapInArrow(_seen(rest), _SEEN).where("inside"))
        repeated = materialise(repeated.unionByName(inside), "repeated")
        map_, _ = _bitmap(repeated, "prefix", "all-repeated")
    where = repeated.groupBy("prefix").agg(F.min("inside").alias("only_inside"))
    open_ = array.mapInArrow(_open(map_), "page long, block long, position long, prefix long, inside boolean")
    covered = open_.join(where, "prefix").where("inside or not only_inside").groupBy("page").agg(F.collect_set(F.struct("block", "position")).alias("covered"))
    covered = materialise(covered, "covered")

    touched, _ = _bitmap(covered, "page", "touched")
    columns = ["text", "places", "inside", "covered", "page_id", "url"]
    left = parsed.mapInArrow(_touched(touched, False), stored).withColumn("covered", F.lit(None).cast(covered.schema["covered"].dataType)).select(columns)
    joined = parsed.mapInArrow(_touched(touched, True), stored).join(covered, "page", "left").select(columns)
    out = T.StructType([*ids, T.StructField("text", T.StringType())])
    return left.mapInArrow(_texts, out).unionByName(joined.mapInArrow(_texts, out)).withColumn("n_chars", F.length("text").cast("long"))
