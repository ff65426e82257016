"""Main text of web pages: structure, and differencing against the page of the nearest URL."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridrecon.llm.common import written

#: One attribute; as in HTML, quotes count only where a value begins (an unclosed one is part of a name).
_ATTRIBUTE = r"""[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|))?+"""
TOKEN = re.compile(rf"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[\s/=]++|{_ATTRIBUTE})*+)>|[!?][^>]*(?:>|\Z)|/?[a-zA-Z][^<]*\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"'][^\s>]*))?""")
RAW = {"script", "style", "textarea", "title", "iframe", "template", "svg", "xmp", "noframes"}
DROPPED = {"nav", "footer", "aside", "form", "menu", "dialog", "select", "button", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
#: What a whole word of a class, id or role says of an element.
BOILER = re.compile(
    r"^(?:ads?|advert\w*|adsbygoogle|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|sidebar|menu|navbar|navigation|nav|breadcrumbs?|"
    r"footer|masthead|topbar|comments?|disqus|replies|respond|share|sharing|social|related|newsletter|subscribe|subscription|signup|login|search|widget|pagination|pager|toolbar|complementary|contentinfo)$"
)
#: Words that say so even of a paragraph, heading or the like.
PLAIN = re.compile(r"^(?:ads?|advert\w*|adsbygoogle|sponsor\w*|promo\w*|cookies?|consent|gdpr|comments?|disqus|newsletter|breadcrumbs?)$")
TEXTUAL = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "dt", "dd", "td", "th", "tr", "figcaption"} | INLINE
HEADERS = re.compile(r"^(?:header|banner|site-header|page-header)$")


def lines(page: str | None) -> tuple[list[tuple[str, bool, bool]], bool]:
    """([(text, in an article, in an element that is no main text)], whether articles hold at least half of the text outside such elements).

    A line is a block: text between tags other than inline ones, references decoded, white space made one space.
    """
    page = page or ""
    stack: list[tuple[str, bool, bool]] = []  # open elements: name, article, dropped
    out: list[tuple[str, bool, bool]] = []
    buf: list[str] = []
    article = dropped = False

    def flush():
        if buf:
            text = " ".join(entities.unescape("".join(buf)).split())
            buf.clear()
            if text:
                out.append((text, article, dropped))

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            buf.append(page[at:])
            break
        if m.start() > at:
            buf.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name not in INLINE:
            flush()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if stack[k][1] != article or stack[k][2] != dropped or name not in INLINE:
                        flush()
                    article, dropped = (stack[k - 1][1], stack[k - 1][2]) if k else (False, False)
                    del stack[k:]
                    break
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            flush()
            continue
        if name in VOID or m[3].endswith("/"):
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):  # these end an open one of their kind
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ("ul", "ol", "dl", "table", "div", "article", "section", "main", "body"):
                    break
                if stack[k][0] == name:
                    article, dropped = (stack[k - 1][1], stack[k - 1][2]) if k else (False, False)
                    del stack[k:]
                    break
        words: list[str] = []
        here, gone = name in ("article", "main"), name in DROPPED or (name in ("header", "noscript") and not article)
        telling = PLAIN if name in TEXTUAL else BOILER
        for a, v in ATTRIBUTE.findall(m[3]) if m[3] else ():
            v, a = v.strip("\"'").lower(), a.lower()
            if a == "hidden" or (a == "aria-hidden" and v == "true"):
                gone = True
            elif a == "itemprop":
                here |= v == "articlebody"
            elif a == "role" and v == "main":
                here = True
            elif a in ("class", "id", "role"):
                words += v.split()
        for w in words:
            if HEADERS.match(w) and not article or telling.match(w) or any(telling.match(x) for x in re.split(r"[-_]+", w) if x in ("ad", "ads", "comment", "comments", "cookie", "sidebar", "advert", "menu", "footer", "nav", "promo", "newsletter", "sponsored")):
                gone = True
        if name in ("html", "body"):
            gone = False
        if (here and not article) or (gone and not dropped):
            flush()
        article, dropped = article or (here and not gone and not dropped), dropped or gone
        stack.append((name, article, dropped))
    flush()
    within = sum(len(t) for t, inside, gone in out if inside and not gone)
    return out, 0 < within >= sum(len(t) for t, inside, gone in out if not inside and not gone)


#: Bits of the table of an alignment that is walked back in one go; a larger one is halved first.
TABLE = 1 << 28


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """After each element of a, a number whose zero bits are the places of b at which the alignment grows."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | (1 << j)
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of a with each prefix of b."""
    v = (1 << len(b)) - 1
    for v in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def common(a: list[int], b: list[int]) -> list[int]:
    """Positions in a of a longest common subsequence with b, by bit-parallel rows and a walk back; a large table is halved."""
    mine, other = set(a), set(b)
    at = [i for i, x in enumerate(a) if x in other]  # the rest can't be part of one
    a, b = [a[i] for i in at], [x for x in b if x in mine]
    if len(a) * len(b) > TABLE and len(a) > 1:
        half = len(a) // 2
        cut = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
        return [at[i] for i in common(a[:half], b[:cut])] + [at[half + i] for i in common(a[half:], b[cut:])]
    rows = list(_rows(a, b))
    out, i, j = [], len(a) - 1, len(b) - 1
    while i >= 0 and j >= 0:
        if rows[i] >> j & 1:
            j -= 1
        elif i and not rows[i - 1] >> j & 1:
            i -= 1
        else:
            out.append(at[i])
            i, j = i - 1, j - 1
    return out[::-1]


def _where(url: str | None) -> tuple[str, str]:
    try:
        u = urlsplit((url or "").strip())
        return (u.hostname or "").lower(), u.path
    except ValueError:
        return "", url or ""


def _like(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def nearest(pages: DataFrame) -> DataFrame:
    """(page_id, partner): pages (page_id, host, path) with the neighbour in URL order, on the host, whose path shares more.

    The order is cut into ranges of about equal size, in which windows look one row back and ahead; the ends of the
    ranges (two rows of each partition) are told to all, so neither a large host nor a cut changes the result.
    """
    key = F.struct("host", "path", "page_id").alias("key")
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # keys are small beside their pages, so sizes can't decide
    ranged = pages.select(key).distinct().repartitionByRange(parts, "key").withColumn("range", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    # numbers of ranges follow the keys, among which there are nulls
    ends = [(r.lo, r.hi, r.range) for r in ranged.groupBy("range").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("range").collect()]
    kind = ranged.schema["key"].dataType.simpleString()
    rows = [(r, ends[i - 1][1] if i else None, ends[i + 1][0] if i + 1 < len(ends) else None) for i, (_, _, r) in enumerate(ends)]
    edge = pages.sparkSession.createDataFrame(rows, f"range int, before {kind}, after {kind}")
    w = W.partitionBy("range").orderBy("key")
    d = ranged.withColumn("back", F.lag("key").over(w)).withColumn("ahead", F.lead("key").over(w)).join(F.broadcast(edge), "range", "left")
    d = d.select("key", F.coalesce("back", "before").alias("back"), F.coalesce("ahead", "after").alias("ahead"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, partner = [], []
            for k, back, ahead in zip(*(c.to_pylist() for c in b.columns)):
                near = [(-_like(k["path"], x["path"]), i, x["page_id"]) for i, x in enumerate((back, ahead)) if x and x["host"] == k["host"]]
                if near and k["page_id"] is not None:
                    ids.append(k["page_id"])
                    partner.append(min(near)[2])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(partner, pa.int64())], ["page_id", "partner"])

    return d.mapInArrow(run, "page_id long, partner long")


#: Share of a page's open text (outside articles and listed elements) that stays without shared lines: from BULK on all of them go; below COPY
#: the two pages are copies of one text, and none goes; in between those go that HOSTS different pages of the host hold.
BULK, COPY, HOSTS = 0.5, 0.1, 3


def template(got: list[tuple[bool, bool, int]], found: bool, shared: list[int]) -> tuple[list[int], bool]:
    """(positions of shared lines outside articles, whether all of them go): of lines (in an article, in a listed element, length)."""
    shared = [k for k in shared if not got[k][0]]
    if found:
        return shared, True
    whole = sum(n for inside, gone, n in got if not inside and not gone)
    stays = whole - sum(got[k][2] for k in shared if not got[k][1])
    if stays < COPY * whole:
        return [k for k in shared if got[k][1]], True
    return shared, stays >= BULK * whole


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_shared, n_other: the main text of every row of pages (page_id, url, html), and how many
    blocks went because they were shared, and for their place.

    Every page is aligned, by the longest common subsequence of the hashes of its blocks, with the page of its host whose URL is
    nearest. Aligned blocks outside articles are template and go; inside they stay: articles may quote each other. On a page without an
    article they go only if at least half of its text outside listed elements stays, or if three different pages of the host hold the block;
    where less than a tenth would stay the two pages are copies (mirrors, print views, a page fetched again) and keep their text. Of
    what is left, blocks in elements that are no main text by name, class, id or role (menus, headers, footers, asides, notices, adverts,
    forms, comments) go, and where articles (or main) hold at least half of the rest, blocks outside them. Null or empty html: empty
    text; a null or only URL of a host has no partner; rows that share id and html share what goes; empty input: no rows. Whole
    pages are read. Other columns are ignored.

    Only hashes are stored and shuffled for the alignment; pages are parsed again for their text, which meets the few places.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    p = p.withColumn("h", F.xxhash64("html"))

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {
            "page_id": pa.int64(), "h": pa.int64(), "host": pa.string(), "path": pa.string(), "found": pa.bool_(), "blocks": pa.list_(pa.int64()),
            "inside": pa.list_(pa.bool_()), "gone": pa.list_(pa.bool_()), "size": pa.list_(pa.int32()),
        }
        for b in batches:
            rows = []
            for i, u, html, h in zip(*(c.to_pylist() for c in b.columns)):
                got, found = lines(html)
                rows.append((i, h, *_where(u), found, [xxhash.xxh64_intdigest(t) >> 1 for t, _, _ in got], [x for _, x, _ in got], [x for _, _, x in got], [len(t) for t, _, _ in got]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.values())], list(types))

    kinds = "page_id long, h long, host string, path string, found boolean, blocks array<long>, inside array<boolean>, gone array<boolean>, size array<int>"
    out = written(p.mapInArrow(outline, kinds), "outlines")
    pairs = nearest(out.where("host <> ''").select("page_id", "host", "path")).groupBy("page_id").agg(F.min("partner").alias("partner"))
    once = out.groupBy(F.col("page_id").alias("partner")).agg(F.min_by("blocks", F.hash("blocks")).alias("other"))

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, h, host, found, mine, inside, gone, size, other in zip(*(c.to_pylist() for c in b.columns)):
                at, sure = template(list(zip(inside, gone, size)), found, common(mine, other or []))
                if at:
                    rows.append((i, h, host, at, [mine[k] for k in at], sure))
            if rows:
                types = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["page_id", "h", "host", "at", "hash", "sure"])

    both = out.join(pairs, "page_id").join(once, "partner").select("page_id", "h", "host", "found", "blocks", "inside", "gone", "size", "other")
    d = written(both.mapInArrow(differ, "page_id long, h long, host string, at array<int>, hash array<long>, sure boolean"), "differences")
    asked = d.where("not sure").select("page_id", "h", "host", F.explode(F.arrays_zip("at", "hash")).alias("x")).select("page_id", "h", "host", "x.*")
    held = out.select("host", F.xxhash64("blocks").alias("page"), F.explode("blocks").alias("hash")).join(asked.select("host", "hash").distinct(), ["host", "hash"], "left_semi")
    many = held.distinct().groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= HOSTS)
    shared = d.where("sure").select("page_id", "h", "at").unionByName(asked.join(many, ["host", "hash"]).select("page_id", "h", F.array("at").alias("at")))
    shared = written(shared.groupBy("page_id", "h").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("shared")), "shared")

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, same, rest = [], [], []
            for html, gone in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                got, found = lines(html)
                gone = set(gone or ())
                left = [x for k, x in enumerate(got) if k not in gone]
                kept = [t for t, inside, drop in left if not drop and (inside or not found)]
                texts.append(" ".join(kept))
                same.append(len(got) - len(left))
                rest.append(len(left) - len(kept))
            cols = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(same, pa.int64()), pa.array(rest, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars", "n_shared", "n_other"])

    whole = p.join(shared, ["page_id", "h"], "left").select("page_id", "url", "html", "shared")
    return whole.mapInArrow(text, "page_id long, url string, text string, n_chars long, n_shared long, n_other long")
