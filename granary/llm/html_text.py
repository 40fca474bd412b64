"""Main text of web pages: markup proposes what is text, and pages with near URLs of the same host decide what is template.

``lines`` turns a page into text blocks.  Blocks inside menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments go, by element, role or class.  Inside of a marked article ids say nothing, and a class only if it is made of such names alone and stands
on an element that holds others: adverts and comments differ from page to page, so that differencing can't find them.  The others are proposed: those inside a marked article or main element, or all of a page without
one.  Pages are ordered by host and URL path, and neighbours that share ``COPY`` or more of the longer one's characters are a run of copies.
Each page is aligned with the nearest pages before and after its run in its host by a longest common subsequence of their lines, and lines that
it shares with one of them are deleted as template if both pages have other lines too.  Inside a marked article a shared line goes only where
its place in the element tree says the same: ``PAGES`` or more pages of the host have lines there, and ``RATE`` or more of these lines are
shared with a neighbour.  So a bar that every article of a site repeats goes, and a paragraph that two articles have in common stays.

The order is made by a range partitioning on host, path and id with two-pass prefix sums, so that a large host is spread over many tasks, and
the neighbours' lines travel as hashes.  The pages beside a long run are dealt to it by blocks of places.

Null or empty pages give an empty text, null URLs have an empty host and path; ties in the order go by id; repeated rows give repeated results; empty tables give none; other columns are ignored; pages are read whole.
"""

from __future__ import annotations

import bisect
import html as entities
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import stash

# Names of the public HTML standard (fixed values).
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
SPACED = frozenset("br td th img".split())
NEVER = frozenset("nav footer aside noscript template svg math select button dialog menu object audio video canvas ins head datalist".split())
MARKED = NEVER | {"article", "main", "header", "form"}
COPY = 0.75  # share of the longer page's characters that makes two pages copies
RATE, PAGES = 0.8, 8  # evidence that a place in the element tree holds template
MATCHES = 1 << 20  # equal pairs of lines that one alignment lists
BLOCK = 256  # places that one row of a run's neighbours serves
PARAGRAPH_ENDS = BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "summary"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

# Words of class and id values, and roles, that name what isn't main text, and what is.
TEMPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted promotion banner nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside widget widgets related recommended"
    " share sharing social cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup paywall comment comments commentlist reply replies disqus respond pagination pager toolbar login search copyright".split()
)
HEADER_WORDS = frozenset("header masthead topbar".split())
TEMPLATE_ROLES = frozenset("navigation contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# Inside of a marked article a class names template only if no other words stand beside these, and only on elements that hold others.
BESIDE = frozenset("area bar block box button buttons container content form group inner item items link links list panel post posts row section slot title unit widget wrap wrapper".split())
CONTAINERS = frozenset("div section ul ol table span".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN_WORDS = frozenset("articlebody entrycontent postcontent articlecontent maincontent storybody postbody".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+)>""")
_BARE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>"']|\Z)""", re.IGNORECASE)


class Line(NamedTuple):
    text: str
    main: bool
    path: int  # of its place in the element tree


_TELLING = re.compile("class|id|role|hidden|style|itemprop", re.IGNORECASE)


def _role(name: str, attributes: str, in_main: bool) -> int:
    return _short_role(name, attributes, in_main) if len(attributes) <= 500 else _short_role.__wrapped__(name, attributes, in_main)


@lru_cache(maxsize=4096)
def _short_role(name: str, attributes: str, in_main: bool) -> int:
    """-1 for an element whose text goes, 1 for one that marks main text, 0 otherwise."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes and not attributes.isspace() else {}
    names = f"{found.get('class', '')} {found.get('id', '')}".lower()
    role = found.get("role", "").lower()
    if name in NEVER or (name == "header" and not in_main) or role in TEMPLATE_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return -1
    if in_main:
        kinds = [set(re.split("[^a-z0-9]+", token)) for token in found.get("class", "").lower().split()] if name in CONTAINERS else []
        if any(words & TEMPLATE_WORDS and words <= TEMPLATE_WORDS | BESIDE for words in kinds):
            return -1
    elif found and name not in HEADINGS and name not in ("body", "html", "main"):
        words = set(re.split(r"[^a-z0-9]+", names))
        if words & TEMPLATE_WORDS or (words & HEADER_WORDS or role == "banner") and name != "article":
            return -1
    main = name in ("article", "main") or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody" or bool(set(re.sub(r"[^a-z ]", "", names).split()) & MAIN_WORDS)
    return int(main)


def _markup(page: str) -> Iterator[tuple[int, int, re.Match | None]]:
    """Begin, end and match of each tag, comment (no match) or declaration (no match) of a page, in linear time.

    A tag ends at the first ``>`` outside of its quoted values.  From the first tag on that never ends so, tags end at the first ``>``, and one
    without any takes the rest of the page; so at most one scan is in vain.
    """
    at, end, quoted = page.find("<"), len(page), True
    while at >= 0:
        follows, m = page[at + 1 : at + 2], None
        if follows in ("!", "?"):
            mark = "-->" if page.startswith("<!--", at) else ">"
            close = page.find(mark, at + 4 if mark == "-->" else at)
            stop = close + len(mark) if close >= 0 else end
        elif follows.isascii() and follows.isalpha() or follows == "/" and page[at + 2 : at + 3].isascii() and page[at + 2 : at + 3].isalpha():
            m = _TAG.match(page, at) if quoted else None
            if not m:
                quoted, m = False, page.find(">", at) >= 0 and _BARE_TAG.match(page, at) or None
            stop = m.end() if m else end
        else:
            at = page.find("<", at + 1)
            continue
        skip = yield at, stop, m
        at = page.find("<", max(stop, skip or 0))


def lines(page: str | None) -> list[Line]:
    """Text blocks of a page in order, without what its markup says isn't main text.

    A form inside of an article goes; a form around one, or around all of a page's text, is a wrapper.
    """
    out: list[Line] = []
    page = page or ""
    parts: list[str] = []
    open_tags: list[tuple[str, int, int, int, int]] = []  # name, elements that hide, elements that mark main text, path, in a form; counts and path up to here
    inside: dict[str, int] = {}  # open elements by name
    formed: list[bool] = []  # of the lines
    hide = main = at = path = form = 0

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Line(text, main > 0, path))
                formed.append(form > 0)
            parts.clear()

    def close(k: int) -> None:
        nonlocal hide, main, path, form
        flush()
        for x in open_tags[k:]:
            inside[x[0]] -= 1
        del open_tags[k:]
        hide, main, path, form = open_tags[-1][1:] if open_tags else (0, 0, 0, 0)

    def last(name: str) -> int:
        return next(k for k in range(len(open_tags) - 1, -1, -1) if open_tags[k][0] == name)

    tags, skip = _markup(page), None
    while True:
        try:
            start, stop, m = tags.send(skip)
        except StopIteration:
            break
        skip = None
        if start > at and not hide:
            parts.append(page[at:start])
        at = stop
        if not m:
            continue
        name = m[2].lower()
        if m[1]:
            if name in BLOCKS:
                flush()
            if inside.get(name):
                close(last(name))
            continue
        if name in RAW:
            finish = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.IGNORECASE).search(page, at)
            at = skip = len(page) if not finish else (page.find(">", finish.end()) + 1 or len(page))
            continue
        if name in BLOCKS:
            flush()
        elif name in SPACED and not hide:
            parts.append(" ")
        if name == "body" and inside.get("head"):
            close(last("head"))
        if name in PARAGRAPH_ENDS and open_tags and open_tags[-1][0] == "p":
            close(len(open_tags) - 1)
        while name in SIBLINGS and open_tags and open_tags[-1][0] in SIBLINGS[name]:
            close(len(open_tags) - 1)
        if name in VOID or m[3].endswith("/") and name not in BLOCKS:
            continue
        told = m[3] if m[3] and _TELLING.search(m[3]) else ""
        role = _role(name, told, main > 0) if told or name in MARKED else 0
        if role or name in BLOCKS or name in NEVER:
            flush()
            hide, main, path = hide + (role < 0), main + (role > 0), zlib.crc32(f"{path}>{name}{re.sub('[0-9]', '', told)}".encode())
            form = 0 if role > 0 else int(form or name == "form")
            open_tags.append((name, hide, main, path, form))
            inside[name] = inside.get(name, 0) + 1
    if not hide:
        parts.append(page[at:])
    flush()
    return [x for x, f in zip(out, formed) if not f] if not all(formed) else out


def line_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def common_subsequence(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``.

    Equal ends are taken first.  Matches are scanned by position in ``a`` and falling position in ``b``; the longest rising chain of positions
    in ``b`` is the answer.  Pages of many equal lines are halved first, so that no more than ``MATCHES`` matches are listed.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    if head or tail:
        inner = common_subsequence(a[head : len(a) - tail], b[head : len(b) - tail])
        return [*range(head), *(head + k for k in inner), *range(len(a) - tail, len(a))]
    places: dict[int, list[int]] = {}
    for k in range(len(b) - 1, -1, -1):
        places.setdefault(b[k], []).append(k)
    if sum(len(places.get(x, ())) for x in a) > MATCHES and len(a) > 1:
        half = len(a) // 2
        front, back = _lengths(a[:half], b), _lengths(a[half:][::-1], b[::-1])
        cut = int((front + back[::-1]).argmax())
        return common_subsequence(a[:half], b[:cut]) + [half + k for k in common_subsequence(a[half:], b[cut:])]
    ends: list[int] = []
    last: list[int] = []
    chain: list[tuple[int, int]] = []  # position in a, and the link before
    for i, x in enumerate(a):
        for j in places.get(x, ()):
            k = bisect.bisect_left(ends, j)
            chain.append((i, last[k - 1] if k else -1))
            if k == len(ends):
                ends.append(j)
                last.append(len(chain) - 1)
            else:
                ends[k] = j
                last[k] = len(chain) - 1
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(chain[k][0])
        k = chain[k][1]
    return out[::-1]


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of a longest common subsequence of ``a`` with each beginning of ``b``; the rows of the table are bits of one integer."""
    full = (1 << len(b)) - 1
    bits: dict[int, int] = {}
    for value, places in _grouped(b).items():
        row = np.zeros(len(b), np.uint8)
        row[places] = 1
        bits[value] = int.from_bytes(np.packbits(row, bitorder="little").tobytes(), "little")
    rest = full
    for x in a:
        match = rest & bits.get(x, 0)
        rest = ((rest + match) | (rest & ~match)) & full
    steps = np.unpackbits(np.frombuffer((full ^ rest).to_bytes(-(-len(b) // 8), "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(steps.astype(np.int64))])


def _grouped(b: list[int]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for k, x in enumerate(b):
        out.setdefault(x, []).append(k)
    return out


def shared_of_different(own: list[int], sizes: list[int], other: list[int], other_sizes: list[int]) -> list[int] | None:
    """Positions in ``own`` of the lines that two pages share; none if they are copies of each other.

    Lines are hashes, ``sizes`` their lengths.  A page whose lines are all in the other one shares nothing, as nothing tells its text from template.
    """
    if own == other:
        return None
    places = common_subsequence(own, other)
    if sum(sizes[k] for k in places) >= COPY * max(sum(sizes), sum(other_sizes)):
        return None
    return places if len(places) < min(len(own), len(other)) else []


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a URL; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))
    return host, F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _key() -> Column:
    return F.xxhash64("id", "url", "html")


def _ordered(pages: DataFrame, tasks: int) -> DataFrame:
    """``place, key, host, lines, open, sizes, paths`` of every page: its place in the global order of host, path and id, its line hashes, which are in no marked article, their lengths and places in the tree."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lines(x) for x in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([[line_hash(x.text) for x in f] for f in found], pa.list_(pa.int64())), pa.array([[not x.main for x in f] for f in found], pa.list_(pa.bool_())), pa.array([[len(x.text) for x in f] for f in found], pa.list_(pa.int32())), pa.array([[x.path - (1 << 31) for x in f] for f in found], pa.list_(pa.int32()))], ["key", "host", "path", "id", "lines", "open", "sizes", "paths"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), *batch.columns], ["part", "at", "key", "host", "lines", "open", "sizes", "paths"])
            at += n

    host, path = host_and_path(F.col("url"))
    kind = pages.schema["id"].dataType.simpleString()
    found = pages.select(_key().alias("key"), host.alias("host"), path.alias("path"), "id", "html").mapInArrow(hashed, f"key long, host string, path string, id {kind}, lines array<long>, open array<boolean>, sizes array<int>, paths array<int>")
    found = stash(found, "lines")
    order = found.repartitionByRange(tasks, "host", "path", "id", "key").sortWithinPartitions("host", "path", "id", "key").select("key", "host", "lines", "open", "sizes", "paths")
    order = stash(order.mapInArrow(numbered, "part int, at long, key long, host string, lines array<long>, open array<boolean>, sizes array<int>, paths array<int>"), "order")
    base, total = {}, 0
    for part, n in sorted(order.groupBy("part").agg(F.count("*").alias("n")).collect()):  # two numbers a partition
        base[part], total = total, total + n
    shipped = order.sparkSession.sparkContext.broadcast(base)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = np.array([shipped.value[p] for p in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(starts + batch.column(1).to_numpy()), *batch.columns[2:]], ["place", "key", "host", "lines", "open", "sizes", "paths"])

    return order.mapInArrow(placed, "place long, key long, host string, lines array<long>, open array<boolean>, sizes array<int>, paths array<int>")


def _with_runs(order: DataFrame) -> DataFrame:
    """Adds ``run``: neighbours of one host that are copies of each other have one number, which rises with the place."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, sizes, other, other_sizes = (batch.column(k).to_pylist() for k in range(1, 5))
            copy = [shared_of_different(*x) is None for x in zip(own, sizes, other, other_sizes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(copy, pa.bool_())], ["place", "copy"])

    before = order.select((F.col("place") + 1).alias("place"), F.col("host").alias("other_host"), F.col("lines").alias("other"), F.col("sizes").alias("other_sizes"))
    pairs = order.join(before, "place").where(F.col("host") == F.col("other_host")).select("place", "lines", "sizes", "other", "other_sizes")
    copies = pairs.mapInArrow(compared, "place long, copy boolean").where("copy")
    fresh = order.join(copies, "place", "left").withColumn("fresh", F.col("copy").isNull().cast("long")).withColumn("block", F.expr("place div 4096")).drop("copy")
    fresh = stash(fresh, "fresh")
    starts, total = [], 0
    for block, n in sorted(fresh.groupBy("block").agg(F.sum("fresh").alias("n")).collect()):  # two numbers for 4,096 pages
        starts.append((block, total))
        total += n
    base = order.sparkSession.createDataFrame(starts, "block long, base long")
    run = F.col("base") + F.sum("fresh").over(Window.partitionBy("block").orderBy("place"))
    return stash(fresh.join(F.broadcast(base), "block").withColumn("run", run).drop("fresh", "block", "base"), "runs")


def shared_lines(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``key, shared``: for each page with template lines, their positions among its lines."""
    spark = pages.sparkSession
    tasks = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    order = _with_runs(stash(_ordered(source, tasks), "places"))
    ends = order.groupBy("run").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    sides = []
    for place in (F.col("first") - 1, F.col("last") + 1):
        beside = order.select(F.col("place").alias("beside"), F.col("host").alias("other_host"), F.col("lines").alias("other"), F.col("sizes").alias("other_sizes"))
        sides.append(ends.withColumn("beside", place).join(beside, "beside"))
    near = sides[0].unionByName(sides[1])
    near = near.select("run", F.explode(F.sequence(F.expr(f"first div {BLOCK}"), F.expr(f"last div {BLOCK}"))).alias("block"), "other_host", "other", "other_sizes")
    pairs = order.where(F.size("lines") > 0).withColumn("block", F.expr(f"place div {BLOCK}")).join(near, ["run", "block"]).where(F.col("host") == F.col("other_host")).select("key", "host", "lines", "open", "sizes", "paths", "other", "other_sizes")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = []
            for own, sizes, other, other_sizes in zip(*(batch.column(k).to_pylist() for k in (2, 4, 6, 7))):
                row = np.zeros(len(own), bool)
                row[shared_of_different(own, sizes, other, other_sizes) or []] = True
                shared.append(row)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), batch.column(5), pa.array(shared, pa.list_(pa.bool_()))], ["key", "host", "open", "paths", "shared"])

    found = pairs.mapInArrow(aligned, "key long, host string, open array<boolean>, paths array<int>, shared array<boolean>")
    either = F.reduce(F.collect_list("shared"), F.array_repeat(F.lit(False), F.size(F.first("paths"))), lambda a, b: F.zip_with(a, b, lambda x, y: x | y))
    found = stash(found.groupBy("key", "host").agg(F.first("open").alias("open"), F.first("paths").alias("paths"), either.alias("shared")), "shared")
    seen = found.select("key", "host", F.posexplode(F.arrays_zip("open", "paths", "shared")).alias("k", "x")).select("key", "host", "k", "x.open", "x.shared", F.col("x.paths").alias("path"))
    rates = seen.where("not open").groupBy("host", "path").agg(F.avg(F.col("shared").cast("int")).alias("rate"), F.approx_count_distinct("key").alias("pages")).where((F.col("rate") >= RATE) & (F.col("pages") >= PAGES)).select("host", "path")
    spot = seen.where("shared")
    gone = spot.where("open").select("key", "k").union(spot.where("not open").join(rates, ["host", "path"], "left_semi").select("key", "k"))
    return stash(gone.groupBy("key").agg(F.collect_set("k").alias("shared")), "template")


def text_of(found: list[Line], shared: list[int] | None) -> str:
    """A page's main text: the blocks of its marked article, or all without one, less those that near pages show to be template."""
    gone, marked = set(shared or ()), any(x.main for x in found)
    proposed = [(k, x.text) for k, x in enumerate(found) if x.main or not marked]
    return "\n".join([x for k, x in proposed if k not in gone] or [x for _, x in proposed])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: id, URL, main text and its length in code points."""
    template = shared_lines(pages, id_col, url_col, html_col)
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("key", _key())
    rows = source.join(template, "key", "left").select("id", "url", "html", "shared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_of(lines(page), shared) for page, shared in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    return rows.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
