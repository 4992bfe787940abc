"""Main text of web pages: markup rules, and differencing against the pages with the nearest URLs.

Pages are sorted by host and URL path (query and fragment dropped); each is paired with its neighbours of the same host.
The text lines of a pair are aligned by their longest common subsequence; lines both pages share outside an article are
the site's frame and are deleted.  Copies of a page share everything, so a pair whose main lines are all shared tells
nothing and is skipped.

Every page is compared, also one that declares its article by ``<article>`` or ``<main>``; there an exact check by the
markup follows.  Lines beside the declared article go.  In it, shared bare paragraphs and headings are restored, as they
are quotations or copies, which are main text; parts whose class, id or role only hints at a frame (``subscribe-now``,
``related-work``) go when a neighbour shares all of their lines and stay when it doesn't.  A neighbour that shares half of
the article's lines is a near copy and tells nothing about its parts.

Pages meet as lists of line hashes.  After a range sort their places in the whole order are counted, and blocks of
``BLOCK_PAGES`` places, with the page before and the page after, are compared on their own: a host with very many pages is
a run of places, not a group, and the result does not depend on partitions.  What is to be deleted goes back to the pages.

Defined results: null or empty html gives an empty text; a page without a neighbour keeps what markup rules leave; null
urls form a host of their own; repeated rows are extracted each for itself, and lose what any of them shares with a
neighbour; text of ``svg``, ``math`` and ``object`` stays, that of form controls goes; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from html import unescape
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.llm.rows import row_hash
from logweave.plans.session import scratch, ship_package, small, written

#: Elements whose content is no text, elements of a page's frame, and elements that start a block.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "select", "button", "head")
FRAME = ("nav", "header", "footer", "aside", "form", "dialog", "menu", "datalist", "option")
BLOCKS = ("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul").split()
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
#: Words of class, id and role that mark a frame part.
FRAME_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup",
    "promo", "promoted", "related", "reply", "replies", "respond", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget", "complementary", "contentinfo", "search", "alert", "responses",
}

#: Words that name the box of a frame part, together with one of those above.
BOX_WORDS = {"area", "bar", "block", "box", "button", "buttons", "container", "form", "item", "items", "links", "list", "posts", "section", "slot", "unit", "wrap", "wrapper"}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))|=)*+)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_BLOCK_SET, _VOID_SET, _RAW_SET, _FRAME_SET = set(BLOCKS), set(VOID), set(RAW), set(FRAME)
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_P_ENDS = _BLOCK_SET - {"br", "body", "html", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}

#: Pages that are compared in one run, beside one before and one after.
BLOCK_PAGES = 1_000


def _is_frame(attributes: str, inside: bool = False) -> bool:
    """Whether class, id and role mark a frame part: by any word of them or, ``inside`` a declared article, by a class or role all of
    whose words name such a part or its box (``related-posts`` but not ``related-work``); ids do not count there."""
    if _HIDDEN.search(attributes):
        return True
    for m in _NAMES.finditer(attributes):
        if inside and m[0].strip("\"' \t\n\r\f").lower().startswith("id"):
            continue
        for name in m[1].strip("\"'").split():
            words = {w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w}
            if not words.isdisjoint(FRAME_WORDS) and (not inside or words <= FRAME_WORDS | BOX_WORDS):
                return True
    return False


def blocks(html: str | None) -> list[tuple[str, bool]]:
    """Text blocks in page order, with whether each lies in a declared article; frame parts and markup are left out."""
    return blocks_and_parts(html)[0]


def blocks_and_parts(html: str | None) -> tuple[list[tuple[str, bool]], list[tuple[int, int]]]:
    """The blocks, and the parts (from, to) of a declared article that are doubtful: some word of class, id or role names a frame
    part, but not the whole name.  Headings and parts with a title (``h1``) are none."""
    if not html:
        return [], []
    out: list[tuple[str, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool, int]] = []  # element, is frame, is article, first block of a doubtful part or -1
    doubtful: list[tuple[int, int]] = []
    titles: list[int] = []
    frame = article = 0

    def close_block():
        text = " ".join(unescape("".join(parts)).split())
        if text:
            out.append((text, article > 0))
        parts.clear()

    def pop(to: int):
        nonlocal frame, article
        for _, f, a, first in stack[to:]:
            frame -= f
            article -= a
            if 0 <= first < len(out):
                doubtful.append((first, len(out)))
        del stack[to:]

    at = 0
    while True:
        m = _TAG.search(html, at)
        if not frame:
            parts.append(html[at : m.start() if m else len(html)])
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name, attributes = m[2].lower(), m[3]
        if m[1]:
            if name in _BLOCK_SET:
                close_block()
            where = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if where is not None:
                pop(where)
            continue
        if name in _RAW_SET:
            if name == "head":
                continue
            end = _RAW_END[name].search(html, at)
            at = end.end() if end else len(html)
            continue
        if name == "br":
            if not frame:
                parts.append(" ")
            continue
        if (name in _BLOCK_SET or name == "option") and stack and stack[-1][0] == "option":  # whose end tag may be left out
            pop(len(stack) - 1)
        if name in _BLOCK_SET:
            close_block()
            if name in _P_ENDS and (where := next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p"), None)) is not None:
                pop(where)
            if name == "li" and (where := next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in ("li", "ul", "ol")), None)) is not None and stack[where][0] == "li":
                pop(where)
        if name in _VOID_SET or attributes.rstrip().endswith("/"):
            continue
        is_article = name in ("article", "main") and not frame
        # A header inside an article carries its title; elsewhere it is the page's.
        is_frame = (name in _FRAME_SET and not (name == "header" and article)) or (name not in ("html", "body", "article", "main") and _is_frame(attributes, article > 0))
        if name == "article" and article and _is_frame(attributes):
            is_frame, is_article = True, False
        if name == "h1":
            titles.append(len(out))
        hinted = article and not frame and not is_frame and name in _BLOCK_SET and name not in _HEADINGS and attributes and _is_frame(attributes)
        stack.append((name, is_frame, is_article, len(out) if hinted else -1))
        frame += is_frame
        article += is_article
    close_block()
    pop(0)
    return out, sorted({(a, b) for a, b in doubtful if bisect_left(titles, a) == bisect_left(titles, b)})


def _prefix_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and every prefix of ``b``, a row of bits at a time (Hyyrö, 2004)."""
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    full = row = (1 << len(b)) - 1
    for x in a:
        mask = 0
        for j in places.get(x, ()):
            mask |= 1 << j
        if mask:
            same = row & mask
            row = ((row + same) | (row - same)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """Indexes of ``a`` on a longest common subsequence of two line lists, in linear memory (Hirschberg, 1975)."""
    also = set(b)
    at = [i for i, x in enumerate(a) if x in also]
    also = {a[i] for i in at}
    shared: set[int] = set()
    todo = [(at, [x for x in b if x in also])]
    while todo:
        own, other = todo.pop()
        head = 0
        while head < min(len(own), len(other)) and a[own[head]] == other[head]:
            head += 1
        tail = 0
        while tail < min(len(own), len(other)) - head and a[own[-1 - tail]] == other[-1 - tail]:
            tail += 1
        shared.update(own[:head])
        shared.update(own[len(own) - tail :])
        own, other = own[head : len(own) - tail], other[head : len(other) - tail]
        if len(own) == 1:
            shared.update(i for i in own if a[i] in other)
        elif own and other:
            middle = len(own) // 2
            first = _prefix_lengths([a[i] for i in own[:middle]], other)
            second = _prefix_lengths([a[i] for i in reversed(own[middle:])], other[::-1])
            cut = int((first + second[::-1]).argmax())
            todo += [(own[:middle], other[:cut]), (own[middle:], other[cut:])]
    return shared


def line_hashes(own: list[tuple[str, bool]]) -> list[int]:
    """Signed 64-bit hashes of the lines."""
    return np.array([xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) for text, _ in own], dtype=np.uint64).view(np.int64).tolist()


def frame_lines(lines: list[int], neighbours: list[list[int]], inside: list[bool] = (), parts: list[tuple[int, int]] = ()) -> list[int]:
    """Indexes of the lines that a neighbour shares, but for neighbours that share all.  Of the lines ``inside`` a declared article,
    those of doubtful ``parts`` that a neighbour shares whole, but for neighbours that share half of the article."""
    gone: set[int] = set()
    article = {i for i, x in enumerate(inside) if x}
    for other in neighbours:
        shared = common_lines(lines, other)
        if len(shared) == len(lines):
            continue
        gone |= shared - article
        if parts and 2 * len(shared & article) < len(article):
            own = [0, *accumulate(i not in shared for i in range(len(lines)))]
            end = 0
            for a, b in sorted(parts, key=lambda x: (x[0], -x[1])):
                if b > end and own[a] == own[b]:
                    gone.update(range(a, b))
                    end = b
    return sorted(gone)


def main_text(own: list[tuple[str, bool]], gone: list[int]) -> str:
    """The blocks that aren't gone, of the declared article only if there is one, with an empty line between them."""
    dropped = set(gone)
    declared = any(inside for _, inside in own)
    return "\n\n".join(text for i, (text, inside) in enumerate(own) if i not in dropped and (inside or not declared))


#: Columns of a compared page beside its id: row hash, line hashes, whether each line lies in a declared article, doubtful parts.
_LINES = "r long, lines array<long>, inside array<boolean>, parts array<int>"


def _lined(pages: DataFrame) -> DataFrame:
    """``host, path, id, r, lines, inside, parts`` of each page; parts are pairs of line numbers in one list."""
    kind = dict(pages.dtypes)["id"]

    def rows(batches):
        for batch in batches:
            found = [blocks_and_parts(x.as_py()) for x in batch.column(4)]
            lines = pa.array([line_hashes(own) for own, _ in found], pa.list_(pa.int64()))
            inside = pa.array([[x for _, x in own] for own, _ in found], pa.list_(pa.bool_()))
            parts = pa.array([[i for part in parts for i in part] for _, parts in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], lines, inside, parts], ["host", "path", "id", "r", "lines", "inside", "parts"])

    return pages.select("host", "path", "id", "r", "html").mapInArrow(rows, f"host string, path string, id {kind}, {_LINES}")


def _placed(lined: DataFrame, folder: str) -> DataFrame:
    """The pages with their ``place`` in the order of host, path and id."""
    kind = dict(lined.dtypes)["id"]
    names = ["part", "row", "host", "id", "r", "lines", "inside", "parts"]

    def rows(batches):
        n, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            here = [batch.column(i) for i in (0, 2, 3, 4, 5, 6)]
            yield pa.RecordBatch.from_arrays([pa.array([part] * batch.num_rows, pa.int32()), pa.array(np.arange(n, n + batch.num_rows)), *here], names)
            n += batch.num_rows

    order = ("host", "path", "id", "r")
    ordered = lined.repartitionByRange(*order).sortWithinPartitions(*order)
    # The number of a partition is its place in the order, as nothing stands between the sort and the write.
    numbered = written(ordered.mapInArrow(rows, f"part int, row long, host string, id {kind}, {_LINES}"), "numbered", folder)
    counts = numbered.groupBy("part").agg(F.count("*").alias("n"))
    starts = counts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return numbered.join(F.broadcast(starts), "part").select((F.col("start") + F.col("row")).alias("place"), *names[2:])


def _frames(placed: DataFrame) -> DataFrame:
    """``id, r, gone``: places of the lines of a page that go, as it shares them with a neighbour of its host."""
    kind = dict(placed.dtypes)["id"]
    own = F.expr(f"place div {BLOCK_PAGES}")
    beside = F.array_distinct(F.transform(F.array(F.col("place") - 1, F.col("place"), F.col("place") + 1), lambda x: F.call_function("div", x + BLOCK_PAGES, F.lit(BLOCK_PAGES)) - 1))
    names = ["block", "home", "host", "id", "r", "lines", "inside", "parts"]
    dealt = placed.select(F.explode(beside).alias("block"), "place", (own).alias("home"), *names[2:])

    def rows(batches):
        before = page = None  # pages are (block, home, host, id, r, lines, inside, parts)

        def decided(before, page, after):
            near = [x[5] for x in (before, after) if x is not None and x[0] == page[0] and x[2] == page[2]]
            gone = frame_lines(page[5], near, page[6], list(zip(page[7][::2], page[7][1::2], strict=True))) if page[0] == page[1] and near else []
            return [(page[3], page[4], gone)] if gone else []

        def batch_of(done):
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], key_type), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.list_(pa.int32()))], ["id", "r", "gone"])

        key_type = None
        for batch in batches:
            key_type = batch.column(3).type
            done = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(len(names))), strict=True):
                if page is not None:
                    done += decided(before, page, row)
                before, page = page, row
            yield batch_of(done)
        if page is not None:
            yield batch_of(decided(before, page, None))

    sorted_ = dealt.repartition("block").sortWithinPartitions("block", "place").select(*names)
    found = sorted_.mapInArrow(rows, f"id {kind}, r long, gone array<int>")
    return found.groupBy("id", "r").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("gone")))).alias("gone"))


def _texts(html, gone):
    """Main texts for an Arrow function."""
    return pa.array([main_text(blocks(body.as_py()), lines.as_py() or []) for body, lines in zip(html, gone, strict=True)], pa.string())


def extract_main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: ``key``, ``url`` and its main ``text``."""
    spark = pages.sparkSession
    ship_package(spark)
    row = row_hash(key, url, html)
    bare = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://|[?#].*$", "")
    host = F.regexp_replace(F.lower(F.substring_index(bare, "/", 1)), r"^(www\.|m\.)", "")
    path = F.regexp_replace(F.substr(bare, F.length(F.substring_index(bare, "/", 1)) + 1), r"(\.html?|/)$", "")
    source = pages.select(host.alias("host"), path.alias("path"), F.col(key).alias("id"), row.alias("r"), F.col(html).alias("html"))
    with scratch(spark) as folder:
        lined = written(_lined(source), "lined", folder)  # or the sort's sample would parse them all once more
        gone = written(_frames(_placed(lined, folder)), "frames")
    gone = small(gone.select(F.struct("id", "r").alias("at"), "gone"))
    each = pages.select(F.struct(F.col(key).alias("id"), row.alias("r")).alias("own"), F.col(url).alias("u"), F.col(html).alias("html"))
    texts = F.arrow_udf(_texts, "string")
    joined = each.join(gone, F.col("own").eqNullSafe(F.col("at")), "left")
    return joined.select(F.col("own.id").alias(key), F.col("u").alias(url), texts("html", "gone").alias("text"))
