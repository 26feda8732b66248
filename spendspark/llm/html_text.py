"""Operator 7: main text of web pages by nearest-URL page differencing.

A page is cut into lines, one for each block of text. Pages of a host are sorted by URL path, each page is paired with the
neighbour whose path agrees longest, their lines are aligned by longest common subsequence, and lines that both share are
deleted. All lines are aligned, those of containers that are never main text (menus, footers, adverts, ...; told by element,
role and class) as well: most of them are shared, and the list judges what no neighbour shows, such as a comment or an advert
of one page. To stand inside an article or main element is evidence for a line: it takes WITNESSES neighbours that all share
it, at the ends of all their articles, and of the list's words only the plainest count there. A neighbour that shares nearly all text, or most text of the article, is a copy and says nothing about
the template; the next different one is taken, whatever the distance. Where a host has none, the nearest two decide if all
three have text of their own beside the same shared lines.

Pages of a host with the same lines are one class, judged once. Classes are dealt by ranges of host and path, so a hot host
is split; only line hashes are dealt, not text. Deletions of lines that the list drops anyhow are not joined back. Copies that follow one another are one run, and the runs at a range's ends are
carried to the next ranges. The deletions, few and small, are joined back by a key of the row.

Cases: a null or empty html gives ''; long pages are read whole; a null url has an empty host and path; repeated rows are
differenced once and all get the same text; a page alone on its host keeps its article, or all lines; unclosed elements end with their
parent or the page; extra columns pass through, those named like an output are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from heapq import merge

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendspark.llm.common import ROWS_AT_ONCE, arrow_columns, quoted, small_enough, table, without, written
from spendspark.llm.url_filter import host_of, path_of

#: A neighbour that shares more than this part of a page's text, or of the text in its article, is a copy of it.
COPY_SHARE, ARTICLE_SHARE = 0.9, 0.5
#: Neighbours that have to share a line inside an article before it goes.
WITNESSES = 5
#: Classes of pages for a range; runs at each end of a range that are carried to the next.
PAGES_EACH, EDGE = 4000, 3
#: Rows of an alignment are kept for the way back up to so many bits; longer pages are aligned in halves.
ALIGN_BITS = 1 << 28
#: Elements whose text is never shown or never main text.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "math", "object", "canvas")
DROPPED = {"nav", "footer", "aside", "form", "head", "menu", "dialog", "button", "select", "datalist", "search", "audio", "video", "map"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form", "status"}
#: Words of a class or id that mark what is not main text.
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer",
    "gdpr", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "pager", "popup", "promo", "promoted", "promotion", "related",
    "replies", "respond", "share", "sharing", "sidebar", "sidebars", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget", "widgets",
}
#: Of these the ones that mark as much inside an article; the others may name what the article tells of.
PLAIN_MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "adsense", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "gdpr", "navbar",
    "newsletter", "promoted", "replies", "respond", "sidebar", "sidebars", "signup", "sponsored", "subscribe",
}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "q", "rb", "rp", "rt", "ruby",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_TOKEN = re.compile(
    rf"<!--(?:>|->|.*?(?:-->|\Z))|<({'|'.join(RAW)})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*+>|\Z)|<(/?)([a-zA-Z][\w:-]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*+>|<(/?)([a-zA-Z][\w:-]*+)([^>]*+)>",
    re.I | re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WORD = re.compile(r"[a-z0-9]+")


def _marked(name: str, attributes: str, inside: bool = False) -> bool:
    """Whether an element is left out by its role, class or id, of which fewer words count inside an article."""
    if name in ("body", "html", "main", "article") and "comment" not in attributes:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        kind, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if kind == "hidden" or kind == "role" and value in ROLES or kind in ("class", "id") and not (PLAIN_MARKS if inside else MARKS).isdisjoint(_WORD.findall(value)):
            return True
    return False


#: Where a line stands: outside of all, inside an article or main element, in a container that is never main text.
PLAIN, INSIDE, MARKED = 0, 1, 2


def lines_of(html: str | None) -> list[tuple[str, int]]:
    """The lines of a page in order, and where each stands."""
    if not html:
        return []
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    inside = 0  # open article and main elements
    left_out, depth = "", 0  # the container that is never main text, and how many of its name are open

    def end_line() -> None:
        if parts:
            line = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if line:
                out.append((line, MARKED if left_out else INSIDE if inside else PLAIN))

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            parts.append(html[at : m.start()])
        at = m.end()
        name, closing, attributes = (m[3] or m[6] or "").lower(), m[2] or m[5], m[4] or m[7] or ""
        if not name:
            if m[1]:
                parts.append(" ")
            continue
        if left_out:
            if name not in INLINE or name == left_out:
                end_line()
            if name in ("article", "main") and not closing and name != left_out and not _marked(name, attributes):
                left_out = ""  # an article never stands in what is left out: that was not closed
            elif name == left_out:
                depth += -1 if closing else 0 if attributes.endswith("/") else 1
                if not depth:
                    left_out = ""
                continue
            elif name in ("body", "html") and closing:
                left_out = ""
                continue
            else:
                continue
        if name not in INLINE:
            end_line()
        if closing:
            if name in ("article", "main"):
                inside = max(0, inside - 1)
        elif name not in VOID and not attributes.endswith("/"):
            if name in DROPPED or name == "header" and not inside or attributes and _marked(name, attributes, inside > 0):
                if name in INLINE:
                    end_line()
                left_out, depth = name, 1
            elif name in ("article", "main"):
                inside += 1
    if at < len(html):
        parts.append(html[at:])
    end_line()
    return out


def main_text(html: str | None, deleted: list[int] | None) -> str:
    """The lines without the deleted ones and those that the list drops, joined by blanks. Where nothing was compared (None), the
    page's own evidence decides: lines outside its article go, unless they hold more text than it."""
    lines = lines_of(html)
    gone = set(deleted or ())
    if deleted is None and 2 * sum(len(line) for line, kind in lines if kind == INSIDE) >= sum(len(line) for line, kind in lines if kind != MARKED):
        gone = {i for i, (_, kind) in enumerate(lines) if kind == PLAIN}
    return " ".join(line for i, (line, kind) in enumerate(lines) if kind != MARKED and i not in gone)


def _rows(a: list[int], b: list[int]) -> list[int]:
    """Bit-parallel rows of the alignment: bit j of row i is 0 where the common subsequence of a[:i+1] grows at b[j]."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    mask = (1 << len(b)) - 1
    row, out = mask, []
    for x in a:
        hit = row & where.get(x, 0)
        row = (row + hit | row - hit) & mask
        out.append(row)
    return out


def _growth(row: int, n: int) -> np.ndarray:
    """Length of the common subsequence with each prefix of the other side, from a row."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes(n // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_subsequence(a: list[int], b: list[int]) -> list[int]:
    """Indexes in ``a`` of one longest common subsequence with ``b``."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    end = 0
    while end < min(len(a), len(b)) - low and a[-1 - end] == b[-1 - end]:
        end += 1
    head, tail = list(range(low)), list(range(len(a) - end, len(a)))
    x, y = a[low : len(a) - end], b[low : len(b) - end]
    if not x or not y:
        return head + tail
    if len(x) * len(y) > ALIGN_BITS and len(x) > 1:
        half = len(x) // 2
        front, back = _growth(_rows(x[:half], y)[-1], len(y)), _growth(_rows(x[half:][::-1], y[::-1])[-1], len(y))
        cut = int(np.argmax(front + back[::-1]))
        middle = common_subsequence(x[:half], y[:cut]) + [half + i for i in common_subsequence(x[half:], y[cut:])]
    else:
        rows, middle, i, j = _rows(x, y), [], len(x), len(y)
        while i and j:
            if rows[i - 1] >> j - 1 & 1:
                j -= 1
                continue
            i -= 1
            if not (i and not rows[i - 1] >> j - 1 & 1):
                middle.append(i)
                j -= 1
        middle.reverse()
    return head + [low + i for i in middle] + tail


def _common(row: dict, other: dict) -> list[int]:
    """Indexes of the lines of a page that align with those of another; lines of marked containers only with such."""
    out = []
    for marked in (False, True):
        mine, its = ([i for i, k in enumerate(r["kinds"]) if (k == MARKED) == marked] for r in (row, other))
        out += [mine[k] for k in common_subsequence([row["lines"][i] for i in mine], [other["lines"][i] for i in its])]
    return sorted(out)


def _shared(row: dict, other: dict) -> tuple[list[int], bool]:
    """Lines of a page that it shares with another, and whether that is a copy of it (by what may be main text)."""
    found, sizes, kinds = _common(row, other), row["sizes"], row["kinds"]
    if own := sum(n for n, k in zip(sizes, kinds) if k == INSIDE):
        return found, sum(sizes[i] for i in found if kinds[i] == INSIDE) > ARTICLE_SHARE * own
    return found, sum(sizes[i] for i in found if kinds[i] == PLAIN) > COPY_SHARE * sum(n for n, k in zip(sizes, kinds) if k == PLAIN)


def _agreeing(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _at_ends(row: dict, shared: set[int]) -> set[int]:
    """Of shared lines (hashes) in an article those that stand before its own text, a title apart, or after it."""
    inside = [x for x, k in zip(row["lines"], row["kinds"]) if k == INSIDE]
    own = [i for i, x in enumerate(inside) if x not in shared]
    if not own:
        return set()
    middle = {x for i, x in enumerate(inside) if own[min(1, len(own) - 1)] < i < own[-1]}
    return shared & set(inside) - middle


def _decided(row: dict, differing: Iterator[tuple[dict, list[int]]]) -> list[int] | None:
    """Lines to delete, from neighbours that are no copies, nearest first, and what is shared with each; None without any.

    One neighbour decides on a line outside an article. One inside is deleted if WITNESSES neighbours, no copies of each other,
    all share it, or all there are and two at least, and if it stands at the ends of all of the articles: a sentence that some
    articles have in common, or that all have amid their text, is no template.
    """
    first, found = next(differing, (None, []))
    if first is None:
        return None
    doubtful, seen = {i for i in found if row["kinds"][i] == INSIDE}, [first]
    found = [i for i in found if i not in doubtful]
    while doubtful and len(seen) < WITNESSES:
        other, shared = next(((r, shared) for r, shared in differing if not any(_shared(w, r)[1] for w in seen)), (None, []))
        if other is None:
            break
        doubtful &= set(shared)
        seen.append(other)
    if doubtful and len(seen) > 1:
        ends = {row["lines"][i] for i in doubtful}
        for r in (row, *seen):
            ends &= _at_ends(r, {row["lines"][i] for i in doubtful})
        found = sorted([*found, *(i for i in doubtful if row["lines"][i] in ends)])
    return found


def _runs(rows: list[dict]) -> list[int]:
    """First row of each run of rows that are copies of the one before, both ways, and the number of rows."""
    starts = [i for i, row in enumerate(rows) if not i or row["host"] != rows[i - 1]["host"] or not (_shared(row, rows[i - 1])[1] and _shared(rows[i - 1], row)[1])]
    return [*starts, len(rows)]


def _judged(rows: list[dict], starts: list[int], run: int, i: int) -> list[int] | None:
    """Lines of row ``i``, which is in ``run``, to delete; None if it has no differing neighbour."""
    row = rows[i]

    def beside(step: int) -> Iterator[tuple[int, dict, list[int]]]:
        at = run + step
        while 0 <= at < len(starts) - 1:
            r = rows[starts[at] if step > 0 else starts[at + 1] - 1]
            if r["host"] != row["host"]:
                return
            found, copy = _shared(row, r)
            if not copy:
                yield -_agreeing(r["path"], row["path"]), r, found
            at += step

    differing = ((r, found) for _, r, found in merge(beside(-1), beside(1), key=lambda x: x[0]))
    found = _decided(row, differing)
    return _alike(rows, i) if found is None else found


def _alike(rows: list[dict], i: int) -> list[int] | None:
    """Where all pages of a host seem copies: what the nearest two share is the template if each of the three has text of its own."""
    row = rows[i]
    near = [rows[j] for j in (i - 1, i + 1, i - 2, i + 2) if 0 <= j < len(rows) and rows[j]["host"] == row["host"]][:2]
    if len(near) < 2 or INSIDE in row["kinds"]:
        return None

    def common(a: dict, b: dict) -> list[int]:
        return [i for i in _common(a, b) if a["kinds"][i] != MARKED]

    found = _common(row, near[0])
    core = [row["lines"][i] for i in common(row, near[0])]
    for a, b in ((row, near[0]), (near[0], row), (near[1], row), (near[1], near[0])):
        shared = set(common(a, b))
        own = [n for i, n in enumerate(a["sizes"]) if i not in shared and a["kinds"][i] != MARKED]
        # A counter or a date is no text of its own: that is no shorter than the shared lines on an average.
        if [a["lines"][i] for i in sorted(shared)] != core or not own or sum(own) * len(core) < sum(a["sizes"][i] for i in shared) * len(own):
            return None
    return found


_LAID = "key string, host string, path string, lines array<bigint>, sizes array<int>, kinds array<tinyint>, part int, run int, role string"


def _laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's rows, and once more those at its edges: the first row of its first runs, the last row of its last runs."""
    from pyspark import TaskContext

    rows = [r for b in batches for r in b.to_pylist()]
    starts, part = _runs(rows), TaskContext.get().partitionId()
    run = [k for k, (a, b) in enumerate(zip(starts, starts[1:])) for _ in range(a, b)]
    at = [(i, "page") for i in range(len(rows))]
    if rows:
        at += [(a, "head") for a in starts[:-1][:EDGE]] + [(b - 1, "tail") for b in starts[1:][-EDGE:]]
    schema = pa.schema([("key", pa.string()), ("host", pa.string()), ("path", pa.string()), ("lines", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("kinds", pa.list_(pa.int8())), ("part", pa.int32()), ("run", pa.int32()), ("role", pa.string())])
    for k in range(0, len(at), ROWS_AT_ONCE):
        yield pa.RecordBatch.from_pylist([rows[i] | {"part": part, "run": run[i], "role": role} for i, role in at[k : k + ROWS_AT_ONCE]], schema=schema)


def _carried(ranges: list) -> list[tuple[int, str, int]]:
    """(range, role, range to carry to): the edge rows that a range needs, from next ranges on to one with another run.

    Of ranges that are one run each, those between the nearest and the furthest say nothing more and are left out.
    """
    out = []
    for step, role in ((-1, "tail"), (1, "head")):
        order = ranges if step > 0 else ranges[::-1]
        end = [0] * len(order)  # where a chain of ranges of one run, all on one host, ends
        for k in range(len(order) - 1, -1, -1):
            goes_on = k + 1 < len(order) and order[k]["runs"] == 1 and order[k + 1]["first_host"] == order[k]["last_host"] == order[k + 1]["last_host"] and order[k + 1]["runs"] == 1
            end[k] = end[k + 1] if goes_on else k
        for k, r in enumerate(order[:-1]):
            host = r["last_host"] if step > 0 else r["first_host"]
            wanted = {k + 1, end[k + 1]} | ({end[k + 1] + 1} if order[k + 1]["runs"] == 1 and end[k + 1] + 1 < len(order) else set())
            out += [(order[j]["part"], role, r["part"]) for j in sorted(wanted) if host in (order[j]["first_host"], order[j]["last_host"])]
    return out


def deletions(pages: DataFrame, every: bool = False) -> DataFrame:
    """key and indexes of the lines to delete, from a table of pages: key, host, path, and hashes, sizes and kinds of lines.

    Pages with no line to delete are left out, but for those with lines in and outside an article that had a neighbour. Lines
    that the list drops anyhow are left out too, unless ``every`` is asked for.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judge(rows: list[dict]) -> pa.RecordBatch:
            keys, gone, starts = [], [], _runs(rows)
            for run, (a, b) in enumerate(zip(starts, starts[1:])):
                for i in range(a, b):
                    if rows[i]["role"] == "page":
                        found, kinds = _judged(rows, starts, run, i), rows[i]["kinds"]
                        open_ = [k for k in found or () if kinds[k] != MARKED]
                        if every and found or open_ or found is not None and len({*kinds} - {MARKED}) > 1:
                            keys.append(rows[i]["key"])
                            gone.append(found if every else open_)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(gone, pa.list_(pa.int32()))], names=["key", "deleted"])

        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["part"] != row["part"]:
                    yield judge(held)
                    held = []
                held.append(row)
        yield judge(held)

    parts = -(-pages.count() // PAGES_EACH) or 1
    order = ["host", "path", "key"]
    laid = written(pages.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("key", "host", "path", "lines", "sizes", "kinds").mapInArrow(_laid, _LAID), "page-ranges")
    own = laid.where("role = 'page'")
    ranges = own.groupBy("part").agg(F.min("host").alias("first_host"), F.max("host").alias("last_host"), (F.max("run") + 1).alias("runs")).orderBy("part").collect()
    if moves := _carried(ranges):
        to = pages.sparkSession.createDataFrame(moves, "part int, role string, to int")
        edges = laid.where("role <> 'page'").join(small_enough(to, len(moves), 64), ["part", "role"]).drop("part").withColumnRenamed("to", "part")
        own = own.unionByName(edges)
    return own.repartition(max(1, len(ranges)), "part").sortWithinPartitions("part", *order).mapInArrow(work, "key string, deleted array<int>")


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Adds ``text`` and ``n_chars``; the html column goes, other columns pass through."""

    def hashed(pages_: list) -> list:
        found = [lines_of(h) for h in pages_]
        return [[[hash_of(line) for line, _ in lines] for lines in found], [[len(line) for line, _ in lines] for lines in found], [[kind for _, kind in lines] for lines in found]]

    key = F.md5(F.concat(F.coalesce(F.col(quoted(url)), F.lit("")), F.lit("\x00"), F.coalesce(F.col(quoted(html)), F.lit(""))))
    small = pages.select(key.alias("key"), host_of(F.col(quoted(url))).alias("host"), path_of(F.col(quoted(url))).alias("path"), F.col(quoted(html)).alias("__html"))
    kinds = {"lines": T.LongType(), "sizes": T.IntegerType(), "kinds": T.ByteType()}
    lines = arrow_columns(small, "__html", [T.StructField(n, T.ArrayType(k, False), False) for n, k in kinds.items()], lambda: hashed)
    # Pages with the same lines on one host are one class; the least key and path stand for it.
    alike = F.md5(F.concat_ws(" ", "host", F.col("lines").cast("array<string>"), F.col("kinds").cast("array<string>")))
    lines = written(lines.where(F.size("lines") > 0).drop("__html").withColumn("class", alike), "page-lines")
    least = F.min(F.struct("path", "key"))
    classes = lines.groupBy("class").agg(least.alias("least"), *[F.first(c).alias(c) for c in ("host", "lines", "sizes", "kinds")])
    gone = written(deletions(written(classes.select(F.col("class").alias("key"), "host", "least.path", "lines", "sizes", "kinds"), "page-classes")), "page-deletions")

    kept = [F.col(quoted(c)) for c in without(pages, ["text", "n_chars"]) if c != html]
    given = pages.select(*kept, F.col(quoted(html)).alias("__html"), key.alias("__key"))
    n = gone.count()
    if n:  # without deletions the rows need not meet them
        gone = lines.select("key", "class").distinct().join(small_enough(gone.withColumnRenamed("key", "class"), n, 512), "class")
        n = (gone := written(gone, "page-deletions")).count()
        given = given.join(small_enough(gone.select(F.col("key").alias("__key"), "deleted"), n, 512), "__key", "left")
    else:
        given = given.withColumn("deleted", F.lit(None).cast("array<int>"))
    both = given.select(*kept, F.struct("__html", "deleted").alias("__page"))
    out = arrow_columns(both, "__page", [T.StructField("text", T.StringType(), False)], lambda: lambda rows: [[main_text(r["__html"], r["deleted"]) for r in rows]])
    return out.select(*kept, "text", F.length("text").cast("long").alias("n_chars"))


def hash_of(line: str) -> int:
    """A stable 64-bit hash of a line."""
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(line.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def op7(spark, sf_dir: str) -> DataFrame:
    """Main text of every whole page."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
