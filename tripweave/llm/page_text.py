"""Main text of web pages by differencing each page with the page of the nearest URL on its host.

Pages are cut into lines (blocks of text). Within a host, pages are sorted by URL path; of the two neighbours the one
that shares the longer path is the partner. The longest common subsequence of both pages' lines is what the site
repeats, and these lines are deleted, inside an article too. Copies of the page are passed over for the next page that is none. Markup has
the last word on one thing only: lines inside menus, headers, footers and the like go even if no partner repeats them.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tripweave.llm.common import map_runs

# Element names by their part in HTML.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "select", "object")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
ARTICLE = frozenset(("article", "main"))
APART = frozenset("nav header footer aside form menu dialog button head figure fieldset".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar form".split())
# Names of classes and ids, as whole words of the attribute.
APART_NAMES = re.compile(
    r"ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|"
    r"pagination|popup|promo\w*|related|repl(?:y|ies)|share|sharing|sidebar|social|sponsor\w*|subscribe|subscription|toolbar|widget",
    re.IGNORECASE,
)
# In these an article is no main text either; in others that are set apart, such as a form around the whole page, it is.
SHUT = frozenset("nav footer aside head".split())
SHUT_ROLES = frozenset("navigation contentinfo complementary".split())
SHUT_NAMES = re.compile(r"comments?|disqus|footer|nav|navbar|navigation|related|repl(?:y|ies)|sidebar", re.IGNORECASE)
TOKEN = re.compile(
    rf"<!--.*?(?:-->|$)|<({'|'.join(RAW)})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\"<>])*)>|<[!?][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
# One attribute after the other, each with its value, so that nothing inside a value passes for a name.
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAMED = frozenset(("class", "id", "role", "hidden", "aria-hidden"))
# Elements that may stand in a head; any other one, or text, ends it.
IN_HEAD = frozenset("head title meta link base script style noscript template".split())
PLAIN, PROSE, BESIDE = 0, 1, 2  # a line outside an article, inside one, or in a part that is no text of the page
CLOSED = 3  # while reading: set apart, and articles inside are too
COPY_SHARE = 0.95  # of two pages that share more of the shorter one's text, one is a copy and says nothing about the other
ALIGN_CELLS = 1 << 26


def _part(tag: str, attributes: str, part: int) -> int:
    """The part of an element inside ``part``."""
    if part == CLOSED:
        return CLOSED
    apart = tag in APART and not (part == PROSE and tag in ("header", "figure"))
    shut = tag in SHUT
    for name, *values in ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        name, value = name.lower(), "".join(values)
        if name not in NAMED:
            continue
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            shut = True
        elif name == "role":
            apart, shut = apart or value.lower() in APART_ROLES, shut or value.lower() in SHUT_ROLES
        elif name in ("class", "id") and tag not in ("html", "body") and tag not in ARTICLE:
            words = value.split()
            apart, shut = apart or any(map(APART_NAMES.fullmatch, words)), shut or any(map(SHUT_NAMES.fullmatch, words))
        elif name == "class" and tag in ARTICLE and re.search(r"comment|reply", value, re.IGNORECASE):
            shut = True
    if shut:
        return CLOSED
    return BESIDE if apart else PROSE if tag in ARTICLE else part


def page_lines(page: str) -> list[tuple[str, int]]:
    """Text blocks of a page in order, white space made plain, with the part of the page they are in."""
    found: list[tuple[str, int]] = []
    open_tags: list[tuple[str, int]] = []  # elements that are open, with the part their text is in
    opened: Counter[str] = Counter()  # how often each is open
    part, piece = PLAIN, []

    def close() -> None:
        if piece:
            if line := " ".join(html.unescape("".join(piece)).split()):
                found.append((line, min(part, BESIDE)))
            piece.clear()

    def pop() -> str:
        tag = open_tags.pop()[0]
        opened[tag] -= 1
        return tag

    def outside() -> int:
        return open_tags[-1][1] if open_tags else PLAIN

    def end_head() -> int:
        close()
        while pop() != "head":
            pass
        return outside()

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            text = page[at : m.start()]
            if open_tags and open_tags[-1][0] == "head" and not text.isspace():
                part = end_head()
            piece.append(text)
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if opened["head"] and not m[2] and tag not in IN_HEAD:
            part = end_head()
        if tag == "br" or tag == "hr":
            piece.append(" ")
            continue
        if tag in VOID:
            continue
        inline = tag in INLINE
        if m[2]:
            if opened[tag]:
                if not inline or part >= BESIDE:
                    close()
                while pop() != tag:
                    pass
                part = outside()
            elif not inline:
                close()
            continue
        if inline and _part(tag, m[4], part) < BESIDE:
            continue  # its end, and a missing one, then change nothing
        close()
        if not inline:
            while open_tags and (open_tags[-1][0] == "p" or tag == "li" and open_tags[-1][0] == "li"):
                pop()
            part = outside()
        if not m[4].endswith("/"):
            part = _part(tag, m[4], part)
            open_tags.append((tag, part))
            opened[tag] += 1
    piece.append(page[at:])
    close()
    return found


def common_lines(one: list, two: list) -> set[int]:
    """Places in ``one`` of a longest common subsequence with ``two``.

    Equal ends are taken off first; then rows of bits, one a line, are kept for the way back. Beyond ``ALIGN_CELLS`` cells both
    pages are first cut in two where the halves' subsequences add up to a longest one (Hirschberg), so memory stays small.
    """
    low, high, other = 0, len(one), len(two)
    while low < high and low < other and one[low] == two[low]:
        low += 1
    while high > low and other > low and one[high - 1] == two[other - 1]:
        high, other = high - 1, other - 1
    kept = set(range(low)) | set(range(high, len(one)))
    first, second = one[low:high], two[low:other]
    if not first or not second or set(first).isdisjoint(second):
        return kept
    if len(first) * len(second) > ALIGN_CELLS:
        if len(first) == 1:
            return kept | {low}
        middle = len(first) // 2
        lengths = _lengths(first[:middle], second) + _lengths(first[:middle - 1 : -1], second[::-1])[::-1]
        at = int(lengths.argmax())
        kept |= {low + i for i in common_lines(first[:middle], second[:at])}
        return kept | {low + middle + i for i in common_lines(first[middle:], second[at:])}
    rows = list(_bit_rows(first, second))
    j = len(second) - 1
    for i in range(len(first) - 1, -1, -1):
        while j >= 0 and rows[i] >> j & 1:
            j -= 1
        if j < 0:
            break
        if i == 0 or rows[i - 1] >> j & 1:
            kept.add(low + i)
            j -= 1
    return kept


def _bit_rows(first: list, second: list) -> Iterator[int]:
    """A row for each line of ``first``; bit j is 0 where the j-th line of ``second`` adds one to the longest common subsequence."""
    bits: dict = {line: bytearray(len(second) // 8 + 1) for line in set(first)}
    for j, line in enumerate(second):
        if line in bits:
            bits[line][j >> 3] |= 1 << (j & 7)
    places = {line: int.from_bytes(b, "little") for line, b in bits.items()}
    full = row = (1 << len(second)) - 1
    for line in first:
        hit = row & places[line]
        row = (row + hit | row - hit) & full
        yield row


def _lengths(first: list, second: list) -> np.ndarray:
    """Length of the longest common subsequence of ``first`` with the leading 0, 1, 2, ... lines of ``second``."""
    row = (1 << len(second)) - 1
    for row in _bit_rows(first, second):
        pass
    flat = np.unpackbits(np.frombuffer(row.to_bytes(len(second) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(second)]
    return np.concatenate([[0], np.cumsum(1 - flat.astype(np.int64))])


def judged(lines: list[str], parts: list[int], places: Iterable[int] | None = None) -> int:
    """Characters in lines that are not set apart, of all lines or those at ``places``."""
    return sum(len(lines[i]) for i in (range(len(lines)) if places is None else places) if parts[i] != BESIDE)


def copies(lines: list[str], parts: list[int], other: list[str], other_parts: list[int]) -> bool:
    """Whether one page holds over ``COPY_SHARE`` of the other's text; of such a pair nothing can be told from what it shares."""
    least = min(judged(lines, parts), judged(other, other_parts))
    return least == 0 or lines == other or judged(lines, parts, common_lines(lines, other)) > COPY_SHARE * least


def main_text(lines: list[str], parts: list[int], partner: list[str] | None) -> str:
    """The lines that stay, joined by blanks: not set apart by markup and not shared with the partner, which is no copy."""
    shared = common_lines(lines, partner) if partner else set()
    return " ".join(line for i, (line, part) in enumerate(zip(lines, parts)) if part != BESIDE and i not in shared)


def _near(one: str, two: str) -> int:
    """Leading characters that two paths share."""
    n = min(len(one), len(two))
    return next((i for i in range(n) if one[i] != two[i]), n)


def partners(rows: Iterable[tuple]) -> Iterator[tuple[tuple, tuple | None]]:
    """Each of the sorted ``rows`` (key, url, lines, parts, host, path) with its partner: of the nearest pages of its host to
    both sides that are no copies of it, the one that shares the longer path.

    Pages between a page and its partner are copies, and so have the same next page that is none. Only pages that wait for it are kept,
    exact copies with one list of lines.
    """
    differ = lambda one, two: not copies(one[2], one[3], two[2], two[3])

    def settled(page: tuple, back: tuple | None, after: tuple | None) -> tuple[tuple, tuple | None]:
        near = [n for n in (back, after) if n is not None]
        return page, max(near, key=lambda n: _near(n[5], page[5]), default=None)

    waiting: list[tuple] = []  # pages, each a copy of the next, with the page behind that each differs from
    before = behind = None  # the last page, and the nearest one behind that it differs from
    for now in rows:
        if before is not None and not (now[4] and now[4] == before[4]):
            yield from (settled(*w, None) for w in waiting)
            waiting, before, behind = [], None, None
        if before is not None:
            if differ(before, now):
                yield from (settled(*w, now if w[0] is before or differ(w[0], now) else None) for w in waiting)
                waiting, behind = [], before
            elif now[2] == before[2] and now[3] == before[3]:
                now = (*now[:2], before[2], before[3], *now[4:])
        waiting.append((now, behind if behind is not None and (behind is before or differ(now, behind)) else None))
        before = now
    yield from (settled(*w, None) for w in waiting)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``key, url, text, n_chars`` for every row of ``pages``.

    Rows are dealt to tasks by ranges of host and path, so a host of any size is split; the first page of a range
    has its partner behind it only. Pages without a partner, with a null URL, or alone on their host are judged by markup. Null and
    empty pages have an empty text. Repeated rows stay rows (and are each other's partners). Other columns are not read.
    """
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(page).alias("page"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = pa.schema([("lines", pa.list_(pa.string())), ("parts", pa.list_(pa.int8()))])

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        cut_pages = [page_lines(p or "") for p in batch.column(2).to_pylist()]
        lines = pa.array([[x for x, _ in p] for p in cut_pages], schema.field(0).type)
        parts = pa.array([[x for _, x in p] for p in cut_pages], schema.field(1).type)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lines, parts], names=["key", "url", "lines", "parts"])

    lines = map_runs(rows, "page", f"key {kind}, url string, lines array<string>, parts array<tinyint>", cut)
    # The host without a default port or case, and the path without query and fragment.
    lines = lines.withColumn("host", F.lower(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)))
    lines = lines.withColumn("path", F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://[^/?#]*([^?#]*)", 1))
    dealt = lines.repartitionByRange(*_tasks(pages), "host", "path", "key").sortWithinPartitions("host", "path", "key")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat() -> Iterator[tuple]:
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    yield from zip(*(c.to_pylist() for c in batch.slice(start, 256).columns))

        out: list[tuple] = []
        for now, partner in partners(flat()):
            text = main_text(now[2], now[3], partner[2] if partner else None)
            out.append((now[0], now[1], text, len(text)))
            if len(out) >= 256:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    key_type = to_arrow_type(rows.schema["key"].dataType)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = (key_type, pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["key", "url", "text", "n_chars"])

    return dealt.mapInArrow(pair, f"key {kind}, url string, text string, n_chars long").select(F.col("key").alias(key), F.col("url").alias(url), "text", "n_chars")


def _tasks(df: DataFrame) -> tuple[int]:
    return (int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")),)
