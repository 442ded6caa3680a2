"""HTML extraction by differencing each page with the page of the nearest URL on its host.

Pages are sorted by host and path over the whole table (a range partition, so a host with very many pages lies on many
tasks). Each page becomes a list of blocks (text lines); its partner is the nearest page with other blocks before or after
it in that order with the same host, the one whose path shares the longest prefix, the earlier one in a tie. Pages with
equal blocks that follow each other are one run with one text for each path; a run may span tasks, and a small first job
carries the pages at the borders of each task over to the others, so the text does not depend on the partitions. The longest common subsequence of both lists of lines
marks shared lines, and shared lines are deleted as furniture.

Two exact checks follow. Blocks that the markup itself calls furniture (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, comments) go even if no other page shares them. And if the page marks its article,
shared lines inside it are restored: passages and whole articles do repeat between pages; nothing outside it stays.
A page whose every candidate line is shared (an exact copy without an article mark) keeps them.

White space inside a block becomes one space; blocks are joined in page order by one space. Null and empty html give
the empty text; null URLs have an empty host and path. Every row is kept, repeated rows too."""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_left, bisect_right

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import cut, small_batches

# Elements of HTML by what they do to a text.
RAW = {"script", "style", "textarea", "noscript", "template", "iframe", "svg", "math", "object"}
FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "head", "title", *RAW}
MAIN = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
    "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt",
    "u", "var", "wbr", "img",
}
LEAVES = {"p", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "option"}
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|banner|nav\w*|menu|breadcrumbs?|sidebar|side|footer|header|masthead|cookies?|consent|"
    r"notice|popup|modal|newsletter|subscribe|share|social|related|comments?|replies|respond)(?:$|[\s_-])", re.I)  # fmt: skip
MARKUP = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def blocks(page: str) -> list[tuple[str, bool, bool]]:
    """(text, inside the marked article, furniture by markup) of each block in page order; blank blocks are left out."""
    out: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    open_: list[tuple[str, bool, bool]] = []  # element, furniture, main
    state = [0, 0]  # open elements of furniture, of the article

    def end_block() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append((text, state[1] > 0, state[0] > 0))

    def close(down_to: int) -> None:
        for _, furniture, main in open_[down_to:]:
            state[0] -= furniture
            state[1] -= main
        del open_[down_to:]

    at, size = 0, len(page)
    while at < size:
        m = MARKUP.search(page, at)
        if not m:
            parts.append(page[at:])
            break
        parts.append(page[at : m.start()])
        at = m.end()
        if m[1] is not None:
            parts.append(m[1].replace("&", "&amp;"))
        name = (m[3] or "").lower()
        if not name:
            continue
        if name not in INLINE:
            if name == "br":
                parts.append(" ")
            else:
                end_block()
        if m[2]:
            places = [i for i, e in enumerate(open_) if e[0] == name]
            if places:
                close(places[-1])
        elif name in RAW:
            ending = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = ending.end() if ending else size
        elif name not in VOID and not (m[4] or "").endswith("/"):
            names = " ".join(a or b or c for _, a, b, c in ATTRIBUTE.findall(m[4] or "")) if m[4] else ""
            main = name in MAIN or names.strip() == "main"
            if main and state[0] and not state[1]:  # an unclosed menu or notice does not swallow the article
                close(min(i for i, e in enumerate(open_) if e[1]))
            if open_ and name not in INLINE and (open_[-1][0] == "p" or open_[-1][0] == name == "li"):
                close(len(open_) - 1)
            furniture = not main and name not in ("html", "body") and (name in FURNITURE or bool(names and NAMED.search(names)))
            if furniture or main or name not in INLINE | LEAVES:
                open_.append((name, furniture, main))
                state[0] += furniture
                state[1] += main
    end_block()
    return out


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in a of a longest common subsequence of a and b."""
    low, high_a, high_b = 0, len(a), len(b)
    while low < high_a and low < high_b and a[low] == b[low]:
        low += 1
    while high_a > low and high_b > low and a[high_a - 1] == b[high_b - 1]:
        high_a, high_b = high_a - 1, high_b - 1
    found = {*range(low), *range(high_a, len(a))}
    places: dict[str, list[int]] = {}
    for j in range(high_b - 1, low - 1, -1):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []  # least last position in b of a common subsequence, by its length
    chain: list[tuple[int, object]] = []
    for i in range(low, high_a):
        for j in places.get(a[i], ()):  # from the right, so that a line is used once
            k = bisect_left(ends, j)
            node = (i, chain[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chain.append(node)
            else:
                ends[k], chain[k] = j, node
    node = chain[-1] if chain else None
    while node:
        found.add(node[0])
        node = node[1]
    return found


def main_text(own: list[tuple[str, bool, bool]], partner: list[tuple[str, bool, bool]] | None) -> str:
    """The page's main text, given its blocks and those of its partner (None: it has none)."""
    shared = shared_lines([b[0] for b in own], [b[0] for b in partner]) if partner else set()
    marked = any(main for _, main, _ in own)
    kept = [text for i, (text, main, furniture) in enumerate(own) if not furniture and (main or not marked) and (main or i not in shared)]
    if not kept and not marked:
        kept = [text for text, _, furniture in own if not furniture]
    return " ".join(kept)


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _content(own: list[tuple[str, bool, bool]]) -> str:
    return hashlib.md5("\0".join(text for text, _, _ in own).encode("utf-8", "surrogatepass")).hexdigest()


def _borders(pages: DataFrame, html: str, parts: int) -> tuple[list[bytes], dict[bytes, list[int]]]:
    """Where each part of the order begins, and the pages that are carried to other parts: the nearest page before a part
    with other blocks than its first page, and the nearest after it with other blocks than its last."""

    def light(batches):
        for batch in batches:
            content = [_content(blocks(page) if page else []) for page in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("__order"), pa.array(content, pa.string())], ["place", "content"])

    def ends(batches):
        first = other = last = before = None
        for batch in batches:
            for row in zip(batch.column("place").to_pylist(), batch.column("content").to_pylist(), strict=True):
                first = first or row
                if other is None and row[1] != first[1]:
                    other = row
                if last is not None and row[1] != last[1]:
                    before = last
                last = row
        if first:
            yield pa.RecordBatch.from_pylist([{f"{n}{i}": row[i] if row else None for n, row in zip("abcd", (first, other, before, last), strict=True) for i in (0, 1)}], schema=pa.schema([(f"{n}{i}", pa.string()) for n in "abcd" for i in (0, 1)]))

    rows = cut(pages.select("__order", html).mapInArrow(light, "place string, content string"))
    rows = rows.repartitionByRange(parts, "place").sortWithinPartitions("place", "content")
    schema = ", ".join(f"{n}{i} string" for n in "abcd" for i in (0, 1))
    found = sorted(rows.mapInArrow(ends, schema).collect(), key=lambda r: r.a0.encode())
    carried: dict[bytes, list[int]] = {}
    for k, r in enumerate(found):
        for others, content, near, far in ((found[:k][::-1], r.a1, ("d0", "d1"), "c0"), (found[k + 1 :], r.d1, ("a0", "a1"), "b0")):
            for o in others:
                place = o[near[0]] if o[near[1]] != content else o[far]
                if place is not None:
                    carried.setdefault(place.encode(), []).append(k)
                    break
    return [r.a0.encode() for r in found], carried


def extract(df: DataFrame, url: str = "url", html: str = "html", out: str = "text", parts: int | None = None) -> DataFrame:
    """df with the main text in a new column (which takes the place of one of that name)."""
    fields = [f for f in df.schema.fields if f.name != out]
    has, rest = F.col(url).contains("://"), F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")
    host = F.coalesce(F.when(has, F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0))), F.lit(""))
    path = F.coalesce(F.when(has, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)), F.lit(""))
    df = small_batches(df.select(*[f.name for f in fields])).withColumns({"__host": host, "__path": path})
    number = lambda c: F.lpad(F.hex(F.coalesce(c, F.lit(0)).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    ties = [number(F.col(f.name)) for f in fields if isinstance(f.dataType, LongType)]
    # one text that orders all pages: hosts by hash, then path, URL, numbers and content
    order = F.concat(number(F.xxhash64("__host")), "__path", F.lit("\0"), F.coalesce(F.col(url), F.lit("")), F.lit("\0"), *ties, number(F.xxhash64(html)))
    df = df.withColumn("__order", order)
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    starts, carried = _borders(df, html, parts)

    @F.pandas_udf("array<int>")
    def parts_of(places: pd.Series) -> pd.Series:
        """The page's own part, then, as -1 - part, those that it is carried to."""
        keys = [p.encode() for p in places]
        return pd.Series([[max(0, bisect_right(starts, k) - 1), *(-1 - p for p in carried.get(k, ()))] for k in keys], dtype=object)

    placed = df.withColumn("__to", F.explode(parts_of("__order"))).withColumn("__part", F.when(F.col("__to") < 0, -1 - F.col("__to")).otherwise(F.col("__to")))
    placed = placed.repartition(parts, "__part").sortWithinPartitions("__part", "__order")

    names = [f.name for f in fields]
    at_html = names.index(html)

    def run(batches):
        before, pages, texts = None, [], {}  # the run of pages with equal blocks, and the last page before it: (host, path, blocks)
        own, part = None, None
        done: list[tuple] = []

        def emit(following):
            sides = [x for x in (before, following) if x is not None]
            made: dict[tuple[int, int], str] = {}
            for row, host, path, carried_here, marked in pages:
                if carried_here:
                    continue
                near = [i for i, x in enumerate(sides) if x[0] == host]
                side = max(near, key=lambda i: _common(sides[i][1], path), default=-1)
                if (side, id(marked)) not in made:
                    made[side, id(marked)] = main_text(marked, sides[side][2] if side >= 0 else None)
                done.append((*row, made[side, id(marked)]))

        def packed(rows):
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], [*names, out])

        for batch in batches:
            kinds = [*batch.select(names).schema.types, pa.string()]
            for row in zip(*[batch.column(c).to_pylist() for c in (*names, "__host", "__path", "__part", "__to")], strict=True):
                *row, host, path, new_part, to = row
                page = row[at_html]
                if page in texts and new_part == part:  # copies hold their page once
                    row[at_html], found = texts[page]
                else:
                    found = blocks(page) if page else []
                if new_part != part or [b[0] for b in found] != [b[0] for b in own]:
                    if pages:
                        emit((host, path, found) if new_part == part else None)
                    before = (pages[-1][1], pages[-1][2], own) if pages and new_part == part else None
                    pages, texts, own, part = [], {}, found, new_part
                texts.setdefault(page, (row[at_html], found))
                pages.append((tuple(row), host, path, to < 0, texts[page][1]))
                while len(done) >= 500:
                    yield packed(done[:500])
                    del done[:500]
        if pages:
            emit(None)
        for i in range(0, len(done), 500):
            yield packed(done[i : i + 500])

    return placed.drop("__order").mapInArrow(run, StructType([*fields, StructField(out, StringType())]))
