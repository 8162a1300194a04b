"""Main text of pages: nearest-URL page differencing, then the parts that aren't main text whatever their words.

Pages are put in order of (host, path) over ranges of that order, so that a large host fills many ranges; only hashes and
sizes of lines are moved for it. Pages that are copies of the page before them form a run with it. Each page is paired with
the nearest dissimilar page on either side, looked for at the edges of other runs of the same host, at most LOOK of them,
within its range and beyond: which pages meet doesn't depend on the ranges. First, all text lines (blocks) of a page,
whatever element they are in, are aligned with each neighbour's by longest common subsequence and shared lines are deleted
as the site's template. A declared <article> or <main> is a prior, no more: a line within it goes if two neighbours hold it
that aren't copies of one another, any other line if one does. Neighbours that share most of their text are copies, from
which nothing follows. Then, of the lines left, those go that no neighbour can tell: lines inside elements that HTML itself
or their class or id names as menus, headers, footers, sidebars, notices, adverts, forms, comments (each page has its own),
and lines outside what is declared where no neighbour was met. Scripts, styles and titles aren't text.

Defined cases: null or empty html gives empty text; broken markup is read as far as it goes (an end tag closes what is open
inside it, unclosed elements end with the page); null urls are one host without neighbours' deletions; null page_ids are
pages like others, ids are whole at any size; repeated rows are copies; ties in (host, path) are ordered by page_id, then by
the row's hash; of several longest common subsequences any may be taken, the same at every number of ranges; an empty table
gives no rows; extra columns are ignored. A host whose pages are all copies of the page before them has no neighbours, and
its pages keep their lines.
"""

import pickle
import re

from bisect import bisect_left
from collections import Counter, deque
from hashlib import blake2b
from html import unescape
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from stepforge.llm.storage import bounded_batches, discard, map_frames, materialize, whole

COPY_SHARE = 0.6
#: Runs of copies that a page looks at on either side for a dissimilar page.
LOOK = 16
#: Pairs of equal lines up to which their places are listed; beyond, rows of bits are worked through.
LISTED = 1 << 20

# Fixed values of HTML: element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
LEFT_OUT = frozenset("head nav footer aside form button select option menu menuitem dialog noscript template svg math canvas object audio video label fieldset".split())
BLOCK = frozenset(
    "address article aside blockquote body center caption dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Words in class or id that name parts that aren't the main text.
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alerts?|side-?bar|menu\w*|nav|navbar|navigation|breadcrumbs?|comments?|disqus|replies|foot|footer|head|header"
    r"|masthead|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|popup|modal|pagination|pager|widget)(?:$|[\s_-])",
    re.I,
)
_MARKUP = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|$)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|$)""", re.S)
_NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class Line(NamedTuple):
    """A block's text; declared: within <article> or <main>; out: within an element that isn't main text."""

    text: str
    declared: bool
    out: bool


def blocks(html: str) -> list[Line]:
    """Every block of text in page order (one inside an element that is left out comes before what it interrupts)."""
    lines: list[Line] = []
    text: tuple[list[str], list[str]] = ([], [])  # of the block that is open: what stays, and what is left out
    stack: list[tuple[str, bool]] = []  # element, and whether it began what is left out
    hidden = declared = at = 0

    def close(out):
        if text[out]:
            t = " ".join("".join(text[out]).split())
            if t:
                lines.append(Line(t, declared > 0, out))
            text[out].clear()

    def pop(n):
        nonlocal hidden, declared
        while len(stack) > n:
            name, left = stack.pop()
            if name in BLOCK or hidden == left:
                close(hidden > 0)
            hidden -= left
            declared -= name in ("article", "main")

    def words(s):
        if s:
            text[hidden > 0].append(unescape(s) if "&" in s else s)

    while m := _MARKUP.search(html, at):
        words(html[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name = name.lower()
        if m[1] or m[4]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop(i)
                    break
            else:
                if name in BLOCK:
                    close(hidden > 0)
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name in BLOCK:
            close(hidden > 0)
        if name in VOID:
            if name == "br":
                text[hidden > 0].append(" ")
            continue
        if name in BLOCK:  # a block ends an open paragraph
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    pop(i)
                    break
                if stack[i][0] in BLOCK:
                    break
        attrs = m[3] if m[2] else m[6]
        left = name in LEFT_OUT or (name == "header" and not declared)
        if not left and attrs and name not in ("html", "body", "main", "article") and ("=" in attrs):
            left = any(NAMED.search(next(filter(None, v), "")) for v in _NAME.findall(attrs))
        stack.append((name, left))
        hidden += left
        declared += name in ("article", "main")
    words(html[at:])
    close(True)
    close(False)
    return lines


# ---- alignment -------------------------------------------------------------------------------------------------------

def _listed(a: list, b: list) -> list[int]:
    """Positions in a of a longest common subsequence with b, from the places of equal lines (Hunt and Szymanski)."""
    places: dict = {}
    for j, line in enumerate(b):
        places.setdefault(line, []).append(j)
    tails: list[int] = []
    links: list[tuple] = []
    for i, line in enumerate(a):
        for j in reversed(places.get(line, ())):
            k = bisect_left(tails, j)
            node = (i, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(node)
            else:
                tails[k] = j
                links[k] = node
    node, found = (links[-1] if links else None), []
    while node:
        found.append(node[0])
        node = node[1]
    return found[::-1]


def _lengths(a: list, b: list) -> np.ndarray:
    """Lengths of longest common subsequences of a with b[:0], b[:1], ..., b: a row of bits a line of a."""
    n = len(b)
    places: dict = {}
    for j, line in enumerate(b):
        places.setdefault(line, []).append(j)
    masks: dict = {}
    every = (1 << n) - 1
    row = every
    for line in a:
        mask = masks.get(line)
        if mask is None:
            bits = np.zeros(n, np.uint8)
            bits[places.get(line, [])] = 1
            mask = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            if len(places.get(line, ())) > 64:  # few lines are that frequent; other masks are made as they come
                masks[line] = mask
        both = row & mask
        row = ((row + both) | (row - both)) & every
    left = np.unpackbits(np.frombuffer(row.to_bytes(-(-n // 8), "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate(([0], np.cumsum(1 - left.astype(np.int64))))


def common_lines(a: list, b: list) -> set[int]:
    """Positions in a of a longest common subsequence with b. Equal beginnings and ends and lines that one side lacks are
    set aside; where equal lines make too many pairs, a is halved at the best place of b (Hirschberg)."""
    found: set[int] = set()
    todo = [(list(enumerate(a)), b)]
    while todo:
        pa, b = todo.pop()
        in_b, in_a = set(b), {line for _, line in pa}
        pa, b = [p for p in pa if p[1] in in_b], [line for line in b if line in in_a]
        lo, end = 0, min(len(pa), len(b))
        while lo < end and pa[lo][1] == b[lo]:
            lo += 1
        hi = 0
        while hi < end - lo and pa[-1 - hi][1] == b[-1 - hi]:
            hi += 1
        found.update(i for i, _ in pa[:lo])
        found.update(i for i, _ in pa[len(pa) - hi :])
        pa, b = pa[lo : len(pa) - hi], b[lo : len(b) - hi]
        if not pa or not b:
            continue
        lines, count = [line for _, line in pa], Counter(b)
        if sum(count[line] for line in lines) <= LISTED or len(lines) == 1:
            found.update(pa[i][0] for i in _listed(lines, b))
            continue
        half = len(lines) // 2
        at = int((_lengths(lines[:half], b) + _lengths(lines[:half - 1 : -1], b[::-1])[::-1]).argmax())
        todo += [(pa[:half], b[:at]), (pa[half:], b[at:])]
    return found


# ---- pairs of pages --------------------------------------------------------------------------------------------------

class Page(NamedTuple):
    """A page's lines as pairs are aligned: keys (texts or their hashes), sizes in characters, declared, out."""

    keys: list
    sizes: list[int]
    declared: list[bool]
    out: list[bool]


def as_page(lines: list[Line]) -> Page:
    return Page([x.text for x in lines], [len(x.text) for x in lines], [x.declared for x in lines], [x.out for x in lines])


def copies(a: Page, b: Page, got: set[int]) -> bool:
    """Whether a and b, which share the lines got of a, are copies: of the lines that aren't left out, most of the longer text
    is shared, or all of the shorter."""
    short, long = sorted(sum(s for s, o in zip(p.sizes, p.out, strict=True) if not o) for p in (a, b))
    return sum(a.sizes[i] for i in got if not a.out[i]) >= min(short, COPY_SHARE * long)


def difference(page: Page, neighbours: list[Page]) -> tuple[set[int], bool]:
    """Positions of the lines that neighbours show to be template, and whether there was a neighbour to tell."""
    near = [(o, got) for o in neighbours for got in [common_lines(page.keys, o.keys)] if not copies(page, o, got)]
    shared = set().union(*(got for _, got in near))
    body = {i for i in shared if page.declared[i] and not page.out[i]}
    if body:
        twice: set[int] = set()
        if len(near) == 2:
            (p, a), (q, b) = near
            if (twice := body & a & b) and copies(p, q, common_lines(p.keys, q.keys)):
                twice = set()
        shared -= body - twice
    return shared, bool(near)


def kept(page: Page, neighbours: list[Page]) -> tuple[list[int], int]:
    """Positions of the lines that are main text, and how many lines differencing took."""
    shared, told = difference(page, neighbours)
    told = told or not any(d and not o for d, o in zip(page.declared, page.out, strict=True))
    stay = [i for i, (d, o) in enumerate(zip(page.declared, page.out, strict=True)) if i not in shared and not o and (d or told)]
    return stay, len(shared)


def main_text(page: list[Line], neighbours: list[list[Line]]) -> str:
    return "\n".join(page[i].text for i in kept(as_page(page), [as_page(n) for n in neighbours])[0])


class Edges(NamedTuple):
    """What other ranges need of a range: its first and last page, and where runs of copies begin (from the front) and end
    (from the back) within the host of that page."""

    first: tuple[str, Page]
    last: tuple[str, Page]
    whole: bool  # all of one host
    starts: list[Page]
    ends: list[Page]


def _alike(a: Page, b: Page) -> bool:
    return copies(a, b, common_lines(a.keys, b.keys))


def _rows(pdf: pd.DataFrame) -> list[tuple]:
    """(host, page, key, second key) in order, repeated rows once."""
    out: list[tuple] = []
    for h, k, k2, keys, sizes, declared, left in pdf.sort_values("__pos")[["__host", "__k", "__k2", "keys", "sizes", "declared", "out"]].itertuples(index=False, name=None):
        if not out or out[-1][2:] != (k, k2):
            out.append((h, Page([int(x) for x in keys], [int(x) for x in sizes], [bool(x) for x in declared], [bool(x) for x in left]), k, k2))
    return out


def edges_of(rows: list[tuple]) -> Edges:
    n, starts, ends = len(rows), [], []
    for j in range(1, n):
        if rows[j][0] != rows[0][0] or len(starts) == LOOK:
            break
        if not _alike(rows[j - 1][1], rows[j][1]):
            starts.append(rows[j][1])
    for j in range(n - 2, -1, -1):
        if rows[j][0] != rows[-1][0] or len(ends) == LOOK:
            break
        if not _alike(rows[j][1], rows[j + 1][1]):
            ends.append(rows[j][1])
    return Edges(rows[0][:2], rows[-1][:2], rows[0][0] == rows[-1][0], starts, ends)


def beyond(at: int, edges: list[Edges], back: bool) -> list[Page]:
    """The ends of runs before range `at` (back), or the starts of runs after it, of the host at its edge; nearest first."""
    out: list[Page] = []
    host, page = edges[at].first if back else edges[at].last
    for e in reversed(edges[:at]) if back else edges[at + 1 :]:
        near, far = (e.last, e.first) if back else (e.first, e.last)
        if near[0] != host or len(out) >= LOOK:
            break
        if not _alike(near[1], page):
            out.append(near[1])
        out += e.ends if back else e.starts
        if not e.whole:
            break
        page = far[1]
    return out[:LOOK]


def decide(rows: list[tuple], before: list[Page], after: list[Page]) -> list[tuple[list[int], int]]:
    """The positions kept of each page of a range, and how many lines differencing took."""
    n = len(rows)
    same = [False] + [rows[j][0] == rows[j - 1][0] for j in range(1, n)]
    new = [same[j] and not _alike(rows[j - 1][1], rows[j][1]) for j in range(n)]

    def dissimilar(page, runs):
        return next((p for p in runs if not _alike(page, p)), None)

    near: list[list] = [[None, None] for _ in rows]
    runs = deque(before, LOOK)  # nearest first
    for j in range(n):
        if j and not same[j]:
            runs.clear()
        elif new[j]:
            runs.appendleft(rows[j - 1][1])
        near[j][0] = dissimilar(rows[j][1], runs)
    runs = deque(after, LOOK)
    for j in range(n - 1, -1, -1):
        if j < n - 1:
            if not same[j + 1]:
                runs.clear()
            elif new[j + 1]:
                runs.appendleft(rows[j + 1][1])
        near[j][1] = dissimilar(rows[j][1], runs)
    return [kept(r[1], [p for p in pair if p is not None]) for r, pair in zip(rows, near, strict=True)]


def _line_frames(frames):
    """Pages as hashes and sizes of their lines; those without a host or a line that may be main text have no neighbours."""
    for pdf in frames:
        out = []
        for p, h, host, path, k, k2 in zip(whole(pdf["page_id"]), *(pdf[c].tolist() for c in ("html", "__host", "__path", "__k", "__k2")), strict=True):
            lines = blocks(h) if host and isinstance(h, str) else []
            if any(not x.out for x in lines):
                keys = [int.from_bytes(blake2b(x.text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) for x in lines]
                page = as_page(lines)
                out.append((p, host, path, k, k2, keys, *page[1:]))
        yield pd.DataFrame(out, columns=["page_id", "__host", "__path", "__k", "__k2", "keys", "sizes", "declared", "out"], dtype=object).astype({"page_id": "Int64"})


def decisions(keyed: DataFrame, ranges: int) -> DataFrame:
    """(__k, __k2, keep, n_shared): the positions of the lines that stay and how many differencing took, for each distinct row
    that has a host and a line."""
    spark = keyed.sparkSession
    schema = "page_id long, __host string, __path string, __k long, __k2 long, keys array<long>, sizes array<int>, declared array<boolean>, out array<boolean>"
    lines = materialize(map_frames(keyed.select("page_id", "html", "__host", "__path", "__k", "__k2"), _line_frames, schema), "page-lines")
    order = ["__host", "__path", "page_id", "__k", "__k2"]
    placed = lines.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("__pos", F.monotonically_increasing_id())
    placed = materialize(placed.withColumn("__part", F.shiftright("__pos", 33)).drop("page_id", "__path"), "page-order")
    discard(lines)
    grouped = placed.repartition(ranges, "__part").groupBy("__part")

    def edge_frame(pdf):
        return pd.DataFrame({"part": [int(pdf["__part"].iloc[0])], "edges": [pickle.dumps(edges_of(_rows(pdf)))]})

    found = sorted(grouped.applyInPandas(edge_frame, "part long, edges binary").collect())
    at = {r["part"]: i for i, r in enumerate(found)}
    shared = spark.sparkContext.broadcast([bytes(r["edges"]) for r in found])

    def keep_frame(pdf):
        rows, edges = _rows(pdf), [pickle.loads(e) for e in shared.value]
        i = at[int(pdf["__part"].iloc[0])]
        keep = decide(rows, beyond(i, edges, True), beyond(i, edges, False))
        return pd.DataFrame({"__k": [r[2] for r in rows], "__k2": [r[3] for r in rows], "keep": [k for k, _ in keep], "n_shared": [n for _, n in keep]})

    keep = materialize(grouped.applyInPandas(keep_frame, "__k long, __k2 long, keep array<int>, n_shared long"), "page-kept")
    discard(placed)
    return keep


def extract(pages: DataFrame, ranges: int | None = None) -> DataFrame:
    """page_id, url, text, n_chars, n_shared (lines that differencing took), n_left_out (lines that went after it): one row for
    each row of pages. The result doesn't depend on the number of ranges."""
    url = F.coalesce("url", F.lit(""))
    keyed = pages.select(
        "page_id", "url", "html", F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("__host"), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1).alias("__path"),
        F.xxhash64("page_id", "url", "html").alias("__k"), F.xxhash64(F.lit(4), "html", "url", "page_id").alias("__k2"),
    )
    keyed = bounded_batches(keyed)
    keep = decisions(keyed, ranges or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    joined = keyed.drop("__host", "__path").join(keep.hint("shuffle_hash"), ["__k", "__k2"], "left").select("page_id", "url", "html", "keep", "n_shared")

    def run(frames):
        for pdf in frames:
            texts, shared, left = [], [], []
            for h, k, n in zip(pdf["html"].tolist(), pdf["keep"].tolist(), whole(pdf["n_shared"]), strict=True):
                lines = blocks(h) if isinstance(h, str) else []
                k, n = kept(as_page(lines), []) if n is None else (k, n)
                texts.append("\n".join(lines[i].text for i in k))
                shared.append(n)
                left.append(len(lines) - n - len(k))
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts], "n_shared": shared, "n_left_out": left})

    return map_frames(joined, run, "page_id long, url string, text string, n_chars long, n_shared long, n_left_out long")
