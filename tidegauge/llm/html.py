"""Main text of web pages: structure first, then differencing against the page with the nearest URL.

A page is read into text lines, one for each block. Lines inside menus, headers, footers, sidebars, notices, adverts,
forms and reader comments (by element, role or class) are furniture. If the page marks an article (``article``, ``main``),
the text is its other lines, and its unmarked lines too where they outweigh the article. Any of these lines may still be furniture that only its repetition tells: the page is
paired with the page of the same host whose URL path is nearest, their lines are aligned by a longest common
subsequence, and shared lines are deleted. A pair that shares most of its text is two copies of one article, not two
pages of one template (``templated`` tells them apart); the walk goes on to the next nearest page then, as far as the host's pages go. Articles quote each other, so a marked line is deleted only
if the alignments with each of the ``WITNESSES`` nearest unlike articles of the host share it.

How it scales: pages meet in groups of one host, of about ``GROUP`` pages; larger hosts are cut in the order of their
paths, and each group is given, as prints of their lines, the nearest pages beyond its edges of which no two are alike.
So a page at an edge finds its nearest unlike page as in an uncut host.

Defined results: null html is empty; pages with a null URL are together one host; the key is a number; a page without text has an empty text; broken or
cut markup is read as far as it goes; repeated pages each have their row; an empty table gives an empty table; only the
columns named are read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Pages of a host that are compared in one group; how many of these are drawn to find the edges; the share of a page's
#: text above which a pair counts as copies.
GROUP, SAMPLE, COPY_SHARE = 400, 20, 0.5
#: Unlike articles that must all have a marked article's line before it counts as the site's.
WITNESSES = 3
#: Pages unlike each other that a group sees beyond each of its edges.
EDGE = 4

ARTICLE, FURNITURE, LOOSE = 0, 1, 2

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?][^>]*>|<[/!?a-zA-Z][^>]*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\s(hidden)(?=[\s/]|\Z)""", re.I)
_RAW = {n: re.compile(rf"</{n}[\s>/]", re.I) for n in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "select")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
_FURNITURE = frozenset("nav footer aside form button menu dialog".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation note search status toolbar".split())
_WORDS = re.compile(
    r"(?:ads?|advert\w*|adsense|adslot|sponsor\w*|promo\w*|banners?|cookies?|consent|gdpr|notices?|notification\w*|alerts?|popups?|modal|overlay|newsletters?|"
    r"subscri\w*|signup|login|sidebar|aside|menu|menubar|submenu|nav|navbar|navigation|breadcrumbs?|topbar|masthead|footer|comments?|commentlist|disqus|respond|"
    r"replies|related|recommend\w*|share|sharing|social|widgets?|pagination|pager|toolbar|search|searchform|hidden)"
)
_STATES = ("has", "with", "no", "without", "is", "not", "js")


def boilerplate(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element holds furniture. ``inside``: it lies in an article, whose own header is part of it."""
    if name in _FURNITURE or (name == "header" and not inside):
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    for what, *values, bare in _ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        what = what.lower()
        if bare or (what == "aria-hidden" and value == "true") or (what == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True
        if what == "role" and value in _ROLES:
            return True
        if what in ("class", "id"):
            for token in value.split():
                words = re.split(r"[-_]+", token)
                if words[0] not in _STATES and any(_WORDS.fullmatch(w) or (w == "header" and not inside) for w in (words[0], words[-1])):
                    return True
    return False


def lines(page: str) -> list[tuple[int, str]]:
    """The page's text lines in order, each with its zone."""
    out: list[tuple[int, str]] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements, and what each opened: an article (1), furniture (2) or neither
    at = articles = skipped = 0

    def zone() -> int:
        return FURNITURE if skipped else ARTICLE if articles else LOOSE

    def end_line() -> None:
        line = " ".join("".join(text).split())
        text.clear()
        if line:
            out.append((zone(), line))

    def close(depth: int) -> None:
        nonlocal articles, skipped
        while len(stack) > depth:
            name, opened = stack.pop()
            if opened or name in _BLOCK:
                end_line()
            articles -= opened == 1
            skipped -= opened == 2

    for tag in _TAG.finditer(page):
        if tag.start() < at:
            continue
        if tag.start() > at:
            piece = page[at : tag.start()]
            text.append(html.unescape(piece) if "&" in piece else piece)
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        if tag[1] or tag[4]:
            depth = next((d for d in range(len(stack) - 1, -1, -1) if stack[d][0] == name), None)
            if depth is not None:
                close(depth)
            elif name in _BLOCK:
                end_line()
            continue
        if name in _VOID:
            text.append(" ")
            if name == "hr":
                end_line()
            continue
        if name in _RAW:
            text.append(" ")
            if not (tag[3] or tag[6] or "").endswith("/"):
                end = _RAW[name].search(page, at)
                at = end.start() if end else len(page)
                stack.append((name, 0))
            continue
        attributes = tag[3] or tag[6] or ""
        if name in ("article", "main") and not articles and not boilerplate("div", attributes, True):
            first = next((d for d, x in enumerate(stack) if x[1] == 2), None)
            if first is not None:  # furniture was left open
                close(first)
            end_line()
            stack.append((name, 1))
            articles += 1
            continue
        if name in _BLOCK:
            if name != "body" and stack and (p := next((d for d in range(len(stack) - 1, -1, -1) if stack[d][0] in ("p", "li") or stack[d][0] in _BLOCK), None)) is not None:
                if stack[p][0] == "p" or (stack[p][0] == name == "li"):
                    close(p)
            end_line()
        opened = 2 if boilerplate(name, attributes, articles > 0) else 0
        if opened:
            end_line()
        stack.append((name, opened))
        skipped += opened == 2
        if name in ("td", "th"):
            text.append(" ")
    if at < len(page):
        text.append(html.unescape(page[at:]))
    close(0)
    end_line()
    return out


def shared(mine: list[str], theirs: list[str]) -> list[int]:
    """Positions in ``mine`` of a longest common subsequence of lines.

    Matches are laid end to end by the least last position for each length, so the work follows the number of matches.
    """
    places = defaultdict(list)
    for j, line in enumerate(theirs):
        places[line].append(j)
    last: list[int] = []
    tip: list[tuple] = []
    for i, line in enumerate(mine):
        for j in reversed(places.get(line, ())):
            k = bisect_left(last, j)
            link = (i, tip[k - 1] if k else None)
            if k == len(last):
                last.append(j)
                tip.append(link)
            else:
                last[k], tip[k] = j, link
    out, link = [], tip[-1] if tip else None
    while link:
        out.append(link[0])
        link = link[1]
    return out[::-1]


def nearness(a: str, b: str) -> tuple[int, int]:
    """Steps that two URL paths have in common from the left, then characters."""
    x, y = a.split("/"), b.split("/")
    steps = next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    characters = next((k for k, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))
    return steps, characters


def outward(place: int, paths: list[str]) -> Iterator[int]:
    """The other places of the sorted ``paths``, the nearest path first."""
    left, right = place - 1, place + 1
    while left >= 0 or right < len(paths):
        if right >= len(paths) or (left >= 0 and nearness(paths[place], paths[left]) >= nearness(paths[place], paths[right])):
            yield left
            left -= 1
        else:
            yield right
            right += 1


class Page:
    """A page's place in its host's order, and its lines (or their prints) by zone."""

    def __init__(self, path: str, place: str, zones: list[int], tokens: list, sizes: list[int]):
        self.path, self.place, self.zones, self.sizes = path, place, zones, sizes
        self.lines = {zone: [t for z, t in zip(zones, tokens, strict=True) if z == zone] for zone in (ARTICLE, LOOSE)}
        self.lengths = {zone: [n for z, n in zip(zones, sizes, strict=True) if z == zone] for zone in (ARTICLE, LOOSE)}
        self.sets = {zone: set(x) for zone, x in self.lines.items()}
        self.content = (tuple(zones), tuple(tokens))

    def overlap(self, other: "Page", zone: int) -> float:
        """The share of this page's characters whose lines the other page has too."""
        return sum(n for t, n in zip(self.lines[zone], self.lengths[zone], strict=True) if t in other.sets[zone]) / (sum(self.lengths[zone]) or 1)


def printed(line: str) -> bytes:
    return blake2b(line.encode("utf-8", "surrogatepass"), digest_size=12).digest()


def repeated(place: int, order: list[Page], paths: list[str]) -> set[int]:
    """Positions of a marked article's lines that each of the ``WITNESSES`` nearest articles unlike it has too."""
    page = order[place]
    mine = page.lines[ARTICLE]
    gone, seen = set(range(len(mine))), 0
    for j in outward(place, paths):
        other = order[j]
        if not other.lines[ARTICLE] or page.overlap(other, ARTICLE) > COPY_SHARE:
            continue
        gone &= set(shared(mine, other.lines[ARTICLE])) if gone and not other.sets[ARTICLE].isdisjoint(mine) else set()
        seen += 1
        if not gone or seen == WITNESSES:
            break
    return gone if seen == WITNESSES else set()


def templated(place: int, order: list[Page], paths: list[str]) -> set[int]:
    """Positions of a page's unmarked lines that are its site's.

    The walk ends at the nearest page that shares some, but at most ``COPY_SHARE`` of the text: what both share goes. It
    ends before that at a page that shares more, if a third shares exactly the same lines with this page and no two of the
    three share any other line: these are siblings of one template with little text, for copies edited in different lines
    share different ones. Other pages that share more are copies and are passed over.
    """
    page = order[place]
    mine, alike = page.lines[LOOSE], {}
    if not mine:
        return set()
    for j in outward(place, paths):
        other = order[j]
        met = page.sets[LOOSE] & other.sets[LOOSE]
        if not met:
            continue
        if page.overlap(other, LOOSE) <= COPY_SHARE:
            return set(shared(mine, other.lines[LOOSE]))
        if met == page.sets[LOOSE] or met == other.sets[LOOSE]:
            continue
        third = alike.setdefault(frozenset(met), [])
        for one in third:
            if one.sets[LOOSE] & other.sets[LOOSE] == met:
                return set(shared(mine, other.lines[LOOSE])) & set(shared(mine, one.lines[LOOSE]))
        third.append(other)
    return set()


def differenced(pages: list[Page], around: list[Page] = ()) -> list[list[int]]:
    """The positions of the text lines of each page of one group; ``around`` are pages beyond the group's edges.

    Pages of equal lines are one page, at the first of their places.
    """
    equal = defaultdict(list)
    for i, page in sorted(enumerate([*pages, *around]), key=lambda x: x[1].place):
        equal[page.content].append((i, page))
    order = [same[0][1] for same in equal.values()]
    paths = [p.path for p in order]
    out: list[list[int]] = [[] for _ in pages]
    for place, same in enumerate(equal.values()):
        page = order[place]
        if any(i < len(pages) for i, _ in same):
            left = kept(page, {LOOSE: templated(place, order, paths), ARTICLE: repeated(place, order, paths) if page.lines[ARTICLE] else set()})
            for i, _ in same:
                if i < len(pages):
                    out[i] = left
    return out


def kept(page: Page, gone: dict[int, set[int]]) -> list[int]:
    """A page's positions without those gone by zone; a marked page's unmarked lines count only if they outweigh its article."""
    left, at, size = [], {LOOSE: 0, ARTICLE: 0}, {LOOSE: 0, ARTICLE: 0}
    for k, z in enumerate(page.zones):
        if at[z] not in gone[z]:
            left.append(k)
            size[z] += page.sizes[k]
        at[z] += 1
    return [k for k in left if page.zones[k] == ARTICLE or not at[ARTICLE] or size[LOOSE] > size[ARTICLE]]


def hosts_cut(plain: DataFrame) -> DataFrame:
    """Rows (host, cuts) of the hosts of more than ``GROUP`` pages: places that cut them into parts of about ``GROUP``.

    The cuts are every ``SAMPLE``-th place of a sample by hash, which holds ``SAMPLE`` pages of ``GROUP``.
    """
    large = plain.groupBy("host").count().filter(F.col("count") > GROUP).select("host")
    drawn = plain.filter(F.pmod(F.xxhash64("place", F.lit("cut")), F.lit(GROUP // SAMPLE)) == 0).select("host", "place")
    sample = drawn.join(large, "host", "left_semi").groupBy("host").agg(F.array_sort(F.collect_list("place")).alias("places"))
    cuts = F.filter("places", lambda x, k: k % SAMPLE == SAMPLE - 1)
    return sample.select("host", cuts.alias("cuts")).filter(F.size("cuts") > 0)


def unlike_ones(rows: list[dict]) -> list[dict]:
    """The first rows of which none is like one before it, in each zone as many as a page's neighbours may have to be."""
    out: list[tuple[dict, Page]] = []
    full = dict.fromkeys((ARTICLE, LOOSE), 0)
    for r in rows:
        page = Page(r["path"], r["place"], r["zones"], r["prints"], r["sizes"])
        zones = [z for z in full if page.lines[z] and full[z] < EDGE and all(page.overlap(p, z) <= COPY_SHARE for _, p in out)]
        if zones:
            out.append((r, page))
            for z in zones:
                full[z] += 1
        if min(full.values()) == EDGE:
            break
    return [r for r, _ in out]


def ends(group: pa.Table) -> pa.Table:
    """Of a part, the unlike pages nearest to its first edge (first true) and to its last."""
    rows = sorted(group.to_pylist(), key=lambda r: r["place"])
    return pa.Table.from_pylist([*({**r, "first": True} for r in unlike_ones(rows)), *({**r, "first": False} for r in unlike_ones(rows[::-1]))], group.schema.append(pa.field("first", pa.bool_())))


def beyond_edges(host: pa.Table) -> pa.Table:
    """For each part of a host, the unlike pages nearest to its edges from the parts before and after it."""
    rows = sorted(host.to_pylist(), key=lambda r: r["place"])
    schema = host.schema.remove(host.schema.get_field_index("first"))
    parts = sorted({r["part"] for r in rows})
    out = []
    for first in (True, False):
        side = defaultdict(list)
        for r in rows if first else rows[::-1]:
            if r["first"] is first:
                side[r["part"]].append({k: v for k, v in r.items() if k != "first"})
        held: list[dict] = []
        for part in parts[::-1] if first else parts:
            out += [{**r, "part": part} for r in held]
            held = unlike_ones(side[part] + held)
    return pa.Table.from_pylist(out, schema)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """A row for each page: id, url, text (its lines joined by two newlines)."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    path = F.regexp_replace(F.coalesce("url", F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*|[?#].*$|/$|\.html?$", "")
    plain = pages.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{url}`").alias("url"), F.col(f"`{markup}`").alias("html"))
    # equal paths lie in the order of a hash, so that they can be cut too
    plain = plain.withColumns({"host": host, "path": path, "place": F.concat(path, F.lit("\x00"), F.hex(F.xxhash64("id", "url", "html")))})
    cuts = {r.host: r.cuts for r in hosts_cut(plain).collect()}

    def read(batches: Iterator[pa.RecordBatch], cut_only: bool = False) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                hosts = batch.column(3).to_pylist()
                if cut_only:
                    batch = batch.take(pa.array([i for i, h in enumerate(hosts) if h in cuts], pa.int32()))
                    hosts = batch.column(3).to_pylist()
                found = [[x for x in lines(h.as_py() or "") if x[0] != FURNITURE] for h in batch.column(2)]
                parts = pa.array([bisect_right(cuts.get(h, ()), p) for h, p in zip(hosts, batch.column(5).to_pylist(), strict=True)], pa.int32())
                zones = pa.array([[z for z, _ in x] for x in found], pa.list_(pa.int32()))
                if cut_only:
                    sizes = pa.array([[len(t) for _, t in x] for x in found], pa.list_(pa.int32()))
                    prints = pa.array([[printed(t) for _, t in x] for x in found], pa.list_(pa.binary()))
                    yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (3, 4, 5)), parts, zones, sizes, prints], ["host", "path", "place", "part", "zones", "sizes", "prints"])
                else:
                    texts = pa.array([[t for _, t in x] for x in found], pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 1, 3, 4, 5)), parts, zones, texts], ["id", "url", "host", "path", "place", "part", "zones", "lines"])

    def compare(group: pa.Table, around: pa.Table) -> pa.Table:
        rows, others = group.select(["path", "place", "zones", "lines"]).to_pylist(), around.to_pylist()
        own = [Page(r["path"], r["place"], r["zones"], [printed(t) for t in r["lines"]] if others else r["lines"], list(map(len, r["lines"]))) for r in rows]
        taken = differenced(own, [Page(r["path"], r["place"], r["zones"], r["prints"], r["sizes"]) for r in others])
        return pa.table({"id": group.column("id"), "url": group.column("url"), "text": pa.array(["\n\n".join(r["lines"][k] for k in t) for r, t in zip(rows, taken, strict=True)], pa.string())})

    read_pages = plain.mapInArrow(read, "id long, url string, host string, path string, place string, part int, zones array<int>, lines array<string>")
    signs = "host string, path string, place string, part int, zones array<int>, sizes array<int>, prints array<binary>"
    if cuts:
        signed = plain.mapInArrow(lambda batches: read(batches, True), signs)
        beyond = signed.groupBy("host", "part").applyInArrow(ends, f"{signs}, first boolean").groupBy("host").applyInArrow(beyond_edges, signs)
    else:
        beyond = pages.sparkSession.createDataFrame([], signs)
    return read_pages.groupBy("host", "part").cogroup(beyond.groupBy("host", "part")).applyInArrow(compare, "id long, url string, text string")
