"""Main text of web pages by wrapper induction.

Template and content are found for a whole host, whatever tasks its pages lie in: pages are
read in any order, and what is counted of them (shapes, texts of slots, sizes of slots) is
added up by host; each host's plan is then joined to its pages. Each page's markup becomes a tree of blocks in which neighbouring siblings of
equal shape count as one repeated node. The most common shape of a host is its
wrapper; simple tree matching aligns every other shape with it, and so each block of a page
is put into a slot of the wrapper, or beside it. Slots whose text is the same on most
pages are template; pages with the same longest block count once for this, so copies of an
article do not make it template. Slots that vary are content, unless they mostly hold
links, or their element, role or class says that they are a menu, a notice, an advert, a
form or the like. The text of a page is what varies in the part of the wrapper that
holds most of the varying text; this part is found over all pages of the host.

Defined cases: null and empty pages, and pages without text, give an empty string; a host
with a single page has no template and keeps its varying part by the other rules; a null
URL is a host of its own; rows with equal ids or URLs are treated one by one; an empty
table gives an empty one; other columns are left out. A task holds one batch of pages, and at
most twice ``GROUP`` pages of a host with its plan.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import ready, slices, stored
from callscope.llm.urls import parted

GROUP = 256
#: A slot is template if this share of at least MIN_PAGES pages has the same text in it.
SAME = 0.7
MIN_PAGES = 5
#: Share of link characters from which a slot is a menu, and share of the text that the content part holds.
LINKS = 0.5
PART = 0.7
#: Blocks of a telling name that hold this share of the varying text are the article all the same.
HOLDS = 0.5
DEPTH = 100

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: The end of a self-closed element; a slash at the end of a value without quotes belongs to the value.
_CLOSED = re.compile(r"(?<!=)(?:^|[\s\"']|(?:^|\s)[^\s\"'=]+)/\Z")
#: Elements whose content is not markup, and elements without content.
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
#: Elements that may stand in a page's head; any other one ends it, and so does text.
_HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark output q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var".split()
)
_DROPPED = frozenset(
    "head nav footer aside form dialog button select option input fieldset menu script style noscript template iframe"
    " object canvas audio video svg math figure-ad".split()
)
#: Whole classes, ids or roles, numbers aside, that mark a block as not the article.
_DROPPED_NAMES = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments complementary consent"
    " contentinfo cookie cookies disclaimer disqus footer gdpr header masthead menu menubar modal nav navbar navigation"
    " newsletter notice notices notification overlay pager pagination popup promo promotion related reply replies respond"
    " search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
_MAIN = frozenset(("article", "main"))
_HEADERS = frozenset(("header", "masthead"))
#: An element of this kind ends an open one of the same kinds, up to the element that holds them.
_ENDS = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr",)), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "option": (frozenset(("option",)), frozenset(("select",))),
}


class Block:
    """A block element: its label, whether it is dropped, names that speak against it, and its block children."""

    __slots__ = ("tag", "label", "dropped", "marks", "main", "children", "shape", "spot", "block")

    def __init__(
        self, tag: str, names: tuple[str, ...], parent: Block | None, block: bool = True, marks: tuple[str, ...] = ()
    ):
        self.tag, self.block = tag, block
        self.label = ".".join((tag, *names)) if block else tag
        self.main = bool(parent and parent.main) or tag in _MAIN
        # The head of an article is part of it; the head of a page is not.
        header = tag == "header" and not (parent and parent.main)
        self.dropped = bool(parent and parent.dropped) or tag in _DROPPED or header
        if tag in _MAIN or not parent:
            self.marks: frozenset[str] = frozenset()
        else:
            self.marks = parent.marks.union(m for m in marks if not (parent.main and m in _HEADERS))
        self.children: list[Block] = []
        self.shape = self.spot = ""


def _names(rest: str) -> tuple[str, ...]:
    found = [w for m in _NAMES.finditer(rest) for w in re.split(r"[^a-z]+", (m[1] or m[2] or m[3] or "").lower()) if w]
    return tuple(dict.fromkeys(found))


def _marks(rest: str) -> tuple[str, ...]:
    words = (w for m in _NAMES.finditer(rest) for w in (m[1] or m[2] or m[3] or "").lower().split())
    return tuple(n for w in words if (n := "-".join(p for p in re.split(r"[^a-z]+", w) if p)) in _DROPPED_NAMES)


def parse(html: str) -> tuple[Block, list]:
    """The block tree, and the runs of text in page order: [block, pieces, characters in links]."""
    root = Block("html", (), None)
    stack, runs, links, at = [root], [], 0, 0
    state = {"open": False}

    def owner() -> Block:
        return next(b for b in reversed(stack) if b.block)

    def text(piece: str) -> None:
        if not piece:
            return
        if stack[-1].tag == "head" and not piece.isspace():
            close_to(len(stack) - 1)
        top = stack[-1]
        if top.dropped:
            return
        if not state["open"]:
            runs.append([owner(), [], 0])
            state["open"] = True
        piece = unescape(piece)
        runs[-1][1].append(piece)
        if links:
            runs[-1][2] += len(piece.strip())

    def close_to(index: int) -> None:
        nonlocal links
        for b in stack[index:]:
            links -= b.tag == "a"
            if b.block:
                state["open"] = False
        del stack[index:]

    while True:
        m = _MARKUP.search(html, at)
        text(html[at : m.start() if m else len(html)])
        if not m:
            return root, runs
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        inline = tag in _INLINE
        # Nothing that is kept open can stand in a head, so an open one is on top.
        if stack[-1].tag == "head" and (tag not in _HEAD or (tag == "html" and (m["end"] or m["end2"]))):
            close_to(len(stack) - 1)
        if m["end"] or m["end2"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close_to(i)
                    break
                if inline and stack[i].block:
                    break
            else:
                state["open"] = state["open"] and inline
            continue
        if tag in _RAW:
            state["open"] = False
            foreign = tag in ("svg", "math")
            if foreign and _CLOSED.search(m["rest"] or m["rest2"] or ""):
                continue
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            # A drawing or formula that is never closed is empty too; the markup behind it ends it.
            at = end.start() if end else at if foreign else len(html)
            continue
        if tag in ("html", "body") or tag in _VOID:
            state["open"] = state["open"] and tag not in ("br", "hr", "html", "body")
            continue
        if not inline:
            state["open"] = False
            near = next(i for i in range(len(stack) - 1, -1, -1) if stack[i].block)
            if stack[near].tag == "p":
                close_to(near)
            if tag in _ENDS:
                ended, held = _ENDS[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in ended:
                        close_to(i)
                        break
                    if stack[i].tag in held:
                        break
        if len(stack) >= DEPTH:
            continue
        rest = m["rest"] or m["rest2"] or ""
        names = _names(rest)
        marks = () if _DROPPED_NAMES.isdisjoint(names) else _marks(rest)
        made = Block(tag, names, stack[-1], not inline, marks)
        if not inline:
            owner().children.append(made)
        links += tag == "a"
        stack.append(made)


def shaped(root: Block) -> str:
    """The shape of a tree; every block gets its spot in it. Equal neighbours share a spot."""

    def shape(block: Block) -> None:
        for child in block.children:
            shape(child)
        shapes = [c.shape for c in block.children]
        kept = [s for i, s in enumerate(shapes) if i == 0 or s != shapes[i - 1]]
        block.shape = f"{block.label}({','.join(kept)})"

    def place(block: Block, spot: str) -> None:
        block.spot = spot
        number, before = -1, None
        for child in block.children:
            number += child.shape != before
            before = child.shape
            place(child, f"{spot}/{number}")

    shape(root)
    place(root, "")
    return root.shape


@lru_cache(maxsize=4096)
def _children(shape: str) -> tuple[str, tuple[str, ...]]:
    """Label and children of a shape."""
    label, _, inner = shape.partition("(")
    parts, depth, start = [], 0, 0
    inner = inner[:-1]
    for i, c in enumerate(inner):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append(inner[start:i])
            start = i + 1
    if inner:
        parts.append(inner[start:])
    return label, tuple(parts)


@lru_cache(maxsize=65536)
def _match(a: str, b: str) -> tuple[int, tuple[tuple[int, int], ...]]:
    """Simple tree matching: the number of matched nodes, and which children are matched."""
    (label_a, kids_a), (label_b, kids_b) = _children(a), _children(b)
    if label_a != label_b:
        return 0, ()
    best = [[0] * (len(kids_b) + 1) for _ in range(len(kids_a) + 1)]
    for i, x in enumerate(kids_a):
        for j, y in enumerate(kids_b):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + _match(x, y)[0])
    pairs, i, j = [], len(kids_a), len(kids_b)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return 1 + best[-1][-1], tuple(reversed(pairs))


def aligned(shape: str, wrapper: str) -> dict[str, str]:
    """For each spot of a shape its slot of the wrapper; spots without one are kept apart below their parent's."""
    slots = {}

    def walk(a: str, b: str, spot: str, slot: str) -> None:
        slots[spot] = slot
        matched = dict(_match(a, b)[1])
        kids_a, kids_b = _children(a)[1], _children(b)[1]
        for i, kid in enumerate(kids_a):
            if i in matched:
                walk(kid, kids_b[matched[i]], f"{spot}/{i}", f"{slot}/{matched[i]}")
            else:
                beside(kid, f"{spot}/{i}", f"{slot}/+{_children(kid)[0]}")

    def beside(a: str, spot: str, slot: str) -> None:
        slots[spot] = slot
        for i, kid in enumerate(_children(a)[1]):
            beside(kid, f"{spot}/{i}", f"{slot}/+{_children(kid)[0]}")

    walk(shape, wrapper, "", "")
    return slots


def _within(slot: str, part: str) -> bool:
    return slot == part or slot.startswith(part + "/")


#: A line of a page: spot, text (or its length), characters in links, whether in article or main, marks.
Line = tuple[str, str, int, bool, str]


def read(html: str | None) -> tuple[str, list[Line]]:
    """The shape and the lines of a page."""
    root, runs = parse(html or "")
    shape = shaped(root)
    lines = (
        (block.spot, " ".join("".join(pieces).split()), links, block.main, " ".join(sorted(block.marks)))
        for block, pieces, links in runs
    )
    return shape, [x for x in lines if x[1]]


def weigh(lines, slots: dict[str, str], template: set[str], sizes: dict, shares: dict) -> None:
    """Adds a page's varying lines to the sizes by (slot, marks) and to what each mark holds of its pages' text outside links."""
    free, own = 0, Counter()
    for spot, size, links, main, marks in lines:
        slot = slots[spot]
        if slot in template:
            continue
        known = sizes[slot, marks]
        known[0] += size
        known[1] += links
        known[2] += size * main
        free += max(size - links, 0)
        for mark in marks.split():
            own[mark] += max(size - links, 0)
    for mark, held in own.items():
        shares[mark][0] += held
        shares[mark][1] += free


def decide(sizes: dict, shares: dict) -> tuple[set[str], set[str], str]:
    """The slots that are content, the marks that count, and the part of the wrapper that holds the article."""
    size: Counter = Counter()
    linked: Counter = Counter()
    for (slot, _), (n, links, _) in sizes.items():
        size[slot] += n
        linked[slot] += links
    content = {slot for slot in size if linked[slot] <= LINKS * size[slot]}
    against = {mark for mark, (own, all_) in shares.items() if own < HOLDS * all_}
    weights: Counter = Counter()
    for (slot, marks), (n, _, main) in sizes.items():
        if slot in content and against.isdisjoint(marks.split()):
            # Text in article or main elements weighs three times.
            weights[slot] += n + 2 * main
    total, part = sum(weights.values()), ""
    while True:
        below: Counter = Counter()
        for slot, weight in weights.items():
            if slot.startswith(part + "/"):
                below[part + "/" + slot[len(part) + 1 :].split("/", 1)[0]] += weight
        heaviest = min(below, key=lambda s: (-below[s], s), default=None)
        # Down to the element that holds the blocks, not to one of its blocks.
        if heaviest is None or below[heaviest] < PART * total or not any(s.startswith(heaviest + "/") for s in weights):
            break
        part = heaviest
    return content, against, part


def written(lines: list[Line], slots: dict[str, str], content: set[str], against: set[str], part: str) -> str:
    """The text of a page."""
    varying = [(slots[x[0]], x[1], x[4]) for x in lines if slots[x[0]] in content]
    # A page of which nothing else is left keeps what names speak against.
    kept = [(slot, line) for slot, line, marks in varying if against.isdisjoint(marks.split())]
    kept = kept or [(slot, line) for slot, line, _ in varying]
    # A page of another build than its host's may have nothing in that part; then all that varies is its text.
    return "\n".join([line for slot, line in kept if _within(slot, part)] or [line for _, line in kept])


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def copied(lines: list[Line]) -> int:
    """A hash of a page's lines, equal for copies; lines of blocks with telling names (adverts, comments) do not count."""
    return _hash("\n".join([x[1] for x in lines if not x[4]] or [x[1] for x in lines]))


def extract(pages: list[str | None]) -> list[str]:
    """The main texts of pages of one host."""
    parsed = [read(html) for html in pages]
    # The most common shape; the first in order of itself among equals.
    counts = Counter(shape for shape, _ in parsed)
    wrapper = min(counts, key=lambda s: (-counts[s], s)) if counts else ""
    slots = {shape: aligned(shape, wrapper) for shape in counts}
    texts: dict[str, Counter] = defaultdict(Counter)
    seen: set[int] = set()
    for shape, lines in parsed:
        copy = copied(lines)
        if copy in seen:
            continue
        seen.add(copy)
        joined = defaultdict(list)
        for x in lines:
            joined[slots[shape][x[0]]].append(x[1])
        for slot, found in joined.items():
            texts[slot]["\n".join(found)] += 1
    template = {
        slot for slot, found in texts.items() if found.total() >= MIN_PAGES and max(found.values()) >= SAME * found.total()
    }
    sizes: dict = defaultdict(lambda: [0, 0, 0])
    shares: dict = defaultdict(lambda: [0, 0])
    for shape, lines in parsed:
        weigh([(x[0], len(x[1]), *x[2:]) for x in lines], slots[shape], template, sizes, shares)
    chosen = decide(sizes, shares)
    return [written(lines, slots[shape], *chosen) for shape, lines in parsed]


def _groups(batches, columns=("host", "page_id", "url", "html")):
    """Runs of rows of one host, of at most twice GROUP pages; the last column holds the page."""
    held: list = []
    for batch in slices(batches, columns[-1]):
        for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if held and (held[0][0] != row[0] or len(held) >= 2 * GROUP):
                # The rest of a large host stays large enough for a group of its own.
                cut = GROUP if held[0][0] == row[0] else len(held)
                yield held[:cut]
                held = held[cut:]
            held.append(row)
    if held:
        yield held


@lru_cache(maxsize=1024)
def _placed(shape: str, wrapper: str) -> dict[str, str]:
    return aligned(shape, wrapper)


@lru_cache(maxsize=64)
def _template(listed: str) -> frozenset[str]:
    return frozenset(json.loads(listed))


def _made(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_SLIM = pa.schema([("host", pa.string()), ("shape", pa.string()), ("copy", pa.int64()), ("lines", pa.string())])
_TEXTS = pa.schema([("host", pa.string()), ("slot", pa.string()), ("text", pa.int64()), ("n", pa.int64())])
_SUMS = pa.schema([("host", pa.string()), ("slot", pa.string()), ("marks", pa.string())] + [(c, pa.int64()) for c in "abc"])
_PLANS = pa.schema([("host", pa.string()), ("plan", pa.string())])


def _slim(batches):
    """Pages without their text: lines as (spot, length, characters in links, main, marks, hash)."""
    for batch in slices(batches, "html"):
        rows = []
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            shape, lines = read(page)
            slim = [(x[0], len(x[1]), *x[2:], _hash(x[1])) for x in lines]
            rows.append((host, shape, copied(lines), json.dumps(slim)))
        yield _made(rows, _SLIM)


def _texts(batches):
    """How many pages have which text in a slot."""
    for batch in batches:
        found: Counter = Counter()
        for host, shape, wrapper, lines in zip(*(batch.column(c).to_pylist() for c in ("host", "shape", "wrapper", "lines"))):
            slots, joined = _placed(shape, wrapper), defaultdict(list)
            for x in json.loads(lines):
                joined[slots[x[0]]].append(str(x[5]))
            found.update((host, slot, _hash("\n".join(hashes))) for slot, hashes in joined.items())
        yield _made([(*k, n) for k, n in found.items()], _TEXTS)


def _sums(batches):
    """Sizes of varying slots by marks, and, without a slot, what each mark holds."""
    for batch in batches:
        found: dict = defaultdict(lambda: (defaultdict(lambda: [0, 0, 0]), defaultdict(lambda: [0, 0])))
        names = ("host", "shape", "wrapper", "template", "lines")
        for host, shape, wrapper, template, lines in zip(*(batch.column(c).to_pylist() for c in names)):
            weigh([x[:5] for x in json.loads(lines)], _placed(shape, wrapper), _template(template), *found[host])
        rows = [(host, *k, *n) for host, (sizes, _) in found.items() for k, n in sizes.items()]
        rows += [(host, None, mark, *n, 0) for host, (_, shares) in found.items() for mark, n in shares.items()]
        yield _made(rows, _SUMS)


def _plans(batches):
    """Each host's plan: wrapper, slots that are not content, marks that count, part."""
    for batch in batches:
        rows = []
        for host, wrapper, template, sums in zip(*(batch.column(c).to_pylist() for c in ("host", "wrapper", "template", "sums"))):
            sizes = {(x["slot"], x["marks"]): (x["a"], x["b"], x["c"]) for x in sums if x["slot"] is not None}
            shares = {x["marks"]: (x["a"], x["b"]) for x in sums if x["slot"] is None}
            content, against, part = decide(sizes, shares)
            out = _template(template).union(slot for slot, _ in sizes if slot not in content)
            rows.append((host, json.dumps([wrapper, sorted(out), sorted(against), part])))
        yield _made(rows, _PLANS)


def main_texts(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: id, url, main text."""
    ready(pages.sparkSession)
    rows = parted(pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")))
    rows = rows.select("host", "page_id", "url", "html")
    kind = rows.schema["page_id"].dataType.simpleString()

    slim = rows.select("host", "html").mapInArrow(_slim, "host string, shape string, copy long, lines string")
    slim = stored(slim, "wrappers")
    shapes = slim.groupBy("host", "shape").agg((-F.count("*")).alias("n"))
    # The most common shape; the first in order of itself among equals.
    wrappers = shapes.groupBy("host").agg(F.min(F.struct("n", "shape"))["shape"].alias("wrapper"))
    first = slim.groupBy("host", "copy").agg(F.min(F.struct("shape", "lines")).alias("one")).select("host", "one.*")
    texts = first.join(wrappers, "host").mapInArrow(_texts, "host string, slot string, text long, n long")
    counts = texts.groupBy("host", "slot", "text").agg(F.sum("n").alias("n"))
    counts = counts.groupBy("host", "slot").agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    same = counts.where((F.col("total") >= MIN_PAGES) & (F.col("most") >= SAME * F.col("total")))
    templates = same.groupBy("host").agg(F.to_json(F.sort_array(F.collect_list("slot"))).alias("template"))
    hosts = wrappers.join(templates, "host", "left").select("host", "wrapper", F.coalesce("template", F.lit("[]")).alias("template"))
    hosts = stored(hosts, "wrappers")
    sums = slim.join(hosts, "host").mapInArrow(_sums, "host string, slot string, marks string, a long, b long, c long")
    sums = sums.groupBy("host", "slot", "marks").agg(*[F.sum(c).alias(c) for c in "abc"])
    sums = sums.groupBy("host").agg(F.collect_list(F.struct("slot", "marks", "a", "b", "c")).alias("sums"))
    plans = stored(hosts.join(sums, "host").mapInArrow(_plans, "host string, plan string"), "wrappers")

    def lines(batches):
        for batch in slices(batches, "html"):
            page = pa.array([json.dumps(read(x), ensure_ascii=False) for x in batch.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], page], ["host", "page_id", "url", "page"])

    def run(batches):
        types = {}

        def noted(batches):
            for batch in batches:
                types["id"] = batch.schema.field("page_id").type
                yield batch

        for group in _groups(noted(batches), ("host", "plan", "page_id", "url", "page")):
            texts = []
            # A host without a plan has nothing that varies.
            wrapper, out, against, part = json.loads(group[0][1] or '["", [], [], ""]')
            out, against = set(out), set(against)
            for row in group:
                shape, found = json.loads(row[4])
                slots = _placed(shape, wrapper) if row[1] else {}
                content = set(slots.values()) - out
                texts.append(written(found, slots, content, against, part) if row[1] else "")
            ids, links = pa.array([row[2] for row in group], types["id"]), pa.array([row[3] for row in group], pa.string())
            yield pa.RecordBatch.from_arrays([ids, links, pa.array(texts, pa.string())], ["page_id", "url", "text"])

    read_pages = rows.mapInArrow(lines, f"host string, page_id {kind}, url string, page string")
    return read_pages.join(plans, "host", "left").mapInArrow(run, f"page_id {kind}, url string, text string")
