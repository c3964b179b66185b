"""Main text of web pages by wrapper induction over the pages of a host.

1. Each page becomes a tree of its block elements; inline markup melts into the
   text of its block.  Neighbouring blocks of one kind form one slot.
2. The trees of a host are aligned by simple tree matching (the largest
   order-preserving matching of equal nodes, from the root down) and merged
   into one wrapper.
3. Every page is aligned with the merged wrapper of its host: a text slot
   counts its pages, how much text and link text it holds and, exactly, on how
   many pages each of its texts stands.  A text that recurs on
   ``CONSTANT_SHARE`` of the pages of its slot is template, text that varies
   is content, if it lies below the content root: from the top, the section
   that holds more than half of the varying text.  Sections whose element,
   role, class or id names a menu, header, footer, sidebar, notice, advert,
   form, script, style or comment list, and slots of mostly link text, are
   template too; a class or id decides only on the wrapper, and never against
   a section that holds more than half of the host's varying text.  On fewer
   than ``CONSTANT_PAGES`` pages, which show little of what varies, names still
   decide beside an article or main element with text.
4. Every page is aligned with the wrapper again and the content slots are read
   out in page order.  A page that lacks the wrapper's content root is read by
   the same rules from its own tree, without named sections that elsewhere on
   the host hold at most half as much as its pages do on average.

Scale: wrappers are built inside each task, merged first for parts of a host
and then for the host; a host with a third of all pages adds one small wrapper
a task.  Texts are counted by (host, slot, 64-bit hash of the text), added up
inside each task first: a text on all pages of a host is one row a task, and
the many texts of a hot host are spread by their hash.  Texts on fewer pages
than any constant one needs go before the counts meet the pages of their slot.
Pages meet the wrapper of their host in a plain join, which adaptive execution
broadcasts when the wrappers are few and splits when one host is hot.

Defined results: null, empty or tagless html gives the text outside tags, or
an empty string; a null url counts as the host ""; repeated rows are extracted
each; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from review_insights.llm.common import partition_id, saved

CONSTANT_SHARE = 0.6
CONSTANT_PAGES = 5
LINK_SHARE = 0.6
HOST_PARTS = 16
TASK_TEXTS = 200_000  # texts a task adds up before it passes their counts on

# FIXED VALUES: elements and names that mark template sections.
DROP_TAGS = frozenset("""head title script style noscript template nav footer aside form button select textarea iframe
svg canvas object embed dialog menu audio video map datalist""".split())
DROP_NAMES = frozenset("""nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside ad ads advert
adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice popup modal overlay
newsletter subscribe subscription signup login signin search share sharing social related recommended comment comments disqus
respond reply replies widget pagination pager toolbar skip copyright""".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q s samp
small span strike strong sub sup time tt u var wbr input meta link""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
SECTIONS = frozenset("html body div section main article center table tbody tr td #root".split())
KEEP_TAGS = frozenset("html body main article #root".split())
CLOSED_BY = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
             "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
             "option": frozenset(["option"])}
BARRIER = frozenset("ul ol dl table div section article main body html td th blockquote form aside nav header footer".split())

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Depth of a tree: deeper blocks stand side by side there.  Runs under one node beyond which each kind is
#: one run, and cells of a matching beyond which no table is filled.
MAX_DEPTH, FOLD, TABLE = 120, 32, 4_096

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
    |<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>""", re.S | re.X)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    """A block element of a page, or a ``#text`` leaf."""

    __slots__ = ("key", "tag", "kids", "text", "links", "drop", "named")

    def __init__(self, key: str, tag: str, drop: bool = False, named: bool = False, text: str = "", links: int = 0):
        self.key, self.tag, self.drop, self.named, self.text, self.links = key, tag, drop, named, text, links
        self.kids: list[Node] = []


_KEYS: dict[tuple[str, str, bool], tuple[str, bool, bool]] = {}


def _describe(tag: str, attributes: str, in_article: bool) -> tuple[str, bool, bool]:
    """Alignment key of an element, whether its kind makes it a template section,
    and whether its class or id names one.  Neither shares a key with a plain one."""
    if not attributes:
        return tag, tag in DROP_TAGS or (tag == "header" and not in_article), False
    known = _KEYS.get((tag, attributes, in_article))
    if known:
        return known
    names: list[str] = []
    classes = ""
    drop = tag in DROP_TAGS or (tag == "header" and not in_article)
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "class":
            classes = " ".join(sorted(_NAME.findall(value))).lower()
        if name in ("class", "id"):
            names += [n.lower() for n in _NAME.findall(value)]
        elif name == "role":
            drop = drop or (value.lower() in DROP_ROLES and tag not in KEEP_TAGS)
        elif tag not in KEEP_TAGS:
            drop = drop or name == "hidden" or value.lower() == "true"
    named = tag not in KEEP_TAGS and any(n in DROP_NAMES and not (n == "header" and in_article) for n in names)
    key = f"{tag}.{classes}" if classes else tag
    out = (key + "!" * drop + "?" * named, drop, named)
    if len(_KEYS) > 20_000:
        _KEYS.clear()
    _KEYS[(tag, attributes, in_article)] = out
    return out


def parse(source: str | None) -> Node:
    """The tree of block elements of a page."""
    root = Node("#root", "#root")
    stack = [root]
    articles = [False]          # for every open element, whether it stands in an article
    opened: Counter = Counter()  # open elements by tag
    text: list[str] = []
    aside: list[str] = []       # text of inline elements whose name marks template, a section of its own
    inline: list[str] = []      # open inline elements of the current block
    muted = hushed = 0          # open inline elements that are template, by their kind and by their name
    links = aside_links = 0

    def flush() -> None:
        nonlocal links, aside_links
        joined = " ".join("".join(text).split())
        if joined:
            leaf = Node("#text", "#text", text=joined, links=min(links, len(joined)))
            stack[-1].kids.append(leaf)
        text.clear()
        links = 0
        if aside:
            joined = " ".join("".join(aside).split())
            if joined:
                named = Node("#named?", "#named", named=True)
                named.kids.append(Node("#text", "#text", text=joined, links=min(aside_links, len(joined))))
                stack[-1].kids.append(named)
            aside.clear()
            aside_links = 0

    def add(piece: str) -> None:
        nonlocal links, aside_links
        if muted or not piece:
            return
        if "&" in piece:
            piece = html.unescape(piece)
        if hushed:
            aside.append(piece)
            aside_links += len(piece) * ("a" in inline or "?a" in inline)
            return
        text.append(piece)
        if "a" in inline:
            links += len(piece)

    def close(i: int) -> None:
        for n in stack[i:]:
            opened[n.tag] -= 1
        del stack[i:], articles[i:]

    source = source or ""
    at, end, last = 0, len(source), (source or "").rfind(">")
    while at < end:
        m = _TOKEN.search(source, at, last + 1) if at <= last else None  # no tag ends behind the last ">"
        if m is None:
            comment = source.find("<!--", at)
            add(source[at:] if comment < 0 else source[at:comment])
            break
        if m.start() > at:
            add(source[at:m.start()])
        at = m.end()
        if m[0].startswith("<!--") and not m[0].endswith("-->"):
            break  # never closed
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                add(" ")
            elif closing:
                for i in range(len(inline) - 1, -1, -1):
                    if inline[i].lstrip("!?") == tag:
                        muted -= sum(x[0] == "!" for x in inline[i:])
                        hushed -= sum(x[0] == "?" for x in inline[i:])
                        del inline[i:]
                        break
            elif tag not in VOID and not attributes.endswith("/"):
                _, drop, named = _describe(tag, attributes, True) if attributes else (tag, False, False)
                inline.append("!" + tag if drop else "?" + tag if named else tag)
                muted += drop
                hushed += named and not drop
            continue
        flush()
        inline.clear()
        muted = hushed = 0
        if closing:
            for i in range(len(stack) - 1 if opened[tag] else 0, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if tag not in BARRIER and stack[i].tag in BARRIER:
                    break
            continue
        shut = CLOSED_BY.get(tag)
        for i in range(len(stack) - 1 if opened["p"] or (shut and any(opened[x] for x in shut)) else 0, 0, -1):
            below = stack[i].tag
            if below == "p" or (shut and below in shut):
                close(i)
                if not (shut and below == "p"):
                    break
            elif below in BARRIER and not (tag == "tr" and below in ("td", "th")):
                break
        key, drop, named = _describe(tag, attributes.strip().rstrip("/"), articles[-1])
        node = Node(key, tag, drop, named)
        if len(stack) < MAX_DEPTH or ((drop or named) and not (stack[-1].drop or stack[-1].named)):
            stack[-1].kids.append(node)
        else:
            node.kids, node.drop, node.named = stack[-1].kids, stack[-1].drop, stack[-1].named  # its blocks stand beside it
        if tag in RAW:
            ended = re.compile(f"</{tag}", re.I).search(source, at)
            at = ended.start() if ended else end
        if (ended if tag in RAW else tag not in VOID and not attributes.endswith("/")):
            stack.append(node)
            articles.append(articles[-1] or tag == "article")
            opened[tag] += 1
    flush()
    return root


class Slot:
    """A node of a wrapper: all neighbouring blocks of one kind, over all pages."""

    __slots__ = ("key", "tag", "drop", "named", "pages", "leaves", "chars", "links", "kids", "content", "inside", "large", "fixed", "fixed_leaves")

    def __init__(self, key: str, tag: str, drop: bool, named: bool):
        self.key, self.tag, self.drop, self.named = key, tag, drop, named
        self.pages = self.leaves = self.chars = self.links = 0
        self.kids: list[Slot] = []
        self.content = self.inside = self.large = False
        self.fixed: set[int] = set()
        self.fixed_leaves = 0

    def as_list(self) -> list:
        return [self.key, self.tag, int(self.drop), int(self.named), [k.as_list() for k in self.kids]]

    @staticmethod
    def of_list(x: list) -> Slot:
        s = Slot(x[0], x[1], bool(x[2]), bool(x[3]))
        s.kids = [Slot.of_list(k) for k in x[4]]
        return s


class Run:
    """Neighbouring children of one key in a page."""

    __slots__ = ("key", "nodes", "kids")

    def __init__(self, key: str):
        self.key, self.nodes = key, []
        self.kids: list[Run] = []


def runs_of(nodes: list[Node]) -> list[Run]:
    """The children of ``nodes`` as slots: runs of equal keys, each kind of a second
    and later node joined to the slot it has already.  More than ``FOLD`` runs (blocks of a few kinds in
    turns) are one run a kind."""
    out: list[Run] = []
    for i, node in enumerate(nodes):
        seen = {r.key: r for r in out} if i else None
        last = None
        for kid in node.kids:
            if seen is not None and kid.key in seen:
                last = seen[kid.key]
            elif last is None or last.key != kid.key:
                last = Run(kid.key)
                out.append(last)
            last.nodes.append(kid)
    if len(out) > FOLD and len({r.key for r in out}) < len(out):
        folded: dict[str, Run] = {}
        for r in out:
            folded.setdefault(r.key, Run(r.key)).nodes.extend(r.nodes)
        out = list(folded.values())
    for r in out:
        if not r.nodes[0].drop and r.key != "#text":
            r.kids = runs_of(r.nodes)
    return out


def mark_of(text: str) -> int:
    """A 64-bit hash of a text for the counts of recurring texts."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def skeleton(runs: list[Run]) -> str:
    return "".join(f"{r.key}({skeleton(r.kids)})" if r.kids else f"{r.key}," for r in runs)


def match(left: list, right: list, known: dict | None = None) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two child lists: size and pairs of the largest
    order-preserving matching of children with equal keys.

    ``known`` keeps the sizes of pairs of subtrees that were matched before.  Lists beyond ``TABLE`` cells
    (of many kinds, as runs of one kind are folded) are matched by the longest common order of kinds."""
    known = {} if known is None else known
    m, n = len(left), len(right)
    if m == 0 or n == 0:
        return 0, []

    def size(a, b) -> int:
        at = (id(a), id(b))
        if at not in known:
            known[at] = 1 + match(a.kids, b.kids, known)[0]
        return known[at]

    if [x.key for x in left] == [x.key for x in right] and len({x.key for x in left}) == m:
        return sum(size(a, b) for a, b in zip(left, right)), [(i, i) for i in range(m)]
    if m * n > TABLE:
        pairs = common_order([x.key for x in left], [x.key for x in right])
        return sum(size(left[i], right[j]) for i, j in pairs), pairs
    weight = [[size(a, b) if a.key == b.key else 0 for b in right] for a in left]
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m):
        for j in range(n):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + weight[i][j])
    pairs, i, j = [], m, n
    while i and j:
        if weight[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + weight[i - 1][j - 1]:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[m][n], pairs[::-1]


def common_order(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """The longest pairing, in order, of the first places of equal keys (patience sorting, no table)."""
    first: dict[str, int] = {}
    for i, key in enumerate(left):
        first.setdefault(key, i)
    tops: list[int] = []
    ends: list[tuple[int, int, int]] = []   # place left, place right, the pair before
    piles: list[int] = []
    for j, key in enumerate(right):
        i = first.pop(key, None)
        if i is None:
            continue
        at = bisect.bisect_left(tops, i)
        ends.append((i, j, piles[at - 1] if at else -1))
        tops[at:at + 1] = [i]
        piles[at:at + 1] = [len(ends) - 1]
    out, at = [], piles[-1] if piles else -1
    while at >= 0:
        out.append(ends[at][:2])
        at = ends[at][2]
    return out[::-1]


def align(slots: list[Slot], runs: list[Run], add: bool, known: dict | None = None) -> list[tuple[Run, Slot | None]]:
    """Pairs of page runs and wrapper slots, from the top down; with ``add`` the
    wrapper gets a slot for every run it lacks."""
    known = {} if known is None else known
    pairs = dict((j, i) for i, j in match(slots, runs, known)[1])
    out: list[tuple[Run, Slot | None]] = []
    at, shift = 0, 0
    for j, run in enumerate(runs):
        if j in pairs:
            slot = slots[pairs[j] + shift]
            at = pairs[j] + shift + 1
        elif add:
            slot = Slot(run.key, run.nodes[0].tag, run.nodes[0].drop, run.nodes[0].named)
            slots.insert(at, slot)
            at, shift = at + 1, shift + 1
        else:
            slot = None
        out.append((run, slot))
        if run.kids:
            out += align(slot.kids if slot is not None else [], run.kids, add, known)
    return out


def _flat(runs: list[Run]) -> list[Run]:
    out = []
    for r in runs:
        out.append(r)
        if r.kids:
            out += _flat(r.kids)
    return out


class Wrapper:
    """Merged tree of the pages of one host."""

    def __init__(self, slots: list[Slot] | None = None):
        self.slots = slots or []
        self._known: dict[str, list[Slot | None]] = {}

    def paired(self, runs: list[Run], add: bool) -> list[tuple[Run, Slot | None]]:
        shape = skeleton(runs)
        slots = self._known.get(shape)
        if slots is not None:
            return list(zip(_flat(runs), slots))
        pairs = align(self.slots, runs, add)
        if len(self._known) < 2_000:
            self._known[shape] = [s for _, s in pairs]
        return pairs

    def learn(self, runs: list[Run]) -> None:
        self.paired(runs, add=True)

    def count(self, runs: list[Run]) -> list[tuple[Slot, set[int]]]:
        """Adds a page to the counts of its slots; the text slots and their texts."""
        out = []
        for run, slot in self.paired(runs, add=False):
            if slot is None:
                continue
            slot.pages += 1
            if run.key == "#text":
                slot.leaves += len(run.nodes)
                slot.chars += sum(len(n.text) for n in run.nodes)
                slot.links += sum(n.links for n in run.nodes)
                out.append((slot, {mark_of(n.text) for n in run.nodes}))
        return out

    def numbered(self) -> list[Slot]:
        """All slots, from the top down."""
        out: list[Slot] = []
        stack = self.slots[::-1]
        while stack:
            out.append(stack.pop())
            stack += out[-1].kids[::-1]
        return out

    def absorb(self, other: Wrapper) -> None:
        self._known.clear()
        self._absorb(self.slots, other.slots)

    def _absorb(self, mine: list[Slot], more: list[Slot]) -> None:
        pairs = dict((j, i) for i, j in match(mine, more)[1])
        at, shift = 0, 0
        for j, slot in enumerate(more):
            if j in pairs:
                own = mine[pairs[j] + shift]
                at = pairs[j] + shift + 1
                self._absorb(own.kids, slot.kids)
            else:
                mine.insert(at, slot)
                at, shift = at + 1, shift + 1

    def settle(self) -> Wrapper:
        """Mark the content slots."""
        def varying(slot: Slot) -> float:
            if slot.drop:
                return 0
            if slot.key == "#text":
                if slot.links >= LINK_SHARE * max(slot.chars, 1):
                    return 0
                return max(0.0, slot.chars * (1 - slot.fixed_leaves / max(slot.leaves, 1)))
            return sum(map(varying, slot.kids))

        half = sum(map(varying, self.slots)) / 2
        pages = max((s.pages for s in self.slots), default=0)
        for slot in self.numbered():    # more than half of a page's text, where it stands
            slot.large = slot.named and varying(slot) * pages > half * slot.pages

        def told(slot: Slot, named: bool) -> bool:
            """Whether an article or main element holds text, in named sections too or outside them only."""
            return not slot.drop and (named or not slot.named) and (
                (slot.tag in ("article", "main") and varying(slot) > 0) or any(told(k, named) for k in slot.kids))

        # few pages do not show what varies: an article outside then speaks for the names
        few = pages < CONSTANT_PAGES and any(told(s, False) for s in self.slots)
        gone: set[int] = set()

        def names(slot: Slot, inside: bool) -> None:
            if slot.named and (varying(slot) <= half or (few and not inside and not told(slot, True))):
                gone.add(id(slot))
            for k in slot.kids:
                names(k, inside or slot.tag in ("article", "main"))

        for slot in self.slots:
            names(slot, False)

        def useful(slot: Slot) -> float:
            """The varying text, without named sections unless one holds more than half of the host's."""
            if slot.drop or id(slot) in gone:
                return 0
            return sum(map(useful, slot.kids)) if slot.kids else varying(slot)

        def mark(slot: Slot) -> None:
            if useful(slot):
                slot.content = True
                for k in slot.kids:
                    mark(k)

        level = self.slots
        while True:
            mass = [useful(s) for s in level]
            top = max(range(len(level)), key=mass.__getitem__, default=None)
            if top is None or level[top].tag not in SECTIONS or 2 * mass[top] <= sum(mass):
                break
            if level[top].named and mass[top] < sum(mass):     # its name still speaks against its being the root
                break
            level = level[top].kids
        for s in level:
            mark(s)
        below = list(level)
        while below:
            below[-1].inside = True
            below += below.pop().kids
        return self

    def to_json(self) -> str:
        return json.dumps([s.as_list() for s in self.slots])

    @staticmethod
    def of_json(text: str, counts: str | None = None) -> Wrapper:
        """``counts``: rows ``slot, mark, pages, leaves, chars, links``, of a whole slot
        (no mark) or of a text that recurs on ``CONSTANT_SHARE`` of its pages."""
        out = Wrapper([Slot.of_list(s) for s in json.loads(text)])
        slots = out.numbered() if counts else []
        for number, mark, pages, leaves, chars, links in json.loads(counts or "[]"):
            slot = slots[number]
            if mark is None:
                slot.pages, slot.leaves, slot.chars, slot.links = pages, leaves, chars, links
            else:
                slot.fixed.add(mark)
                slot.fixed_leaves += pages
        return out


def extract(page: Node, wrapper: Wrapper | None) -> str:
    """Texts of the content slots of a page, in page order, one line a block.  A heading that recurs on the
    host's pages stays where varying text follows it directly, inside the root of the content."""
    runs = runs_of([page])
    for settled in (wrapper, None):
        if settled is None:
            if wrapper is not None:     # what is little on this host's pages does not become the text of an empty one
                for run, slot in wrapper.paired(runs, add=False):
                    if slot is not None and slot.named and not slot.large:
                        for n in run.nodes:
                            n.drop = True
                runs = runs_of([page])
            settled = Wrapper()
            settled.learn(runs)
            settled.count(runs)
            settled.settle()
        content = {id(n) for run, slot in settled.paired(runs, add=False) if slot is not None and slot.content
                   for n in run.nodes if not slot.fixed or mark_of(n.text) not in slot.fixed}
        inside = {id(n) for run, slot in settled.paired(runs, add=False) if slot is not None and slot.inside for n in run.nodes}
        out: list[str] = []
        stack = [(n, None) for n in reversed(page.kids)]   # nodes and the path above them
        headings: list[tuple[str, Node]] = []              # recurring ones just passed, and where they stand
        while stack:
            node, path = stack.pop()
            if node.drop:
                continue
            if node.key != "#text":
                stack.extend((k, (node, path)) for k in reversed(node.kids))
            elif id(node) in content:
                if headings:
                    above = set()
                    while path is not None:
                        above.add(id(path[0]))
                        path = path[1]
                    out += [text for text, place in headings if id(place) in above]
                    headings = []
                out.append(node.text)
            elif path is not None and path[1] is not None and path[0].tag in HEADINGS and id(path[0]) in inside and not path[0].named:
                headings.append((node.text, path[1][0]))
            else:
                headings = []
        if out:
            return "\n".join(out)
    return ""


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, Wrapper] = {}
    for batch in batches:
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            if host not in found:
                if len(found) >= 5_000:
                    yield _wrappers(found)
                    found = {}
                found[host] = Wrapper()
            found[host].learn(runs_of([parse(source)]))
    yield _wrappers(found)


def _wrappers(found: dict[str, Wrapper]) -> pa.RecordBatch:
    part = partition_id() % HOST_PARTS
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([part] * len(found), pa.int32()),
                                       pa.array([w.to_json() for w in found.values()], pa.string())], names=["host", "part", "wrapper"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by host and part: wrappers of one (host, part) become one."""
    current, merged = None, None

    def emit() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([current[0]], pa.string()), pa.array([current[1]], pa.int32()),
                                           pa.array([merged.to_json()], pa.string())], names=["host", "part", "wrapper"])

    for batch in batches:
        for host, part, text in zip(*(batch.column(c).to_pylist() for c in ("host", "part", "wrapper"))):
            if (host, part) == current:
                merged.absorb(Wrapper.of_json(text))
                continue
            if current is not None:
                yield emit()
            current, merged = (host, part), Wrapper.of_json(text)
    if current is not None:
        yield emit()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the slots (no mark) and of their texts, as far as a task sees them."""
    schema = pa.schema([("host", pa.string()), ("slot", pa.int32())]
                       + [(c, pa.int64()) for c in ("mark", "pages", "leaves", "chars", "links")])
    known: dict[str, Wrapper] = {}
    number: dict[int, int] = {}
    texts: dict[tuple[str, int, int], int] = {}

    def flush() -> pa.RecordBatch:
        rows = []
        for host, wrapper in known.items():
            for i, slot in enumerate(wrapper.numbered()):
                if slot.pages:
                    rows.append((host, i, None, slot.pages, slot.leaves, slot.chars, slot.links))
                    slot.pages = slot.leaves = slot.chars = slot.links = 0
        rows += [(*k, n, 0, 0, 0) for k, n in texts.items()]
        texts.clear()
        columns = zip(*rows) if rows else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)

    for batch in batches:
        for host, source, wrapper in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "wrapper"))):
            if len(texts) >= TASK_TEXTS or (host not in known and len(known) >= 5_000):
                yield flush()
            if host not in known:
                if len(known) >= 5_000:
                    known.clear()
                    number.clear()
                known[host] = Wrapper.of_json(wrapper)
                number.update((id(s), i) for i, s in enumerate(known[host].numbered()))
            for slot, marks in known[host].count(runs_of([parse(source)])):
                for mark in marks:
                    key = (host, number[id(slot)], mark)
                    texts[key] = texts.get(key, 0) + 1
    yield flush()


def _with_host(pages: DataFrame, url_col: str, html_col: str, *more) -> DataFrame:
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    return pages.select(*more, host.alias("host"), F.col(html_col).cast("string").alias("html"))


def induce_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, wrapper, counts`` (JSON), from all pages of every host."""
    schema = "host string, part int, wrapper string"
    source = _with_host(pages, url_col, html_col)
    parts = source.mapInArrow(_learn, schema)
    parts = parts.repartition("host", "part").sortWithinPartitions("host", "part").mapInArrow(_merge, schema)
    whole = parts.select("host", F.lit(0).alias("part"), "wrapper").repartition("host").sortWithinPartitions("host")
    wrappers = saved(whole.mapInArrow(_merge, schema).select("host", "wrapper"), "wrappers")

    numbers = ("pages", "leaves", "chars", "links")
    counts = (source.join(wrappers, "host").select("host", "html", "wrapper")
              .mapInArrow(_count, "host string, slot int, mark long, " + ", ".join(f"{c} long" for c in numbers))
              .groupBy("host", "slot", "mark").agg(*[F.sum(c).alias(c) for c in numbers])
              .where(F.col("mark").isNull() | (F.col("pages") >= CONSTANT_SHARE * CONSTANT_PAGES)))
    counts = saved(counts, "slot_texts")
    slots, texts = counts.where(F.col("mark").isNull()), counts.where(F.col("mark").isNotNull())
    fixed = (texts.join(slots.select("host", "slot", F.col("pages").alias("of")), ["host", "slot"])
             .where((F.col("of") >= CONSTANT_PAGES) & (F.col("pages") >= CONSTANT_SHARE * F.col("of"))).drop("of"))
    row = F.array(*[F.col(c).cast("long") for c in ("slot", "mark", *numbers)])
    by_host = slots.unionByName(fixed).groupBy("host").agg(F.to_json(F.collect_list(row)).alias("counts"))
    return saved(wrappers.join(by_host, "host", "left").select("host", "wrapper", "counts"), "wrappers")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``."""
    wrappers = induce_wrappers(pages, url_col, html_col)
    source = _with_host(pages, url_col, html_col, F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper | None] = {}
        for batch in batches:
            texts = []
            for host, source_, wrapper, counts in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "wrapper", "counts"))):
                if host not in known:
                    if len(known) >= 5_000:
                        known.clear()
                    known[host] = Wrapper.of_json(wrapper, counts).settle() if wrapper else None
                texts.append(extract(parse(source_), known[host]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return (source.join(wrappers, "host", "left").select("page_id", "url", "host", "html", "wrapper", "counts")
            .mapInArrow(run, "page_id long, url string, text string, n_chars long"))
