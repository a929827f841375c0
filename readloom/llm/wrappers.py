"""HTML extraction by wrappers: union-free regular expressions inferred from pages of one host.

A page is a stream of tokens: tags of containers and of blocks, and the text of blocks between them. Streams of one host are aligned one
after the other: equal tags meet by a longest common subsequence among siblings, a tag that only some pages have becomes an optional
group, tags that follow themselves (containers up to `PERIOD` siblings in turn, blocks in any order) become repeated groups, and text
becomes a text slot. The result is a wrapper such as
`<html><body><nav>(<li>#</li>)+</nav>(<div.ad>#</div>)?<article><h1>#</h1>(<p>#</p>)+</article></body></html>`.

A wrapper's slots are sorted once for the host: out goes what lies in menus, headers, footers, sidebars, notices, adverts, forms and
reader comments by tag, class or id; in stays what lies in an article or main element, however often it is the same. There a name that
may mean more than one thing (`widget-table`) is left to the wrapper: what is the same on all of the host's pages, or mostly links,
goes, what differs stays. On pages without an article, what is left stays, but for containers that are mostly links, and short text that is the same on every
page while other slots differ, in containers that hold no text that differs. An element that holds all of a page's articles is
not judged by its class. Each page is then aligned with its host's wrapper, which gives its texts their slots; text that the wrapper
does not know is judged by its own containers. Whether there is an article is decided for each page, as templates of one host differ;
texts and links are counted apart for pages with and without one. A page that would have no text at all is read again without its names, then
with its forms and link lists.

A wrapper is inferred from all pages of a host. Tasks fold each page into a wrapper of its own and add up, for pages of equal ones, what
their slots hold: whether texts differ, and their characters. The distinct wrappers of a host are aligned in `PARTS` groups by hash,
these in `FAN` groups, and these with each other, in an order that does not depend on how rows are dealt. All pages are extracted
whole. Nothing recurses, so pages may nest as deeply as they like. Wrappers are broadcast while they are under `broadcast_bytes`
together, else joined by host.

Cases: a null or empty html gives an empty text; a null url is a page of the empty host; a null id is kept; repeated rows give
repeated rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import kept, lean, shared, table
from readloom.llm.url_filter import host_and_path

PERIOD = 3
PARTS, FAN = 4096, 64
CONTAINERS = frozenset("html head body header nav footer aside main article section div form table ul ol dl figure fieldset dialog details menu search".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote tr td th dt dd hr address figcaption caption summary option title center hgroup legend".split())
OUT_TAGS = frozenset("head nav footer aside form dialog menu search fieldset".split())
IN_TAGS = frozenset(("article", "main"))
#: Words of a class, id or role that tell what is no main text, anywhere in a name such as `site-nav-2`.
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu nav navbar navigation newsletter promo promoted promotion sidebar sponsor sponsored".split()
)
#: The same, as a name's first or last word.
OUT_ENDS = frozenset("contentinfo login notice notices notification notifications pager pagination recommended related replies reply share sharing signup social subscribe subscription topbar".split())
#: The same, of words that may name a part of an article too: within one the wrapper decides.
WEAK_ENDS = frozenset("banner complementary disclaimer form modal overlay popup toolbar widget widgets".split())
IN_WORDS = frozenset("article articlebody content entry maincontent post postbody story".split())
#: A name with one of these tells of a neighbour: `has-sidebar`.
ABOUT = frozenset("has with no without is".split())
COMMENTS = frozenset("comment comments reply".split())

#: What the end of a container's key tells: out by its name; out by its name, but within an article as the wrapper says; out like a header;
#: in by its name; a reader's comment; not to be judged by name or tag.
OUT_NAME, WEAK_NAME, HEADER_NAME, IN_NAME, COMMENT, WHOLE = "!", "%", "~", "^", "?", "+"
#: What containers say of a slot within an article, in one of weak name.
WEAK = "weak"

_RAW = "script|style|noscript|template|iframe|textarea|select|button|canvas"
#: A tag's inside up to its end, quoted values with it; nothing is tried twice.
_INSIDE = r"(?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+"


def _token(inside: str) -> re.Pattern:
    return re.compile(rf"<!--.*?(?:-->|\Z)|<({_RAW})\b{inside}>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({inside})>|<[!?][^>]*+>|[^<]++|<", re.S | re.I)


_STRICT, _LOOSE = _token(_INSIDE), _token("[^>]*+")
_TAG = re.compile("</?[a-zA-Z]")


def tokens(html: str) -> Iterator[re.Match]:
    """Comments, raw elements, tags and texts, in time that grows with the page. What follows the last `>` is text.

    A tag whose quotes don't close ends at the next `>`, as do all tags after it: looking for its end went through the whole page, which
    must not happen twice.
    """
    end = html.rfind(">") + 1
    at, pattern, last = 0, _STRICT, None
    while at < end:
        for m in pattern.finditer(html, at, end):
            if pattern is _STRICT and m[0] == "<" and _TAG.match(html, m.start()):
                at, pattern = m.start(), _LOOSE
                break
            last = m
            yield m
        else:
            at = end
    if end < len(html) and not (last and (last[0].startswith("<!--") and not last[0].endswith("-->") or last[1] and not re.search(rf"</{last[1]}\s*>\Z", last[0], re.I))):
        comment = html.find("<!--", end)
        yield _TEXT.match(html, end, comment if comment >= 0 else len(html))


#: All that is left; its groups, as those of a token, are null.
_TEXT = re.compile(r"(?:(\b\B)(\b\B)(\b\B)(\b\B))?.*", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HUMP = re.compile(r"([a-z])([A-Z])")


class Node:
    """A container with its children in order, or a slot, the text of one block: its key is `#` and the block's tag."""

    __slots__ = ("key", "kids", "link_chars", "marks", "optional", "repeated", "stats", "text", "within")

    def __init__(self, key: str, text: str | None = None, link_chars: int = 0):
        self.key, self.kids, self.text, self.link_chars = key, [], text, link_chars
        self.optional = self.repeated = False
        self.marks: list[int] | None = None
        self.stats: list[list[int] | None] = [None, None]  # of pages without and with an article
        self.within: list[Node] = []  # a page's slots that fall on this slot

    @property
    def is_slot(self) -> bool:
        return self.key[:1] == "#"

    def shape(self) -> bytes:
        """A digest of the tree's keys."""
        h, todo = hashlib.blake2b(digest_size=16), [self]
        while todo:
            n = todo.pop()
            h.update(f"{n.key}({len(n.kids)}".encode("utf-8", "surrogatepass"))
            todo += reversed(n.kids)
        return h.digest()


def _key(name: str, attributes: str) -> str:
    """The key of a container: its tag, the words of its class, id and role, and what they tell."""
    if not attributes:
        return name
    tokens = [t for g in _NAMES.findall(attributes) for t in "".join(g).split()]
    named = [[w for w in re.split(r"[^a-z]+", _HUMP.sub(r"\1-\2", t).lower()) if w] for t in tokens]
    words = sorted({w for parts in named for w in parts})
    judged = [parts for parts in named if parts and ABOUT.isdisjoint(parts)]
    end = ""
    if name in IN_TAGS:
        end = COMMENT if any(len(p) == 1 and p[0] in COMMENTS for p in judged) else ""
    elif any(not OUT_WORDS.isdisjoint(p) or p[0] in OUT_ENDS or p[-1] in OUT_ENDS for p in judged):
        end = OUT_NAME
    elif any(p[0] in WEAK_ENDS or p[-1] in WEAK_ENDS for p in judged):
        end = WEAK_NAME
    elif any("header" in (p[0], p[-1]) for p in judged):
        end = HEADER_NAME
    elif any(not IN_WORDS.isdisjoint(p) for p in judged):
        end = IN_NAME
    return ".".join([name, *words]) + end


def _step(state: bool | str | None, key: str) -> bool | str | None:
    """What a container makes of what those around it said: False: not main text, True or WEAK: within an article, None: neither."""
    if state is False:
        return False
    name, end = re.match("[a-z0-9]*", key)[0], key[-1:]
    if name in IN_TAGS:
        return not (state and end == COMMENT)
    if end == WHOLE or name in ("html", "body"):
        return state
    if name in OUT_TAGS or end == OUT_NAME or (name == "header" or end == HEADER_NAME) and not state:
        return False
    if end == WEAK_NAME:
        return WEAK if state else False
    return state or (True if end == IN_NAME else state)


def parse(html: str, names: bool = True) -> Node:
    """The page as a tree; without `names` classes and ids are not looked at."""
    root = Node("")
    stack, parts, block = [root], [], ""
    nodes: list[tuple[Node, int]] = [(root, -1)]  # containers as they come, each with the place of the one around it
    places, open_ = [0], Counter()
    links = link_chars = 0

    def end_block() -> None:
        nonlocal link_chars
        if parts and (text := " ".join("".join(parts).split())):
            stack[-1].kids.append(Node("#" + block, text, min(link_chars, len(text))))
        parts.clear()
        link_chars = 0

    for m in tokens(html):
        name = m[3]
        if name is None:
            raw = m[0]
            if raw[:1] != "<" or raw == "<" or m.re is _TEXT:
                text = unescape(raw)
                parts.append(text)
                if links:
                    link_chars += len(" ".join(text.split()))
            continue
        name, closing = name.lower(), bool(m[2])
        if name in CONTAINERS:
            end_block()
            block = ""
            if not closing:
                node = Node(_key(name, m[4]) if names else name)
                stack[-1].kids.append(node)
                nodes.append((node, places[-1]))
                places.append(len(nodes) - 1)
                stack.append(node)
                open_[name] += 1
            elif open_[name]:
                while True:
                    last = re.match("[a-z0-9]*", stack.pop().key)[0]
                    places.pop()
                    open_[last] -= 1
                    if last == name:
                        break
        elif name in BLOCKS:
            end_block()
            block = "" if closing else name
        elif name == "br":
            parts.append(" ")
        elif name == "a":
            links = max(0, links + (-1 if closing else 1))
    end_block()
    # what holds all of the page's articles isn't judged by its name, nor as a form
    held = [int(re.match("[a-z0-9]*", n.key)[0] in IN_TAGS) for n, _ in nodes]
    total = sum(held)
    for i in range(len(nodes) - 1, 0, -1):
        held[nodes[i][1]] += held[i]
    for (n, _), h in zip(nodes[1:], held[1:], strict=True):
        if total and h == total and (n.key == "form" or n.key.startswith("form.") or n.key[-1] in (OUT_NAME, WEAK_NAME, HEADER_NAME)):
            n.key = n.key.rstrip(OUT_NAME + WEAK_NAME + HEADER_NAME) + WHOLE
    return root


def fold(kids: list[Node]) -> list[tuple[Node, list[Node]]]:
    """Siblings with repeats folded: each place with all the siblings that fall on it. Slots in a row are one place for each key."""
    runs: list[tuple[Node, list[Node]]] = []
    own: dict[str, list[Node]] = {}
    for k in kids:
        if not k.is_slot:
            own = {}
            runs.append((k, [k]))
        elif k.key in own:
            own[k.key].append(k)
        else:
            own[k.key] = [k]
            runs.append((k, own[k.key]))
    keys = [k.key for k, _ in runs]
    out: list[tuple[Node, list[Node]]] = []
    i = 0
    while i < len(runs):
        for p in range(1, PERIOD + 1):
            n = 1
            while i + (n + 1) * p <= len(keys) and keys[i + n * p : i + (n + 1) * p] == keys[i : i + p]:
                n += 1
            if n > 1:
                out += [(runs[i + j][0], [x for _, same in runs[i + j : i + n * p : p] for x in same]) for j in range(p)]
                i += n * p
                break
        else:
            out.append(runs[i])
            i += 1
    return out


def aligned(a: list[str], b: list[str], most: int = 4096) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, from rows of bits; sequences of over `most` keys meet stretch by stretch."""
    if len(a) > most or len(b) > most:
        n = -(-max(len(a), len(b)) // most)
        cuts = [(len(a) * k // n, len(b) * k // n) for k in range(n + 1)]
        return [(i + x, j + y) for (i, j), (i2, j2) in zip(cuts, cuts[1:], strict=False) for x, y in aligned(a[i:i2], b[j:j2], most)]
    if a == b:
        return [(i, i) for i in range(len(a))]
    places: dict[str, int] = {}
    for j, k in enumerate(b):
        places[k] = places.get(k, 0) | 1 << j
    full = (1 << len(b)) - 1
    bits, rows = full, []  # a row's zeros: where the common subsequence of a[: i + 1] and b grows
    for k in a:
        u = bits & places.get(k, 0)
        bits = ((bits + u) | (bits - u)) & full
        rows.append(bits)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> (j - 1) & 1:
            j -= 1
            out.append((i, j))
    return out[::-1]


def folded(own: Node, page: Node) -> Node:
    """Widens `own`, a wrapper of parts of one page, by a container of equal key."""
    todo = [(own, page, True)]
    while todo:
        own_, page_, first = todo.pop()
        places = fold(page_.kids)
        pairs = aligned([k.key for k in own_.kids], [n.key for n, _ in places])
        met, at = {j: i for i, j in pairs}, 0
        for k in {*range(len(own_.kids))} - {i for i, _ in pairs}:
            own_.kids[k].optional = True
        kids: list[Node] = []
        inner = []
        for j, (node, same) in enumerate(places):
            if j in met:
                kids += own_.kids[at : met[j] + 1]
                at = met[j] + 1
            else:
                kids.append(Node(node.key))
                kids[-1].optional = not first
            place = kids[-1]
            place.repeated |= len(same) > 1
            for n, x in enumerate(same):
                if x.is_slot:
                    place.within.append(x)
                else:
                    inner.append((place, x, j not in met and n == 0))
        own_.kids = kids + own_.kids[at:]
        todo += reversed(inner)
    return own


DIFFER = -1


def added(a: list[int] | None, b: list[int] | None) -> list[int] | None:
    """What two groups of pages say of a slot: [pages, hash of its text or DIFFER, characters, characters in links, longest text]."""
    if a is None or b is None:
        return b if a is None else a
    return [a[0] + b[0], a[1] if a[1] == b[1] else DIFFER, a[2] + b[2], a[3] + b[3], max(a[4], b[4])]


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=7).digest())


def merged(a: Node, b: Node) -> Node:
    """The wrapper that fits what either of two wrappers of equal key fits; made of their nodes."""
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        x.optional |= y.optional
        x.repeated |= y.repeated
        x.stats = [added(s, t) for s, t in zip(x.stats, y.stats, strict=True)]
        pairs = aligned([k.key for k in x.kids], [k.key for k in y.kids])
        kids: list[Node] = []
        i = j = 0
        for p, q in [*pairs, (len(x.kids), len(y.kids))]:
            for k in [*x.kids[i:p], *y.kids[j:q]]:
                k.optional = True
                kids.append(k)
            if p < len(x.kids) and q < len(y.kids):
                kids.append(x.kids[p])
                todo.append((x.kids[p], y.kids[q]))
            i, j = p + 1, q + 1
        x.kids = kids
    return a


def slots(root: Node) -> list[tuple[Node, bool | None, Node]]:
    """The slots in order, each with what its containers say and with the one around it."""
    out: list[tuple[Node, bool | None, Node]] = []
    todo: list[tuple[Node, bool | None, Node]] = [(root, None, root)]
    while todo:
        n, state, around = todo.pop()
        if n.is_slot:
            out.append((n, state, around))
        else:
            state = _step(state, n.key) if n.key else state
            todo += [(k, state, n) for k in reversed(n.kids)]
    return out


#: What becomes of a slot: left out; main text of a page without an article; article; or as PLAIN, if the page's own container is not mostly links.
OUT, PLAIN, ARTICLE, OWN = 0, 1, 2, 3


def sort_slots(wrapper: Node, pages: list[list]) -> bool:
    """Marks each slot, for pages without and with an article; tells whether any page of the host has one. pages: see `Pages`."""
    loose: set[int] = set()  # slots that are repeated or within what is
    todo = [(wrapper, False)]
    while todo:
        n, repeated = todo.pop()
        for k in n.kids:
            if k.is_slot and (repeated or k.repeated):
                loose.add(id(k))
            todo.append((k, repeated or k.repeated))
    found = slots(wrapper)
    for s, _, _ in found:
        s.marks = []
    for kind, (n, some) in enumerate(pages):
        sums: dict[int, list[int]] = {}  # characters, and those in links, of a container's own slots; whether one differs
        for s, _, around in found:
            of = s.stats[kind] or [0, 0, 0, 0, 0]
            x = sums.setdefault(id(around), [0, 0, 0])
            sums[id(around)] = [x[0] + of[2], x[1] + of[3], x[2] or of[1] == DIFFER]
        differs = any(s.stats[kind][1] == DIFFER for s, v, _ in found if v is not False and s.stats[kind])
        for s, v, around in found:
            of, text, own, _, longest = s.stats[kind] or [0, DIFFER, 0, 0, 0]
            chars, links, beside = sums[id(around)]
            fixed = len(some) == SOME and differs and of == n and id(s) not in loose and text != DIFFER and longest < 80 and not beside
            # in a container of weak name what is the same on all pages, or mostly links, is no part of their articles
            same = len(some) == SOME and of == n and text != DIFFER
            s.marks.append(OUT if v is False or v == WEAK and (same or links > 0.5 * chars) else ARTICLE if v else OWN if not own else OUT if fixed or links > 0.5 * chars else PLAIN)
    return any(v for _, v, _ in found)


def regex(root: Node) -> str:
    """The wrapper as an expression: # for text, ? + * for optional and repeated groups."""
    out: list[str] = []
    todo: list[Node | str] = [root]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
            continue
        tag = n.key[1:] if n.is_slot else n.key.rstrip(OUT_NAME + WEAK_NAME + HEADER_NAME + IN_NAME + COMMENT + WHOLE)
        group = "*" if n.optional and n.repeated else "?" if n.optional else "+" if n.repeated else ""
        out.append(("(" if group else "") + (f"<{tag}>" if tag else ""))
        todo.append((f"</{tag.split('.')[0]}>" if tag else "") + (f"){group}" if group else ""))
        if n.is_slot:
            out.append("#")
        todo += reversed(n.kids)
    return "".join(out)


def _data(root: Node, stats: bool = True) -> list:
    """The nodes in order, each as [key, flags, children, stats]."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append([n.key, n.optional + 2 * n.repeated, len(n.kids), n.stats if stats and n.is_slot else 0])
        todo += reversed(n.kids)
    return out


def _node(data: list) -> Node:
    root, open_ = None, []  # nodes that lack children
    for key, flags, n_kids, stats in data:
        n = Node(key)
        n.optional, n.repeated, n.stats = bool(flags & 1), bool(flags & 2), stats or [None, None]
        if open_:
            open_[-1][0].kids.append(n)
            open_[-1][1] -= 1
        else:
            root = n
        if n_kids:
            open_.append([n, n_kids])
        while open_ and not open_[-1][1]:
            open_.pop()
    return root


#: So many different pages make fixed text.
SOME = 4


class Pages:
    """Pages of one folded shape: their number, the hashes of up to SOME different ones, and what each slot holds."""

    def __init__(self) -> None:
        self.n, self.some, self.slots = 0, [], []

    def add(self, n: int, some: list[int], slots_: list[list[int]]) -> None:
        self.n += n
        self.some = sorted({*self.some, *some})[:SOME]
        self.slots = [added(a, b) for a, b in zip(self.slots, slots_, strict=True)] if self.slots else slots_


class Tally:
    """Folded shapes of pages by host."""

    def __init__(self) -> None:
        self.of: dict[tuple[str | None, str], Pages] = {}
        self.known: dict[bytes, tuple[str, list[list[int]]]] = {}  # of a page's shape: the folded one as JSON, and which slots of the page fall on its slots

    def add(self, host: str | None, html: str) -> None:
        page = parse(html)
        own_slots = [k for k, _, _ in slots(page)]
        if (shape := page.shape()) not in self.known:
            if len(self.known) > 2000:
                self.known.clear()
            own, at = folded(Node(""), page), {id(k): i for i, k in enumerate(own_slots)}
            self.known[shape] = json.dumps(_data(own, False)), [[at[id(x)] for x in k.within] for k, _, _ in slots(own)]
        key, places = self.known[shape]
        found = []
        for place in places:
            hashes = {_hash(own_slots[i].text) for i in place}
            found.append([1, hashes.pop() if len(hashes) == 1 else DIFFER, sum(len(own_slots[i].text) for i in place), sum(own_slots[i].link_chars for i in place), max(len(own_slots[i].text) for i in place)])
        self.of.setdefault((host, key), Pages()).add(1, [_hash(html)], found)


def of_shape(shape: str, pages: Pages) -> tuple[Node, list[list]]:
    """The wrapper of pages of one folded shape, and (pages, some of them) without and with an article."""
    root = _node(json.loads(shape))
    found = slots(root)
    kind = int(any(v for _, v, _ in found))
    for (k, _, _), x in zip(found, pages.slots, strict=True):
        k.stats[kind] = x
    return root, [[pages.n, pages.some] if k == kind else [0, []] for k in range(2)]


def union(wrappers: list[tuple[Node, list[list]]]) -> tuple[Node, list[list]]:
    root, pages = wrappers[0]
    for other, more in wrappers[1:]:
        root = merged(root, other)
        pages = [[n + m, sorted({*some, *others})[:SOME]] for (n, some), (m, others) in zip(pages, more, strict=True)]
    return root, pages


def sorted_out(root: Node, pages: list[list]) -> dict:
    """The wrapper as JSON data: {article, regex, tree}; a tree lists its nodes in order as [key, children, marks]."""
    article, out, todo = sort_slots(root, pages), [], [root]
    while todo:
        n = todo.pop()
        out.append([n.key, len(n.kids), n.marks])
        todo += reversed(n.kids)
    return {"article": article, "regex": regex(root), "tree": out}


def infer(pages: list[str]) -> dict:
    """The wrapper of pages of one host."""
    tally = Tally()
    for html in pages:
        tally.add(None, html)
    return sorted_out(*union([of_shape(shape, x) for (_, shape), x in sorted(tally.of.items(), key=lambda x: x[0][1])]))


class Extractor:
    """Main text of a host's pages; pages of one shape are aligned once."""

    def __init__(self, wrapper: dict | None):
        self.tree = _node([[key, 0, n, 0] for key, n, _ in wrapper["tree"]]) if wrapper else Node("")
        todo, marks = [self.tree], iter(wrapper["tree"] if wrapper else [["", 0, None]])
        while todo:
            n = todo.pop()
            n.marks = next(marks)[2]
            todo += reversed(n.kids)
        self.seen: dict[bytes, list[int]] = {}

    def _decide(self, page: Node) -> list[int]:
        """The mark of each slot of the page in order."""
        own = slots(page)
        kind = int(any(v for _, v, _ in own))
        marks = {id(k): OUT if v is False else ARTICLE if v else OWN for k, v, _ in own}
        todo = [(page, self.tree)]
        while todo:
            node, tree = todo.pop()
            places = fold(node.kids)
            for i, j in aligned([t.key for t in tree.kids], [n.key for n, _ in places]):
                for x in places[j][1]:
                    if x.is_slot:
                        marks[id(x)] = tree.kids[i].marks[kind]
                    else:
                        todo.append((x, tree.kids[i]))
        return [marks[id(k)] for k, _, _ in own]

    def text(self, html: str) -> str:
        return self._text(html) or _only_text(html)

    def _text(self, html: str) -> str:
        page = parse(html)
        if (shape := page.shape()) not in self.seen:
            if len(self.seen) > 2000:
                self.seen.clear()
            self.seen[shape] = self._decide(page)
        marks, own = self.seen[shape], slots(page)
        if ARTICLE in marks:
            return "\n\n".join(k.text for (k, _, _), mark in zip(own, marks, strict=True) if mark == ARTICLE)
        sums: dict[int, int] = {}  # characters of a container less twice those in links
        for k, _, around in own:
            sums[id(around)] = sums.get(id(around), 0) + len(k.text) - 2 * k.link_chars
        return "\n\n".join(k.text for (k, _, around), mark in zip(own, marks, strict=True) if mark == PLAIN or mark == OWN and sums[id(around)] >= 0)


def _only_text(html: str) -> str:
    """Main text of a page on which names, forms and links leave none: what lies in no menu, header, footer or sidebar by its tag.

    Names go first; then a form is but a container, and text within it or around links is text, unless nine tenths of its container are links.
    """
    own = slots(parse(html, names=False))
    found = [k.text for k, v, _ in own if v]
    if not found:
        sums: dict[int, list[int]] = {}
        for k, _, around in own:
            x = sums.setdefault(id(around), [0, 0])
            sums[id(around)] = [x[0] + len(k.text), x[1] + k.link_chars]
        for most in (0.5, 0.9):
            found = [k.text for k, v, around in own if v is None and sums[id(around)][1] <= most * sums[id(around)][0]]
            if found:
                return "\n\n".join(found)
        page = parse(re.sub(r"(?i)<(/?)form\b", r"<\1div", html), names=False)
        found = [k.text for k, v, _ in slots(page) if v is not False and k.link_chars <= 0.9 * len(k.text)]
    return "\n\n".join(found)


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper JSON) of pages (url, html)."""
    host, _ = host_and_path(F.col("url"))

    def rows_of(tally: Tally) -> pa.RecordBatch:
        rows = [(host, zlib.crc32(shape.encode()) % PARTS, shape, json.dumps([x.n, x.some, x.slots])) for (host, shape), x in tally.of.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.string()))], ["host", "part", "shape", "pages"])

    def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for b in batches:
            for host, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                tally.add(host, html)
                if len(tally.of) >= 5000:
                    yield rows_of(tally)
                    tally.of.clear()
        yield rows_of(tally)

    def part(group: pa.Table) -> pa.Table:
        shapes: dict[str, Pages] = {}
        for shape, pages in zip(group["shape"].to_pylist(), group["pages"].to_pylist(), strict=True):
            shapes.setdefault(shape, Pages()).add(*json.loads(pages))
        root, pages = union([of_shape(x, shapes[x]) for x in sorted(shapes)])
        return pa.table({"host": group["host"].slice(0, 1), "part": group["part"].slice(0, 1), "wrapper": [json.dumps([_data(root), pages])]})

    def together(group: pa.Table) -> tuple[Node, list[list]]:
        parts = [json.loads(w) for _, w in sorted(zip(group["part"].to_pylist(), group["wrapper"].to_pylist(), strict=True))]
        return union([(_node(x), pages) for x, pages in parts])

    def fan(group: pa.Table) -> pa.Table:
        root, pages = together(group)
        return pa.table({"host": group["host"].slice(0, 1), "part": [group["part"][0].as_py() % FAN], "wrapper": [json.dumps([_data(root), pages])]}, pa.schema({"host": pa.string(), "part": pa.int32(), "wrapper": pa.string()}))

    def whole(group: pa.Table) -> pa.Table:
        return pa.table({"host": group["host"].slice(0, 1), "wrapper": [json.dumps(sorted_out(*together(group)))]})

    rows = pages.filter("html != ''").select(host.alias("host"), "html").mapInArrow(lean(tallied), "host string, part int, shape string, pages string")
    parts = rows.groupBy("host", "part").applyInArrow(part, "host string, part int, wrapper string")
    fans = parts.groupBy("host", (F.col("part") % FAN).alias("fan")).applyInArrow(fan, "host string, part int, wrapper string")
    return fans.groupBy("host").applyInArrow(whole, "host string, wrapper string")


def extract(pages: DataFrame, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """pages (page_id, url, html) -> (page_id, url, text, n_chars)."""
    wrappers = kept(infer_wrappers(pages), "wrappers")
    total = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    host, _ = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    small = total <= broadcast_bytes
    given_all = shared(pages.sparkSession, {r["host"]: r["wrapper"] for r in wrappers.collect()} if small else None)
    if not small:
        rows = rows.join(wrappers, "host", "left").select("page_id", "url", "html", "host", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, Extractor] = {}
        for b in batches:
            for first in range(0, len(b), 256):
                part = b.slice(first, 256)
                given = [given_all.value.get(h) for h in part.column("host").to_pylist()] if given_all.value is not None else part.column("wrapper").to_pylist()
                texts = []
                for html, h, w in zip(part.column("html").to_pylist(), part.column("host").to_pylist(), given, strict=True):
                    if h not in made:
                        if len(made) > 1000:
                            made.clear()
                        made[h] = Extractor(json.loads(w) if w else None)
                    texts.append(made[h].text(html) if html else "")
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op6_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
