"""Main text of web pages by wrapper induction: same-host pages' trees are aligned by simple tree matching into a template."""

from __future__ import annotations

import html
import json
import re
import sys
from collections import OrderedDict
from collections.abc import Iterator
from hashlib import blake2b, sha256
from itertools import accumulate
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivane.llm.common import by_value, materialise, text_of

#: A block with so large a share in links is a menu, on pages without articles.
LINKS = 0.8
#: Distinct pages of a host that a node must stand on to be template, at least, and least share of them; a host's sections have templates of their own.
PAGES, SHARE = 4, 0.02
#: A text is constant if it stands on so large a share of the pages that have its node.
CONSTANT = 0.5
#: The content slot is the deepest element that holds so large a share of its parent's varying text.
CONTENT = 0.75
#: Texts that a template's node counts; beyond them the rarest give way, and what counts may lack is known.
TEXTS = 64
#: A template of more nodes loses those on so few of the pages merged so far (a part of SHARE) that they can't become template.
NODES, RARE = 4096, SHARE / 4
#: Two lists of children with more possible pairs are matched by rows of a band, with the same pairs: places off the diagonal that
#: are tried first, and numbers that a table of rows or of weights may hold (rows beyond them are made again where they are needed).
PAIRS, BAND, CELLS = 4096, 8, 1 << 22
#: Calls that a worker may nest, as trees are as deep as their pages.
DEEP = 100_000
#: Templates are broadcast if they hold no more bytes than this in all, else joined by a shuffle.
BROADCAST_BYTES = 8 << 20
#: Groups that the partial templates of one host are first merged in.
SALTS = 32

# HTML's elements by what they mean here.
RAW = {"script", "style", "template", "iframe", "noembed", "noframes", "xmp", "textarea", "title"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var".split())
NEVER = set("nav footer aside form script style noscript template iframe svg canvas button select option textarea input object embed video audio map dialog menu head title".split())
MAIN = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PROSE = HEADINGS | set("p li tr td th dt dd blockquote pre figure figcaption ul ol dl table thead tbody tfoot".split())
BOILERPLATE = re.compile(
    r"(?:^|[^a-z])(?:nav|navbar|navigation|menu|header|masthead|footer|sidebar|side|aside|widget|ads?|adverts?|advertisement|advertorial|banner|sponsor(?:ed)?|promo|promotion|cookies?|consent|gdpr|notice|notification|alert|popup|modal|"
    r"overlay|newsletter|subscribe|subscription|signup|login|search|breadcrumbs?|pagination|pager|share|sharing|social|related|recommend(?:ed|ations)?|comments?|commentlist|replies|responses|discussion|disqus|toolbar|topbar|toast|disclaimer|skip|copyright|legal|hidden)(?:$|[^a-z])"
)
CLOSES = {  # what an opening tag closes, up to the element that holds such elements
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
_TAG = re.compile(r"""<(?:!--(?P<note>.*?)(?:--!?>|\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']++|"[^"]*"|'[^']*')*+)>|/?[a-zA-Z][^>]*(?:>|\Z)|[!?/][^>]*(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")


class Node:
    """An element, or like siblings together. out: it or an ancestor is no part of main text; main: within an article."""

    __slots__ = ("children", "label", "like", "main", "out", "tag", "texts")

    def __init__(self, tag: str, label: str, out: bool, main: bool):
        self.tag, self.label, self.out, self.main = tag, label, out, main
        self.children: list[Node] = []
        self.like: dict[tuple[str, bool], Node] = {}  # its paragraphs, headings and cells
        self.texts: list[tuple[int, int]] = []  # hash and characters outside links of each


def _open(parent: Node, tag: str, rest: str) -> Node:
    names, out, hidden = [], tag in NEVER, False
    if rest and "=" in rest or "hidden" in rest:
        for name, a, b, c in _ATTRIBUTE.findall(rest):
            name, value = name.lower(), (a or b or c).lower()
            if name in ("class", "id"):
                names.append(value)
            elif name == "role":
                out |= value in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar")
            elif name == "hidden" and not value or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                hidden = True
    named = " ".join(names)
    if named and tag not in ("body", "html", "article", "main"):
        found = BOILERPLATE.search(named)
        out |= bool(found) and not (parent.main and "header" in found[0])  # an article's own header holds its title
    main = parent.main or tag in MAIN
    if tag == "header" and not parent.main:
        out = True
    label = tag + ("." + _DIGITS.sub("#", named) if named else "")
    out = out or hidden or parent.out
    # Like paragraphs, headings and cells of one parent are one node, wherever they stand; so is a run of like containers with a class.
    last = parent.children[-1] if named and parent.children else None
    same = parent.like.get((label, out)) if tag in PROSE else last if last is not None and (last.label, last.out) == (label, out) else None
    if same is not None:
        return same
    node = Node(tag, label, out, main)
    parent.children.append(node)
    if tag in PROSE:
        parent.like[label, out] = node
    return node


def text_hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=7).digest())


def parse(page: str) -> tuple[Node, list[tuple[Node, str, float]]]:
    """The tree of block elements and the page's blocks of text, each with its element and the share of it in links, in page order."""
    root = Node("", "", False, False)
    stack: list[tuple[str, Node]] = [("", root)]  # inline elements stand with the block they are in, unless they are left out
    blocks: list[tuple[Node, str, float]] = []
    held: list[str] = []
    linked: list[int] = []  # characters within links, of what is held

    def flush() -> None:
        if held:
            node = stack[-1][1]
            if text := _SPACE.sub(" ", html.unescape("".join(held))).strip():
                share = sum(linked) / max(1, sum(len(h) - h.count(" ") for h in held))
                blocks.append((node, text, share))
                node.texts.append((text_hash(text), round(len(text) * max(0.0, 1 - share))))
            held.clear()
            linked.clear()

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        text = page[at:] if m is None else page[at : m.start()]
        if text:
            held.append(text)
            inside = next((t for t, _ in reversed(stack) if t == "a" or t not in INLINE), "")
            if inside == "a":
                linked.append(len(text) - text.count(" "))
        if m is None:
            break
        at, name = m.end(), m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    if any(t not in INLINE or n is not stack[k - 1][1] for t, n in stack[k:]):
                        flush()
                    del stack[k:]
                    break
                if name in INLINE and stack[k][0] not in INLINE:
                    break  # a stray end tag of an inline element
            else:
                if name == "p":
                    flush()
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in INLINE:
            if stack[-1][1].out or not m["rest"].strip():
                stack.append((name, stack[-1][1]))
            else:
                probe = _open(Node("", "", False, True), name, m["rest"])
                if probe.out:
                    flush()
                    stack.append((name, _open(stack[-1][1], name, m["rest"])))
                else:
                    stack.append((name, stack[-1][1]))
            continue
        flush()
        if name in CLOSES:
            shut, within = CLOSES[name]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in within:
                    break
                if stack[k][0] in shut:
                    del stack[k:]
                    break
        else:
            for k in range(len(stack) - 1, 0, -1):  # a block closes the paragraph that is open
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] not in INLINE:
                    break
        if not m["rest"].rstrip().endswith("/") or name not in ("svg", "path"):
            stack.append((name, _open(stack[-1][1], name, m["rest"])))
    flush()
    return root, blocks


LABEL, CHILDREN, TAG, OUT, COUNT, SIZE, KEPT, LACK, OF = range(9)
# A template's node: label, children, tag, out, pages, characters outside links, {hash: [pages, characters]} of texts, what such
# a count may lack, and the page's own node. A finished one: label, children, tag, out, chrome, content, constant texts.


def as_template(node: Node) -> list:
    texts: dict[int, list[int]] = {}
    for h, n in node.texts:
        texts.setdefault(h, [1, n])
    return [node.label, [as_template(c) for c in node.children], node.tag, node.out, 1, sum(n for _, n in node.texts), texts, 0, node]


def flat(template: list, fields: int) -> str:
    """A template as JSON, node by node with its number of children, so that depth doesn't matter."""
    out, todo = [], [template]
    while todo:
        t = todo.pop()
        out.append([len(t[CHILDREN]), t[LABEL], *([[h, *x] for h, x in f.items()] if isinstance(f, dict) else f for f in t[TAG:fields])])
        todo += reversed(t[CHILDREN])
    return json.dumps(out, separators=(",", ":"))


def unflat(text: str) -> list:
    root: list = []
    todo: list[tuple[list, int]] = [(root, 1)]
    for n, label, *rest in json.loads(text):
        if len(rest) > KEPT - TAG + 1:
            rest[KEPT - TAG] = {h: x for h, *x in rest[KEPT - TAG]}
        t = [label, [], *rest]
        while todo[-1][1] == 0:
            todo.pop()
        held, left = todo[-1]
        held.append(t)
        todo[-1] = (held, left - 1)
        todo.append((t[CHILDREN], n))
    return root[0]


Pairs = list[tuple[int, int, list]]


class Shapes:
    """Of one matching: the numbers of its nodes' trees (equal trees of labels have one), how many nodes each has, and how many can be paired of two."""

    __slots__ = ("numbers", "of", "sizes", "weights")

    def __init__(self):
        self.numbers: dict[tuple, int] = {}
        self.of: dict[int, int] = {}
        self.sizes: list[int] = []
        self.weights: dict[tuple[int, int], int] = {}

    def learn(self, forest: list[list]) -> list[int]:
        order, todo = [], list(forest)
        while todo:
            t = todo.pop()
            if id(t) not in self.of:
                order.append(t)
                todo += t[CHILDREN]
        for t in reversed(order):
            below = [self.of[id(c)] for c in t[CHILDREN]]
            k = self.of[id(t)] = self.numbers.setdefault((t[LABEL], *below), len(self.sizes))
            if k == len(self.sizes):
                self.sizes.append(1 + sum(self.sizes[c] for c in below))
        return [self.of[id(t)] for t in forest]

    def weight(self, x: list, y: list) -> int:
        """The most nodes that can be paired of two trees whose roots have one label."""
        k = self.of[id(x)], self.of[id(y)]
        if k[0] == k[1]:
            return self.sizes[k[0]]
        if k not in self.weights:
            w = 1 + match(x[CHILDREN], y[CHILDREN], self, False)[0]
            if self.sizes[k[0]] * self.sizes[k[1]] <= PAIRS and len(self.weights) > CELLS // 8:
                return w
            self.weights[k] = w  # large trees always: long lists within long lists would be matched anew for each list around them
        return self.weights[k]


def match(a: list[list], b: list[list], shapes: Shapes | None = None, paired: bool = True) -> tuple[int, Pairs]:
    """Simple tree matching of two ordered forests: the most nodes that can be paired by label in order, and the pairs of
    roots, each with the pairs below (none unless paired; shapes has to know the trees then). No child is left out, however
    many there are; of several best matchings the one whose pairs stand last is taken, whatever the lists' lengths."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0, []
    shapes = shapes or Shapes()
    if n * m > PAIRS:
        return _match_long(a, b, shapes, paired)
    below: dict[tuple[int, int], tuple[int, Pairs]] = {}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            if x[LABEL] == y[LABEL]:
                below[i, j] = match(x[CHILDREN], y[CHILDREN], shapes) if paired else (shapes.weight(x, y) - 1, [])
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        row, up = best[i], best[i - 1]
        for j in range(1, m + 1):
            w = below.get((i - 1, j - 1))
            row[j] = max(up[j], row[j - 1], up[j - 1] + 1 + w[0] if w else 0)
    pairs, i, j = [], n if paired else 0, m
    while i and j:
        w = below.get((i - 1, j - 1))
        if w and best[i][j] == best[i - 1][j - 1] + 1 + w[0]:
            i, j = i - 1, j - 1
            pairs.append((i, j, w[1]))
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[n][m], pairs[::-1]


def _match_long(a: list[list], b: list[list], shapes: Shapes, paired: bool) -> tuple[int, Pairs]:
    """match's own table, row by row, of the places j - i from low to high only. Whatever leaves them skips over `off` children
    of both lists, so that if the best within exceeds what the others could reach, all best matchings are within; else the band grows."""
    n, m = len(a), len(b)
    own, other = shapes.learn(a), shapes.learn(b)
    kinds = {s: k for k, s in enumerate(dict.fromkeys(other))}
    first = dict(zip(reversed(other), reversed(b), strict=True))
    first = [first[s] for s in kinds]
    labelled: dict[str, list[int]] = {}
    for k, y in enumerate(first):
        labelled.setdefault(y[LABEL], []).append(k)
    known: OrderedDict[int, np.ndarray] = OrderedDict()  # of a's shapes, the weights with b's; -1: not yet known

    label = {name: k for k, name in enumerate(labelled)}
    kind = np.array([*(label[y[LABEL]] for y in first), -2])
    size = np.array([*(shapes.sizes[s] for s in kinds), 0], np.int32)

    def most(i: int, at: np.ndarray) -> np.ndarray:
        """No less than the weights, by sizes alone."""
        return np.where(kind[at] == label.get(a[i][LABEL], -1), np.minimum(size[at], np.int32(shapes.sizes[own[i]])), np.int32(0))

    def weights(i: int, at: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
        row = known.get(own[i])
        if row is None:
            while len(known) * len(first) > CELLS:
                known.popitem(last=False)
            row = known[own[i]] = np.zeros(len(first) + 1, np.int32)
            row[labelled.get(a[i][LABEL], [])] = -1
        w = row[at]
        if w.min() < 0:
            for k in np.unique(at[w < 0 if wanted is None else (w < 0) & wanted]).tolist():
                row[k] = shapes.weight(a[i], first[k])
            w = np.maximum(row[at], 0)
        return w

    def reached(x: list[list], at: list[int], y: list[list], there: list[int]) -> list[int]:
        """The most nodes in pairs if the k least children of x are skipped, for each k."""
        most: dict[str, int] = {}
        for t, s in zip(y, there, strict=True):
            most[t[LABEL]] = max(most.get(t[LABEL], 0), shapes.sizes[s])
        each = sorted((min(shapes.sizes[s], most.get(t[LABEL], 0)) for t, s in zip(x, at, strict=True)), reverse=True)
        return [*accumulate(each, initial=0)][::-1]

    bounds = reached(a, own, b, other), reached(b, other, a, own)
    off, total = BAND, 0
    while True:
        low, high = max(-n, min(0, m - n) - off), min(m, max(0, m - n) + off)
        width = high - low + 1
        places = np.full(n + high - low, len(first))  # b's kinds, and beyond its ends one that nothing pairs with
        places[-low : m - low] = [kinds[s] for s in other]
        step = 1 if n * width <= CELLS else isqrt(n) + 1

        def after(row: np.ndarray, w: np.ndarray) -> np.ndarray:
            now = row + w
            np.maximum(now[:-1], row[1:], out=now[:-1])
            return np.maximum.accumulate(now)

        ends: list[np.ndarray] = []  # the most that sizes allow from each place on, from the last row up
        if total and step == 1 and len(kinds) * len(set(own)) > PAIRS:
            row = np.zeros(width, np.int32)
            for i in range(n - 1, -1, -1):
                ends.append(row)
                row = after(row[::-1], most(i, places[i : i + width])[::-1])[::-1]
        row = begun = np.zeros(width, np.int32)
        kept = {0: row}
        for i in range(n):
            at, wanted = places[i : i + width], None
            if ends:  # what can't reach the best of the narrower band is in no best matching: its weight may count as none
                w = most(i, at)
                wanted = begun + w + ends.pop() >= total
                begun = after(begun, w)
            row = after(row, weights(i, at, wanted))
            if paired and (i + 1) % step == 0:
                kept[i + 1] = row
        total = int(row[m - n - low])
        if off >= min(n, m) or total > min(x[off + 1] for x in bounds):
            break
        off *= 4
    if not paired:
        return total, []
    found, held, i, j = [], {}, n, m
    while i and j:
        if i - 1 not in held:
            start = (i - 1) // step * step
            row = kept[start]
            held = {start: row}
            for x in range(start, min(start + step, n)):
                row = held[x + 1] = kept[x + 1] if x + 1 in kept else after(row, weights(x, places[x : x + width]))
        now, up, k = held[i], held[i - 1], j - i - low
        w = weights(i - 1, places[i - 1 + k : i + k])[0]
        if w and now[k] == up[k] + w:
            i, j = i - 1, j - 1
            found.append((i, j))
        elif k + 1 < width and now[k] == up[k + 1]:
            i -= 1
        else:
            j -= 1
    made: dict[tuple[int, int], Pairs] = {}
    pairs = []
    for i, j in reversed(found):
        if (own[i], other[j]) not in made:
            made[own[i], other[j]] = match(a[i][CHILDREN], b[j][CHILDREN], shapes)[1]
        pairs.append((i, j, made[own[i], other[j]]))
    return total, pairs


def _joined(a: list, b: list, pairs: Pairs) -> list:
    """Both nodes as one. Texts are counted by a mergeable summary: a count lacks LACK at most."""
    texts = a[KEPT]
    for h, (n, chars) in b[KEPT].items():
        if h in texts:
            texts[h][0] += n
        else:
            texts[h] = [n, chars]
    lack = a[LACK] + b[LACK]
    if len(texts) > TEXTS:
        least = sorted((x[0] for x in texts.values()), reverse=True)[TEXTS]
        texts = {h: [n - least, chars] for h, (n, chars) in texts.items() if n > least}
        lack += least
    children, j = [], 0
    of = {i: (k, below) for i, k, below in pairs}
    for i, x in enumerate(a[CHILDREN]):
        if i in of:
            k, below = of[i]
            children += b[CHILDREN][j:k]
            children.append(_joined(x, b[CHILDREN][k], below))
            j = k + 1
        else:
            children.append(x)
    children += b[CHILDREN][j:]
    return [a[LABEL], children, a[TAG], a[OUT], a[COUNT] + b[COUNT], a[SIZE] + b[SIZE], texts, lack]


def merged(a: list, b: list) -> list:
    """Both templates, aligned. A template of over NODES nodes loses those on the fewest pages."""
    out = _joined(a, b, match(a[CHILDREN], b[CHILDREN])[1])
    nodes, todo = 0, [out]
    while todo:
        t = todo.pop()
        nodes += 1
        todo += t[CHILDREN]
    if nodes > NODES:
        todo = [out]
        while todo:
            t = todo.pop()
            t[CHILDREN] = [c for c in t[CHILDREN] if c[COUNT] >= RARE * out[COUNT]]
            todo += t[CHILDREN]
    return out


def finished(template: list) -> list:
    """What extraction needs: of each node the constant texts, and whether it is chrome beside the content slot.

    From the root down, the child that holds CONTENT of the varying text (outside links, and outside elements that are left
    out anyway) is content, and the other containers are chrome, until none holds so much, or to an article or a paragraph.
    """
    least = max(PAGES, SHARE * template[COUNT])
    order, todo = [], [template]
    while todo:
        t = todo.pop()
        order.append(t)
        todo += t[CHILDREN]
    constant, mass, headed = {}, {}, {}
    for t in reversed(order):
        headed[id(t)] = t[TAG] in HEADINGS or any(headed[id(c)] for c in t[CHILDREN])
        constant[id(t)] = sorted(h for h, (n, _) in t[KEPT].items() if n >= least and n + t[LACK] >= CONSTANT * t[COUNT])
        own = t[SIZE] - sum(t[KEPT][h][0] * t[KEPT][h][1] for h in constant[id(t)])
        mass[id(t)] = 0 if t[OUT] else max(0, own) + sum(mass[id(c)] for c in t[CHILDREN])
    chrome, content, at = set(), set(), template
    while template[COUNT] >= PAGES and at[CHILDREN] and at[TAG] not in MAIN:
        first = max(at[CHILDREN], key=lambda c: mass[id(c)])
        if first[TAG] in PROSE or not mass[id(first)] or mass[id(first)] < CONTENT * mass[id(at)]:
            break
        chrome |= {id(c) for c in at[CHILDREN] if c is not first and c[TAG] not in PROSE and c[COUNT] >= least and not headed[id(c)]}
        content.add(id(first))
        at = first
    made: dict[int, list] = {}
    for t in reversed(order):
        made[id(t)] = [t[LABEL], [made[id(c)] for c in t[CHILDREN] if c[COUNT] >= least], t[TAG], t[OUT], id(t) in chrome, id(t) in content, constant[id(t)]]
    return made[id(template)]


CHROME, SLOT, TEXT = 4, 5, 6


def _decided(root: Node, template: list) -> tuple[set[tuple[int, int]], set[int]]:
    """The page's constant texts, by node and hash, and the nodes of its chrome, with all below."""
    own = as_template(root)
    constant, out = set(), set()
    todo = [(own, template, match(own[CHILDREN], template[CHILDREN])[1])]

    def texts(t: list) -> int:
        n, held = 0, [t]
        while held:
            x = held.pop()
            n += x[SIZE]
            held += x[CHILDREN]
        return n

    while todo:
        page, t, pairs = todo.pop()
        node = page[OF]
        constant |= {(id(node), h) for h in t[TEXT] if h in page[KEPT]}
        slot = any(t[CHILDREN][j][SLOT] and texts(page[CHILDREN][i]) for i, j, _ in pairs)
        for i, j, below in pairs:
            if slot and t[CHILDREN][j][CHROME]:  # without its content slot a page is of another kind
                held = [page[CHILDREN][i][OF]]
                while held:
                    x = held.pop()
                    out.add(id(x))
                    held += x.children
            else:
                todo.append((page[CHILDREN][i], t[CHILDREN][j], below))
    return constant, out


def extract(page: str, template: list | None = None) -> str:
    """The page's main text. template: a finished one.

    The template decides first: the host's constant texts go, within articles too, and so do containers beside the content
    slot. Of what is left, elements that are never text by their tag, role or name go; on pages with an article, what is
    outside of it; and on others blocks that are links for the most part, unless they are headings.
    """
    root, blocks = parse(page)
    constant, out = _decided(root, template) if template else (set(), set())
    whole = any(n.main and not n.out for n, _, _ in blocks)
    kept = [t for n, t, links in blocks if not n.out and id(n) not in out and (n.main or not whole and (links < LINKS or n.tag in HEADINGS)) and (not constant or (id(n), text_hash(t)) not in constant)]
    return "\n\n".join(kept)


def main_digest(blocks: list[tuple[Node, str, float]]) -> str:
    """Tells apart pages of a host by their texts that are no boilerplate by name; copies of a page have one digest."""
    whole = any(n.main and not n.out for n, _, _ in blocks)
    own = [t for n, t, _ in blocks if not n.out and (n.main or not whole)]
    return sha256("\0".join(own).encode("utf-8", "surrogatepass")).hexdigest()


def _page_templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages to (host, digest, template), one row each."""
    sys.setrecursionlimit(max(DEEP, sys.getrecursionlimit()))
    for batch in batches:
        for part in (batch.slice(i, 128) for i in range(0, batch.num_rows, 128)):
            parsed = [parse(page) for page in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([main_digest(b) for _, b in parsed], pa.string()), pa.array([flat(as_template(r), OF) for r, _ in parsed], pa.string())], ["host", "digest", "template"])


def _templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Templates of pages to one template for each host of the partition."""
    sys.setrecursionlimit(max(DEEP, sys.getrecursionlimit()))
    hosts: dict[str, list] = {}

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(hosts), pa.string()), pa.array([flat(t, OF) for t in hosts.values()], pa.string())], ["host", "template"])
        hosts.clear()
        return batch

    for batch in batches:
        for host, template in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = unflat(template)
            hosts[host] = merged(hosts[host], own) if host in hosts else own
            if len(hosts) > 4096:
                yield out()
    if hosts:
        yield out()


def _merge(last_time: bool):
    """Templates sorted by host (and salt) to one for each, holding one at a time; finished the last time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key: tuple, t: list) -> pa.RecordBatch:
            text = flat(finished(t), TEXT + 1) if last_time else flat(t, OF)
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip((*key, text), (pa.string(), pa.int32(), pa.string()), strict=True)], ["host", "salt", "template"])

        sys.setrecursionlimit(max(DEEP, sys.getrecursionlimit()))
        last, held = None, None
        for batch in batches:
            for host, salt, text in zip(*(batch.column(n).to_pylist() for n in ("host", "salt", "template")), strict=True):
                t = unflat(text)
                if (host, salt) == last:
                    held = merged(held, t)
                else:
                    if last is not None:
                        yield out(last, held)
                    last, held = (host, salt), t
        if last is not None:
            yield out(last, held)

    return run


def induce(pages: DataFrame) -> DataFrame:
    """(host, template) from all of (host, page): copies of a page count once; templates merge where they are dealt, then in salted groups, then by host."""
    each = pages.where(F.col("host") != "").mapInArrow(_page_templates, "host string, digest string, template string")
    distinct = each.groupBy("host", "digest").agg(F.min("template").alias("template"))
    partial = distinct.select("host", "template").mapInArrow(_templates, "host string, template string")
    salted = partial.withColumn("salt", F.pmod(F.xxhash64("template"), F.lit(SALTS)).cast("int"))
    schema = "host string, salt int, template string"
    once = salted.repartition("host", "salt").sortWithinPartitions("host", "salt", "template").mapInArrow(_merge(False), schema)
    twice = once.withColumn("salt", F.lit(0)).repartition("host").sortWithinPartitions("host", "template").mapInArrow(_merge(True), schema)
    return twice.select("host", "template")


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sys.setrecursionlimit(max(DEEP, sys.getrecursionlimit()))
    known: OrderedDict[str, list] = OrderedDict()
    for batch in batches:
        for part in (batch.slice(i, 128) for i in range(0, batch.num_rows, 128)):
            texts = []
            for page, template in zip(part.column("page").to_pylist(), part.column("template").to_pylist(), strict=True):
                if template is not None and template not in known:
                    known[template] = unflat(template)
                    if len(known) > 256:
                        known.popitem(last=False)
                texts.append(extract(page, known.get(template)))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(df: DataFrame, page: str = "html", url: str = "url", id: str = "page_id") -> DataFrame:
    """One row for each row of df: (page_id, url, text, n_chars).

    Every page takes part in its host's template; pages of a host with the same main texts count once. A page whose url is null or has no host is extracted without one.
    Null pages are empty and give empty texts; very long and very deep ones are read whole; repeated rows are extracted each; an empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    host = F.translate(F.regexp_extract(F.coalesce(F.col(f"`{url}`"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{url}`").alias("url"), text_of(page).alias("page"), host.alias("host"))
    templates = materialise(induce(own.select("host", "page")), "templates")
    size = templates.agg(F.sum(F.length("template") + F.length("host"))).first()[0] or 0
    joined = own.join(F.broadcast(templates) if size <= BROADCAST_BYTES else templates, "host", "left").select("id", "url", "page", "template")
    key = joined.schema["id"].dataType.simpleString()
    return joined.mapInArrow(_extracted, f"page_id {key}, url string, text string, n_chars long")


by_value(__name__)
