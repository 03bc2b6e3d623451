"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page is a stream of tags and text slots, nested as its elements are; a slot whose text is mostly links is a link slot.
Equal neighbours in a page make a repeated group. The streams of one host are aligned one after another, level by level:
where two differ, surplus becomes optional, or, next to its like, a repeated group; classes that differ are left
out; texts fall into slots. An alignment accepts all that its two sides accept, so every page matches its host's wrapper
to the end. Slots remember on how many pages they stood, how much text they had, and whether it was always the same.

The wrapper decides what is main: its article element or what is declared as the main part if enough of the host's text is
there, or else the element into which most of the text that varies from page to page leads. Below it, what the elements'
names mark as menus, forms, asides and the like is left out, and so are blocks that say the same on all pages of the host.
Words of classes and identifiers count only if all words of a name say so (of paragraphs and the like, without words that say nothing), and
never for what holds most of the text.
A page is matched with its host's wrapper, token by token, and its text is what stands in the main slots. A page that has no such part
is taken for itself, by the same rules, with its own stream as the wrapper.

Wrappers are inferred from all pages: every task aligns what it has read of a host, the tasks' wrappers of a host are
aligned in groups, and then the groups'. Nothing of a wrapper is cut off; elements nested deeper than DEPTH count to the
one at that depth.

Defined cases: null and empty html have empty text; broken markup is read as far as it goes, a tag that the page's end cuts
off is dropped; very long pages are read whole; pages without url form a host of their own; of equally good containers
the first in page order is taken; repeated rows are extracted each for itself, and count each for the wrapper; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import arrow_rows, cut
from larkspur.llm.text import slices

# Element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
DROPPED = frozenset("script style noscript template head title nav footer aside form button select textarea option iframe svg canvas object embed dialog menu noembed noframes map audio video".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar tablist".split())
LISTED = frozenset("p li tr td th dt dd h1 h2 h3 h4 h5 h6 blockquote pre option figure".split())
HEADINGS = frozenset("h1 h2 h3 p".split())
TEXTUAL = frozenset("p li h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption".split())
WHOLE = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption caption address ul ol dl".split())
# Words of classes and identifiers; words that say nothing for themselves.
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored sponsors promo promotion nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager "
    "sidebar aside footer cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist "
    "reply replies respond disqus share sharing social related recommended widget widgets masthead topbar toolbar skip hidden".split()
)
MAIN_WORDS = frozenset("content article post entry story main articlebody maincontent".split())
PLAIN_WORDS = frozenset(
    "area article articles bar block body bottom box button buttons card cards col column columns container content entry form global grid group head header icon icons inner item items "
    "label left link links list main page panel post posts primary right row secondary section site slot stories story text this title top unit user wrap wrapper zone".split()
)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>|<[a-zA-Z/][^>]*\Z", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORDS = re.compile(r"[a-z]+")
#: Nested elements that count each for itself; equal plain neighbours that are a repetition already in one page.
DEPTH, RUN = 100, 8
#: Wrappers merged by one task; pages of a host from which on equal texts say that they belong to the template.
FAN, PAGES = 16, 3
#: Forms, and hosts, that a task remembers before it hands its wrappers on.
FORMS, HOSTS = 20_000, 5000
#: Bytes of the hosts' wrappers up to which they are sent to the tasks.
BROADCAST_BYTES = 8 << 20


class Run:
    """A text between two block boundaries, at its place in the page."""

    __slots__ = ("at", "parts", "chars", "links")

    def __init__(self, at: int) -> None:
        self.at, self.parts, self.chars, self.links = at, [], 0, 0


class Element:
    """An open element: flags are d (not main text), h (its class words say so) and its rank as main part, 0 to 3."""

    __slots__ = ("name", "flags", "classes", "inline", "gone", "link", "children", "run")

    def __init__(self, name: str, flags: str = "0", classes: tuple[str, ...] = ()) -> None:
        self.name, self.flags, self.classes = name, flags, classes
        self.inline = self.gone = self.link = False
        self.children: list = []
        self.run: Run | None = None


_KNOWN: dict[tuple[str, str, bool], Element] = {}


def element(name: str, attrs: str, in_main: bool) -> Element:
    """A new element by its name and attributes."""
    if not attrs.strip() and name in INLINE:
        made = Element(name)
    else:
        found = {k.lower(): (v or "").strip("\"'").lower() for k, v in _ATTR.findall(attrs)} if attrs.strip() else {}
        said = found.get("class", "").split()
        names = [tuple(_WORDS.findall(w)) for w in [*said, *found.get("id", "").split()]]
        words = {w for one in names for w in one}
        role = found.get("role", "")
        gone = name in DROPPED or role in DROPPED_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
        gone |= name == "header" and not in_main
        hint = name not in ("html", "body", "main") and any(DROPPED_WORDS.intersection(one) and all(w in DROPPED_WORDS or w in PLAIN_WORDS and name not in TEXTUAL for w in one) for one in names)
        rank = 0 if gone or hint else 3 if name == "article" or "articlebody" in found.get("itemprop", "") else 2 if name == "main" or role == "main" else 1 if words & MAIN_WORDS and name in ("div", "section", "td") else 0
        made = Element(name, ("d" if gone else "h" if hint else "") + str(rank), tuple(sorted({"-".join(_WORDS.findall(w)) for w in said} - {""})))
        made.gone = gone or hint
    made.inline = name in INLINE
    made.link = name == "a"
    return made


# A page's form: name, flags, classes and items, interned. An item is (many, body): body is "#" or "@" (a text or link
# slot), a form's number, or a tuple of items (a group). The slots of a form are numbered from left to right.


class Forms:
    """Interned forms, by number."""

    def __init__(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.all: list[tuple] = []

    def of(self, form: tuple) -> int:
        found = self.ids.get(form)
        if found is None:
            found = self.ids[form] = len(self.all)
            self.all.append(form)
        return found


def fold(items: list[tuple], slots: list[list], listed: list[bool]) -> tuple[list[tuple], list[list]]:
    """items with equal neighbours, one or several in a row, made repeated groups; slots are put together accordingly.

    A single item repeats if it is listed (an element of lists, or one with classes) or stands RUN times in a row.
    """

    def together(parts: list[list]) -> list:
        whole = [list(x) for x in parts[0]]
        for part in parts[1:]:
            for mine, other in zip(whole, part, strict=True):
                mine += other
        return whole

    out, kept, marks = [], [], []
    i = 0
    while i < len(items):
        k = i + 1
        while k < len(items) and items[k][1] == items[i][1]:
            k += 1
        if k > i + 1 and (listed[i] or k - i >= RUN):
            out.append((True, items[i][1]))
            kept.append(together(slots[i:k]))
            marks.append(listed[i])
        else:
            out += items[i:k]
            kept += slots[i:k]
            marks += listed[i:k]
        i = k
    size = 2
    while 2 * size <= len(out):
        i = 0
        while i + 2 * size <= len(out):
            k = i + size
            while out[k : k + size] == out[i : i + size]:
                k += size
            if k > i + size and any(marks[i : i + size]):
                blocks = [[x for part in kept[j : j + size] for x in part] for j in range(i, k, size)]
                out[i:k] = [(True, tuple(out[i : i + size]))]
                kept[i:k] = [together(blocks)]
                marks[i:k] = [True]
            i += 1
        size += 1
    return out, kept


def read(html: str, forms: Forms) -> tuple[int, list[list[Run]]]:
    """The number of the page's form, and the texts in each of its slots."""
    root = Element("root")
    stack = [root]
    owners = [root]
    at, n, turn, in_main = 0, len(html), 0, 0

    def breaks() -> None:
        owner = owners[-1]
        run = owner.run
        if run is not None:
            owner.run = None
            if run.chars:
                owner.children.append(((False, "@" if 2 * run.links > run.chars else "#"), [[run]], False))

    def text(raw: str) -> None:
        nonlocal turn
        if not raw:
            return
        link = False
        for e in reversed(stack):
            if not e.inline:
                break
            if e.gone:
                return
            link |= e.link
        owner = owners[-1]
        if owner.run is None:
            turn += 1
            owner.run = Run(turn)
        said = unescape(raw)
        size = len(said.strip())
        owner.run.parts.append(said)
        owner.run.chars += size
        owner.run.links += size if link else 0

    def pop() -> None:
        nonlocal in_main
        e = stack.pop()
        if e.inline or owners[-1] is not e:
            return
        breaks()
        owners.pop()
        in_main -= e.flags == "3"
        if e.children or e.flags in ("2", "3"):
            items, slots = fold([c[0] for c in e.children], [c[1] for c in e.children], [c[2] for c in e.children])
            form = forms.of((e.name, e.flags, e.classes, tuple(items)))
            owners[-1].children.append(((False, form), [x for part in slots for x in part], e.name in LISTED or bool(e.classes)))

    def close(name: str, scope: tuple[str, ...]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name == name:
                while len(stack) > k:
                    pop()
                return
            if stack[k].name in scope:
                return

    while at < n:
        found = _TOKEN.search(html, at)
        if found is None:
            text(html[at:])
            break
        text(html[at : found.start()])
        at = found.end()
        if found["cdata"] is not None:
            text(found["cdata"].replace("&", "&amp;"))
            continue
        name = (found["name"] or found["name2"] or "").lower()
        if not name:
            continue
        if name == "br":
            text(" ")
            continue
        if name not in INLINE:
            breaks()
        if found["end"] or found["end2"]:
            if any(e.name == name for e in stack):
                while stack[-1].name != name:
                    pop()
                pop()
            continue
        attrs = found["attrs"] if found["attrs"] is not None else found["attrs2"] or ""
        if name in CLOSES_P:
            close("p", ("div", "article", "section", "td", "li", "main", "body", "blockquote", "table"))
        if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            for other in {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}[name]:
                close(other, ("ul", "ol", "dl", "table", "select", "div"))
        if name in VOID or attrs.rstrip().endswith("/") and name not in CLOSES_P:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else n
            continue
        one = element(name, attrs, in_main > 0)
        stack.append(one)
        if not one.inline and len(owners) <= DEPTH:
            breaks()
            owners.append(one)
            in_main += one.flags == "3"
    while len(stack) > 1:
        pop()
    breaks()
    items, slots = fold([c[0] for c in root.children], [c[1] for c in root.children], [c[2] for c in root.children])
    return forms.of(("root", "0", (), tuple(items))), [x for part in slots for x in part]


# A wrapper is an element: ["<", name, flags, classes, items, pages]. An item is [least, many, body]; a body is an
# element, a slot ["#" or "@", pages, characters, checksum of its text or 0 if that varies], or a group ["(", items].


def expression(form: int, forms: Forms, stats: Iterator[tuple[int, int]], pages: int) -> list:
    """A form as a wrapper, its slots with stats (characters, checksum) from left to right."""
    name, flags, classes, items = forms.all[form]

    def body(said: object) -> list:
        if isinstance(said, str):
            return [said, pages, *next(stats)]
        if isinstance(said, tuple):
            return ["(", [item(x) for x in said]]
        return expression(said, forms, stats, pages)

    def item(x: tuple) -> list:
        return [1, int(x[0]), body(x[1])]

    return ["<", name, flags, list(classes), [item(x) for x in items], pages]


def kind(body: list) -> object:
    """What two bodies must have in common to be aligned."""
    if body[0] == "<":
        return (body[1], body[2])
    return "#" if body[0] in "#@" else tuple(kind(x[2]) for x in body[1])


def _within(body: list) -> set:
    return {kind(x[2]) if x[2][0] != "(" else "(" for x in body[4]} if body[0] == "<" else set()


def _share(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def alike(a: list, b: list) -> float:
    """How well two bodies stand for one: 0 if they can't."""
    if kind(a) != kind(b):
        return 0.0
    if a[0] != "<":
        return 1.0 + (a[0] == b[0])
    return 1.0 + _share(set(a[3]), set(b[3])) + _share(_within(a), _within(b))


def united(a: list, b: list) -> list:
    """One body that accepts what either does."""
    if a[0] == "<":
        return ["<", a[1], a[2], [c for c in a[3] if c in b[3]], align(a[4], b[4]), a[5] + b[5]]
    if a[0] == "(":
        return ["(", align(a[1], b[1])]
    return [a[0] if a[0] == b[0] else "#", a[1] + b[1], a[2] + b[2], a[3] if a[3] == b[3] else 0]


def regrouped(items: list, groups: list) -> list:
    """items with what stands there like one of the groups made a group too."""
    for group in groups:
        want, out, i = kind(group), [], 0
        while i < len(items):
            if tuple(kind(x[2]) for x in items[i : i + len(want)]) == want:
                out.append([1, 0, ["(", items[i : i + len(want)]]])
                i += len(want)
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def align(a: list, b: list) -> list:
    """The items of two: what is alike stays, surplus becomes optional, and next to its like it becomes repeated."""
    if any(x[2][0] == "(" for x in (*a, *b)):
        of_a, of_b = ([x[2] for x in one if x[2][0] == "("] for one in (a, b))
        a, b = regrouped(a, of_b), regrouped(b, of_a)
    n, m = len(a), len(b)
    if n == m and all(alike(x[2], y[2]) >= 2.5 or x[2][0] != "<" and alike(x[2], y[2]) for x, y in zip(a, b, strict=True)):
        return repeated([[min(x[0], y[0]), max(x[1], y[1]), united(x[2], y[2])] for x, y in zip(a, b, strict=True)])
    weight = [[alike(x[2], y[2]) for y in b] for x in a]
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            skip = max(best[i + 1][j], best[i][j + 1])
            best[i][j] = max(skip, best[i + 1][j + 1] + weight[i][j]) if weight[i][j] else skip
    out = []
    i = j = 0
    while i < n and j < m:
        if weight[i][j] and best[i][j] == best[i + 1][j + 1] + weight[i][j]:
            out.append([min(a[i][0], b[j][0]), max(a[i][1], b[j][1]), united(a[i][2], b[j][2])])
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            out.append([0, a[i][1], a[i][2]])
            i += 1
        else:
            out.append([0, b[j][1], b[j][2]])
            j += 1
    return repeated(out + [[0, x[1], x[2]] for x in (*a[i:], *b[j:])])


def _like(a: list, b: list) -> bool:
    return kind(a) == kind(b) and (a[0] != "<" or _share(_within(a), _within(b)) >= 0.5)


def repeated(items: list) -> list:
    """items in which surplus beside its like (an optional item or block beside one of the same kind) makes it repeated."""
    size = 1
    while 2 * size <= len(items):
        i = 0
        while i + 2 * size <= len(items):
            one, two = items[i : i + size], items[i + size : i + 2 * size]
            if all(_like(x[2], y[2]) for x, y in zip(one, two, strict=True)) and (not any(x[0] for x in one) or not any(x[0] for x in two)):
                least = int(any(x[0] for x in (*one, *two)))
                if size == 1:
                    items[i : i + 2] = [[least, 1, united(one[0][2], two[0][2])]]
                else:
                    inner = [[min(x[0], y[0]), max(x[1], y[1]), united(x[2], y[2])] for x, y in zip(one, two, strict=True)]
                    items[i : i + 2 * size] = [[least, 1, ["(", inner]]]
            else:
                i += 1
        size += 1
    i = 0
    while i + 1 < len(items):
        x, y = items[i], items[i + 1]
        if x[2][0] == "(" and y[2][0] == "(" and kind(x[2]) == kind(y[2]):
            items[i : i + 2] = [[int(x[0] or y[0]), 1, united(x[2], y[2])]]
        else:
            i += 1
    return items


class Wrapper:
    """What a task knows of a host: its pages' forms with their texts' sizes, and the wrapper of what was merged."""

    def __init__(self, forms: Forms) -> None:
        self.forms, self.root = forms, None
        self.seen: dict[int, list] = {}

    def add_page(self, html: str) -> None:
        form, slots = read(html, self.forms)
        known = self.seen.get(form)
        if known is None:
            known = self.seen[form] = [0, [0] * len(slots), [None] * len(slots)]
        known[0] += 1
        for k, runs in enumerate(slots):
            known[1][k] += sum(r.chars for r in runs)
            check = zlib.crc32("".join(p for r in runs for p in r.parts).strip().encode("utf-8", "replace")) | 1 << 32
            known[2][k] = check if known[2][k] in (None, check) else 0

    def merge(self, root: list | None) -> None:
        if root is not None:
            self.root = root if self.root is None else united(self.root, root)

    def whole(self) -> list | None:
        """The wrapper of everything so far."""
        for form in sorted(self.seen, key=lambda f: repr(plain(f, self.forms))):
            pages, chars, checks = self.seen[form]
            self.merge(expression(form, self.forms, iter(zip(chars, checks, strict=True)), pages))
        self.seen = {}
        return self.root


def plain(form: int, forms: Forms) -> tuple:
    """A form without numbers, the same in every task."""
    name, flags, classes, items = forms.all[form]

    def said(x: tuple) -> tuple:
        return (x[0], x[1] if isinstance(x[1], str) else tuple(map(said, x[1])) if isinstance(x[1], tuple) else plain(x[1], forms))

    return (name, flags, classes, tuple(map(said, items)))


def _children(items: list) -> Iterator[tuple[list, bool]]:
    """The elements and slots of items, through groups, and whether they repeat."""
    for _, many, body in items:
        if body[0] == "(":
            for x, _ in _children(body[1]):
                yield x, True
        else:
            yield body, bool(many)


def decided(root: list) -> list:
    """The wrapper with what is main: elements become ["<", name, flags, classes, items, main] and slots [symbol, kept]."""
    pages = root[5]
    sums: dict[int, tuple[float, float, float]] = {}

    def weigh(e: list) -> tuple[float, float, float]:
        """Characters of text below, without what the names drop; those of texts that vary; all, links too."""
        text = varied = whole = 0.0
        for x, _ in _children(e[4]):
            if x[0] == "<":
                a, b, c = weigh(x)
                if x[2][0] != "d":
                    text, varied = text + a, varied + b
                whole += c
            else:
                whole += x[2]
                if x[0] == "#":
                    text += x[2]
                    varied += x[2] if x[3] == 0 or pages < PAGES else 0
        sums[id(e)] = (text, varied, whole)
        return sums[id(e)]

    total = weigh(root)
    by = 1 if total[1] >= 0.1 * total[0] else 0
    gone = lambda e: e[2][0] == "d" or e[2][0] == "h" and sums[id(e)][by] < 0.5 * total[by]

    def mass(e: list) -> float:
        """The text that counts below e, without what is left out there."""
        return sum((0 if gone(x) else mass(x)) if x[0] == "<" else x[2] * (x[0] == "#" and (by == 0 or x[3] == 0 or pages < PAGES)) for x, _ in _children(e[4]))

    found: dict[int, list[tuple[float, int, list]]] = {3: [], 2: [], 1: []}

    def ranked(e: list, blocked: bool) -> None:
        for x, _ in _children(e[4]):
            if x[0] == "<":
                rank = int(x[2][-1])
                if rank and not blocked:
                    found[rank].append((mass(x), -len(found[rank]), x))
                ranked(x, blocked or gone(x) and x[1] not in ("nav", "div", "section", "header"))

    ranked(root, False)
    main = None
    everything = max([mass(root), *(f[0] for rank in found.values() for f in rank)])
    for rank in (3, 2, 1):
        if main is None and found[rank]:
            best = max(found[rank], key=lambda f: f[:2])
            if best[0] >= 0.3 * everything and (best[0] > 0 or rank > 1):
                main = best[2]
    if main is None:
        main = root
        while True:
            below = [(x, many) for x, many in _children(main[4]) if x[0] == "#" or x[0] == "<" and not gone(x)]
            heavy = max((x for x in below if x[0][0] == "<"), key=lambda x: mass(x[0]), default=None)
            others = any(x is not heavy[0] and (x[0] == "#" or x[1] in HEADINGS and mass(x) > 0) for x, _ in below) if heavy else True
            if heavy is None or heavy[1] or others or heavy[0][1] in WHOLE or mass(heavy[0]) < 0.6 * mass(main):
                break
            main = heavy[0]
    inside = sums[id(main)]
    template = pages >= PAGES and inside[1] >= 0.5 * inside[0] > 0

    def constant(e: list) -> bool:
        return all(constant(x) if x[0] == "<" else x[3] != 0 for x, _ in _children(e[4]))

    def shown(e: list, kept: bool) -> list:
        here = e is main
        if here:
            kept = True
        elif kept:
            kept = not gone(e) and not (template and e[1] not in WHOLE and 2 * e[5] >= pages and constant(e))
        return ["<", e[1], e[2], e[3], [item(x, kept) for x in e[4]], int(here)]

    def item(x: list, kept: bool) -> list:
        body = x[2]
        if body[0] == "<":
            return [x[0], x[1], shown(body, kept)]
        return [x[0], x[1], ["(", [item(y, kept) for y in body[1]]] if body[0] == "(" else [body[0], int(kept)]]

    return shown(root, False)


class Matcher:
    """A decided wrapper as automata, one for each element's items; forms are matched once."""

    def __init__(self, root: list, forms: Forms) -> None:
        self.root, self.forms = root, forms
        self.automata: dict[int, tuple] = {}
        self.known: dict[tuple[int, int], tuple[float, tuple[bool, ...], bool] | None] = {}

    def _automaton(self, e: list) -> tuple[list, list[int], set[int], list[list[int]], bool]:
        """e's bodies with the first ones, the last ones, those that may follow each, and whether none need be there."""
        made = self.automata.get(id(e))
        if made is not None:
            return made
        atoms: list[list] = []
        follow: list[list[int]] = []

        def sequence(items: list) -> tuple[list[int], list[int], bool]:
            first, last, empty = [], [], True
            for least, many, body in items:
                if body[0] == "(":
                    f, t, none = sequence(body[1])
                else:
                    atoms.append(body)
                    follow.append([])
                    f = t = [len(atoms) - 1]
                    none = False
                if many:
                    for i in t:
                        follow[i] += [j for j in f if j not in follow[i]]
                for i in last:
                    follow[i] += [j for j in f if j not in follow[i]]
                if empty:
                    first = [*first, *f]
                last = [*last, *t] if none or not least else list(t)
                empty = empty and (none or not least)
            return first, last, empty

        first, last, empty = sequence(e[4])
        self.automata[id(e)] = atoms, first, set(last), follow, empty
        return self.automata[id(e)]

    def match(self, e: list, form: int) -> tuple[float, tuple[bool, ...], bool] | None:
        """How well a form matches the element's items, which of its slots are main, whether the main part is there; None if it doesn't match."""
        key = (id(e), form)
        if key not in self.known:
            self.known[key] = self._match(e, form)
        return self.known[key]

    def _match(self, e: list, form: int) -> tuple[float, tuple[bool, ...], bool] | None:
        atoms, first, last, follow, empty = self._automaton(e)
        tokens: list[tuple[object, int]] = []
        slots = 0

        def size(body: object) -> int:
            if isinstance(body, str):
                return 1
            return sum(size(x[1]) for x in (body if isinstance(body, tuple) else self.forms.all[body][3]))

        def spread(items: tuple, at: int) -> int:
            """The items as tokens with their first slots, repeated ones twice."""
            for many, body in items:
                for _ in range(2 if many else 1):
                    if isinstance(body, tuple):
                        spread(body, at)
                    else:
                        tokens.append((body, at))
                at += size(body)
            return at

        slots = spread(self.forms.all[form][3], 0)
        kept = [False] * slots
        if not tokens:
            return (0.0, (), bool(e[5])) if empty else None
        trail: list[dict[int, tuple[float, int, tuple | None]]] = []
        for k, (body, _) in enumerate(tokens):
            now: dict[int, tuple[float, int, tuple | None]] = {}
            for before, score in ([(-1, 0.0)] if k == 0 else [(i, s[0]) for i, s in trail[-1].items()]):
                for j in first if k == 0 else follow[before]:
                    if j in now and now[j][0] >= score + 4:
                        continue
                    fit = self._fits(atoms[j], body)
                    if fit is not None and (j not in now or score + fit[0] > now[j][0]):
                        now[j] = (score + fit[0], before, fit)
            if not now:
                return None
            trail.append(now)
        ends = [(s[0], -j) for j, s in trail[-1].items() if j in last]
        if not ends:
            return None
        best, j = max(ends)
        j, there = -j, bool(e[5])
        for k in range(len(tokens) - 1, -1, -1):
            _, before, fit = trail[k][j]
            body, at = tokens[k]
            for d, keep in enumerate(fit[1]):
                kept[at + d] |= keep
            there |= fit[2]
            j = before
        return best / len(tokens), tuple(kept), there

    def _fits(self, atom: list, body: object) -> tuple[float, tuple[bool, ...], bool] | None:
        if isinstance(body, str):
            return (1.0 + (atom[0] == body), (bool(atom[1]),), False) if atom[0] == body or atom[0] == "#" else None
        if atom[0] != "<":
            return None
        name, flags, classes, _ = self.forms.all[body]
        if atom[1] != name or atom[2] != flags or not set(atom[3]) <= set(classes):
            return None
        inner = self.match(atom, body)
        return None if inner is None else (1.0 + (len(atom[3]) == len(classes)) + min(inner[0], 2.0) / 2, inner[1], inner[2])


def own(form: int, slots: list[list[Run]], forms: Forms) -> list:
    """The decided wrapper of one page alone."""
    return decided(expression(form, forms, ((sum(r.chars for r in runs), 0) for runs in slots), 1))


def extract(html: str, matcher: Matcher | None, forms: Forms) -> str:
    """A page's text in the main slots of its host's wrapper, or of its own."""
    form, slots = read(html, forms)
    found = matcher.match(matcher.root, form) if matcher is not None else None
    if found is None or not found[2]:
        root = own(form, slots, forms)
        found = Matcher(root, forms).match(root, form)
    runs = sorted((r.at, "".join(r.parts)) for keep, some in zip(found[1], slots, strict=True) if keep for r in some)
    return " ".join(" ".join(said for _, said in runs).split())


def host_of(url: str) -> Column:
    """A page's host, lower-cased; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper: each host's wrapper (JSON), inferred from all its pages (host, html)."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms, found = Forms(), {}

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(found), pa.string()), pa.array([json.dumps(w.whole()) for w in found.values()], pa.string())], names=["host", "wrapper"])
            found.clear()
            return out

        for batch in slices(batches, "html"):
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                if host not in found:
                    found[host] = Wrapper(forms)
                found[host].add_page(html or "")
            if len(found) > HOSTS or len(forms.all) > FORMS:
                yield flush()
                forms = Forms()
        if found:
            yield flush()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = Wrapper(Forms())
        for said in pdf.wrapper.sort_values():
            whole.merge(json.loads(said))
        return pd.DataFrame({"host": [pdf.host.iloc[0]], "wrapper": [json.dumps(whole.root)]})

    arrow_rows(pages.sparkSession)
    parts = pages.select("host", "html").mapInArrow(first, "host string, wrapper string")
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(FAN)))
    groups = salted.groupBy("host", "salt").applyInPandas(merge, "host string, wrapper string")
    return groups.groupBy("host").applyInPandas(merge, "host string, wrapper string")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", "html").withColumn("host", host_of("url"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [json.dumps(decided(json.loads(w)), separators=(",", ":")) for w in batch.column("wrapper").to_pylist()]
            yield pa.record_batch([batch.column("host"), pa.array(said, pa.string())], names=["host", "main"])

    mains = cut(wrappers(rows).mapInArrow(decide, "host string, main string"))
    size = mains.agg(F.sum(F.octet_length("host") + F.octet_length("main") + 32)).first()[0] or 0
    small = {r["host"]: r["main"] for r in mains.toLocalIterator()} if size <= BROADCAST_BYTES else None
    shared = None if small is None else spark.sparkContext.broadcast(small)
    schema = "page_id long, url string, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms, matchers = Forms(), {}
        for batch in slices(batches, "html"):
            texts = []
            said = batch.column("main").to_pylist() if shared is None else None
            for k, (host, html) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True)):
                if host not in matchers:
                    main = said[k] if said is not None else shared.value.get(host)
                    matchers[host] = Matcher(json.loads(main), forms) if main else None
                texts.append(extract(html or "", matchers[host], forms))
            if len(matchers) > HOSTS or len(forms.all) > FORMS:
                forms, matchers = Forms(), {}
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if shared is not None:
        return rows.mapInArrow(run, schema)
    return rows.join(mains, "host", "left").select("page_id", "url", "host", "html", "main").mapInArrow(run, schema)
