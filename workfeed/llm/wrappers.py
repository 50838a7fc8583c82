"""HTML extraction with wrappers inferred from the pages of a host.

A page is a stream of tags and texts; with implied end tags closed it nests into
elements. A wrapper is a union-free regular expression over such streams: items in
order, each an element, a text or a repeated group of several items, any of which may
be optional. A host's wrapper starts as its first page and is aligned with one page
after the other. The streams below two matching tags are aligned by the best-scoring
common subsequence (equal tags with the most attribute words in common), and each
mismatch generalises: an item of one side alone becomes optional, consecutive
recurrences of the same items become a repeated group, a text that differs becomes a
slot, attribute words that differ are dropped. A stream without such order, of over
MOST items after alignment, becomes one repeated group of optional items, one for each
tag and words. Wrappers align with wrappers in the same way, so they are folded per
input partition first, then per host and salt, then per host. A wrapper's size is
bounded by its host's template: numbers in attribute words count as alike, a tag has at
most KINDS kinds in a stream, and nesting stops at DEPTH.

The varying text of a wrapper, gathered from all of the host's pages, decides which item
holds the main text: an article or main element with enough of it, else the element
reached by going down wherever one child holds most of it. A page is then aligned with
the host's items level by level on the way to that item, and what lands in it is its
text, without the constants of the template. Decisions are broadcast while their
measured size is small and joined else.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from html import unescape
from itertools import chain

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.extract import MARKS, marked_open_ends
from .common import checkpoint, free_name
from .urlrules import host_of

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|title|noscript|iframe|template)(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
    r"|<[!?][^>]*>"
    r"|([^<]+|<)",
    re.I | re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NUMBER = re.compile(r"\d+")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stand in a line of text and do not begin a block.
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split()
)
#: An opening tag ends an open element of these first.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What never holds main text; a header does where it is that of the main element.
ASIDE = set("head header nav aside footer form fieldset button select option input menu dialog svg canvas object audio video".split())
COMMENT_WORDS = set("comment comments commentlist disqus replies respond reply".split())
ASIDE_WORDS = COMMENT_WORDS | set(
    "ad ads advert adverts advertisement advertising sponsored sponsor promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead cookie cookies consent notice notices notification alert popup modal overlay newsletter subscribe signup login share sharing social "
    "related recommended pagination pager widget toolbar skip".split()
)
#: Their usual compounds; "has-sidebar" or "comments-open" say what a page has and not what an element is.
ENDINGS = "left right list box block container wrapper wrap inner area bar buttons links widget posts articles form section thread panel slot unit item items body message signup".split()
BEGINNINGS = "site left right top bottom social cookie reader user page main global inline primary secondary".split()
COMMENT_WORDS |= {f"{w}-{x}" for w in COMMENT_WORDS for x in ENDINGS} | {f"{x}-{w}" for w in COMMENT_WORDS for x in BEGINNINGS}
ASIDE_WORDS |= {f"{w}-{x}" for w in ASIDE_WORDS for x in ENDINGS} | {f"{x}-{w}" for w in ASIDE_WORDS for x in BEGINNINGS}
#: Headings where they stand in a main element; "page-header" is that of an article in many pages.
HEADER_WORDS = {w for w in ASIDE_WORDS if {"header", "masthead"} & set(w.split("-"))}
ASIDE_WORDS -= {"page-header", "main-header", "inline-header", "primary-header"}
#: Elements whose texts belong to an article even if every page has them.
CONTENT = set("p h1 h2 h3 h4 h5 h6 li dt dd td th caption figcaption blockquote pre figure".split())
#: Elements of a text's own structure: the way down to the main element ends before them.
STRUCTURE = CONTENT | set("ul ol dl table tbody thead tfoot tr".split())
#: What is never aside for its words; a nested article (a comment, in most pages) can be.
WHOLE = ("html", "body", "main", "article")
MAIN_TAGS, MAIN_WORDS = ("article", "main"), {"main", "articlebody"}
#: Boxes without a meaning of their own: unnamed ones are told apart by the blocks in them, and only three alike in a row are a list.
BOXES = ("div", "section", "center")

#: Nesting beyond which elements count as part of the one they stand in; items of a stream in order; kinds of a tag in a stream without order; items of a group.
DEPTH, MOST, KINDS, PERIOD = 100, 24, 32, 6


def key_of(tag: str, attributes: str) -> str:
    """The tag with its class, id, role and itemprop words, numbers in them as 0, by which elements align."""
    words = sorted({NUMBER.sub("0", w) for _, *v in ATTRIBUTE.findall(attributes) for w in "".join(v).lower().replace(".", "-").split()})
    return f"{tag}.{'.'.join(words)}" if words else tag


def tag_of(key: str) -> str:
    return key.split(".", 1)[0]


def is_main(key: str) -> bool:
    tag, *words = key.split(".")
    return tag in MAIN_TAGS or bool(MAIN_WORDS & set(words))


def by_tag(key: str, inside: bool) -> bool:
    """Whether an element holds no main text by its tag; inside where it stands in an article or main element."""
    tag = tag_of(key)
    return tag in ASIDE and not (inside and tag == "header")


def by_word(key: str, inside: bool, words: set[str] = ASIDE_WORDS) -> bool:
    """The same by a whole word of its class, id or role."""
    tag, *own = key.split(".")
    if tag in WHOLE and not (inside and tag == "article"):
        return False
    named = {w.replace("_", "-") for w in own} & words
    return bool(named - HEADER_WORDS if inside else named)


#: Tags without an end that are looked for in the rest of a page before all of them are told at once.
OPEN_ENDS = 16


def tokens(html: str) -> Iterator[tuple[str | None, str | None, str | None, str, str | None]]:
    """The groups of TOKEN, one match after the other. Once several tags have no end, those of the rest of the page are told in one pass, as each would be looked for to the end of the page."""
    misses = 0
    for m in TOKEN.finditer(html):
        if m[5] == "<":
            misses += 1
            if misses > OPEN_ENDS:
                break
        yield m.groups()
    else:
        return
    mark = next(c for c in MARKS if c not in html)
    rest = marked_open_ends(html[m.start() :], mark)
    for m in TOKEN.finditer(rest):
        raw, close, tag, attributes, text = m.groups()
        yield raw, close, tag, attributes and attributes.replace(mark, "<"), text and text.replace(mark, "<")


def nested(html: str | None) -> list:
    """The page as [key, children]; a child is such an element or a text. Scripts, styles, comments and the like are left out.

    Beyond DEPTH an element is an empty mark among the children of the one it stands in,
    where its texts and elements follow; what never holds main text goes as a whole.
    """
    root: list = ["", []]
    stack = [root]
    for raw, close, tag, attributes, text in tokens(html or ""):
        if text is not None:
            stack[-1][1].append(unescape(text))
        elif raw is not None or tag is None:
            continue
        elif close:
            tag = tag.lower()
            at = next((i for i in range(len(stack) - 1, 0, -1) if tag_of(stack[i][0]) == tag), 0)
            # An inline end tag does not reach out of its block.
            if at and not (tag in INLINE and any(tag_of(e[0]) not in INLINE for e in stack[at + 1 :])):
                if at >= DEPTH and tag not in INLINE:
                    stack[DEPTH - 1][1].append([tag, []])
                del stack[at:]
        else:
            tag = tag.lower()
            if tag not in INLINE:
                while len(stack) > 1 and tag_of(stack[-1][0]) in INLINE:
                    stack.pop()
                own = {"p"} if tag not in ENDS else ENDS[tag] | {"p"}
                while len(stack) > 1 and tag_of(stack[-1][0]) in own:
                    stack.pop()
                    while len(stack) > 1 and tag_of(stack[-1][0]) in INLINE:
                        stack.pop()
            element = [key_of(tag, attributes), []]
            stack[-1][1].append(element)
            if tag not in VOID and not re.search(r"(?<!=)/\s*$", attributes):
                # Past the limit, one list of children is shared, but for what is aside by its tag.
                own_list = len(stack) < DEPTH or (tag in ASIDE and stack[-1][1] is stack[DEPTH - 1][1])
                stack.append(element if own_list else [element[0], stack[-1][1]])
    return root


# -- streams ---------------------------------------------------------------------------------


def stream(element: list) -> list[tuple[str, object]]:
    """The element's children as (key, text or element): blank texts and breaks left out, unnamed boxes with marks of the blocks in them."""
    out: list[tuple[str, object]] = []
    for child in element[1]:
        if isinstance(child, str):
            if text := " ".join(child.split()):
                if out and out[-1][0] == "#":
                    out[-1] = ("#", f"{out[-1][1]} {text}")
                else:
                    out.append(("#", text))
        elif (key := child[0]) not in ("br", "wbr"):
            if key in BOXES:
                inner = sorted({t for c in child[1] if not isinstance(c, str) and (t := tag_of(c[0])) not in INLINE})
                key = ".".join([key, *(f"~{t}" for t in inner)])
            out.append((key, child))
    return out


def folded(keys: list[str]) -> list[dict]:
    """Items {k, i, m} over a stream's keys: i are the places that an item covers, m says whether it recurs.

    Consecutive recurrences of up to PERIOD items become one group {k, m, c}, shorter ones
    first. A long stream of many kinds has no such order and stays as it is.
    """
    items: list[dict] = [{"k": k, "i": [i], "m": False} for i, k in enumerate(keys)]
    if len(keys) > MOST * PERIOD and len(set(keys)) > MOST:
        return items
    for size in range(1, PERIOD + 1):
        out, at = [], 0
        while at < len(items):
            names = [x["k"] for x in items[at : at + size]]
            times = 1
            if len(names) == size and any(n != "#" for n in names):
                while [x["k"] for x in items[at + times * size : at + (times + 1) * size]] == names:
                    times += 1
            if times < (3 if size == 1 and tag_of(names[0]) in BOXES else 2):
                out.append(items[at])
                at += 1
                continue
            block = items[at : at + size]
            for r in range(1, times):
                block = [_same(a, b) for a, b in zip(block, items[at + r * size : at + (r + 1) * size], strict=True)]
            out.append(block[0] | {"m": True} if size == 1 else {"k": f"({' '.join(names)})", "m": True, "c": block})
            at += times * size
        items = out
    return items


def _same(one: dict, two: dict) -> dict:
    """An item and its recurrence as one."""
    if "i" in one:
        return one | {"i": one["i"] + two["i"], "m": one["m"] or two["m"]}
    return one | {"c": [_same(a, b) for a, b in zip(one["c"], two["c"], strict=True)]}


def _worth(one: str, two: str) -> int:
    """How well two keys align; 0 for not at all."""
    if one == two:
        return 4 if one != "#" else 2
    tag, *words = one.split(".")
    other, *more = two.split(".")
    if tag != other or tag[:1] in "#(" or by_word(one, False) != by_word(two, False):
        return 0
    return min(3, 1 + len(set(words) & set(more)))


def _groups(items: list[dict]) -> list[dict]:
    return [x for x in items if x["k"].startswith("(")]


def _grouped(items: list[dict], groups: list[dict]) -> list[dict]:
    """items with a single occurrence of another side's group made a group as well."""
    for g in groups:
        names = [x["k"] for x in g["c"]]
        out, at = [], 0
        while at < len(items):
            block = items[at : at + len(names)]
            if [x["k"] for x in block] == names:
                out.append({"k": g["k"], "m": False, "c": block} | ({"n": max(x["n"] for x in block)} if "n" in block[0] else {}))
                at += len(names)
            else:
                out.append(items[at])
                at += 1
        items = out
    return items


def paired(one: list[dict], two: list[dict]) -> list[tuple[dict | None, dict | None]]:
    """The items of both in order, those that align as pairs."""
    if [x["k"] for x in one] == [x["k"] for x in two]:
        return list(zip(one, two, strict=True))
    one, two = _grouped(one, _groups(two)), _grouped(two, _groups(one))
    n, m = len(one), len(two)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    worth = [[_worth(a["k"], b["k"]) for b in two] for a in one]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            w = worth[i][j]
            best[i][j] = max(best[i + 1][j], best[i][j + 1], w + best[i + 1][j + 1] if w else 0)
    out: list[tuple[dict | None, dict | None]] = []
    i = j = 0
    while i < n and j < m:
        if worth[i][j] and best[i][j] == worth[i][j] + best[i + 1][j + 1]:
            out.append((one[i], two[j]))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            out.append((one[i], None))
            i += 1
        else:
            out.append((None, two[j]))
            j += 1
    return out + [(x, None) for x in one[i:]] + [(None, x) for x in two[j:]]


# -- wrappers --------------------------------------------------------------------------------

# A wrapper is {k, m, n, o, c, x}: k the key, m whether it recurs, n how many of its parent's
# occurrences have it, o its own occurrences, c its items in order, or without order where x
# is set. A text has the key "#" and {t: the constant or null for a slot, w: its characters};
# a group has its members' keys in brackets, m, n and c.


def constant(text: str) -> str:
    """A normalised text as it is compared: itself, or if over 80 characters, its beginning, length and digest."""
    if len(text) <= 80:
        return text
    return f"{text[:48]} {len(text)} {hashlib.md5(text.encode('utf-8', 'replace')).hexdigest()}"


def wrapper_of(element: list) -> dict:
    """The wrapper of a single element."""
    parts = stream(element)
    items = [_bound(x, parts) for x in folded([k for k, _ in parts])]
    loose = len(items) > MOST
    return {"k": element[0], "m": False, "n": 1, "o": 1, "c": _by_kind(items) if loose else items, "x": loose}


def _bound(item: dict, parts: list) -> dict:
    """An item of places as the wrapper of what stands there."""
    if "c" in item:
        return {"k": item["k"], "m": item["m"], "n": 1, "c": [_bound(x, parts) for x in item["c"]]}
    made = None
    for i in item["i"]:
        key, what = parts[i]
        new = {"k": "#", "m": False, "n": 1, "t": constant(what), "w": len(what)} if key == "#" else wrapper_of(what) | {"k": key}
        made = new if made is None else merged(made, new, True)
    return made | {"m": item["m"]}


def merged(one: dict, two: dict, same: bool = False) -> dict:
    """The least general wrapper of two items that align; same where they stand under one occurrence of their parent."""
    n = max(one["n"], two["n"]) if same else one["n"] + two["n"]
    many = one["m"] or two["m"] or same
    if one["k"] == "#":
        return {"k": "#", "m": many, "n": n, "t": one["t"] if one["t"] == two["t"] else None, "w": one["w"] + two["w"]}
    if one["k"].startswith("("):
        return {"k": one["k"], "m": many, "n": n, "c": [merged(a, b, same) for a, b in zip(one["c"], two["c"], strict=True)]}
    key = one["k"]
    if key != two["k"]:
        tag, *words = key.split(".")
        other = set(two["k"].split(".")[1:])
        key = ".".join([tag, *(w for w in words if w in other)])
    loose = one["x"] or two["x"]
    items = _by_kind(one["c"], two["c"]) if loose else [a if b is None else b if a is None else merged(a, b) for a, b in paired(one["c"], two["c"])]
    if not loose and len(items) > MOST:
        items, loose = _by_kind(items), True
    return {"k": key, "m": many, "n": n, "o": one["o"] + two["o"], "c": items, "x": loose}


def _by_kind(*sides: list[dict]) -> list[dict]:
    """The items of both sides without order: each key once, and of a tag at most KINDS keys, else it alone."""
    flat: list[list[dict]] = []
    for side in sides:
        todo, out = side[::-1], []
        while todo:
            x = todo.pop()
            if x["k"].startswith("("):
                todo += x["c"][::-1]
            else:
                out.append(x)
        flat.append(out)
    kinds: dict[str, set[str]] = {}
    for x in chain.from_iterable(flat):
        kinds.setdefault(tag_of(x["k"]), set()).add(x["k"])
    found: dict[str, dict] = {}
    for side in flat:
        own: dict[str, dict] = {}
        for x in side:
            k = x["k"] if len(kinds[tag_of(x["k"])]) <= KINDS else tag_of(x["k"])
            own[k] = merged(own[k], x | {"k": k}, True) if k in own else x | {"k": k}
        for k, x in own.items():
            found[k] = merged(found[k], x) if k in found else x
    return list(found.values())


def expression(item: dict, occurrences: int = 1) -> str:
    """A wrapper written as a regular expression over tags and texts."""
    k, some, many = item["k"], item["n"] < occurrences, item["m"]
    if k == "#":
        out = "#TEXT" if item["t"] is None else repr(item["t"])
    elif k.startswith("("):
        inner = " ".join(expression(c, c["n"]) for c in item["c"])
        return f"({inner}){'*' if some and many else '+' if many else '?' if some else ''}"
    else:
        inner = " ".join(expression(c, item["o"]) for c in item["c"])
        inner = f"({inner})*" if item["x"] else inner
        out = f"<{k}> {inner} </{tag_of(k)}>" if k else inner
    return f"({out}){'*' if some and many else '+' if many else '?'}" if some or many else out


# -- decisions -------------------------------------------------------------------------------


class _Masses:
    """For every item of a wrapper, by identity: the characters of text that varies and is no link, and whether a main element has some."""

    def __init__(self, wrapper: dict, words: set[str], varying: bool = True, inside: bool | None = None):
        """With inside, the wrapper is that of an element which is no aside itself and stands, or not, in a main element."""
        self.words, self.varying = words, varying
        self.held: dict[int, tuple[int, bool]] = {}
        if inside is None:
            self.total, self.main = self._add(wrapper, False, False)
        else:
            below = [self._add(c, inside, False) for c in wrapper["c"]]
            self.total, self.main = sum(m for m, _ in below), any(b for _, b in below)

    def _add(self, item: dict, inside: bool, linked: bool) -> tuple[int, bool]:
        k = item["k"]
        if k == "#":
            out = (0 if linked or (self.varying and item["t"] is not None and item["n"] > 1) else item["w"], False)
        elif k and not k.startswith("(") and (by_tag(k, inside) or by_word(k, inside, self.words)):
            out = (0, False)
        else:
            main = is_main(k)
            below = [self._add(c, inside or main, linked or tag_of(k) == "a") for c in item["c"]]
            mass = sum(m for m, _ in below)
            out = (mass, (main and mass > 0) or any(b for _, b in below))
        self.held[id(item)] = out
        return out

    def of(self, item: dict) -> int:
        return self.held.get(id(item), (0, False))[0]

    def has_main(self, item: dict) -> bool:
        return self.held.get(id(item), (0, False))[1]

    def titled(self, item: dict) -> bool:
        """Whether a first-level heading with such text stands in an item."""
        return item["k"] != "#" and self.of(item) > 0 and (tag_of(item["k"]) == "h1" or any(map(self.titled, item["c"])))


def decided(wrapper: dict) -> dict:
    """{way, fixed, inside, words}: the way to the item that holds the main text, the constants in it, whether it is or stands in a
    main element, and whether class words other than those of comments make an aside.

    Each step of the way is {items: the keys of a level, at: place, in: place in a group}, or {key} in a level without order.
    """
    masses = _Masses(wrapper, ASIDE_WORDS)
    # What holds the only main element, or without any twice as much text as all the rest, is no aside for a word.
    freed = _Masses(wrapper, COMMENT_WORDS)
    if not masses.main and (freed.main or freed.total > 3 * masses.total):
        masses = freed
    varying = masses.total > 0
    if not varying:
        # One page over and over: nothing in it is the template's.
        masses = _Masses(wrapper, ASIDE_WORDS, False)
    way: list[dict] = []
    node, inside = wrapper, False
    while masses.of(node) > 0 and tag_of(node["k"]) != "article":
        places = [(at, j, c) for at, x in enumerate(node["c"]) for j, c in (enumerate(x["c"]) if x["k"].startswith("(") else [(None, x)])]
        places = [p for p in places if p[2]["k"] != "#" and not p[2]["k"].startswith("(")]
        holders = [p for p in places if masses.has_main(p[2]) and masses.of(p[2]) >= (0.6 if inside else 0.3) * masses.of(node)]
        if not holders and (inside or not places):
            break
        at, j, child = max(holders or places, key=lambda p: masses.of(p[2]))
        if not holders and (
            masses.of(child) < 0.6 * masses.of(node) or tag_of(child["k"]) in STRUCTURE | INLINE or any(masses.titled(p[2]) for p in places if p[2] is not child)
        ):
            break
        way.append({"key": child["k"]} if node["x"] else {"items": [_skeleton(x) for x in node["c"]], "at": at, "in": j})
        node, inside = child, inside or is_main(child["k"])
    # Inside, words hold unless they would take most of the text.
    words = 3 * _Masses(node, ASIDE_WORDS, varying, inside).total >= masses.of(node)
    fixed: list = []

    def constants(item: dict, path: list[str]) -> None:
        for c in item["c"]:
            k = c["k"]
            if k == "#":
                # On nine of ten pages with the same words.
                if path and c["t"] is not None and 10 * c["n"] >= 9 * node["o"]:
                    fixed.append([path, c["t"]])
            elif not c["m"] and tag_of(k) not in CONTENT:
                constants(c, path if k.startswith("(") else [*path, tag_of(k)])

    # A single page has nothing to compare with.
    if varying and node["o"] > 1 and not node["m"]:
        constants(node, [])
    return {"way": way, "fixed": fixed, "words": words, "inside": inside}


def _skeleton(item: dict) -> dict:
    return {"k": item["k"], "c": [_skeleton(c) for c in item["c"]]} if item["k"].startswith("(") else {"k": item["k"]}


def _reached(page: list, way: list[dict]) -> list[list]:
    """The page's elements at the end of the way; none where the page lacks it."""
    roots = [page]
    for step in way:
        below: list[list] = []
        for root in roots:
            parts = stream(root)
            if "key" in step:
                tag, *words = step["key"].split(".")
                below += [e for k, e in parts if tag_of(k) == tag and set(words) <= set(k.split("."))]
                continue
            wanted = step["items"][step["at"]]
            for a, b in paired(step["items"], folded([k for k, _ in parts])):
                if a is None or b is None:
                    continue
                place = step["in"] if a is wanted else next((i for i, x in enumerate(a.get("c", ())) if x is wanted), None)
                if a is wanted or place is not None:
                    member = b if place is None else b["c"][place]
                    below += [parts[i][1] for i in member.get("i", ())]
        roots = below
    return roots


def main_text(html: str | None, decision: dict | None = None) -> str:
    """The page's blocks of main text, one to a line, under a host's decision or else the page's own."""
    page = nested(html)
    roots = _reached(page, decision["way"]) if decision else []
    if not any(e[1] for e in roots):
        decision = decided(wrapper_of(page))
        roots = _reached(page, decision["way"])
    fixed = {(tuple(p), t) for p, t in decision["fixed"]}
    inside, words = decision["inside"], ASIDE_WORDS if decision["words"] else COMMENT_WORDS
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if joined := " ".join("".join(line).split()):
            blocks.append(joined)
        line.clear()

    def walk(element: list, path: tuple) -> None:
        for child in element[1]:
            if isinstance(child, str):
                if not fixed or (path, constant(" ".join(child.split()))) not in fixed:
                    line.append(child)
                continue
            tag = tag_of(child[0])
            if tag == "br":
                line.append(" ")
            elif by_tag(child[0], inside) or by_word(child[0], inside, words):
                flush()
            elif tag in INLINE:
                walk(child, (*path, tag))
            else:
                flush()
                walk(child, (*path, tag))
                flush()

    for root in roots:
        walk(root, ())
        flush()
    return "\n".join(blocks)


# -- tables ----------------------------------------------------------------------------------


def _folded(of, flush_at: int = 2000):
    """mapInPandas function: one wrapper per host of what a task reads, or more where hosts are many."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, dict] = {}
        salt = TaskContext.get().partitionId() % 64

        def out() -> pd.DataFrame:
            rows = [(host, salt, json.dumps(w, ensure_ascii=False)) for host, w in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=["host", "salt", "wrapper"])

        for batch in batches:
            for host, body in zip(batch["host"], batch["body"], strict=True):
                new = of(body)
                held[host] = merged(held[host], new) if host in held else new
                if len(held) >= flush_at:
                    yield out()
        yield out()

    return run


def infer(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, wrapper): the wrapper of every host as JSON; see expression() and decided()."""
    shape = T.StructType([T.StructField("host", T.StringType()), T.StructField("salt", T.IntegerType()), T.StructField("wrapper", T.StringType())])
    rows = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("body"))
    parts = rows.mapInPandas(_folded(lambda body: wrapper_of(nested(body))), shape)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        met = None
        for w in sorted(group["wrapper"]):
            met = json.loads(w) if met is None else merged(met, json.loads(w))
        return group.head(1).assign(wrapper=json.dumps(met, ensure_ascii=False))

    salted = parts.groupBy("host", "salt").applyInPandas(merge, shape)
    return salted.groupBy("host").applyInPandas(merge, shape).select("host", "wrapper")


def decisions(wrappers: DataFrame) -> DataFrame:
    """(host, decision) of (host, wrapper), both as JSON; see decided()."""
    shape = T.StructType([T.StructField("host", T.StringType()), T.StructField("decision", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"host": batch["host"], "decision": [json.dumps(decided(json.loads(w)), ensure_ascii=False) for w in batch["wrapper"]]})

    return wrappers.mapInPandas(run, shape)


def extract(pages: DataFrame, url: str = "url", html: str = "html", broadcast_bytes: int = 8 << 20) -> DataFrame:
    """pages with text: the main text of each page's html.

    All rows and columns are kept, but a column called text is replaced. Character
    references are decoded, white space inside a block is one space, blocks are
    trimmed and joined by a line feed, and empty ones left out. A null or empty html
    has an empty text. A null URL, or one without a host, counts as the host "". A page
    that lacks its host's main element is judged by its own wrapper. Pages that repeat
    are one row each; nesting of any depth and texts of any length are read as a whole.
    """
    found = checkpoint(decisions(infer(pages, url, html)))
    size = found.agg(F.sum(F.octet_length("host") + F.octet_length("decision"))).first()[0] or 0
    docs = pages.drop("text")
    host, decision = free_name(docs, "host"), free_name(docs, "decision")
    side = found.select(F.col("host").alias(host), F.col("decision").alias(decision))
    joined = docs.withColumn(host, host_of(F.col(url))).join(F.broadcast(side) if size <= broadcast_bytes else side, host, "left").drop(host)
    shape = T.StructType([*docs.schema.fields, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parsed: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for body, d in zip(batch[html], batch[decision], strict=True):
                if d is not None and d not in parsed:
                    if len(parsed) > 10_000:
                        parsed.clear()
                    parsed[d] = json.loads(d)
                texts.append(main_text(body, None if d is None else parsed[d]))
            yield batch.drop(columns=[decision]).assign(text=texts)

    return joined.mapInPandas(run, shape)
