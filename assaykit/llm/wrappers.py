"""Main text of HTML pages by wrappers that are inferred per host.

A wrapper is a union-free regular expression over the block tags and texts of a host's pages,
nested as the tags are. It starts as one page's token stream; tandem repeats fold into repeated
groups (``p+``, ``(h2 p+)+``). The other sampled pages are aligned to it one after the other: what
only one side has becomes optional, texts that meet become a text slot, groups that meet are
generalised in turn. Inline tags belong to the text they stand in.

The slots of the wrapper then say what is article and what is not:

* a slot with the same text on every page that has it is template text, one that varies is not;
  a slot whose text is mostly links is a menu;
* the article is where the varying text is: from the body on, the wrapper's branch that holds most
  of it is followed down, and on the way back branches beside it join it if they are headings of
  it, stand between a heading and it, or hold much text themselves;
* ``article`` and ``main`` settle the branch where a host has them; elements of forms, menus, asides
  and the like are never article, nor are those whose class is just that (``OUTSIDE_NAMES``).
  Weaker names (``WEAK_NAMES``) only count with slots that are partly links;
* inside the article, template texts and link slots go; a heading goes with what it stands over.

``SAMPLE`` distinct pages of each host (seeded order) are aligned, so a group is bounded whatever
the host's size. Every page is then read whole: its own stream is aligned to its host's wrapper, and
the texts that fall into the article's slots are the result. A block that no sampled page had is
read if it stands inside the article. A page with much text outside the wrapper's article, or none
in it, is of another template and is read through a wrapper of its own.

Blocks: white space becomes one space, ends are trimmed, character references are decoded, blocks
are joined by an empty line in page order. Defined cases: null or empty html gives the empty text;
a null or odd url has the empty host; broken markup is closed as browsers do; pages of any length
are read whole; of a host with one distinct page nothing is known to be template text; ties go to
the branch that comes first; repeated rows each give a row; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, map_rows, written

SAMPLE = 6
RESULT = "page_id long, url string, text string, n_chars long"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"

# Fixed vocabulary of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object textarea title xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CELL = frozenset(["td", "th", "br", "option"])
GENERIC = frozenset("div section center #group".split())
RUNS = frozenset("p li tr dd dt blockquote pre".split())
OUTSIDE = frozenset("nav footer aside form button select menu dialog fieldset head label".split())
OUTSIDE_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
# Class and id names: those of things that are no article, those that may be, and what stands beside them.
OUTSIDE_NAMES = frozenset(
    "nav navbar navigation menu topbar masthead footer sidebar aside ad ads advert adverts advertisement advertising banner sponsor sponsored cookie cookies "
    "consent gdpr popup modal newsletter subscribe comment comments replies respond disqus related recommended breadcrumb breadcrumbs pagination pager toolbar login signup".split()
)
WEAK_NAMES = frozenset("share sharing social legal notice alert promo promotion search widget skip copyright subscription".split())
BESIDE = frozenset(
    "box bar block section list wrap wrapper container area inner outer links link buttons button btn top bottom left right main site page global primary "
    "secondary panel item items group holder slot unit row col column module mobile desktop sticky fixed small large js".split()
)
CLOSES_P = BLOCK - {"summary"}

#: Share of a branch's varying text that its largest branch must hold to be followed.
FOLLOWED = 0.6
#: Share of the article's text that makes a branch beside it a part of it.
PART = 0.25
LINKED, PARTLY_LINKED = 0.6, 0.3
#: Words beyond the article (and so many times it) that make a page one of another template.
MISSED, MISSED_TIMES = 100, 3
LONGEST_GROUP = 4

TAG = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|$)", re.DOTALL)
ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")


def tokens(page: str):
    """("open", tag, attributes), ("close", tag, None) and ("text", text, None), in page order."""
    at, n = 0, len(page)
    while at < n:
        match = TAG.search(page, at)
        begin = match.start() if match else n
        if begin > at:
            yield "text", page[at:begin], None
        if not match:
            return
        at = match.end()
        if match[2]:
            tag = match[2].lower()
            if match[1]:
                yield "close", tag, None
            else:
                yield "open", tag, match[3]
                if tag in RAW and not match[3].rstrip().endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.IGNORECASE).search(page, at)
                    yield "close", tag, None
                    at = end.end() if end else n
        elif at == begin:
            at += 1


def named(attributes: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes and "=" in attributes else {}


class Text:
    """A block's text on a page: its pieces, and how many characters of them are links."""

    __slots__ = ("keep", "linked", "page", "parts")

    def __init__(self, page: int):
        self.page, self.parts, self.linked, self.keep = page, [], 0, False

    def block(self) -> str:
        return " ".join(entities.unescape("".join(self.parts)).split())


class Node:
    """A part of a wrapper, or of a page: an element, a text slot ("#") or a repeated group."""

    __slots__ = ("hard", "keep", "kids", "name", "optional", "region", "repeated", "tag", "texts", "weak", "whole")

    def __init__(self, tag: str, name: str = "", hard: bool = False, weak: bool = False):
        self.tag, self.name, self.hard, self.weak, self.whole = tag, name, hard, weak, False
        self.kids: list[Node] = []
        self.texts: list[Text] = []
        self.repeated = self.optional = self.region = self.keep = False

    @property
    def label(self) -> str:
        return f"{self.tag}.{self.name}" if self.name else self.tag

    def expression(self) -> str:
        """The part as a regular expression."""
        inner = " ".join(k.expression() for k in self.kids)
        mark = "+" if self.repeated else ""
        own = "#" if self.tag == "#" else f"({inner})" if self.tag == "#group" else f"{self.label}({inner})"
        return own + mark + ("?" if self.optional else "")

    def data(self) -> dict:
        flags = self.hard | self.weak << 1 | self.repeated << 2 | self.optional << 3 | self.region << 4 | self.keep << 5
        return {"t": self.tag, "n": self.name, "f": flags, "k": [k.data() for k in self.kids]}

    @staticmethod
    def of(data: dict) -> Node:
        node, f = Node(data["t"], data["n"]), data["f"]
        node.hard, node.weak, node.repeated, node.optional, node.region, node.keep = (bool(f >> i & 1) for i in range(6))
        node.kids = [Node.of(k) for k in data["k"]]
        return node


def name_kind(name: str) -> tuple[bool, bool, bool]:
    """Whether a class or id names something outside the article, a header, or perhaps something."""
    hard = header = weak = False
    for word in name.split():
        parts = set(re.split(r"[-_]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", word).lower())) - {""}
        rest = parts - BESIDE
        hard |= bool(rest) and rest <= OUTSIDE_NAMES
        header |= rest == {"header"}
        weak |= bool(rest) and rest <= WEAK_NAMES | OUTSIDE_NAMES
    return hard, header, weak


def tree(page: str, number: int = 0) -> Node:
    """A page as nested blocks; what is open at the end is closed."""
    top = Node("")
    stack: list[tuple[str, Node | None, bool, bool]] = [("", top, False, False)]  # tag, node of a block, outside, in article or main
    blocks, links = [top], 0
    names: dict[str, tuple[bool, bool, bool]] = {}

    def add(text: str, linked: bool) -> None:
        kids = blocks[-1].kids
        if not (kids and kids[-1].tag == "#"):
            if text.isspace() or not text:
                return
            kids.append(Node("#"))
            kids[-1].texts.append(Text(number))
        slot = kids[-1].texts[0]
        slot.parts.append(text)
        slot.linked += len(text) * linked

    def pop_to(k: int) -> None:
        nonlocal links
        while len(stack) > k:
            tag, node, _, _ = stack.pop()
            links -= tag == "a"
            if node is not None:
                blocks.pop()

    for kind, value, attributes in tokens(page):
        outside, within = stack[-1][2], stack[-1][3]
        if kind == "text":
            if not outside or stack[-1][1] is not None:
                add(value, links > 0)
        elif kind == "open":
            if value in CLOSES_P or value in ("td", "th", "option"):
                ends = {"p"} if value in CLOSES_P else set()
                ends |= {value} if value in ("li", "tr", "option") else {"td", "th"} if value in ("td", "th") else {"dt", "dd"} if value in ("dt", "dd") else set()
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ends:
                        pop_to(k)
                        break
                    if stack[k][0] in BLOCK and stack[k][0] != "p":
                        break
                outside, within = stack[-1][2], stack[-1][3]
            attr = named(attributes)
            name = re.sub(r"[0-9]+", "", f"{attr.get('id', '')} {attr.get('class', '')}").strip() if attr else ""
            hard, header, weak = (names[name] if name in names else names.setdefault(name, name_kind(name))) if name else (False, False, False)
            role = attr.get("role", "").lower()
            whole = value in ("html", "body", "main") or role == "main" or (value == "article" and not hard)
            own = value in OUTSIDE or value in RAW or (hard and not whole) or role in OUTSIDE_ROLE or (not within and (value == "header" or (header and not whole)))
            own = own or "hidden" in attr or bool(re.search(r"(?:^|\s)hidden(?:\s|$)", attributes or "")) or "display:none" in attr.get("style", "").replace(" ", "").lower()
            node = None
            if value in BLOCK:
                node = Node(value, name, outside or own, weak)
                node.whole = (value in ("article", "main") or role == "main") and not node.hard
                blocks[-1].kids.append(node)
            elif value in CELL and not outside:
                add(" ", False)
            if value not in VOID and not (attributes or "").rstrip().endswith("/"):
                stack.append((value, node, outside or own, within or value in ("article", "main") or role == "main"))
                links += value == "a"
                if node is not None:
                    blocks.append(node)
        else:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == value:
                    pop_to(k)
                    break
    return top


# --- The expression ---------------------------------------------------------------------------------


def key(node: Node) -> str:
    """What an element looks like, its texts apart."""
    return f"{node.label}{'!' if node.hard else ''}{'+' if node.repeated else ''}({','.join(map(key, node.kids))})" if node.kids else f"{node.label}{'+' if node.repeated else ''}"


def fold(node: Node) -> Node:
    """Tandem repeats below a node become repeated items, then repeated groups, from short to long."""
    for kid in node.kids:
        fold(kid)
    if len(node.kids) < 2:
        return node
    keys = [key(k) for k in node.kids]
    out: list[Node] = []
    at = 0
    while at < len(node.kids):
        first, end = node.kids[at], at + 1
        # unnamed boxes must look alike three times in a row: two may be different things
        plain = first.tag in GENERIC and not first.name
        while first.tag not in ("#", "#group") and first.tag not in HEADINGS and end < len(node.kids) and node.kids[end].label == first.label and node.kids[end].hard == first.hard and (not plain or keys[end] == keys[at]) and (first.tag in RUNS or first.tag in GENERIC or first.name or keys[end] == keys[at]):
            end += 1
        if plain and end - at < 3:
            end = at + 1
        for kid in node.kids[at + 1 : end]:
            merge(first, kid)
            first.repeated = True
        out.append(first)
        at = end
    for size in range(2, LONGEST_GROUP + 1):
        out = grouped(out, size)
    node.kids = out
    return node


def grouped(items: list[Node], size: int) -> list[Node]:
    out, at = [], 0
    labels = [k.label for k in items]
    while at < len(items):
        unit, end = labels[at : at + size], at + size
        while len(unit) == size and len(set(unit)) > 1 and "#" not in unit and labels[end : end + size] == unit:
            end += size
        if end > at + size:
            out.append(group(items[at : at + size]))
            for k in range(at + size, end, size):
                merge(out[-1], group(items[k : k + size]))
            out[-1].repeated = True
            at = end
        else:
            out.append(items[at])
            at += 1
    return out


def group(items: list[Node]) -> Node:
    node = Node("#group")
    node.kids = list(items)
    node.hard = all(k.hard for k in items)
    return node


def regrouped(items: list[Node], patterns: list[list[str]]) -> list[Node]:
    """Runs of items that read like a group of the other side become such a group."""
    for pattern in patterns:
        at, out = 0, []
        while at < len(items):
            if [k.label for k in items[at : at + len(pattern)]] == pattern:
                out.append(group(items[at : at + len(pattern)]))
                at += len(pattern)
            else:
                out.append(items[at])
                at += 1
        items = out
    return items


def likeness(a: Node, b: Node) -> float:
    """How well two items meet: 0 if they can't, else up to 1."""
    if a.tag != b.tag or a.hard != b.hard:
        return 0.0
    if a.tag == "#":
        return 1.0
    left, right = {k.tag for k in a.kids}, {k.tag for k in b.kids}
    inner = len(left & right) / len(left | right) if left or right else 1.0
    if a.name or b.name:
        x, y = set(a.name.split()), set(b.name.split())
        outer = len(x & y) / len(x | y)
    else:
        outer = 0.5 if a.tag in GENERIC else 1.0
    score = 0.4 * outer + 0.6 * inner
    return score if score > 0.35 else 0.0


def align(wrapper: list[Node], other: list[Node]) -> list[tuple[Node | None, Node | None]]:
    """Pairs of items that meet, in order; items that meet nothing stand alone."""
    groups = [[k.label for k in n.kids] for n in wrapper if n.tag == "#group"]
    if groups:
        other = regrouped(other, groups)
    groups = [[k.label for k in n.kids] for n in other if n.tag == "#group"]
    if groups:
        wrapper = regrouped(wrapper, groups)
    n, m = len(wrapper), len(other)
    if n == m and len({k.label for k in wrapper}) == n and all(a.label == b.label and a.hard == b.hard and a.tag not in GENERIC for a, b in zip(wrapper, other)):
        return list(zip(wrapper, other))
    # the best sum of likenesses over common subsequences
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    meets = [[likeness(a, b) for b in other] for a in wrapper]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + meets[i][j] if meets[i][j] else 0.0)
    pairs: list[tuple[Node | None, Node | None]] = []
    i = j = 0
    while i < n and j < m:
        if meets[i][j] and best[i][j] == best[i + 1][j + 1] + meets[i][j]:
            pairs.append((wrapper[i], other[j]))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            pairs.append((wrapper[i], None))
            i += 1
        else:
            pairs.append((None, other[j]))
            j += 1
    return pairs + [(a, None) for a in wrapper[i:]] + [(None, b) for b in other[j:]]


def merge(wrapper: Node, other: Node) -> Node:
    """The wrapper generalised to accept ``other`` as well."""
    wrapper.texts += other.texts
    wrapper.repeated |= other.repeated
    wrapper.optional |= other.optional
    wrapper.whole |= other.whole
    if wrapper.kids or other.kids:
        kids: list[Node] = []
        for a, b in align(wrapper.kids, other.kids):
            if a is not None and b is not None:
                kids.append(merge(a, b))
                continue
            alone = a if b is None else b
            alone.optional = True
            last = kids[-1] if kids else None
            # one more item beside its repeats is one of them
            if last is not None and last.label == alone.label and (last.repeated or alone.repeated) and last.hard == alone.hard and last.tag != "#group":
                merge(last, alone).repeated = True
            else:
                kids.append(alone)
        wrapper.kids = kids
    return wrapper


# --- What the slots say -------------------------------------------------------------------------------


class Slot:
    """A text slot of the wrapper, and what the sampled pages have in it."""

    def __init__(self, node: Node, parents: list[Node], pages: int):
        self.node, self.parents = node, parents
        by_page: dict[int, list[str]] = {}
        self.chars = self.linked = self.words = 0
        for text in node.texts:
            block = text.block()
            by_page.setdefault(text.page, []).append(block)
            self.chars += sum(map(len, text.parts))
            self.linked += text.linked
            self.words += len(block.split())
        self.template = len(by_page) > 1 and len({tuple(t) for t in by_page.values()}) == 1
        self.words /= pages
        self.links = self.linked / max(1, self.chars)
        self.hard = any(p.hard for p in parents)
        self.heading = any(p.tag in HEADINGS for p in parents)
        self.varies = not (self.template or self.hard or self.links >= LINKED)


def slots_of(node: Node, pages: int, parents: tuple[Node, ...] = ()) -> list[Slot]:
    if node.tag == "#":
        return [Slot(node, list(parents), pages)] if any(t.block() for t in node.texts) else []
    return [s for k in node.kids for s in slots_of(k, pages, (*parents, node))]


def article_parts(top: Node, slots: list[Slot]) -> list[Node]:
    """The parts of the wrapper that hold the article."""
    varying = [s for s in slots if s.varies] or [s for s in slots if not s.hard and s.links < LINKED] or [s for s in slots if not s.hard]
    mass: dict[int, float] = {}
    for s in varying:
        for p in (*s.parents, s.node):
            mass[id(p)] = mass.get(id(p), 0.0) + s.words
    whole = mass.get(id(top), 0.0)
    if not whole:
        return []
    for tag in ("article", "main"):
        found, queue = [], [top]
        while queue:
            node = queue.pop(0)
            if node.whole and not node.hard and (node.tag == "article") == (tag == "article"):
                if mass.get(id(node), 0.0):
                    found.append(node)
            else:
                queue += node.kids
        if found and sum(mass[id(n)] for n in found) >= PART * whole:
            return found
    path = [top]
    while True:
        heaviest = max(path[-1].kids, key=lambda k: mass.get(id(k), 0.0), default=None)
        if heaviest is None or heaviest.tag in RUNS or heaviest.tag in HEADINGS or heaviest.tag in ("#", "#group") or mass.get(id(heaviest), 0.0) < FOLLOWED * mass[id(path[-1])]:
            break
        path.append(heaviest)
    if path[-1] is top:
        return [top]
    parts, own = [path[-1]], mass[id(path[-1])]
    open_heading = {id(s.parents[-1]) for s in varying if s.heading} | {id(p) for s in varying if s.heading for p in s.parents if p.tag in GENERIC and all(q.tag in HEADINGS or q.tag == "#" for q in p.kids)}
    for parent, child in reversed(list(zip(path, path[1:]))):
        at = next(k for k, x in enumerate(parent.kids) if x is child)
        heads = [k for k in range(at) if id(parent.kids[k]) in open_heading]
        start = heads[0] if heads else at
        for k, beside in enumerate(parent.kids):
            weight = mass.get(id(beside), 0.0)
            if k != at and weight and (start <= k < at or weight >= PART * own):
                parts.append(beside)
    return parts


def decide(top: Node, pages: int) -> Node:
    """Marks the wrapper's article (``region``) and the slots that are read (``keep``)."""
    slots = slots_of(top, pages)

    def mark(node: Node) -> None:
        if not node.hard:
            node.region = True
            for k in node.kids:
                mark(k)

    for part in article_parts(top, slots):
        mark(part)
    inside = [s for s in slots if s.node.region]
    all_template = all(s.template for s in inside)
    for s in inside:
        partly = s.links >= PARTLY_LINKED and any(p.weak for p in s.parents)
        s.node.keep = s.links < LINKED and not partly and (not s.template or all_template)
    # a heading goes with what it stands over
    under: bool | None = None
    for s in reversed(inside):
        if s.heading:
            s.node.keep = under is not False and s.links < LINKED or (under is True)
            under = None if not s.node.keep else True
        else:
            under = s.node.keep if under is None else under or s.node.keep
    return top


def infer(pages: list[str]) -> Node:
    """The wrapper of a host's sampled pages."""
    own = list(dict.fromkeys(pages))
    wrapper = fold(tree(own[0], 0)) if own else Node("")
    for k, page in enumerate(own[1:], 1):
        merge(wrapper, fold(tree(page, k)))
        for size in range(2, LONGEST_GROUP + 1):
            wrapper.kids = grouped(wrapper.kids, size)
    return decide(wrapper, max(1, len(own)))


# --- Reading pages ------------------------------------------------------------------------------------


def match(wrapper: Node, page: Node) -> None:
    """Marks the page's texts that fall into slots that are read, and new ones inside the article."""
    for a, b in align(wrapper.kids, page.kids):
        if b is None:
            continue
        if a is None:
            fresh(b, wrapper.region)
        elif b.tag == "#":
            for t in b.texts:
                t.keep = a.keep
        else:
            match(a, b)


def fresh(node: Node, region: bool) -> None:
    if node.hard:
        return
    for t in node.texts:
        t.keep = region and t.linked < LINKED * sum(map(len, t.parts))
    for k in node.kids:
        fresh(k, region)


def texts_of(node: Node) -> list[tuple[Text, bool]]:
    return [(t, node.hard) for t in node.texts] + [x for k in node.kids for x in ([(t, node.hard) for t in k.texts] if k.tag == "#" else texts_of(k))]


def read(page: str, wrapper: Node) -> tuple[list[str], bool]:
    """The page's blocks by the wrapper, and whether the page is of its template."""
    top = tree(page)
    order = texts_of(top)  # before folding: in page order
    fold(top)
    match(wrapper, top)
    blocks = [t.block() for t, _ in order if t.keep]
    kept = sum(len(b.split()) for b in blocks)
    missed = sum(len("".join(t.parts).split()) for t, hard in order if not t.keep and not hard and t.linked < LINKED * sum(map(len, t.parts)))
    return [b for b in blocks if b], kept > 0 and missed <= max(MISSED, MISSED_TIMES * kept)


def main_text(page: str | None, wrapper: Node | None) -> str:
    if not page:
        return ""
    if wrapper is not None:
        blocks, fits = read(page, wrapper)
        if fits:
            return "\n\n".join(blocks)
    return "\n\n".join(read(page, infer([page]))[0])


class Wrappers(dict):
    """Wrappers of a task's hosts, by their text."""

    def __missing__(self, text: str | None) -> Node | None:
        if len(self) > 2000:
            self.clear()
        node = self[text] = Node.of(json.loads(text)) if text else None
        return node


class Read:
    """Every page through its host's wrapper."""

    def start(self):
        known = Wrappers()

        def work(page_id, url, html, wrapper):
            texts = [main_text(page, known[w]) for page, w in zip(html, wrapper)]
            return {"page_id": page_id, "url": url, "text": texts, "n_chars": [len(t) for t in texts]}

        return work


def with_host(pages: DataFrame) -> DataFrame:
    plain = columns(pages, page_id="long", url="string", html="string")
    return plain.withColumn("host", F.lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit(""))))


def infer_group(key: tuple[Any, ...], group: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"host": [key[0]], "wrapper": [json.dumps(infer(list(group.sort_values(["at"]).html)).data(), separators=(",", ":"))]})


def wrappers(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(host, wrapper): one row a host, from at most ``sample`` of its pages."""
    order = Window.partitionBy("host").orderBy(F.xxhash64("page_id", "url"), "page_id", F.md5("html"))
    picked = pages.where(F.length("html") > 0).withColumn("at", F.row_number().over(order)).where(F.col("at") <= sample)
    return picked.select("host", "html", "at").groupBy("host").applyInPandas(infer_group, "host string, wrapper string")


def extract(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = with_host(pages)
    # a table of its own: the join deals both sides anew, so a host with most pages can be split
    found = written(wrappers(rows, sample))
    return map_rows(rows.join(found, "host", "left").select("page_id", "url", "html", "wrapper"), Read(), RESULT)
