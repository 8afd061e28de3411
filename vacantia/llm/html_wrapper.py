"""Main text of web pages by wrappers inferred for each host.

1. A page becomes a tree of blocks: tags with what tells them apart (name, class words, id
   and role without digits) and text. Marks inside a line are no blocks.
2. Pages of a host are aligned one after the other, sequence of blocks by sequence of
   blocks. What only one side has becomes optional; neighbours that repeat, alone or as a
   series, become a repeated group; texts meet in text slots. The result is the host's
   wrapper, a regular expression without unions that all its pages match. Each of its nodes
   knows on how many pages it stands, how much text and linked text it holds and whether
   its text is ever another.
3. Wrappers of one host from many tasks are aligned with one another like pages, first
   within a fixed number of parts, then all parts, so no task ever holds a host's pages.
4. A finished wrapper says which of its nodes are the article: the labelled article or
   main part where that holds most of the text, else the narrowest node that does; without
   navigation, forms and whatever names itself a notice, advert, comment or the like,
   without lists of links and without text that is the host's own because it never changes.
5. Each page is aligned with the wrapper of its host, and the text of the nodes that it
   marks is put together in page order.

A wrapper is bounded whatever the pages hold: a sequence of more kinds of blocks than
``LONGEST`` is widened to one repeated group of optional blocks, so is nesting beyond
``DEEPEST``. Widening loses no page and no text.

Rules: a null or empty page has the text ''. Character references are decoded, white space
(as Unicode has it) inside a block becomes one space, blocks are joined by a line feed.
A line break inside a block is white space. Pages without a host, or without a URL, are
aligned with one another. Repeated rows count each and give equal texts.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.hashing import slices
from vacantia.llm.session import Scratch
from vacantia.llm.url_filter import host_of

#: Blocks in a sequence, and levels, before a wrapper is widened; nodes before it is more so.
LONGEST, DEEPEST, MOST_NODES = 48, 60, 4000
#: Wrapper nodes that a task holds before it hands them on.
HELD_NODES = 200_000
#: Parts that the wrappers of one host are first aligned in.
PARTS = 32
#: Bytes of wrappers that all tasks may know; beyond, pages are joined with them.
KNOWN_BYTES = 32_000_000
#: Longest series of blocks that is looked for as a repeated group.
SERIES = 4
#: Text is a host's own if it is the same on so many pages at least, and half of them.
OWN_PAGES = 8

# ------------------------------------------------------------------ fixed values: HTML

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
TRANSPARENT = frozenset(("html", "body"))
HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an opening tag ends, and the tags that it does not look beyond.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
HOLDS_P = frozenset("article aside blockquote body button dd div fieldset figure footer form header li main nav object section table td th".split())
NEVER_TEXT = frozenset(
    "script style noscript template head title nav aside footer menu form fieldset button select option datalist textarea "
    "input iframe object svg math canvas audio video map dialog noembed noframes xmp".split()
)

# ------------------------------------------------------------------ fixed values: names of boilerplate

BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox sponsor sponsored sponsors "
    "promo promos promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs masthead topbar "
    "footer colophon sidebar sidenav aside cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "toast newsletter subscribe subscription signup login signin register searchform comment comments commentlist respond "
    "reply replies disqus discussion share sharing social related recommended recommendations trending widget widgets "
    "toolbar pagination pager paging copyright disclaimer skiplink hidden complementary contentinfo search".split()
)
HEADER_WORDS = frozenset(("header", "banner"))
ARTICLE_WORDS = frozenset("article articlebody post entry story content main maincontent".split())

# ------------------------------------------------------------------ pages as trees of blocks

_TAG = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*))>", re.S
)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}
_ATTRIBUTE = re.compile(
    r"(?<![^\s\"'/])(class|id|role|itemprop|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?=[\s/]|$)", re.I
)
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@lru_cache(20_000)
def kind_of(name: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """Signature; whether it is never text; whether it names the article; whether it names a header."""
    given = {k.lower(): v.strip("\"'") if v else "" for k, v in _ATTRIBUTE.findall(attributes)}
    labels = f"{given.get('class', '')} {given.get('id', '')} {given.get('role', '')} {given.get('itemprop', '')}".split()
    plain = sorted({w for w in (re.sub(r"\d+", "", label).strip("-_").lower() for label in labels) if w})
    signature = ".".join([name, *plain])[:80]
    hidden = "hidden" in given or given.get("aria-hidden", "").lower() == "true" or bool(_HIDES.search(given.get("style", "")))
    whole = set(plain)
    parts: set[str] = set()
    for label in labels:
        own = [w.lower() for w in _WORD.findall(label)]
        if own and own[0] not in ("has", "no", "with", "is", "without"):
            parts.update(own)
    if name in ("article", "main"):
        return signature, hidden or bool(whole & BOILERPLATE), True, False
    dropped = hidden or name in NEVER_TEXT or bool((whole | parts) & BOILERPLATE)
    header = name == "header" or bool((whole | parts) & HEADER_WORDS)
    return signature, dropped, bool(whole & ARTICLE_WORDS), header


class Block:
    """A tag of a page with its texts and blocks in order; ``keep`` is what a wrapper says of it."""

    __slots__ = ("name", "signature", "kids", "inline", "keep", "open")

    def __init__(self, name: str, signature: str, inline: bool = False):
        self.name, self.signature, self.inline = name, signature, inline
        self.kids: list[Block | Text] = []
        self.keep, self.open = False, True


class Text:
    __slots__ = ("text", "links", "keep")

    def __init__(self, text: str, links: int):
        self.text, self.links, self.keep = text, links, False


def parse(page: str) -> Block:
    """The page as a tree; unclosed and misplaced tags are settled much as browsers do."""
    root = Block("", "")
    stack = [root]
    pieces: list[str] = []
    links = [0]  # characters of the pieces that are linked
    linked = 0
    marks: dict[str, list[Block | None]] = {}
    head: Block | None = None

    def flush() -> None:
        if pieces:
            text = "".join(pieces)
            stack[-1].kids.append(Text(html.unescape(text) if "&" in text else text, links[0]))
            pieces.clear()
            links[0] = 0

    def pop_to(block: Block) -> None:
        while True:
            last = stack.pop()
            last.open = False
            if last is block:
                return

    def open_block(name: str, signature: str, inline: bool = False) -> Block | None:
        if len(stack) > DEEPEST:
            return None
        block = Block(name, signature, inline)
        stack[-1].kids.append(block)
        stack.append(block)
        return block

    def end(names: set[str] | frozenset, scope: set[str] | frozenset) -> None:
        for block in reversed(stack[1:]):
            if block.name in names:
                pop_to(block)
                return
            if block.name in scope:
                return

    at, last_end = 0, page.rfind(">")
    search = _TAG.search
    while at <= last_end:
        found = search(page, at)
        if not found:
            break
        if found.start() > at:
            piece = page[at : found.start()]
            pieces.append(piece)
            if linked:
                links[0] += len(piece)
        at = found.end()
        name = found[2]
        if name is None:
            continue
        name, closing = name.lower(), bool(found[1])
        if head is not None and head.open and name not in HEAD and name != "head" and not closing:
            flush()
            pop_to(head)
        if name in VOID:
            if name in ("br", "wbr"):
                pieces.append(" " if name == "br" else "")
            elif name in ("hr", "input"):
                flush()
                if name == "hr":
                    end({"p"}, HOLDS_P)
                stack[-1].kids.append(Block(name, name))
            continue
        if name in TRANSPARENT:
            flush()
            continue
        if name in INLINE:
            if closing:
                if name == "a" and linked:
                    linked -= 1
                own = marks.get(name)
                block = own.pop() if own else None
                if block is not None and block.open:
                    flush()
                    pop_to(block)
                continue
            block = None
            signature, dropped, _, _ = kind_of(name, found[3])
            if signature != name or dropped:
                flush()
                block = open_block(name, f"{signature}!" if dropped else signature, inline=True)
            marks.setdefault(name, []).append(block)
            if name == "a":
                linked += 1
            continue
        flush()
        if closing:
            for block in reversed(stack[1:]):
                if block.name == name:
                    pop_to(block)
                    break
                if block.name in ("table", "td", "th") and name not in ("table", "tr", "tbody", "thead", "tfoot", "div", "article", "main"):
                    break
            continue
        if name in CLOSES_P:
            end({"p"}, HOLDS_P)
        if name in ENDS:
            end(*ENDS[name])
        linked = 0 if name == "p" else linked  # a paragraph ends a link that was never closed
        signature, dropped, _, _ = kind_of(name, found[3])
        block = open_block(name, f"{signature}!" if dropped else signature)
        if name == "head":
            head = block
        if name in RAW:
            stop = _RAW_END[name].search(page, at)
            at = stop.end() if stop else len(page)
            if block is not None:
                pop_to(block)
    if at < len(page):
        pieces.append(page[at:])
    flush()
    return root


# ------------------------------------------------------------------ wrappers

TEXT, SERIES_SIGN, ANY = "#", "(", "(*)"


class Node:
    """A wrapper node: a tag, a text slot, or a group (``(...)``) of nodes in a series."""

    __slots__ = ("signature", "kids", "optional", "repeated", "pages", "chars", "links", "text", "keep", "blocks")

    def __init__(self, signature: str, kids: list[Node], pages: int = 1, chars: int = 0, links: int = 0, text: int = 0):
        self.signature, self.kids = signature, kids
        self.optional = self.repeated = False
        self.pages, self.chars, self.links = pages, chars, links
        #: A hash of the only text seen; 0 if there were several.
        self.text = text
        self.keep: bool | None = None
        self.blocks: list[Block | Text] = []

    def plain(self) -> list:
        flags = self.optional + 2 * self.repeated + 4 * (self.keep is True) + 8 * (self.keep is False)
        return [self.signature, flags, self.pages, self.chars, self.links, self.text, [k.plain() for k in self.kids]]

    @staticmethod
    def from_plain(value: list) -> Node:
        signature, flags, pages, chars, links, text, kids = value
        node = Node(signature, [Node.from_plain(k) for k in kids], pages, chars, links, text)
        node.optional, node.repeated = bool(flags & 1), bool(flags & 2)
        node.keep = True if flags & 4 else False if flags & 8 else None
        return node


def _merged(a: Node, b: Node, same_page: bool) -> Node:
    """Both as one node; ``same_page``: they are neighbours on one page."""
    node = Node(
        a.signature,
        aligned(a.kids, b.kids, same_page),
        max(a.pages, b.pages) if same_page else a.pages + b.pages,
        a.chars + b.chars,
        a.links + b.links,
        a.text if a.text == b.text else 0,
    )
    node.optional = a.optional or b.optional
    node.repeated = same_page or a.repeated or b.repeated
    node.keep = a.keep if a.keep is not None else b.keep
    node.blocks = a.blocks + b.blocks if a.blocks and b.blocks else a.blocks or b.blocks
    return node


def _series(items: list[Node], k: int) -> list[Node] | None:
    """``items`` with its first repeated series of ``k`` blocks as one group."""
    signs = [x.signature for x in items]
    for i in range(len(items) - 2 * k + 1):
        series = signs[i : i + k]
        if series == signs[i + k : i + 2 * k] and not any(s.startswith(SERIES_SIGN) for s in series):
            until = i + k
            group = _as_group(items[i:until])
            while signs[until : until + k] == signs[i : i + k]:
                group = _merged(group, _as_group(items[until : until + k]), True)
                until += k
            return [*items[:i], group, *items[until:]]
    return None


def _as_group(items: list[Node]) -> Node:
    signature = SERIES_SIGN + "|".join(x.signature for x in items) + ")"
    node = Node(signature, items, max(x.pages for x in items))
    node.keep = next((x.keep for x in items if x.keep is not None), None)
    return node


def _widened(items: list[Node], same_page: bool) -> list[Node]:
    """A repeated group of optional blocks, each kind once, in the order of their first place."""
    kinds: dict[str, Node] = {}

    def take(node: Node) -> None:
        if node.signature == ANY or node.signature.startswith(SERIES_SIGN):
            for kid in node.kids:
                take(kid)
            return
        sign = node.signature
        if sign not in kinds and len(kinds) >= LONGEST:
            sign = sign.split(".")[0] + ("!" if sign.endswith("!") else "")
            if sign not in kinds and len(kinds) >= 2 * LONGEST:
                sign = "other!" if sign.endswith("!") else "other"
            node.signature = sign
        kinds[sign] = _merged(kinds[sign], node, True) if sign in kinds else node
        kinds[sign].optional = True

    for item in items:
        take(item)
    group = Node(ANY, list(kinds.values()), max((x.pages for x in items), default=1))
    group.repeated = True
    group.keep = next((x.keep for x in items if x.signature == ANY), None)
    return [group]


def _collapsed(items: list[Node]) -> list[Node]:
    """Neighbours of one kind are one repeated node, series that repeat are one group."""
    changed = True
    while changed:
        changed = False
        out: list[Node] = []
        for item in items:
            if out and out[-1].signature == item.signature:
                out[-1] = _merged(out[-1], item, True)
                changed = True
            else:
                out.append(item)
        items = out
        for k in range(2, SERIES + 1):
            if len(items) >= 2 * k and (found := _series(items, k)) is not None:
                items, changed = found, True
                break
    return _widened(items, True) if len(items) > LONGEST else items


def _grouped_like(items: list[Node], others: list[Node]) -> list[Node]:
    """``items`` with what matches a group of ``others`` taken for that group."""
    signs = {x.signature for x in items}
    for group in others:
        if not group.signature.startswith(SERIES_SIGN) or group.signature == ANY or group.signature in signs:
            continue
        wanted, k = [x.signature for x in group.kids], len(group.kids)
        out, i = [], 0
        while i < len(items):
            if k > 1 and [x.signature for x in items[i : i + k]] == wanted:
                out.append(_as_group(items[i : i + k]))
                i += k
            else:
                out.append(items[i])
                i += 1
        if len(out) < len(items):
            items = _collapsed(out)
    return items


def aligned(a: list[Node], b: list[Node], same_page: bool = False) -> list[Node]:
    """One sequence for both. What one side lacks is optional."""
    if len(a) == len(b) and all(x.signature == y.signature for x, y in zip(a, b)):
        return [_merged(x, y, False) if not same_page else _inside(x, y) for x, y in zip(a, b)]
    if any(x.signature == ANY for x in a) or any(x.signature == ANY for x in b):
        return _widened([*a, *b], same_page)
    a, b = _grouped_like(a, b), _grouped_like(b, a)
    # Longest common subsequence, longer matches of text-bearing blocks first.
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below, sign = best[i], best[i + 1], a[i].signature
        for j in range(m - 1, -1, -1):
            here = below[j + 1] + 1 if sign == b[j].signature else 0
            row[j] = max(here, below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i].signature == b[j].signature and best[i][j] == best[i + 1][j + 1] + 1:
            out.append(_inside(a[i], b[j]) if same_page else _merged(a[i], b[j], False))
            i, j = i + 1, j + 1
            continue
        if j >= m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append(a[i])
            i += 1
        else:
            out.append(b[j])
            j += 1
        out[-1].optional = True
    return _collapsed(out)


def _inside(a: Node, b: Node) -> Node:
    """Like parts of two neighbours on one page: not repeated for that."""
    node = _merged(a, b, False)
    node.pages = max(a.pages, b.pages)
    return node


def wrapper_of(block: Block) -> list[Node]:
    """A page's own wrapper; its nodes know their blocks."""
    items: list[Node] = []
    for kid in block.kids:
        if isinstance(kid, Text):
            chars = len(kid.text)
            if not kid.text or kid.text.isspace():
                continue
            node = Node(TEXT, [], 1, chars, min(kid.links, chars), zlib.crc32(" ".join(kid.text.split()).encode("utf-8", "replace")) + 1)
        else:
            node = Node(kid.signature, wrapper_of(kid))
        node.blocks = [kid]
        items.append(node)
    return _collapsed(items)


def _count(items: list[Node]) -> int:
    return sum(1 + _count(x.kids) for x in items)


def bounded(items: list[Node]) -> list[Node]:
    """A wrapper of too many nodes, widened level by level from below."""
    limit = 16
    while _count(items) > MOST_NODES and limit >= 1:
        items = _narrow(items, limit)
        limit //= 2
    return items


def _narrow(items: list[Node], limit: int) -> list[Node]:
    for item in items:
        item.kids = _narrow(item.kids, limit)
    return _widened(items, True) if len(items) > limit and items[0].signature != ANY else items


# ------------------------------------------------------------------ what of a wrapper is the article


def _name(node: Node) -> str:
    return node.signature.rstrip("!").split(".")[0]


def _labels(node: Node) -> set[str]:
    return set(node.signature.rstrip("!").split(".")[1:])


def _is_group(node: Node) -> bool:
    return node.signature.startswith(SERIES_SIGN)


def _own_text(node: Node, forms: bool) -> int:
    """Characters of unlinked text below a node that may be article text."""
    if _dropped(node, forms):
        return 0
    return node.chars - node.links + sum(_own_text(k, forms) for k in node.kids) if node.kids else node.chars - node.links


def _dropped(node: Node, forms: bool) -> bool:
    if _name(node) == "form" and forms:
        return bool(_labels(node) & BOILERPLATE)
    return node.signature.endswith("!")


def _text_and_links(node: Node) -> tuple[int, int]:
    chars, links = node.chars, node.links
    for kid in node.kids:
        own = _text_and_links(kid)
        chars, links = chars + own[0], links + own[1]
    return chars, links


def decide(items: list[Node], pages: int) -> None:
    """Set ``keep`` of every node: whether its own text belongs to the article."""
    root = Node("", items, pages)
    bare = _own_text(root, False)
    # A form around the whole page is no form of the page.
    forms = _own_text(root, True) > 2 * bare
    total = _own_text(root, forms)

    def outermost(node: Node, test) -> list[Node]:
        if _dropped(node, forms):
            return []
        if test(node):
            return [node]
        return [x for k in node.kids for x in outermost(k, test)]

    tests = (
        lambda x: _name(x) == "article" or "articlebody" in _labels(x),
        lambda x: _name(x) == "main" or "main" in _labels(x),
        lambda x: bool(_labels(x) & ARTICLE_WORDS),
    )
    roots, labelled = [], False
    for test in tests:
        found = outermost(root, test)
        if found and 2 * sum(_own_text(x, forms) for x in found) >= max(1, total):
            roots, labelled = found, True
            break
    if not roots:
        roots = [_narrowest(root, forms)]
    chosen = {id(x) for x in roots}
    changes = any(_changes(x, forms) for x in roots)

    def mark(node: Node, inside: bool) -> None:
        inside = inside or id(node) in chosen
        keep = inside and not _dropped(node, forms)
        if keep and not labelled and id(node) not in chosen:
            _, _, _, header = kind_of(_name(node), "".join(f' class="{" ".join(_labels(node))}"'))
            keep = not header and not _is_menu(node)
        if not keep:
            _drop(node)
            if not inside and not _dropped(node, forms):
                for kid in node.kids:
                    mark(kid, False)
            return
        node.keep = True
        for kid in node.kids:
            mark(kid, True)
            own = kid.signature == TEXT and kid.text and not kid.repeated and not node.repeated
            if own and changes and kid.pages >= OWN_PAGES and 2 * kid.pages >= pages and _name(node) not in HEADINGS:
                kid.keep = False

    mark(root, False)


def _drop(node: Node) -> None:
    node.keep = False
    for kid in node.kids:
        _drop(kid)


def _changes(node: Node, forms: bool) -> bool:
    if _dropped(node, forms):
        return False
    return (node.signature == TEXT and not node.text) or any(_changes(k, forms) for k in node.kids)


def _is_menu(node: Node) -> bool:
    """A list or box of links."""
    if _is_group(node) or _name(node) not in ("ul", "ol", "dl", "div", "table", "section", "p"):
        return False
    chars, links = _text_and_links(node)
    return links * 10 >= chars * 7 and chars > 0


def _narrowest(node: Node, forms: bool) -> Node:
    """The deepest node that still has most of the unlinked text below it, beyond single paragraphs."""
    while True:
        total = _own_text(node, forms)
        wide = [k for k in node.kids if k.signature != TEXT and 10 * _own_text(k, forms) >= 8 * max(1, total)]
        if len(wide) != 1 or _name(wide[0]) in ("p", "pre", "blockquote", "li", "td", "tr", *HEADINGS) or wide[0].repeated:
            return node
        node = wide[0]


# ------------------------------------------------------------------ texts of pages


def page_text(page: Block) -> str:
    """The text of all that is kept, in page order, a line for each block."""
    lines: list[str] = []
    pieces: list[str] = []

    def flush() -> None:
        if line := " ".join("".join(pieces).split()):
            lines.append(line)
        pieces.clear()

    def walk(block: Block) -> None:
        for kid in block.kids:
            if isinstance(kid, Text):
                if kid.keep:
                    pieces.append(kid.text)
                elif kid.text[:1].isspace() or kid.text[-1:].isspace():
                    pieces.append(" ")
            elif kid.inline:
                walk(kid)
            else:
                flush()
                walk(kid)
                flush()

    walk(page)
    flush()
    return "\n".join(lines)


def _apply(items: list[Node], inherited: bool) -> None:
    """Hand a wrapper's decisions on to the page's own blocks."""
    for node in items:
        keep = node.keep
        if keep is None:
            keep = inherited and not node.signature.endswith("!")
        for block in node.blocks:
            block.keep = keep
        _apply(node.kids, keep)


def extract(page: str, wrapper: list[Node]) -> str:
    tree = parse(page)
    _apply(aligned(wrapper, wrapper_of(tree)), False)
    return page_text(tree)


# ------------------------------------------------------------------ Spark jobs


def _packed(items: list[Node], pages: int) -> bytes:
    return zlib.compress(json.dumps([pages, [x.plain() for x in items]], separators=(",", ":")).encode(), 1)


def _unpacked(data: bytes) -> tuple[list[Node], int]:
    pages, items = json.loads(zlib.decompress(data))
    return [Node.from_plain(x) for x in items], pages


def _forget_blocks(items: list[Node]) -> list[Node]:
    for node in items:
        node.blocks = []
        _forget_blocks(node.kids)
    return items


_PARTIAL = pa.schema([("host", pa.string()), ("part", pa.int32()), ("place", pa.int64()), ("wrapper", pa.binary())])


def _task_wrappers(pages: DataFrame) -> DataFrame:
    """A wrapper of each host that a task meets, or several if it meets very many hosts."""

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        held: dict[str, tuple[list[Node], int]] = {}
        sizes: dict[str, int] = {}
        place = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for host in sorted(held):
                blob = _packed(*held[host])
                yield pa.RecordBatch.from_pylist([{"host": host, "part": task % PARTS, "place": task * 1_000_000 + place, "wrapper": blob}], _PARTIAL)

        nodes = 0
        for batch in batches:
            for part in slices(batch, "html"):
                for host, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                    own = _forget_blocks(wrapper_of(parse(page or "")))
                    before, seen = held.get(host, (None, 0))
                    now = bounded(own if before is None else aligned(before, own))
                    held[host] = now, seen + 1
                    if seen & (seen - 1) == 0 or seen % 64 == 0:  # sizes settle soon
                        nodes += (size := _count(now)) - sizes.get(host, 0)
                        sizes[host] = size
                    if nodes > HELD_NODES:
                        yield from rows()
                        held, sizes, nodes, place = {}, {}, 0, place + 1
        yield from rows()

    return pages.select("host", "html").mapInArrow(infer, "host string, part int, place bigint, wrapper binary")


def _joined_wrappers(partial: DataFrame, keys: list[str], finish: bool) -> DataFrame:
    """Rows of equal keys, which follow one another in each partition, as one wrapper."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, items, pages, first = None, [], 0, {}

        def row() -> pa.RecordBatch:
            if finish:
                decide(items, pages)
            return pa.RecordBatch.from_pylist([{**first, "wrapper": _packed(items, pages)}], _PARTIAL)

        for batch in batches:
            for value in batch.to_pylist():
                key = tuple(value[k] for k in keys)
                own, n = _unpacked(value["wrapper"])
                if last is not None and key == last:
                    items, pages = bounded(aligned(items, own)), pages + n
                    continue
                if last is not None:
                    yield row()
                last, items, pages, first = key, own, n, value
        if last is not None:
            yield row()

    order = [*keys, *(c for c in ("part", "place") if c not in keys)]
    return partial.repartition(*keys).sortWithinPartitions(*order).mapInArrow(join, "host string, part int, place bigint, wrapper binary")


def infer_wrappers(pages: DataFrame, url: str = "url", page_html: str = "html") -> DataFrame:
    """``host, wrapper`` of every host, each with its decisions, as a table in the shared folder."""
    rows = pages.select(host_of(F.col(url)).alias("host"), F.coalesce(F.col(page_html), F.lit("")).alias("html"))
    partial = _joined_wrappers(_task_wrappers(rows), ["host", "part"], finish=False)
    whole = _joined_wrappers(partial, ["host"], finish=True)
    return Scratch(pages.sparkSession).stage(whole.select("host", "wrapper"), "wrappers")


def extract_main_text(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    page_html: str = "html",
    wrappers: DataFrame | None = None,
    known_bytes: int = KNOWN_BYTES,
) -> DataFrame:
    """Per page: its id, its URL, ``text`` and ``n_chars``.

    Wrappers of up to ``known_bytes`` in all are sent to all tasks; more are joined with
    the pages by host, in a join whose large partitions Spark can split.
    """
    spark = pages.sparkSession
    if wrappers is None:
        wrappers = infer_wrappers(pages, url, page_html)
    size = wrappers.agg(F.sum(F.length("wrapper"))).first()[0] or 0
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"),
        F.coalesce(F.col(page_html), F.lit("")).alias("html"),
    )
    shared = None
    if size <= known_bytes:
        shared = spark.sparkContext.broadcast(dict(wrappers.select("host", "wrapper").collect()))  # known_bytes at most
        rows = rows.withColumn("wrapper", F.lit(None).cast("binary"))
    else:
        rows = rows.join(wrappers, "host", "left")
    id_type, url_type = (pages.schema[name].dataType.simpleString() for name in (page_id, url))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, list[Node]] = {}
        for batch in batches:
            for part in slices(batch, "html"):
                texts = []
                hosts, blobs = part.column("host").to_pylist(), part.column("wrapper")
                for i, page in enumerate(part.column("html").to_pylist()):
                    host = hosts[i]
                    if host not in ready:
                        if len(ready) > 500:
                            ready.clear()
                        data = blobs[i].as_py() if shared is None else shared.value.get(host)
                        ready[host] = _unpacked(data)[0] if data else []
                    texts.append(extract(page, ready[host]) if page else "")
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
                )

    found = rows.select("page_id", "url", "host", "html", "wrapper").mapInArrow(
        read, f"page_id {id_type}, url {url_type}, text string"
    )
    return found.select(F.col("page_id").alias(page_id), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))

