"""Reading of a page as a stream of block-level elements and text slots."""

from __future__ import annotations

import bisect
import hashlib
import html as entities
import re
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>[^>\"']*+(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*+)*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
#: Opening one of these ends an open one of the second kind.
_ENDS = {
    "p": {"p"},
    "li": {"li", "p"},
    "dt": {"dt", "dd", "p"},
    "dd": {"dt", "dd", "p"},
    "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"},
    "th": {"td", "th", "p"},
    "option": {"option"},
} | {x: {"p"} for x in "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split()}
#: An end is not looked for beyond these.
_WALLS = frozenset("html body table td th div article section main aside nav ul ol dl".split())
#: Fixed by the task: elements that hold no part of an article.
OUTSIDE = frozenset(
    "head nav footer aside form script style noscript template svg math canvas button select option textarea input iframe object embed audio video map dialog menu title noframes noembed".split()
)
#: Words of a class or id, between separators, for what is no part of an article whatever it says, and for what is none if it says the same everywhere or is made of links.
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense breadcrumb breadcrumbs comment comments commentlist disqus footer hidden masthead menu menus modal nav navbar navigation overlay pager pagination popup promoted respond sidebar sidebars sponsor sponsored toolbar topbar".split()
)
DOUBTED_WORDS = frozenset("banner consent cookie cookies newsletter notice notices notification promo related share sharing signup social subscribe subscription widget widgets".split())
#: Words that say nothing about the others of a class or id; one with any further word is only a hint.
_PLAIN_WORDS = frozenset("a area b bar block body bottom box button buttons c card col column container content entry full group holder icon icons id inner item items left line link links list main new outer page panel parent post right row section site slot small style text thread title top unit wrap wrapper".split())
#: Elements that are text rather than hold parts of a page: a doubted word is only a hint there.
TEXT_LEVEL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption caption".split())
#: What is known of an element before its slots are: nothing; a hint; a doubt, against which its slots have to speak; outside.
NOTHING, HINT, DOUBT, OUT = range(4)
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog note".split())
MAIN = frozenset("article main".split())
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_NUMBER = re.compile(r"\d+")


@dataclass(slots=True)
class Block:
    path: str
    level: int  # what is known before: NOTHING, HINT, DOUBT or OUT
    main: bool
    text: str
    links: int


@dataclass(slots=True)
class Node:
    """An element of the wrapper, or (label `#`) a text slot."""

    label: str
    level: int = NOTHING
    main: bool = False
    repeated: bool = False
    optional: bool = False
    children: list = field(default_factory=list)
    chars: int = 0
    links: int = 0
    pages: int = 1
    text: int | None = None  # a hash of the one text that was always seen; None: it varies
    texts: dict = field(default_factory=dict)  # of a slot: hash of a text to (pages that have it, hashes of up to MANY different ones, of texts before it, of texts after it, pages that it can have beyond the counted)
    lost: int = 0  # of a slot: pages that a text can have that isn't counted
    pinned: frozenset = frozenset()  # of the root: texts that are always counted
    templates: dict = field(default_factory=dict)  # of the root: template to its paths: [characters, those in links, those inside article or main, what is known before times characters]


@lru_cache(maxsize=65536)
def _element(name: str, rest: str) -> tuple[str, int, bool]:
    """(label, what is known before, main) of an opening tag."""
    own = {}
    if rest:
        for k, a, b, c in _ATTRIBUTE.findall(rest):
            own.setdefault(k.lower(), a or b or c)
    named = f"{own.get('class', '')} {own.get('id', '')}".strip()
    role = own.get("role", "").lower()
    level = OUT if name in OUTSIDE or role in OUTSIDE_ROLES else NOTHING if name in ("html", "body", "article", "main") else max(map(_hinted, named.split()), default=NOTHING)
    if level == DOUBT and name in TEXT_LEVEL:
        level = HINT
    if "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "").lower():
        level = OUT
    kinds = " ".join(sorted(set(_NUMBER.sub("0", named).split())))
    label = f"{name}.{zlib.crc32(kinds.encode('utf-8', 'replace')) % LABELS:x}" if kinds else name
    return label, level, name in MAIN or role == "main" or own.get("itemprop") == "articleBody"


def _hinted(own: str) -> int:
    """What a class or id says; next to words that mean something else (`share-price`), a word is only a hint."""
    words = set(_WORD.findall(_CAMEL.sub(" ", own).lower()))
    known = words & (OUTSIDE_WORDS | DOUBTED_WORDS)
    if not known:
        return NOTHING
    if words - known - _PLAIN_WORDS:
        return HINT
    return OUT if known & OUTSIDE_WORDS else DOUBT


def _raw_end(name: str) -> re.Pattern:
    return _raw_ends.setdefault(name, re.compile(rf"</{name}(?=[\s/>])", re.I))


_raw_ends: dict[str, re.Pattern] = {}


def read(html: str) -> tuple[list[Block], Node]:
    """The page's blocks in order, and its tree of block-level elements and text slots."""
    root = Node("", pages=1)
    # name, node, path, what is known before, main, in a link
    stack = [("", root, "", NOTHING, False, False)]
    blocks: list[Block] = []
    pieces: list[str] = []
    links = 0

    def close_block() -> None:
        nonlocal links
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                k = len(stack) - 1
                while stack[k][0] in INLINE:
                    k -= 1
                _, node, path, level, main, _ = stack[k]
                level = max(level, stack[-1][3])
                blocks.append(Block(path, level, main, text, min(links, len(text))))
                node.children.append(Node("#", level, main, chars=len(text), links=min(links, len(text)), text=hash_of(text)))
        links = 0

    def add(text: str) -> None:
        nonlocal links
        if text:
            top = stack[-1]
            if top[3] == OUT and top[0] in INLINE and not _base_outside(stack):
                return
            pieces.append(text)
            if top[5]:
                links += len(text)

    at, size = 0, len(html)
    while at < size:
        found = _TOKEN.search(html, at)
        if not found:
            add(html[at:])
            break
        add(html[at : found.start()])
        at = found.end()
        name = found["name"] or found["name2"]
        if name is None:
            continue
        name = name.lower()
        if found["end"] or found["end2"]:
            k = len(stack) - 1
            while k and stack[k][0] != name:
                if name in INLINE and stack[k][0] not in INLINE:
                    k = 0
                    break
                k -= 1
            if k:
                if name not in INLINE:
                    close_block()
                del stack[k:]
            elif name not in INLINE:
                close_block()
            continue
        label, level, main = _element(name, found["rest"] or found["rest2"] or "")
        if name == "br":
            pieces.append(" ")
            continue
        if name in INLINE:
            if name not in VOID:
                top = stack[-1]
                stack.append((name, top[1], top[2], OUT if level == OUT else top[3], top[4], top[5] or name == "a"))
            continue
        close_block()
        ends = _ENDS.get(name)
        if ends:
            k = len(stack) - 1
            cut = None
            while k > 0 and not (stack[k][0] in _WALLS and stack[k][0] not in ends):
                if stack[k][0] in ends:
                    cut = k
                k -= 1
            if cut is not None:
                del stack[cut:]
        top = stack[-1]
        inherited = top[3]
        node = Node(label, max(inherited, level), top[4] or main)
        if name == "header" and not node.main:  # a site's header is outside, an article's own may hold its title
            node.level = OUT
        deep = len(stack) > DEPTH
        path = top[2] if deep else f"{top[2]}/{label}"
        if name in RAW:
            end = _raw_end(name).search(html, at)
            at = end.start() if end else size
            continue
        if not deep:
            top[1].children.append(node)
        if name not in VOID:
            stack.append((name, top[1] if deep else node, path, node.level, node.main, top[5]))
    close_block()
    own = hash_of("\n".join(b.text for b in blocks))
    _fill(root, own, _slots(root))
    paths: dict[str, list[int]] = {}
    for b in blocks:
        if b.level != OUT:
            sums = paths.setdefault(b.path, [0, 0, 0, 0])
            for k, n in enumerate((len(b.text), b.links, len(b.text) * b.main, len(b.text) * b.level)):
                sums[k] += n
    root.templates[template_of(blocks)] = paths
    fold(root)
    return blocks, root


def _slots(node: Node) -> list[Node]:
    """The text slots of a page that aren't outside, in its order."""
    out: list[Node] = []
    for c in node.children:
        if c.label != "#":
            out += _slots(c)
        elif c.level != OUT:
            out.append(c)
    return out


def _fill(root: Node, page: int, slots: list[Node]) -> None:
    """Tells the slots of a page which page it is and which texts stand around theirs (0: none, or one outside the article that the slot is in)."""
    for k, c in enumerate(slots):
        around = [slots[j].text if 0 <= j < len(slots) and slots[j].main == c.main else 0 for j in (k - 1, k + 1)]
        c.texts = {c.text: (1, (page,), (around[0],), (around[1],), 0)}


@lru_cache(maxsize=65536)
def _containers(path: str) -> tuple[str, ...]:
    labels = path.split("/")
    return tuple("/".join(labels[: k + 1]) for k, x in enumerate(labels) if x.partition(".")[0] in CONTAINERS)


def template_of(blocks: list[Block]) -> int:
    """Pages with text in the same containers share a template."""
    return hash_of("\n".join(sorted({c for b in blocks if b.level != OUT for c in _containers(b.path)})))


def _base_outside(stack: list) -> bool:
    k = len(stack) - 1
    while stack[k][0] in INLINE:
        k -= 1
    return stack[k][3] == OUT


def hash_of(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) + (len(text) << 32)


#: Elements nested deeper than this belong to the one at this depth; their text does too.
DEPTH = 200
#: A slot varies when a text of it is on fewer different pages than this, or when it has so many different texts.
SEVERAL = 3
#: A text can be constant from so many different pages on, which are at least this share (in tenths) of those with its slot.
MANY, MOST = 5, 8
#: Of a slot that varies: texts that are counted however rare (the most frequent ones), what part of its pages a text has that isn't counted, at most, and the length from which one can be constant.
TEXTS, RARE, LINE = 32, 20, 20
#: Stands for all templates of a host.
EVERY = -1
#: The elements that tell templates apart.
CONTAINERS = frozenset("article center div main section td".split())
#: Classes and ids of a tag tell at most so many labels apart, so that generated ones don't make ever more.
LABELS = 4096
#: Lists of siblings whose lengths' product is greater are aligned with the nearest equal one at most AHEAD places ahead.
LONG, AHEAD = 40_000, 64
#: Article and main elements are believed in if they hold at least this share of a template's text.
BELIEVED = 0.1
#: The longest group of siblings that is looked for as a repeated one.
PERIOD = 6


def fold(node: Node) -> None:
    """Runs of equal groups of siblings become one repeated group, whose members are aligned with each other."""
    out: list[Node] = []
    for child in node.children:
        fold(child)
        out.append(child)
        again = True
        while again:
            again = False
            for p in range(1, min(PERIOD, len(out) // 2) + 1):
                if all(out[-k].label == out[-k - p].label for k in range(1, p + 1)):
                    for k in range(p, 0, -1):
                        into = out[-k - p]
                        align(into, out[-k], same_page=True)
                        into.repeated = True
                    del out[-p:]
                    again = True
                    break
    node.children = out


def align(a: Node, b: Node, same_page: bool = False, pinned: frozenset = frozenset()) -> None:
    """Makes `a` the union-free expression of both: children in common stay, mismatches become optional."""
    pinned = pinned or a.pinned
    a.repeated |= b.repeated
    a.optional |= b.optional
    a.level = min(a.level, b.level)
    a.main |= b.main
    a.chars += b.chars
    a.links += b.links
    if same_page:
        a.pages = max(a.pages, b.pages)
    else:
        a.pages += b.pages
    if a.text != b.text:
        a.text = None
    if b.texts:
        _count_texts(a, b, same_page, pinned)
    for template, paths in b.templates.items():
        into = a.templates.setdefault(template, {})
        for path, own in paths.items():
            into[path] = [a + b for a, b in zip(into.get(path, (0, 0, 0, 0)), own, strict=True)]
    x, y = a.children, b.children
    if [c.label for c in x] == [c.label for c in y]:
        for c, d in zip(x, y, strict=True):
            align(c, d, same_page, pinned)
        return
    out, i, j = [], 0, 0
    for k, l in [*_matches([c.label for c in x], [c.label for c in y]), (len(x), len(y))]:
        for lone in (*x[i:k], *y[j:l]):
            lone.optional = True
            out.append(lone)
        if k < len(x):
            align(x[k], y[l], same_page, pinned)
            out.append(x[k])
        i, j = k + 1, l + 1
    a.children = out
    if not same_page:
        fold_aligned(a, pinned)


def _matches(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of equal labels, ascending in both: a longest such list, or for long lists the nearest ahead."""
    n, m = len(x), len(y)
    if n * m > LONG:
        places: dict[str, list[int]] = {}
        for i, label in enumerate(x):
            places.setdefault(label, []).append(i)
        out, at = [], 0
        for j, label in enumerate(y):
            own = places.get(label, [])
            k = bisect.bisect_left(own, at)
            if k < len(own) and own[k] - at <= AHEAD:
                out.append((own[k], j))
                at = own[k] + 1
        return out
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if x[i] == y[j] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _count_texts(a: Node, b: Node, same_page: bool, pinned: frozenset = frozenset()) -> None:
    """Counts are never too high, and by how much they can be too low is known: of a slot's texts the most frequent (the
    latest first) and the pinned stay, and all that one in RARE of its pages can have; what goes can't be constant before
    it comes again, and then counts as one that may have been there."""

    def both(n, n_more, m, m_more):  # (pages that have it, pages that it can have beyond these)
        k = max(n, m) if same_page else n + m
        return k, (max(n + n_more, m + m_more) if same_page else k + n_more + m_more) - k

    out = dict(b.texts)
    if a.lost:
        for text, (m, *other, m_more) in b.texts.items():
            m, m_more = both(0, 0 if text in pinned else a.lost, m, m_more)
            out[text] = (m, *other, m_more)
    for text, (n, *own, n_more) in a.texts.items():
        if text in b.texts:
            m, *other, m_more = b.texts[text]
            k, more = both(n, n_more, m, m_more)
            out[text] = (k, *(x if x == y else tuple(sorted({*x, *y})[:MANY]) for x, y in zip(own, other, strict=True)), more)
        else:
            k, more = both(n, n_more, 0, 0 if text in pinned else b.lost)
            out[text] = (k, *own, more)
    a.lost = max(a.lost, b.lost) if same_page else a.lost + b.lost
    if not same_page and len(out) > TEXTS:
        ranked = sorted(out.items(), key=lambda x: -x[1][0])
        rare = [x for x in ranked[TEXTS:] if x[0] not in pinned and RARE * (x[1][0] + x[1][-1]) <= a.pages]
        if rare:
            a.lost = max(a.lost, *(x[0] + x[-1] for _, x in rare))
            gone = {text for text, _ in rare}
            ranked = [x for x in ranked if x[0] not in gone]
        out = dict(ranked)
    a.texts = out


def _constant(node: Node, text: int) -> bool:
    """Whether a text of a slot is the site's own, by what is counted of it."""
    n, pages, before, after, _ = node.texts[text]
    alone = all(len(x) >= SEVERAL or 0 in x for x in (before, after))
    return len(pages) >= MANY and 10 * n >= MOST * node.pages and alone and (node.text is not None or text >> 32 >= LINE)


def unsure(wrapper: Node) -> set[int]:
    """Texts that would be constant if they had all pages that they can have; with these pinned, an alignment counts them whole."""
    out: set[int] = set()
    open_ = [wrapper]
    while open_:
        node = open_.pop()
        open_ += node.children
        if node.label == "#" and node.level != OUT:
            out |= {t for t, (n, *_, more) in node.texts.items() if more and 10 * (n + more) >= MOST * node.pages and t >> 32 >= LINE and not _constant(node, t)}
    return out


def fold_aligned(node: Node, pinned: frozenset = frozenset()) -> None:
    """Neighbours that alignment has brought together fold like any others."""
    out: list[Node] = []
    for child in node.children:
        if out and out[-1].label == child.label:
            optional = out[-1].optional and child.optional
            align(out[-1], child, same_page=True, pinned=pinned)
            out[-1].repeated, out[-1].optional = True, optional
        else:
            out.append(child)
    node.children = out


def expression(node: Node) -> str:
    """The wrapper as text: `#` is a text slot, `( )+` a repeated and `( )?` an optional group."""
    own = "#" if node.label == "#" else (f"<{node.label}>" if node.label else "") + "".join(map(expression, node.children)) + (f"</{node.label.partition('.')[0]}>" if node.label else "")
    mark = ("+" if node.repeated else "") + ("?" if node.optional else "")
    return f"({own}){mark}" if mark else own


@dataclass(slots=True)
class _Slot:
    path: str
    node: Node


def key_of(path: str, of: int) -> int:
    """A signed 64-bit number for a path with the hash of a text or of a template."""
    return int.from_bytes(hashlib.blake2b(f"{path}\n{of}".encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def content(wrapper: Node) -> dict[int, tuple[list[int], list[int]]]:
    """For each template of a host: keys of its constant texts, and keys of the paths that hold its article.

    A text is constant when MANY different pages have it in a slot, MOST of those that have the slot, and what stands
    before and after it there varies (or is the article's border): a line of the site between texts of articles.
    Paragraphs that copies of an article share have each other for neighbours and stay.

    A slot varies if its texts differ from page to page.  One that isn't mostly links can belong to the article; a doubted
    one has to vary on SEVERAL pages for that.  Of these, those in the innermost element that holds most of such text of
    the template are the article; where article or main elements hold a fair share of the text, their slots are, also those
    with links, but for doubted ones that don't vary or are mostly links.  They come with the template's key, and all slots
    that can belong to an article with that of EVERY.
    """
    slots: list[_Slot] = []

    def walk(node: Node, path: str) -> None:
        for c in node.children:
            if c.label == "#":
                slots.append(_Slot(path, c))
            else:
                walk(c, f"{path}/{c.label}")

    walk(wrapper, "")
    constant: dict[str, set[int]] = {}
    varied: set[str] = set()
    differing: dict[str, set[int]] = {}
    for s in slots:
        if s.node.level == OUT:
            continue
        for text in s.node.texts:
            if _constant(s.node, text):
                constant.setdefault(s.path, set()).add(key_of(s.path, text))
        if s.node.text is None or any(len(pages) < SEVERAL for _, pages, *_ in s.node.texts.values()):
            varied.add(s.path)
        differing.setdefault(s.path, set()).update(s.node.texts)
    out = {}
    for template, sums in wrapper.templates.items():
        spoken = {p: len(differing.get(p, ())) >= SEVERAL and p in varied and links * 2 <= chars for p, (chars, links, *_) in sums.items()}
        fit = {p for p, (chars, _, _, known) in sums.items() if known <= HINT * chars or spoken[p]}
        own = {p: chars for p, (chars, links, *_) in sums.items() if chars and p in varied and p in fit and links * 2 <= chars}
        named = {p: chars for p, (_, _, chars, _) in sums.items() if chars}
        near = sorted(p for p in named if p in fit) if sum(named.values()) >= BELIEVED * sum(x[0] for x in sums.values()) else _innermost(own)
        out[template] = sorted({k for p in sums for k in constant.get(p, ())}), sorted([key_of(p, template) for p in near] + [key_of(p, EVERY) for p in own])
    return out


def _innermost(chars: dict[str, int]) -> list[str]:
    """The paths in the deepest element that holds most of the text and isn't itself a block of text."""
    mass: dict[str, int] = {}
    deeper: set[str] = set()
    for p, n in chars.items():
        labels = p.split("/")
        for k in range(1, len(labels) + 1):
            prefix = "/".join(labels[:k])
            mass[prefix] = mass.get(prefix, 0) + n
            if k < len(labels):
                deeper.add(prefix)
    total = sum(chars.values())
    around = max((p for p, n in mass.items() if 10 * n >= 7 * total and p in deeper), key=lambda p: (p.count("/"), p), default="")
    return [p for p in chars if p == around or p.startswith(around + "/") or not around]


def content_paths(wrapper: Node) -> tuple[list[int], list[int]]:
    """What `content` gives, of all templates."""
    own = content(wrapper).values()
    return sorted({k for x, _ in own for k in x}), sorted({k for _, x in own for k in x})


def main_text(blocks: list[Block], constant: frozenset[int] | set[int], paths: frozenset[int] | set[int]) -> str:
    """The text of the blocks that the wrapper counts to the article; a page with none there has those of any template."""
    template = template_of(blocks)
    left = [b for b in blocks if b.level != OUT and (not constant or key_of(b.path, hash_of(b.text)) not in constant)]
    own: list[str] = []
    for of in (template, EVERY):
        own = own or [b.text for b in left if key_of(b.path, of) in paths]
    return "\n".join(own)
