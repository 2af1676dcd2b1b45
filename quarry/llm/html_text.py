"""Main text of web pages by minimum cut.

A page is cut into blocks of text. A linear classifier over a block's ancestors, class names, links and wording
gives a score; its size becomes the capacity from the source (content) or to the sink (boilerplate). Edges between
neighbouring blocks, and between successive blocks of one container, carry a smoothness that falls with the distance
in the tree. The maximum flow's cut labels the blocks: those on the source side are content.

Null and empty pages have an empty text. Broken markup is read as far as it goes: unclosed elements end with their
container, a tag cut off at the end of the page is dropped. Character references are decoded, white space inside a
block becomes one space, blocks are joined in page order by an empty line. Pages of any size are read whole.
A tag whose quotes do not pair ends at its first '>'. Hidden is what has the attribute hidden, aria-hidden=true or an
inline style of display:none or visibility:hidden; html and body never are. Class names and ids only weigh, less where
other words stand beside them, and text and neighbours can outweigh them: main, an article that is not nested in another
one, role=main, and within layout wrappers a content name set the weight anew. Where nothing would be kept, a form, header or
name of a wrapper (not of adverts, comments, navigation and the like) that holds the page's words was wrong: the page is cut
again without it. Time grows in proportion to a page's size.
Repeated rows are treated alike; extra columns pass through, and the output column replaces one of the same name.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)
    |<(/?)([a-zA-Z][^\s/>]*)(
        (?:[^>=]++|=\s*+(?:"[^">]*"|'[^'>]*'|"[^"]*"(?=[\s/>])|'[^']*'(?=[\s/>]))|=(?!\s*["']))*+(?=>)
        |[^>]*  # quotes do not pair
    )>
    |<(?=/?[a-zA-Z]).*\Z""",
    re.S | re.X,
)
ATTRIBUTE = re.compile(r"""([^\s=/>][^\s=/>]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without any readable text of the page.
SKIPPED = frozenset("script style template noscript iframe object svg math head title textarea select option canvas audio video datalist".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split()
)
BOILER_TAGS = frozenset("nav footer aside form menu button dialog fieldset".split())
BOILER_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent
    contentinfo cookie cookies copyright disqus discussion feedback footer gdpr legal login masthead menu menus modal nav navbar
    navigation newsletter notice notices overlay pager pagination popup privacy promo promoted promotion recommended related
    replies reply respond search share sharing shoutbox sidebar sidebars signin signup skip social sponsor sponsored subscribe
    subscription tags toc toolbar topbar trending widget widgets alert alerts announcement dialog disclaimer complementary banner2
    teaser outbrain taboola rail aside footnav header""".split()
)
#: Names of places, which wrappers of a whole page carry as well, and words that make such a name tell of what is inside.
LAYOUT_NAMES = frozenset("aside header menu modal nav navbar navigation overlay rail search sidebar sidebars toc toolbar topbar".split())
MODIFIERS = frozenset("and enabled has layout no with without".split())
#: An article of these names inside a boilerplate wrapper is not the page's.
MINOR_NAMES = frozenset("ad ads advert comment promo promoted recommended related reply sponsored teaser widget".split())
#: Words that say nothing of what a name is about. A token with other words beside a boilerplate name ("legal-history",
#: "share-of-market") is a weak sign only.
STRUCTURE = frozenset(
    """action actions area article author avatar bar big block body bottom box btn button buttons call card cards cell children col
    column columns container content count counter cta date depth desktop dfp div entry even fixed float floating form global
    google grid group heading holder home icon icons image info inline inner item items label large layer left level line link links
    list loader main media meta mobile module more msg new news number odd outer page pane panel parent placeholder policy post posts
    primary reader readers region right row secondary section simple site slot small static sticky story strip tab tabs text
    thread title to tool tools top unit user users video view web widget wrap wrapper your zone""".split()
)
#: Kinds of boilerplate: a wrapper of the layout, other names, elements that are boilerplate by their meaning.
LAYOUT, NAMED, MEANT = 1, 2, 3
#: Not rendered, which holds for all inside, or invisible, which an element inside may end.
INVISIBLE, UNRENDERED = 1, 2
#: Classifier weights of a boilerplate name, and what a weak sign adds. Text and neighbours can outweigh both.
NAME_CUE, WEAK_CUE = -4.5, -2.0
CONTENT_NAMES = frozenset("article body content entry main maincontent post story text prose".split())
#: Names of what is never the page's text. Other names, forms and headers are wrong about a page that has no text besides.
STRICT_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies gdpr masthead menu
    menus nav navbar navigation newsletter outbrain pager pagination popup promo promoted promotion recommended related replies reply
    respond shoutbox sidebar sidebars social sponsor sponsored subscribe subscription taboola toolbar footer footnav""".split()
)
#: Words of a block outside the kept ones that speak against a wrapper, and how many wrappers may be wrong in turn.
TELLING, WRAPPERS = 30, 6
#: What notices and forms say, in texts of fewer than SHORT words.
PHRASES = re.compile(r"\b(?:cookies?|newsletter|subscribe|sign (?:in|up)|log ?in|privacy policy|terms of (?:use|service)|advertisement|sponsored|leave a (?:comment|reply)|share this)\b", re.I)
SHORT = 60


@dataclass(slots=True)
class Element:
    tag: str
    number: int
    depth: int
    cue: float  # classifier weight of this element and those above it
    boiler: int  # 0 outside boilerplate, else its kind
    link: bool
    article: bool
    hidden: int = 0
    nested: bool = False  # inside an article element, or one itself
    soft: bool | None = None  # made boilerplate here by a sign that may be wrong (True) or not (False)
    parent: Element | None = None
    block: Element | None = None  # this element or the nearest above it that is not inline

    def __post_init__(self):
        self.block = self.parent.block if self.tag in INLINE and self.parent is not None else self


@dataclass(slots=True)
class Block:
    text: str
    container: Element
    linked: int
    tag: str
    score: float = 0.0
    kept: bool = field(default=False)


def attributes_of(raw: str) -> dict[str, str]:
    """Values by lower-case name; of a repeated attribute the first counts."""
    out: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), double or single or bare)
    return out


def names_of(attributes: dict[str, str]) -> tuple[set[str], bool]:
    """Words of class, id and role, and whether some token is a weak sign of boilerplate; its boilerplate names are left out."""
    out: set[str] = set()
    weak = False
    for name in ("class", "id", "role"):
        for token in attributes.get(name, "").split():
            words = {w.lower() for w in WORD.findall(token)}
            own = words & BOILER_NAMES
            if own and not MODIFIERS.isdisjoint(words):
                words -= own
            elif own and words - own - STRUCTURE:
                words -= own
                weak = True
            out |= words
    return out, weak


def hidden_by(attributes: dict[str, str], above: int) -> int:
    """Whether an element is hidden, by its attributes and what holds above it."""
    if above == UNRENDERED:
        return above
    if "hidden" in attributes and attributes["hidden"].strip().lower() != "until-found":
        return UNRENDERED
    if attributes.get("aria-hidden", "").strip().lower() == "true":
        return UNRENDERED
    style: dict[str, tuple[bool, str]] = {}
    for declaration in COMMENT.sub("", html.unescape(attributes.get("style", ""))).lower().split(";"):
        name, _, value = declaration.partition(":")
        value, important, _ = value.partition("!")
        if bool(important) >= style.get(name.strip(), (False, ""))[0]:
            style[name.strip()] = bool(important), value.strip()
    if style.get("display", (False, ""))[1] == "none":
        return UNRENDERED
    visibility = style.get("visibility", (False, ""))[1]
    return INVISIBLE if visibility == "hidden" else 0 if visibility == "visible" else above


def opened(tag: str, attributes: str, parent: Element, number: int, plain: frozenset[int] = frozenset()) -> Element:
    """Weight of an element: the innermost sign counts; in boilerplate only signs of the page's own text do. plain: elements whose
    signs of boilerplate don't count."""
    cue, boiler, hidden, soft = parent.cue, parent.boiler, parent.hidden, None
    article = parent.article or tag in ("article", "main")
    names: set[str] = set()
    weak = False
    if attributes and tag not in ("html", "body"):
        found = attributes_of(attributes)
        (names, weak), hidden = names_of(found), hidden_by(found, hidden)
        article = article or found.get("role", "").strip().lower() == "main"
        tag_like = "main" if found.get("role", "").strip().lower() == "main" else tag
    else:
        tag_like = tag
    own = names & BOILER_NAMES
    if number in plain:
        pass
    elif tag_like == "main":
        cue, boiler = 4.0, 0
    elif tag == "article":
        if not boiler or (boiler != MEANT and not parent.nested and MINOR_NAMES.isdisjoint(names)):
            cue, boiler = 4.0, 0
    elif tag in BOILER_TAGS or (tag == "header" and not parent.article):
        kind = LAYOUT if tag in ("form", "fieldset", "header") else MEANT
        cue, boiler, soft = -6.0, max(boiler, kind), kind == LAYOUT and STRICT_NAMES.isdisjoint(names)
    elif own and not (parent.article and names <= {"header", "byline", "content", "article", "entry", "post"}):
        cue, boiler, soft = min(cue, NAME_CUE), max(boiler, LAYOUT if own <= LAYOUT_NAMES else NAMED), STRICT_NAMES.isdisjoint(own)
    elif weak:
        cue = min(cue, max(cue + WEAK_CUE, NAME_CUE))
    elif boiler <= LAYOUT and not CONTENT_NAMES.isdisjoint(names):
        cue = max(cue, 0.0 if boiler else 2.0)
    nested = parent.nested or tag == "article"
    return Element(tag, number, parent.depth + 1, cue, boiler, parent.link or tag == "a", article, hidden, nested, soft, parent)


def blocks_of(page: str, plain: frozenset[int] = frozenset()) -> list[Block]:
    root = Element("", 0, 0, 0.0, 0, False, False)
    top, out, parts, linked, tag = root, [], [], 0, ""
    container = root
    at, n, size = 0, 0, len(page)
    open_tags: Counter[str] = Counter()

    def end_block() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, container, linked, tag))
            parts, linked = [], 0

    while at < size:
        found = MARKUP.search(page, at)
        text = page[at : found.start()] if found else page[at:]
        if text:
            if not parts or not text.isspace():
                if not any(p.strip() for p in parts):
                    container = top.block
                    tag = container.tag
            parts.append(text)
            if top.link:
                linked += len(text)
        if not found:
            break
        at = found.end()
        closing, name = found.group(1), found.group(2)
        if not name:
            continue
        name = name.lower()
        if name in SKIPPED and not closing:
            if not found.group(3).endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                body = re.compile(r"<body\b", re.I).search(page, at) if name == "head" else None
                if body and (not end or body.start() < end.start()):
                    at = body.start()  # a head that is not closed ends where the body begins
                else:
                    at = end.end() if end else size
            continue
        if name == "br":
            parts.append(" ")
            continue
        block = name not in INLINE
        if block:
            end_block()
        if closing:
            if open_tags[name]:
                while top.tag != name:
                    open_tags[top.tag] -= 1
                    top = top.parent
                open_tags[name] -= 1
                top = top.parent
            continue
        if name in VOID:
            continue
        if block:
            if name in ("p", "li", "td", "th", "tr", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6") or top.tag in ("p", *INLINE):
                # a block ends an open paragraph, with the inline elements inside it; an item ends the item before
                place = top.block
                if place.tag == "p" or (place.tag == name and name in ("li", "td", "th", "tr", "dt", "dd")):
                    while top is not place.parent:
                        open_tags[top.tag] -= 1
                        top = top.parent
        n += 1
        if not found.group(3).endswith("/"):
            top = opened(name, found.group(3), top, n, plain)
            open_tags[name] += 1
    end_block()
    return out


NEUTRAL = 0.0


def score(block: Block) -> float:
    """Classifier: positive for content. The weights are fixed; see the module's tests for what they separate."""
    text, cue = block.text, -6.0 if block.container.hidden else block.container.cue
    words = text.count(" ") + 1
    links = block.linked / len(text)
    value = cue - 0.5
    value += 2.5 if words >= 40 else 1.5 if words >= 12 else 0.5 if words >= 5 else -0.5
    value += 0.7 if text[-1] in ".!?\"'”»…" else 0.0
    value -= 3.0 * min(1.0, links) * (1.0 if words < 30 else 0.5)
    value += {"p": 0.8, "h1": 0.8, "h2": 0.3, "h3": 0.3, "blockquote": 0.6, "pre": 0.6, "li": -0.3}.get(block.tag, 0.0)
    if "©" in text or "all rights reserved" in text.lower():
        return value - 5.0
    if words < SHORT and PHRASES.search(text):
        return value - 3.5
    # a short text without links is no sign of boilerplate: its neighbours decide
    return max(value, NEUTRAL) if cue >= 0 and links < 0.2 else value


def apart(a: Element, b: Element) -> tuple[int, Element]:
    """Steps between two elements of the tree, and the nearest element that holds both."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps, a


def bond(a: Element, b: Element) -> int:
    """Smoothness of two successive blocks: it falls with the distance. Within one container of the same weight, headings, items,
    cells and paragraphs belong together."""
    steps, holder = apart(a, b)
    together = a.cue == b.cue and steps <= 6 and (steps <= 2 or holder.tag not in ("", "html", "body"))
    return round((500 if together else 120) / (1 + steps))


def minimum_cut(terminal: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Source side of a minimum cut (the smallest one), by maximum flow.

    terminal: capacity from the source if positive, to the sink if negative. edges: (a, b, capacity) both ways. A node
    whose terminal outweighs all its edges is cut from no minimum: it is settled first, and its edges become terminals of
    its neighbours. Flow is then pushed in phases along shortest paths of what is left.
    """
    n = len(terminal)
    left = list(terminal)
    room: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, c in edges:
        if a != b and c > 0:
            room[a][b] = room[a].get(b, 0) + c
            room[b][a] = room[b].get(a, 0) + c
    weight = [sum(r.values()) for r in room]
    side: list[bool | None] = [None] * n
    waiting = list(range(n))
    while waiting:
        v = waiting.pop()
        if side[v] is not None or -weight[v] < left[v] <= weight[v]:
            continue
        side[v] = left[v] > 0
        for u, c in room[v].items():
            if side[u] is None:
                left[u] += c if side[v] else -c
                weight[u] -= c
                del room[u][v]
                waiting.append(u)
        room[v] = {}
    flow(left, room)
    reached = [x is None and left[v] > 0 for v, x in enumerate(side)]
    queue = deque(v for v in range(n) if reached[v])
    while queue:
        for u, c in room[v := queue.popleft()].items():
            if c > 0 and not reached[u]:
                reached[u] = True
                queue.append(u)
    return [reached[v] if x is None else x for v, x in enumerate(side)]


def flow(left: list[int], room: list[dict[int, int]]) -> None:
    """Pushes as much as can flow from nodes with something left to nodes that lack something; room: residual capacities."""
    n = len(left)
    while True:
        level = [-1] * n
        queue = deque(v for v in range(n) if left[v] > 0 and room[v])
        for v in queue:
            level[v] = 0
        found = False
        while queue:
            v = queue.popleft()
            for u, c in room[v].items():
                if c > 0 and level[u] < 0:
                    level[u] = level[v] + 1
                    found = found or left[u] < 0
                    queue.append(u)
        if not found:
            return
        ways = [iter(room[v].copy()) if level[v] >= 0 else iter(()) for v in range(n)]
        for start in [v for v in range(n) if level[v] == 0]:
            path = [start]
            while path and left[start] > 0:
                v = path[-1]
                if left[v] < 0:
                    amount = min(left[start], -left[v], *(room[x][y] for x, y in pairwise(path)))
                    left[start] -= amount
                    left[v] += amount
                    for x, y in pairwise(path):
                        room[x][y] -= amount
                        room[y][x] += amount
                    # go on before the first edge that is full, else beside the node that was filled
                    full = next((k for k, (x, y) in enumerate(pairwise(path)) if not room[x][y]), len(path) - 2)
                    del path[full + 1 :]
                    continue
                for u in ways[v]:
                    if room[v][u] > 0 and level[u] == level[v] + 1:
                        path.append(u)
                        break
                else:
                    path.pop()
                    level[v] = -2  # nothing goes on from here in this phase


def label(blocks: list[Block]) -> None:
    terminal, edges = [], []
    latest: dict[int, int] = {}
    for i, block in enumerate(blocks):
        block.score = score(block)
        terminal.append(round(100 * block.score))
        if i:
            edges.append((i - 1, i, bond(blocks[i - 1].container, block.container)))
        holder = block.container.parent or block.container
        before = latest.get(holder.number)
        if before is not None and before < i - 1:
            edges.append((before, i, 40))
        latest[holder.number] = i
    if all(t > 0 for t in terminal):
        side = [True] * len(blocks)
    else:
        side = minimum_cut(terminal, edges)
    for block, kept in zip(blocks, side, strict=True):
        block.kept = kept


def main_text(page: str | None) -> str:
    if not page:
        return ""
    blocks, plain = blocks_of(page), frozenset()
    label(blocks)
    for _ in range(WRAPPERS):
        wrong = mistaken(blocks)
        if wrong is None:
            break
        plain |= {wrong}
        blocks = blocks_of(page, plain)
        label(blocks)
    return "\n\n".join(b.text for b in blocks if b.kept)


def mistaken(blocks: list[Block]) -> int | None:
    """The wrapper whose sign of boilerplate must be wrong: where no block of a dozen words is kept, the outermost element with a
    sign that may be wrong, and none inside it that can't be, that holds most words outside links; None if they are few."""
    words = lambda b: b.text.count(" ") + 1
    if any(b.kept and words(b) >= 12 and 2 * b.linked < len(b.text) for b in blocks):
        return None
    held: Counter[int] = Counter()
    for b in blocks:
        if words(b) < 12 or 2 * b.linked >= len(b.text) or b.container.hidden or PHRASES.search(b.text):
            continue
        at, outermost = b.container, None
        while at is not None and at.soft is not False:
            outermost = at.number if at.soft else outermost
            at = at.parent
        if at is None and outermost is not None:
            held[outermost] += words(b)
    if not held:
        return None
    number, most = max(held.items(), key=lambda x: (x[1], -x[0]))
    return number if most >= TELLING else None


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages with the main text of each page."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(x) for x in batch], index=batch.index, dtype=object)

    return pages.withColumn(text_col, text(F.col(html_col)))
