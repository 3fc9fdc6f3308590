"""Main text of HTML pages by a tree-structured graphical model (operator 2).

The DOM's elements are the variables; each is boilerplate, content or a frame
(an element around content).  Node potentials come from what the element is (its
tag, the kind of section it stands in), from its text (length, share inside
links, prose or not, the words of short texts), from all text below it, and from
the words of its own and its parent's class, id and role.  Edge potentials say how a child's state
follows its parent's.  Both are counted, with additive smoothing, on labelled
pages.  Sum-product messages go from the leaves up and from the root down, and
yield each element's marginals; text is kept where content has the largest share.

The labelled pages are layouts labelled by hand (``LAYOUTS``), filled with
invented text; ``train`` takes any others, as HTML with ``data-label`` attributes
that children inherit.  Most class names of the layouts are replaced by
meaningless ones, so that structure counts and not only names.

Null or empty html: empty text.  Pages cut off anywhere, with unclosed or stray
tags, are parsed as far as they go, in time linear in their length; an element
whose inside is skipped hides nothing if it is never closed.  Every page is
handled on its own, repeated ones too: no shuffle, and the model broadcast is a
few kilobytes.
"""

from __future__ import annotations

import bisect
import html
import itertools
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from examloom.llm.blocks import configure

BOILERPLATE, CONTENT, FRAME = range(3)
STATES = {"boilerplate": BOILERPLATE, "content": CONTENT, "frame": FRAME}
SMOOTHING = 0.3

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark math mfrac mi mn mo mrow msqrt msub msup picture q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside is never text of the page; RAW holds no tags.
RAW = frozenset("script style textarea title noscript iframe".split())
SKIPPED = RAW | frozenset("template svg object select canvas audio video head".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th", "tbody"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
WALLS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("datalist",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}
P_WALLS = ("button", "td", "th", "table")
#: Where one of these is, little content stands elsewhere.
CORES = frozenset(("article", "main"))
SECTIONS = frozenset("article main section nav aside header footer form table ul ol dl figure blockquote dialog body html".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"""[>"']""")
_MARKS = re.compile(r"""(?:^|[\s/"'])(class|id|role|data-label|aria-hidden|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[A-Za-z][a-z]*")
_SAID = re.compile(r"[^\W\d_]+|[©]")
_PROSE = re.compile(r"[.!?…:。！？]['\")\]”»]*(?:\s|\Z)")


class Node:
    __slots__ = ("below", "block", "core", "label", "linked", "linked_below", "marks", "parent", "said", "section", "sentences", "size", "tag")

    def __init__(self, tag: str, parent: Node | None, block: bool) -> None:
        self.tag, self.parent, self.block = tag, parent, block
        self.marks: tuple[str, ...] = ()
        self.said: tuple[str, ...] = ()
        self.label = parent.label if parent else FRAME
        self.section = "" if parent is None else parent.tag if parent.tag in SECTIONS else parent.section
        self.core = "in" if parent and (parent.core == "in" or parent.tag in CORES) else ""
        self.size = self.linked = self.below = self.linked_below = self.sentences = 0


class _Tree:
    """Builds the elements while a page is read; every step takes constant time, or removes what it walks over."""

    def __init__(self) -> None:
        root = Node("html", None, True)
        self.nodes: list[Node] = [root]
        self.texts: list[tuple[Node, str] | None] = []
        self.stack: list[tuple[str, Node]] = [("", root)]
        self.places: dict[str, list[int]] = defaultdict(list)  # of open elements by tag
        self.blocks = [0]  # places of open elements that are not inline

    def text(self, raw: str) -> None:
        if raw:
            node = self.stack[-1][1]
            text = html.unescape(raw) if "&" in raw else raw
            self.texts.append((node, text))
            shown = text.strip()
            node.size += len(shown)
            node.sentences += len(shown) > 20 and _PROSE.search(shown) is not None
            if len(shown) < 30 and len(node.said) < 6:
                node.said += tuple(w.lower() for w in _SAID.findall(shown)[:4])
            if self.places["a"]:
                node.linked += len(shown)

    def gap(self) -> None:
        self.texts.append(None)

    def pop_to(self, i: int) -> None:
        for tag, _ in self.stack[i:]:
            self.places[tag].pop()
            if tag not in INLINE:
                self.gap()
        del self.stack[i:]
        while self.blocks[-1] >= i:
            self.blocks.pop()

    def top(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places[t]), default=0)

    def close(self, tag: str) -> None:
        at = self.top((tag,))
        if at and not (tag in INLINE and at < self.blocks[-1]):
            self.pop_to(at)

    def open(self, tag: str, rest: str) -> None:
        if tag in ENDS_P or tag in SAME:
            wall = self.top(WALLS.get(tag, P_WALLS))
            ends = [p[bisect.bisect(p, wall)] for t in SAME.get(tag, ("p",)) if (p := self.places[t]) and p[-1] > wall]
            if ends:
                self.pop_to(min(ends))
        if tag in ("html", "body") and self.places[tag]:
            return
        found = {k.lower(): a or b or c for k, a, b, c in _MARKS.findall(rest)} if "=" in rest or "hidden" in rest else {}
        marks = tuple(w.lower() for k in ("class", "id", "role") if k in found for w in _WORD.findall(found[k]))
        if "hidden" in found or "none" in found.get("style", "").lower() or found.get("aria-hidden") == "true":
            marks = (*marks, "hidden")
        inline = tag in INLINE
        node = self.stack[-1][1]
        if not inline:
            self.gap()
        if tag != "html" and (not inline or marks or "data-label" in found):
            node = Node(tag, node, not inline)
            node.marks = marks
            if "data-label" in found:
                node.label = STATES[found["data-label"]]
            self.nodes.append(node)
        if tag not in VOID and not rest.endswith("/"):
            self.places[tag].append(len(self.stack))
            if not inline:
                self.blocks.append(len(self.stack))
            self.stack.append((tag, node))


def _tag_end(page: str, at: int, dry: set[str]) -> int:
    """Where the tag that begins before at ends: its >, outside of quoted values; dry: quotes that the rest of the page has not."""
    pos = at
    while m := _STOP.search(page, pos):
        if m[0] == ">":
            return m.start()
        pos = m.end()
        if m[0] not in dry and page[at : m.start()].rstrip()[-1:] == "=" if m.start() - at < 4096 else page[m.start() - 1] == "=":
            close = page.find(m[0], pos)
            if close < 0:
                dry.add(m[0])
            else:
                pos = close + 1
    return -1


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str] | None]]:
    """The elements in page order, and the texts with their elements; None stands between blocks."""
    tree, at, n = _Tree(), 0, len(page)
    lower = page.lower() if len(page.lower()) == n else page
    dry: set[str] = set()
    gone: set[str] = set()
    while at < n:
        i = page.find("<", at)
        if i < 0:
            tree.text(page[at:])
            break
        following = page[i + 1 : i + 2]
        if following in "!?" and following:
            tree.text(page[at:i])
            end = page.find("-->", i + 4) + 2 if page.startswith("<!--", i) else page.find(">", i)
            at = n if end < 2 else end + 1
            continue
        name = _NAME.match(page, i + 2 if following == "/" else i + 1)
        if not name:
            tree.text(page[at : i + 1])
            at = i + 1
            continue
        tree.text(page[at:i])
        tag = name[0].lower()
        end = page.find(">", name.end()) if following == "/" else _tag_end(page, name.end(), dry)
        if end < 0:
            break  # a tag cut off
        at = end + 1
        if tag == "br":
            tree.text(" ")
        elif following == "/":
            tree.close(tag)
        elif tag in SKIPPED:
            if page[end - 1] != "/":
                at = _after(tag, lower, at, gone)
        else:
            tree.open(tag, page[name.end() : end])
    return tree.nodes, tree.texts


def _after(tag: str, lower: str, at: int, gone: set[str]) -> int:
    """Where the page goes on after a skipped element; gone: tags that the rest of the page does not close."""
    if tag == "head":
        # A head may be left open: it ends where the body begins.
        ends = [x for x in (lower.find("</head", at), lower.find("<body", at)) if x >= 0]
        return min(ends, default=at)
    depth, pos = 1, at
    while depth:
        close = -1 if tag in gone else lower.find(f"</{tag}", pos)
        if close < 0:
            gone.add(tag)
            break
        if tag not in RAW:
            depth += len(re.findall(rf"<{tag}[\s>]", lower[pos:close]))
        depth -= 1
        pos = close + 2 + len(tag)
    return max(at, lower.find(">", pos) + 1) if pos > at else at


def features(node: Node) -> list[str]:
    size = node.size
    out = [f"tag {node.tag}", f"in {node.tag} {node.section}", f"core {node.core}", f"size {0 if not size else 1 if size < 25 else 2 if size < 80 else 3}"]
    if size:
        share = node.linked / size
        out.append(f"links {0 if share < 0.2 else 1 if share < 0.7 else 2} {node.sentences > 0}")
    if node.below > size:
        share = node.linked_below / node.below
        out.append(f"below {0 if node.below < 60 else 1 if node.below < 250 else 2} {0 if share < 0.3 else 1 if share < 0.7 else 2}")
    out += [f"says {w}" for w in node.said[:1]]
    if size < 30 and node.said:
        out.append(f"whole {' '.join(node.said)}")
    out += [f"mark {w}" for w in set(node.marks)]
    if node.parent:
        out += [f"under {w}" for w in set(node.parent.marks)]
    return out


def measured(nodes: list[Node]) -> list[Node]:
    """The nodes, with what stands below each of them; its first short words come from its first child."""
    for x in nodes:
        x.below, x.linked_below = x.size, x.linked
    cores = any(x.tag in CORES for x in nodes)
    for x in reversed(nodes):
        if x.parent:
            x.parent.below += x.below
            x.parent.linked_below += x.linked_below
            if x.tag in CORES or x.core == "around":
                x.parent.core = x.parent.core or "around"
        x.core = x.core or ("around" if x.tag in CORES else "out" if cores else "none")
    told: set[int] = set()
    for x in nodes:
        p = x.parent
        if p and id(p) not in told and x.size:
            told.add(id(p))
            if not p.size and x.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "strong", "legend"):
                p.said = x.said
    return nodes


class Model:
    """Potentials of features by state, and edge potentials."""

    def __init__(self, pages: list[str]) -> None:
        by_state = [Counter() for _ in STATES]
        edges = [[SMOOTHING] * len(STATES) for _ in STATES]
        n = [SMOOTHING] * len(STATES)
        for page in pages:
            for node in measured(parse(page)[0]):
                by_state[node.label].update(features(node))
                n[node.label] += 1
                if node.parent:
                    edges[node.parent.label][node.label] += 1
        self.potential = {}
        for f in {f for c in by_state for f in c}:
            p = [(by_state[s][f] + SMOOTHING) / (n[s] + 2 * SMOOTHING) for s in range(len(STATES))]
            self.potential[f] = tuple(x / sum(p) for x in p)
        self.edges = tuple(tuple(x / sum(row) for x in row) for row in edges)

    def potentials(self, node: Node) -> list[tuple[float, float, float]]:
        """Those of a node's features; its tag alone speaks where tag and section together were never seen."""
        tag, placed, *rest = features(node)
        got = [self.potential.get(placed) or self.potential.get(tag)] if node.parent else []
        return [x for x in (*got, *map(self.potential.get, rest)) if x]

    def marginals(self, nodes: list[Node]) -> list[tuple[float, float, float]]:
        """By sum-product: messages from the leaves up, then from the root down."""
        place = {id(x): i for i, x in enumerate(nodes)}
        none = (1.0, 1.0, 1.0)
        belief: list[tuple[float, float, float]] = []
        for node in nodes:
            a, b, c = none
            for x, y, z in self.potentials(node):
                a, b, c = a * x, b * y, c * z
            s = a + b + c
            belief.append((a / s, b / s, c / s))
        ups: list[tuple[float, float, float]] = [none] * len(nodes)
        (e00, e01, e02), (e10, e11, e12), (e20, e21, e22) = self.edges
        for i in range(len(nodes) - 1, 0, -1):  # children stand after their parents
            a, b, c = belief[i]
            up = (e00 * a + e01 * b + e02 * c, e10 * a + e11 * b + e12 * c, e20 * a + e21 * b + e22 * c)
            ups[i] = up
            p = place[id(nodes[i].parent)]
            x, y, z = belief[p][0] * up[0], belief[p][1] * up[1], belief[p][2] * up[2]
            s = x + y + z or 1e-300
            # No state's share may vanish under many children, as the way down divides by what they sent.
            belief[p] = (x / s + 1e-30, y / s + 1e-30, z / s + 1e-30)
        for i in range(1, len(nodes)):
            p = belief[place[id(nodes[i].parent)]]
            u = ups[i]
            x, y, z = p[0] / u[0], p[1] / u[1], p[2] / u[2]
            a, b, c = belief[i]
            a, b, c = a * (e00 * x + e10 * y + e20 * z), b * (e01 * x + e11 * y + e21 * z), c * (e02 * x + e12 * y + e22 * z)
            s = a + b + c
            belief[i] = (a / s + 1e-30, b / s + 1e-30, c / s + 1e-30)
        return [tuple(x / sum(b) for x in b) for b in belief]

    def extract(self, page: str) -> str:
        nodes, texts = parse(page)
        if not texts:
            return ""
        keep = {id(x) for x, (a, b, c) in zip(nodes, self.marginals(measured(nodes)), strict=True) if b > a and b > c}
        blocks, own = [], []
        for x in itertools.chain(texts, [None]):
            if x is None:
                if own and (text := " ".join("".join(own).split())):
                    blocks.append(text)
                own = []
            elif id(x[0]) in keep:
                own.append(x[1])
        return "\n".join(blocks)

#: Layouts labelled by hand: b marks boilerplate, c content and f a frame, {parts} are filled in.  What is not marked has its parent's label.
LAYOUTS = [
    "<body f>{top}{ad}<article c>{title}{prose}</article>{foot}</body>",
    "<body f>{top}<div f class=page><div c class=content>{title}{prose}{share}{prose}</div>{side}</div>{foot}</body>",
    "<body f>{notice}{top}<main f><article c>{title}{byline}{prose}{ad}{prose}{form}</article>{comments}</main>{side}{foot}</body>",
    "<body f>{top}<div f id=wrapper><div f class=main>{crumbs}<div c class=post>{title}{prose}</div>{comments}{related}</div></div>{foot}</body>",
    "<body f>{top}<main c>{title}{prose}<div b class=related>{links}</div></main>{foot}</body>",
    "<body f><table f><tr f><td b>{plainlinks}</td><td c>{title}{prose}</td></tr></table>{foot}</body>",
    "<body f><table f><tr b><td>{plainlinks}</td></tr><tr f><td f><table f><tr f><td c>{prose}</td><td b>{plainlinks}</td></tr></table></td></tr><tr b><td>{small}</td></tr></table></body>",
    "<body f><section c>{title}{prose}</section></body>",
    "<body f><div c class=x>{title}{prose}</div></body>",
    "<body f><div f><div c>{prose}</div></div></body>",
    "<body c>{title}{prose}</body>",
    "<body c>{title}<br>{text}<br><br>{text}</body>",
    "<body f><article c>{prose}</article></body>",
    "<body f><article c><p>{words}.</p></article></body>",
    "<body c><p>{words}.</p></body>",
    "<p c>{words}.</p>",
    "<body c>{text}</body>",
    "<body f>{top}<main f><article c><header c>{title}</header><div c>{prose}</div></article></main>{foot}</body>",
    "<body f><header b>{sitename}{nav}</header><article c><header c>{title}{sub}</header>{prose}<footer b>{small}</footer></article>{foot}</body>",
    "<body f>{top}<main f><section c><h2>{words}</h2>{prose}</section><section c><h2>{words}</h2>{prose}</section></main><aside b>{links}</aside>{foot}</body>",
    "<body f><div b class=topbar>{links}</div><div f><div f><article c><div c class=body>{title}{prose}{linklist}{prose}</div>{tags}{share}</article></div>{side}</div><div b>{small}</div></body>",
    "<body f>{top}<div c role=main>{title}{prose}<div b>{form}</div></div>{comments}{foot}</body>",
    "<body f>{top}<div f><h1 c>{words}</h1><div c><p>{text}</p>{ad}<p>{text}</p><p>{text}</p></div>{pager}</div>{foot}</body>",
    "<body f><nav b>{links}</nav><main f><div f><article c>{title}{prose}<section b id=comments class=content>{heading}{replies}</section></article></div></main>{foot}</body>",
    "<body f>{top}<main f><article c>{title}{prose}{ad}{form}{prose}{comments}</article></main>{foot}</body>",
    "<body f>{top}<div f><div c>{title}{prose}{related}{comments}</div></div>{foot}</body>",
    "<body f>{dialog}{top}<div f>{side}<div c>{title}{prose}{prose}</div></div>{foot}</body>",
    "<body f>{top}<article c>{title}{prose}<div b id=comments class=content>{heading}{replies}</div></article>{foot}</body>",
    "<body f>{top}<article c>{title}{prose}{nested}{prose}</article>{foot}</body>",
    "<body f><article c>{nested}</article></body>",
    "<body f>{top}<main f><article c>{title}{prose}{comments}</article></main>{side}{foot}</body>",
    "<body f>{top}<main c>{title}{text}{prose}{nameless}</main>{foot}</body>",
    "<body f>{top}<article c>{title}<p>{text}</p>{nameless}<p>{text}</p>{prose}</article>{foot}</body>",
    "<body f>{top}<article c>{title}<p>{text}</p><p>{text}</p>{nameless}</article>{foot}</body>",
    "<body f>{top}<article c>{title}<p>{text}</p>{signup}<p>{text}</p>{prose}</article>{foot}</body>",
    "<body f>{top}<main f><div f>{crumbs}<div c>{title}{prose}{nested}{ad}{prose}</div>{related}</div></main>{foot}</body>",
]
#: Class names of the parts; two in five are left out or replaced by meaningless ones.
NAMES = {
    "ad": "ad ads advert advertisement sponsor sponsored promo banner adsense werbung", "notice": "notice cookie consent alert gdpr banner popup overlay hinweis", "nav": "nav menu navbar navigation navi topnav", "head": "header masthead banner topbar site-header",
    "foot": "footer copyright legal contentinfo colophon", "side": "sidebar aside widget complementary rail", "comments": "comments comment discussion responses disqus kommentare replies comentarios commentaires", "share": "share social sharing", "tags": "tags meta topics",
    "related": "related recommended more teaser", "form": "search newsletter login subscribe signup contact mailing", "crumbs": "breadcrumb breadcrumbs", "pager": "pagination pager", "byline": "byline author dateline", "dialog": "modal dialog popup",
}
#: What short texts of boilerplate say.
SAYS = {
    "ad": ["Advertisement", "Anzeige", "Sponsored"], "notice": ["We use cookies", "Accept", "Wir verwenden Cookies"], "share": ["Share this", "Tweet", "Teilen", "Share on Facebook", "Share by mail", "Follow us"], "related": ["Related articles", "Related stories", "Read more", "More stories", "You may also like", "Mehr zum Thema"], "comments": ["Comments", "3 Comments", "Kommentare", "Leave a reply", "Commentaires"],
    "reply": ["Reply", "Antworten", "Like"], "form": ["Subscribe", "Search", "Log in", "Sign up", "Newsletter"], "foot": ["© 2024", "Copyright", "All rights reserved", "Privacy policy", "Imprint", "Impressum"], "nav": ["Home", "News", "About", "Contact", "Start", "Blog"], "side": ["Popular", "Archive", "Categories", "Latest"],
}


def labelled_pages(n: int = 1200, seed: int = 11) -> list[str]:
    """The layouts in turn, filled with invented text and with names drawn anew."""
    dice = random.Random(seed)

    def text(lo: int, hi: int, sentence: bool = False) -> str:
        w = ["".join(dice.choice("etaoinshrdlu") for _ in range(dice.randint(1, 9))) for _ in range(dice.randint(lo, hi))]
        if sentence:
            for i in range(dice.randint(6, 14), len(w), 11):
                w[i] += dice.choice([".", ".", ",", "?"])
        return " ".join(w).capitalize() + ("." if sentence else "")

    def named(tag: str, kind: str, body: str) -> str:
        word = dice.choice(NAMES[kind].split()) if dice.random() < 0.6 else "".join(dice.choice("bcfgjkmpqvwxyz") for _ in range(4)) if dice.random() < 0.5 else ""
        return f"<{tag} b{dice.choice([' class=', ' class=', ' id=']) + word if word else ''}>{body}</{tag}>"

    def says(kind: str) -> str:
        return dice.choice(SAYS[kind]) if dice.random() < 0.7 else text(1, 3)

    def links(kind: str = "nav", lo: int = 3, hi: int = 8) -> str:
        return "<ul>" + "".join(f"<li><a href=/>{says(kind) if dice.random() < 0.4 else text(1, 4)}</a></li>" for _ in range(dice.randint(lo, hi))) + "</ul>"

    def heading(kind: str) -> str:
        return f"<{(h := dice.choice(['h2', 'h3', 'h4', 'p', 'strong', 'h1']))}>{says(kind)}</{h}>"

    def replies() -> str:
        one = lambda: dice.choice(["<li><b>{a}</b> <p>{t}</p><a href=/>{r}</a></li>", "<div><p>{a}</p><p>{t}</p></div>", "<p>{a}: {t}</p>", "<article><header>{a}</header><p>{t}</p></article>"]).format(a=text(1, 2), t=text(4, 30, dice.random() < 0.75), r=says("reply"))
        return dice.choice(["<ol>{}</ol>", "<div>{}</div>", "{}"]).format("".join(one() for _ in range(dice.randint(1, 5))))

    def nested(depth: int = 2) -> str:
        """A list whose items may hold lists."""
        item = lambda: text(1, 4) if dice.random() < 0.5 else text(2, 25, True)
        inner = lambda: nested(depth - 1) if depth and dice.random() < 0.6 else ""
        return f"<{(u := dice.choice(['ul', 'ul', 'ol']))}>{''.join(f'<li>{item()}{inner()}</li>' for _ in range(dice.randint(1, 4)))}</{u}>"

    def nameless() -> str:
        """Boxes that only their words and links tell from the article."""
        kind = dice.choice(["related", "share", "ad"])
        box = dice.choice(["div", "section", "div", "aside"])
        if kind == "related":
            return f"<{box} b><{(h := dice.choice(['h2', 'h3', 'h4']))}>{dice.choice(SAYS[kind])}</{h}>{parts['linklist']()}</{box}>"
        said = dice.choice(SAYS[kind])
        return f"<{box} b>{dice.choice(['{}', '{}', '<p>{}</p>', '<a href=/>{}</a> <a href=/>{}</a>']).format(said, text(1, 2))}</{box}>"

    def signup() -> str:
        return f"<{(t := dice.choice(['div', 'section', 'aside']))} b class={dice.choice(NAMES['form'].split())}>{dice.choice(['<p>{}</p>', '<h3>{1}</h3><p>{0}</p>', '{}']).format(text(5, 14, True), says('form'))}</{t}>"

    def prose() -> str:
        out = []
        for _ in range(dice.randint(1, 5)):
            kind, t = dice.random(), text(*dice.choice([(1, 3), (1, 4), (2, 6), (4, 12), (12, 40), (40, 120)]), dice.random() < 0.85)
            if dice.random() < 0.15:  # what boilerplate says, an article may say too
                t = says(dice.choice(list(SAYS))) + "."
            if dice.random() < 0.2:
                t += f" <a href=/>{text(1, 4)}</a> {text(2, 9, True)}"
            if dice.random() < 0.15:
                t = f'<span class="{dice.choice(["", "lead", "qx", "hl"])}">{t}</span>'
            if kind < 0.6:
                out.append(f"<p>{t}</p>")
            elif kind < 0.7:
                out.append(f"<{(h := dice.choice(['h2', 'h3', 'h4']))}>{text(1, 8)}</{h}>")
            elif kind < 0.78:
                out.append(parts["linklist"]())
            elif kind < 0.8:
                out.append(nested())
            elif kind < 0.85:
                out.append(f"<{(u := dice.choice(['ul', 'ol']))}>{''.join(f'<li>{text(2, 15, True)}</li>' for _ in range(3))}</{u}>")
            else:
                out.append(dice.choice(["<blockquote><p>{}</p></blockquote>", "<pre>{}</pre>", "<table><tr><th>x</th><td>{}</td><td>12</td></tr></table>", "<div>{}</div>", "<figure><img src=x><figcaption>{}</figcaption></figure>", "<section><p>{}</p></section>", "<dl><dt>x</dt><dd>{}</dd></dl>", "<blockquote>{}</blockquote>", "{}"]).format(t))
        return "".join(out)

    parts = {
        "top": lambda: dice.choice([named("header", "head", dice.choice(["<h1>{0}</h1>", "<a href=/>{0}</a>", "<p>{0}</p>", ""]).format(text(1, 4)) + dice.choice(["", links(), f"<nav>{links()}</nav>"])), named(dice.choice(["nav", "div", "ul"]), "nav", dice.choice([links(), links(), parts["plainlinks"]()])), ""]),
        "nav": lambda: f"<nav>{links()}</nav>", "sitename": lambda: f"<h1>{text(1, 3)}</h1>" if dice.random() < 0.5 else f"<p>{text(1, 3)}</p>", "links": links, "plainlinks": lambda: dice.choice([" | ", "<br>", " "]).join(f"<a href=/>{says('nav') if dice.random() < 0.5 else text(1, 3)}</a>" for _ in range(dice.randint(2, 7))),
        "foot": lambda: dice.choice([named(dice.choice(["footer", "footer", "div"]), "foot", f"<p>{says('foot')} {text(2, 9)}</p>" + (links("foot") if dice.random() < 0.4 else "")), named("footer", "foot", f"{says('foot')} {text(1, 12, True)}"), ""]),
        "small": lambda: f"{says('foot')} {text(1, 6)}", "ad": lambda: named(dice.choice(["div", "div", "aside", "p", "section", "span"]), "ad", dice.choice([says("ad"), text(3, 20, True), f"<a href=/>{text(3, 9)}</a>", f"<p>{says('ad')}</p><p>{text(3, 20, True)}</p>"])),
        "notice": lambda: named(dice.choice(["div", "p", "section", "aside"]), "notice", dice.choice([f"{says('notice')} {text(4, 20, True)} <button>{says('notice')}</button>", f"<p>{says('notice')}</p><p>{text(4, 20, True)}</p>"])), "dialog": lambda: named("dialog", "dialog", f"<p>{text(3, 12, True)}</p>{heading('form')}"),
        "side": lambda: named(dice.choice(["aside", "aside", "div"]), "side", heading("side") + dice.choice([links("side"), f"<p>{text(3, 25, True)}</p>", f"<p>{text(3, 9)}</p>{links('side')}"])), "share": lambda: named(dice.choice(["div", "ul"]), "share", dice.choice([heading("share"), links("share", 2, 4)])),
        "related": lambda: named(dice.choice(["div", "section", "aside", "nav"]), "related", heading("related") + links("related")), "comments": lambda: named(dice.choice(["div", "section", "section", "ol"]), "comments", heading("comments") + replies()), "replies": replies, "heading": lambda: heading("comments"),
        "form": lambda: named("form", "form", f"{heading('form')}<p>{text(2, 12)}</p><input><button>{says('form')}</button>"), "crumbs": lambda: named(dice.choice(["nav", "div", "ol"]), "crumbs", " / ".join(f"<a href=/>{text(1, 2)}</a>" for _ in range(3))), "pager": lambda: named("div", "pager", links("nav", 2, 4)),
        "tags": lambda: named(dice.choice(["div", "ul", "p"]), "tags", parts["plainlinks"]()), "byline": lambda: named("p", "byline", f"{text(1, 2)}, 3 May 2024"), "title": lambda: f"<{(h := dice.choice(['h1', 'h1', 'h2']))}>{text(2, 10)}</{h}>" if dice.random() < 0.85 else "", "sub": lambda: f"<p>{text(3, 15, True)}</p>" if dice.random() < 0.5 else "",
        "prose": prose, "nested": nested, "nameless": nameless, "signup": signup, "text": lambda: text(8, 60, True), "words": lambda: text(2, 8), "linklist": lambda: f"<ul>{''.join(f'<li><a href=/>{text(2, 9)}</a></li>' for _ in range(dice.randint(2, 5)))}</ul>",
    }
    labels = {" b": ' data-label="boilerplate"', " c": ' data-label="content"', " f": ' data-label="frame"'}
    pages = []
    for layout in itertools.islice(itertools.cycle(LAYOUTS), n):
        page = re.sub(r"\{(\w+)\}", lambda m: parts[m[1]](), layout)
        page = re.sub(r"(?<=<)(\w+)( [bcf])(?=[ >])", lambda m: m[1] + labels[m[2]], page)
        if dice.random() < 0.5:
            page = re.sub(r' class=(content|post|page|main|body|x)(?=>)', lambda m: f' class={"".join(dice.choice("bcfgjkmpqvwxyz") for _ in range(4))}', page)
        pages.append(f"<html>{page}</html>")
    return pages


def train(pages: list[str] | None = None) -> Model:
    return Model(labelled_pages() if pages is None else pages)


def main_text(pages: DataFrame, model: Model | None = None, key: str = "page_id", page: str = "html") -> DataFrame:
    """All columns but the html, and the main text with its length in code points."""
    spark = pages.sparkSession
    configure(spark)
    shared = spark.sparkContext.broadcast(model or train())
    keep = [c for c in pages.columns if c not in (page, "text", "n_chars")]  # those two columns are made anew

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [model.extract(x or "") for x in batch.column(page).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, "text", "n_chars"])

    some = pages.select(*keep, page)
    schema = ", ".join(f"`{c}` {t}" for c, t in some.dtypes if c != page)
    return some.mapInArrow(run, f"{schema}, text string, n_chars long")


def op2_html_extraction(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
