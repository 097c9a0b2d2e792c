"""Small DOM trees from raw HTML, as parallel lists; never fails on broken markup."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: A quote opens a value after = only; a comment may be empty.
TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))*+)(?:>|\Z)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Fixed values of HTML: elements without content, without markup inside, and such as stand in a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe".split())
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.IGNORECASE | re.ASCII) for t in RAW}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr button".split())
#: An opening tag that ends an open element of these names, up to the nearest of the others.
P_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


@dataclass
class Tree:
    """Elements in page order; the root is 0 and its own parent. pieces: (element, text, whether a break stands before)."""

    parent: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: ["#root"])
    words: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    pieces: list[tuple[int, str, bool]] = field(default_factory=list)
    mark: list[str | None] = field(default_factory=lambda: [None])


def hints(attributes: str) -> tuple[tuple[str, ...], str | None]:
    """The lower-case words of class, id and role, and the value of data-main."""
    found, mark = [], None
    for m in ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        if name in ("class", "id", "role"):
            found += [w.lower() for w in PIECE.findall(m[2] or m[3] or m[4] or "")]
        elif name == "data-main":
            mark = m[2]
    return tuple(found), mark


def parse(page: str) -> Tree:
    """The tree of a page; comments, scripts, styles and other raw elements are left out."""
    t = Tree()
    open_, at, gap = [0], 0, True

    def text(piece: str) -> None:
        nonlocal gap
        if piece:
            t.pieces.append((open_[-1], html.unescape(piece) if "&" in piece else piece, gap))
            gap = False

    while m := TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:-3])
            continue
        tag = m[2].lower()
        if tag not in INLINE:
            gap = True
        if m[1]:
            for k in range(len(open_) - 1, 0, -1):
                name = t.tag[open_[k]]
                if name == tag:
                    del open_[k:]
                    break
                if tag in INLINE and name not in INLINE:
                    break
            continue
        if tag in RAW:
            if not m[0].endswith("/>"):
                end = RAW_END[tag].search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in P_ENDS:
            _close(t, open_, {"p"}, {"table", "td", "th", "button"})
        if tag in CLOSES:
            _close(t, open_, *CLOSES[tag])
        words, mark = hints(m[3]) if m[3].strip() else ((), None)
        if tag in VOID:
            continue
        t.parent.append(open_[-1])
        t.depth.append(len(open_))
        t.tag.append(tag)
        t.words.append(words)
        t.mark.append(mark)
        if not m[3].endswith("/") or tag in INLINE or tag in P_ENDS:
            open_.append(len(t.tag) - 1)
    text(page[at:])
    return t


def _close(t: Tree, open_: list[int], names: set[str], bounds: set[str]) -> None:
    """Closes the open elements from the outermost of these names above the nearest bound."""
    for k in range(len(open_) - 1, 0, -1):
        name = t.tag[open_[k]]
        if name in bounds:
            return
        if name in names:
            del open_[k:]
            return


def main_text(t: Tree, content: list[bool]) -> str:
    """The text of the elements that are content: blocks in page order with one space between."""
    out = []
    for node, piece, gap in t.pieces:
        if content[node]:
            out.append(" " + piece if gap else piece)
        elif gap:
            out.append(" ")
    return " ".join("".join(out).split())
