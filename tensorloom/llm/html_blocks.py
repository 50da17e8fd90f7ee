"""Leaf text blocks of an HTML page, with the elements that they stand in."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

#: Elements without content (fixed by the HTML standard).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page.
HIDDEN = frozenset("script style template noscript iframe object svg math canvas head title textarea select datalist audio video".split())
#: Those of them whose content is markup: they end with their parent at the latest.
NESTED = frozenset("template noscript object svg math canvas head select datalist audio video".split())
#: Elements that block elements end: what stands in them are choices of a form.
CHOICES = ("select", "datalist")
#: Start tags that leave an open head open (fixed by the HTML standard).
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Elements that are part of a line of text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Start tags that end an open paragraph (fixed by the HTML standard).
ENDS_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: Start tags that end an open element of one of these names, up to the given parents.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr"}),
    "th": ({"td", "th"}, {"tr"}),
    "option": ({"option"}, {"select"}),
}
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>?|</>|</[^a-zA-Z>][^>]*>?"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)",
    re.S,
)
#: A comment that goes on to the end of the page.
UNENDED = re.compile(r"<!|<\?|</[^a-zA-Z>]")
SPECIAL = re.compile("[>\"']")
ATTR = re.compile(r"(class|id|role|hidden|style|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    tag: str  # the innermost block element
    marks: frozenset[str]  # "<tag" of all elements around it, and the words of their class, id and role
    linked: int  # characters inside links


class Tags:
    """The ends of a page's tags, in time linear in the page.

    A quote runs to the next one of its kind, however long; one without another is a
    character like any. Quotes from which no tag end follows are remembered, and so is
    the last place of a special character, so no part is scanned again and again.
    """

    def __init__(self, page: str) -> None:
        self.page = page
        self.dead: set[int] = set()
        self.since, self.place = 0, -1  # no special character stands in page[since:place]
        self.none_left: set[str] = set()

    def special(self, at: int) -> int:
        if not self.since <= at <= self.place:
            m = SPECIAL.search(self.page, at)
            self.since, self.place = at, m.start() if m else len(self.page)
        return self.place

    def end(self, at: int) -> int:
        """The place of the > that ends the tag whose name ends at `at`, or -1."""
        page, seen = self.page, []
        while (at := self.special(at)) < len(page) and at not in self.dead:
            kind = page[at]
            if kind == ">":
                return at
            close = -1 if kind in self.none_left else page.find(kind, at + 1)
            if close < 0:
                self.none_left.add(kind)
                return page.find(">", at)
            seen.append(at)
            at = close + 1
        self.dead.update(seen)
        return -1


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order; unclosed and stray tags are allowed anywhere."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []  # open block elements, each with all marks so far
    opened: Counter[str] = Counter()
    links = 0
    parts: list[tuple[str, bool]] = []  # text as it reads, and whether it stands in a link

    hid: int | None = None  # the place in the stack of the outermost element that hides its content
    tags = Tags(page)

    def flush() -> None:
        nonlocal parts
        if parts:
            text = SPACE.sub(" ", "".join(p for p, _ in parts)).strip()
            if text:
                linked = sum(len(p) for p, in_link in parts if in_link)
                tag, marks = stack[-1] if stack else ("", frozenset())
                out.append(Block(text, tag, marks, linked))
            parts = []

    def pop(names, stop=frozenset(), least: int = 0) -> None:
        nonlocal hid
        if not any(opened[x] for x in names):
            return
        for k in range(len(stack) - 1, least - 1, -1):
            if stack[k][0] in names:
                if hid is None or k < hid:
                    flush()
                opened.subtract(x for x, _ in stack[k:])
                del stack[k:]
                hid = None if hid is None or k <= hid else hid
                return
            if stack[k][0] in stop:
                return

    at, n, last = 0, len(page), page.rfind(">")
    while at < n:
        m, stop, look = None, -1, at
        while look <= last and (m := TOKEN.search(page, look)) and m["name"] and (stop := tags.end(m.end())) < 0:
            m, look = None, m.end()
        end = m.start() if m else n
        if not m and (open_ := UNENDED.search(page, at)):
            end = open_.start()
        if end > at:
            if stack and stack[-1][0] == "head" and not page[at:end].isspace():
                pop({"head"})
            if hid is None:
                parts.append((html.unescape(page[at:end]), links > 0))
        if not m:
            break
        name = (m["name"] or "").lower()
        attrs = page[m.end() : stop] if name else ""
        at = stop + 1 if name else m.end()
        if not name:
            if (opened["svg"] or opened["math"]) and page.startswith("<![CDATA[", m.start()):
                close = page.find("]]>", m.start())  # elsewhere it is a comment that ends at its first >
                at = close + 3 if close >= 0 else n
            continue
        if m["close"]:
            if name == "a":
                links = max(0, links - (hid is None))
            elif name == "br":
                if hid is None:
                    parts.append((" ", False))
            elif name not in INLINE:
                if name == "p" and hid is None and not opened["p"]:
                    flush()  # an end tag without a paragraph makes an empty one
                pop({name})
            continue
        empty = attrs.rstrip().endswith("/")
        if opened["head"] and name not in IN_HEAD and name != "head":
            pop({"head"})
        drawn = opened["svg"] or opened["math"]
        if empty and (name in ("svg", "math") or drawn):
            continue
        if name in ENDS_P:
            pop(CHOICES)
        if name in HIDDEN and name not in NESTED and not drawn:
            found = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            # raw text that is never closed goes on to the end of the page
            if found is None:
                break
            at = found.end()
            continue
        if hid is not None or name in NESTED:
            # what is hidden ends no block outside
            if name in SIBLINGS and hid is not None:
                pop(*SIBLINGS[name], least=hid + 1)
            if name not in VOID and name not in INLINE:
                hid = len(stack) if hid is None else hid
                stack.append((name, stack[-1][1] if stack else frozenset()))
                opened[name] += 1
            continue
        if name == "a":
            links += not empty
            continue
        if name in INLINE:
            if name in ("br", "wbr", "img"):
                parts.append((" " if name == "br" else "", False))
            continue
        flush()
        links = 0
        if name in ENDS_P:
            pop({"p"}, {"article", "section", "div", "td", "th", "li", "body", "blockquote", "main"})
        if name in SIBLINGS:
            pop(*SIBLINGS[name])
        if name not in VOID:
            marks = ["<" + name]
            for a in ATTR.finditer(attrs):
                value = a[2] or a[3] or a[4] or ""
                key = a[1].lower()
                if key in ("class", "id", "role", "itemprop"):
                    marks += re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
                elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "").lower()):
                    marks.append("invisible")
            above = stack[-1][1] if stack else frozenset()
            stack.append((name, above if above.issuperset(marks) else above.union(marks)))
            opened[name] += 1
    flush()
    return out
