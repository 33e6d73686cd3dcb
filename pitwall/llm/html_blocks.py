"""Leaf blocks of an HTML page: pieces of text between block-level tags, with the open elements around them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# A comment, a declaration, a tag (with quoted values, or else up to the next ">"), an unfinished tag at the end.
TAG = r"<(/?)([a-zA-Z][^\s/>]*)"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>|{TAG}((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|{TAG}([^>]*)>|<[/!?a-zA-Z][^>]*\Z",
                   re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Elements by what HTML makes of them.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "canvas", "object", "head", "title",
       "textarea", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
          "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
          "time", "tt", "u", "var", "wbr", "img", "br"}
# An opening tag closes these open elements first (up to the nearest of the second set).
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
          "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}
HEAD_ONLY = {"meta", "link", "base", "title", "style", "script", "noscript", "template"}


@dataclass
class Block:
    """Text of one leaf block with its open elements as (tag, names in class, id and role), outermost first."""

    path: list[tuple[str, tuple[str, ...]]]
    owner: int                          # number of the innermost block element's parent, tells siblings
    text: str = ""
    linked: int = 0                     # characters inside links
    parts: list[str] = field(default_factory=list)


def names_of(attributes: str) -> tuple[str, ...]:
    """Lower-case words of an element's class, id, role and hidden attributes."""
    out = []
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        value = a or b or c
        key = key.lower()
        if key in ("class", "id", "role", "itemprop", "aria-label"):
            out += [w.lower() for w in NAME.findall(value) if not w.isdigit()]
        elif key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", value):
            out.append("hidden")
    return tuple(out)


def leaf_blocks(page: str) -> list[Block]:
    """Blocks with text, in page order.

    A block is the text between two block-level tags; inline tags and ``br``
    do not end it. Scripts, styles and the like have none. Character
    references are decoded, runs of white space become one space and the ends
    are trimmed. Unclosed and wrongly nested elements are closed the way
    browsers do for paragraphs, items and cells; an unfinished tag or comment
    at the end is markup.
    """
    stack: list[tuple[str, tuple[str, ...], int]] = []
    out: list[Block] = []
    now: Block | None = None
    serial = at = 0

    def end() -> None:
        nonlocal now
        if now:
            text = "".join(now.parts)
            now.text = " ".join(text.split())
            now.parts = []
            if now.text:
                out.append(now)
        now = None

    def say(raw: str) -> None:
        nonlocal now
        if not raw or (now is None and raw.isspace()):
            return
        text = html.unescape(raw) if "&" in raw else raw
        if now is None:
            blocks = [n for t, _, n in stack if t not in INLINE]
            now = Block([(t, names) for t, names, _ in stack], blocks[-2] if len(blocks) > 1 else 0)
        now.parts.append(text)
        if any(t == "a" for t, _, _ in stack):
            now.linked += len(text.strip())

    def leave(depth: int) -> None:
        if any(t not in INLINE for t, _, _ in stack[depth:]):
            end()
        del stack[depth:]

    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at:m.start()])
        at = m.end()
        closing, tag, attributes = m.group(1, 2, 3) if m[2] else m.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    leave(depth)
                    break
                if stack[depth][0] in ("table", "td", "article", "body") and tag in INLINE | {"p", "li"}:
                    break           # a stray end tag does not reach through these
            continue
        if tag in RAW and not (tag == "head"):
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if tag == "head":
            close = re.compile(r"</head\s*>|<body[\s>]", re.I).search(page, at)
            if close:
                at = close.start() if close[0][1] != "/" else close.end()
            continue
        if tag in VOID:
            if tag == "br" and now:
                now.parts.append(" ")
            elif tag == "hr":
                end()
            continue
        if tag not in INLINE:
            end()
            for depth in range(len(stack) - 1, -1, -1):     # a block element ends an open paragraph
                if stack[depth][0] == "p":
                    del stack[depth:]
                    break
                if stack[depth][0] not in INLINE:
                    break
            shut, bound = CLOSES.get(tag, ((), ()))
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in bound:
                    break
                if stack[depth][0] in shut:
                    del stack[depth:]
                    break
        serial += 1
        if not attributes.rstrip().endswith("/") or tag not in INLINE:
            stack.append((tag, names_of(attributes), serial))
    end()
    return out
