"""A fault-tolerant reader of web pages: leaf blocks of text with their ancestors, in page order."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Container
from typing import NamedTuple

#: Elements whose text is never shown as text of the page.
HIDDEN = frozenset("script style noscript template textarea title svg iframe object head select datalist button canvas math audio video".split())
#: Hidden elements whose content is not markup.
RAW = frozenset("script style textarea title iframe noscript".split())
#: Elements that start a block of their own.
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2
    h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split()
)
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end the one before them, and those that they don't reach across.
_ITEMS = ("li", "dt", "dd", "tr", "td", "th")
_LISTS = ("ul", "ol", "dl", "table", "menu")
_ROWS = (*_LISTS, "tr")
_PARTS = re.compile(r"""<!--|<!|<\?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?""")
_HINTS = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
#: Hidden elements that can't hold each other.
_APART = ("button", "select")
#: What ends a comment; one that begins with > or -> is over at once.
_COMMENT_END = re.compile(r"--!?>")
_EMPTY_COMMENT = re.compile(r"-?>")
_PAIRED = {name: re.compile(rf"<(/?){name}(?=[\s/>])([^>]*)>", re.I) for name in HIDDEN - RAW}
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>]|$)[^>]*>?", re.I) for name in RAW}


class Block(NamedTuple):
    tag: str
    ancestors: tuple[str, ...]
    hints: tuple[str, ...]
    text: str
    linked: int  # characters inside links


class _Open(NamedTuple):
    """An open element: its name, the distinct names and hints from the root down to it."""

    name: str
    ancestors: tuple[str, ...]
    hints: tuple[str, ...]


_ROOT = _Open("body", (), ())


def _without_end(page: str, name: str) -> set[int]:
    """Where the element is opened and never closed; an end tag closes the last one that is open.

    Of elements that can't hold each other, one that is opened ends the chance of the one before.
    """
    open_: list[int] = []
    found: set[int] = set()
    for m in _PAIRED[name].finditer(page):
        if not m[1]:
            if not m[2].endswith("/"):
                if name in _APART:
                    found.update(open_)
                    open_.clear()
                open_.append(m.start())
        elif open_:
            open_.pop()
    return found | set(open_)


def blocks(page: str | None, known: Container[str] | None = None) -> list[Block]:
    """The page's leaf blocks; white space inside one is a single space, and character references are decoded.

    Elements may be nested as deep as they like. Of the ancestors' classes, ids and roles those in `known` are kept, and
    those of the outermost element that has any; all, if nothing is known. A hidden element that is never closed (button,
    svg, object and so on) hides what follows up to the next block, or the next of its kind, not the rest of the page.
    """
    found: list[Block] = []
    stack: list[_Open] = []
    inside_of: Counter[str] = Counter()
    text: list[str] = []
    linked: list[str] = []
    links, hidden, opened = 0, [], Counter()  # hidden: name and whether it has no end
    endless: dict[str, set[int]] = {}
    page = page or ""

    def flush() -> None:
        nonlocal text, linked
        if text:
            if joined := " ".join(html.unescape("".join(text)).split()):
                inside = len(" ".join(html.unescape("".join(linked)).split())) if linked else 0
                found.append(Block(*(stack[-1] if stack else _ROOT), joined, inside))
            text, linked = [], []

    def close(name: str, within: tuple[str, ...] = ()) -> None:
        """Ends the innermost open element of this name with all that is open in it, unless one of `within` lies between."""
        if inside_of[name]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == name:
                    inside_of.subtract(x.name for x in stack[k:])
                    del stack[k:]
                    break
                if stack[k].name in within:
                    break

    at = 0
    while (m := _PARTS.search(page, at)) is not None:
        if m.start() > at and not hidden:
            text.append(page[at : m.start()])
            if links:
                linked.append(text[-1])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0] == "<!--":
                end = _EMPTY_COMMENT.match(page, at) or _COMMENT_END.search(page, at)
                at = end.end() if end else len(page)
            else:
                at = page.find(">", at) + 1 or len(page)
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if not closing and name in RAW:
            end = _CLOSE[name].search(page, at)
            at = end.end() if end else len(page)
        elif name in HIDDEN:
            if closing and name == "head":
                hidden, opened = [], Counter()
            elif closing and opened[name]:  # it ends with all that was left open in it
                while (last := hidden.pop()[0]) != name:
                    opened[last] -= 1
                opened[name] -= 1
            elif not closing and not attributes.endswith("/"):
                if name not in endless:
                    endless[name] = _without_end(page, name)
                if hidden and hidden[-1] == (name, True):
                    hidden.pop()
                    opened[name] -= 1
                hidden.append((name, m.start() in endless[name]))
                opened[name] += 1
        elif name == "body":
            hidden, opened = [], Counter()  # whatever the head left open ends here
            flush()
        elif name == "a":
            links = 0 if closing else 1
        elif name == "br":
            text.append("\n")
        elif name in BLOCK:
            while hidden and hidden[-1][1]:
                opened[hidden.pop()[0]] -= 1
            flush()
            links = 0
            if closing:
                close(name)
            elif name not in VOID:
                if stack and stack[-1].name == "p":
                    close("p")
                if name in _ITEMS:
                    close(name, _LISTS if name in ("li", "dt", "dd", "tr") else _ROWS)
                above = stack[-1] if stack else _Open("", (), ())
                hints = above.hints
                if "=" in attributes:
                    words = (w for x in _HINTS.findall(attributes) for w in _WORD.findall("".join(x[1:]).lower()))
                    fresh = [w for w in dict.fromkeys(words) if w not in hints and (known is None or not hints or w in known)]
                    hints = (*hints, *fresh) if fresh else hints
                stack.append(_Open(name, above.ancestors if name in above.ancestors else (*above.ancestors, name), hints))
                inside_of[name] += 1
    if at < len(page) and not hidden:
        text.append(page[at:])
    flush()
    return found
