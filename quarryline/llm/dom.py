"""A forgiving HTML reader: a tree of block elements with their text, in page order."""

from __future__ import annotations

import re
from html import unescape

#: Elements that start and end a block of text.
BLOCKS = frozenset(
    "html body main article section div p ul ol li dl dt dd nav header footer aside form fieldset h1 h2 h3 h4 h5 h6 hgroup "
    "blockquote pre figure figcaption table thead tbody tfoot tr td th caption address details summary center menu dialog search".split()
)
#: Elements whose content is no text of the page.
SKIPPED = frozenset("script style noscript template textarea title iframe svg math object select button canvas audio video head datalist".split())
RAW = frozenset("script style textarea title iframe".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
_P_CLOSERS = BLOCKS - frozenset("html body li dt dd td th tr thead tbody tfoot caption summary".split())
#: A start tag closes an open element of these names, but not beyond an element of those names.
_CLOSES = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "td", "th")), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
}
_P = (frozenset(("p",)), BLOCKS - {"p"})
_TAG = re.compile(r"<(?:!--(?:.*?--!?>|>|.*\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*>)|[!?/][^>]*>)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Page:
    """Nodes in page order: parent (-1 for the root), tag, attribute tokens. Runs of text: node, text
    (references decoded, white space made single), characters inside links."""

    __slots__ = ("parent", "tag", "tokens", "run_node", "run_text", "run_link")

    def __init__(self):
        self.parent, self.tag, self.tokens = [-1], ["#root"], [()]
        self.run_node, self.run_text, self.run_link = [], [], []


def attribute_tokens(source: str) -> tuple[str, ...]:
    """Lower-case words of class, id, role and label attributes; and the names of hidden states."""
    out: list[str] = []
    for name, a, b, c in _ATTR.findall(source):
        name = name.lower()
        if name in ("class", "id", "role", "aria-label", "itemprop", "data-role"):
            out += (t.lower() for t in _TOKEN.findall(a or b or c))
    return tuple(out)


def parse(html: str | None) -> Page:
    page = Page()
    if not html:
        return page
    parent, tags, tokens = page.parent, page.tag, page.tokens
    stack = [0]
    pieces: list[str] = []
    links = [0, 0]  # depth, characters

    def flush() -> None:
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                page.run_node.append(stack[-1])
                page.run_text.append(text)
                page.run_link.append(min(links[1], len(text)))
            pieces.clear()
            links[1] = 0

    def close(names: frozenset, limits: frozenset) -> None:
        for k in range(len(stack) - 1, 0, -1):
            name = tags[stack[k]]
            if name in names:
                flush()
                del stack[k:]
                return
            if name in limits:
                return

    at, find, end = 0, _TAG.search, len(html)
    skip: list[str] = []
    while at < end:
        m = find(html, at)
        start = m.start() if m else end
        if start > at and not skip:
            text = html[at:start]
            pieces.append(text)
            if links[0]:
                links[1] += len(text.strip())
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        closing = m[1]
        if skip:  # inside an element whose content is no text
            if name == skip[-1] and closing:
                skip.pop()
            elif name in SKIPPED and not closing and not m[3].endswith("/>"):
                at = _past_raw(html, name, at) if name in RAW else at
                if name not in RAW:
                    skip.append(name)
            elif name == "body" and not closing and skip == ["head"]:
                skip.clear()
                flush()
                parent.append(stack[-1])
                tags.append(name)
                tokens.append(attribute_tokens(m[3]))
                stack.append(len(tags) - 1)
            continue
        if name in SKIPPED:
            if not closing and not m[3].endswith("/>"):
                if name in RAW:
                    at = _past_raw(html, name, at)
                else:
                    skip.append(name)
            pieces.append(" ")
        elif name == "br" or name == "wbr" and not closing:
            pieces.append(" " if name == "br" else "")
        elif name in BLOCKS or "-" in name:
            if closing:
                if name == "p":  # one without a start still ends a block
                    flush()
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == name:
                        flush()
                        del stack[k:]
                        break
                    if tags[stack[k]] in ("td", "th", "table") and name in ("p", "div", "li"):
                        break  # an end tag that has no start within its cell
                links[0] = 0
            else:
                if name in _P_CLOSERS:
                    close(*_P)
                if name in _CLOSES:
                    close(*_CLOSES[name])
                flush()
                parent.append(stack[-1])
                tags.append(name)
                tokens.append(attribute_tokens(m[3]) if len(m[3]) > 5 else ())
                if not m[3].endswith("/>"):
                    stack.append(len(tags) - 1)
        elif name == "a":
            links[0] = 0 if closing else 1
        elif name == "hr":
            flush()
        elif name == "img" or name == "input":
            pieces.append(" ")
    flush()
    return page


def _past_raw(html: str, name: str, at: int) -> int:
    m = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, at)
    return m.end() if m else len(html)
