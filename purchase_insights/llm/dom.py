"""A small tolerant HTML reader: blocks of a page as a tree of elements and text."""

from __future__ import annotations

import html
import re

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Their content is not text of the page.
UNSEEN = RAW | frozenset("head template svg math canvas object video audio select button datalist".split())
#: What may stand in a head; any other start tag, and text, ends it.
IN_HEAD = frozenset("title meta link base script style noscript template head html basefont bgsound noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td "
    "tfoot th thead tr ul caption".split()
)
#: Elements that don't say what they hold.
BARE = frozenset("# html body center div p section ul ol li h1 h2 h3 h4 h5 h6 table tbody tr td th blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag closes when it is open, and what such closing does not reach beyond.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
IN_PARAGRAPH = frozenset("td th table button caption".split())
TAG = re.compile(
    r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+|[^>]*+)(?:>|\Z)"
    r"|[!?/][^>]*+(?:>|\Z))",
    re.S,
)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """A block element (``tag``) or a run of text without blocks in it (tag '#')."""

    __slots__ = ("attributes", "bare", "linked", "parent", "size", "tag", "text")

    def __init__(self, tag: str, parent: int, attributes: str = "", text: str = "", linked: int = 0):
        self.tag, self.parent, self.attributes, self.text, self.linked = tag, parent, attributes, text, linked
        self.size = len(text)
        self.bare = False  # no tag or name above it says what it is

    def names(self) -> set[str]:
        """Lower-cased words of its class, id and role without plural s, and "hidden"."""
        if not self.attributes:
            return set()
        values = (next(filter(None, groups), "") for groups in NAMES.findall(self.attributes))
        found = {word.lower().removesuffix("s") for value in values for word in WORDS.findall(value)}
        return found | {"hidden"} if HIDDEN.search(self.attributes) else found


def parse(page: str) -> list[Node]:
    """The nodes in page order, parents first; node 0 is the page.

    End tags without a start are ignored, missing ones implied; an element whose
    content isn't text of the page is left out whole. Characters are decoded and
    white space is one blank.
    """
    nodes = [Node("", -1)]
    stack: list[tuple[str, int]] = [("", 0)]  # open elements and the block that each is in
    n_open: dict[str, int] = {"": 1}
    run: list[str] = []
    linked = unseen = 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                nodes.append(Node("#", stack[-1][1], text=text, linked=min(linked, len(text))))
            run.clear()
        linked = 0

    def pop() -> str:
        nonlocal unseen
        name, _ = stack[-1]
        if name in BLOCKS:
            flush()
        stack.pop()
        n_open[name] -= 1
        unseen -= name in UNSEEN
        return name

    def close(names: set[str] | frozenset[str], limits: set[str] | frozenset[str]) -> None:
        if any(n_open.get(name) for name in names):
            for depth in range(len(stack) - 1, 0, -1):
                name = stack[depth][0]
                if name in names:
                    while len(stack) > depth:
                        pop()
                    return
                if name in limits:
                    return

    at, length = 0, len(page)
    while at < length:
        tag = TAG.search(page, at)
        start = tag.start() if tag else length
        if stack[-1][0] == "head" and page[at:start].strip():
            pop()
        if start > at and not unseen:
            run.append(page[at:start])
            if n_open.get("a"):
                linked += start - at
        if not tag:
            break
        at = tag.end()
        name = tag["name"]
        if name is None:
            continue
        name = name.lower()
        if tag["close"]:
            if n_open.get(name):
                while pop() != name:
                    pass
            continue
        if stack[-1][0] == "head" and name not in IN_HEAD:
            pop()
        if name == "br":
            run.append(" ")
        if name in BLOCKS:
            flush()
            if name not in IN_PARAGRAPH and n_open.get("p"):
                close({"p"}, IN_PARAGRAPH)
        if name in CLOSES:
            close(*CLOSES[name])
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            at = end.end() if end else length
            continue
        block = stack[-1][1]
        if name in BLOCKS and not unseen:
            block = len(nodes)
            nodes.append(Node(name, stack[-1][1], tag["rest"]))
        stack.append((name, block))
        n_open[name] = n_open.get(name, 0) + 1
        unseen += name in UNSEEN
    flush()
    for node in nodes:
        node.bare = node.parent < 0 or nodes[node.parent].bare and (node.tag in BARE and not node.names())
    for node in reversed(nodes):  # sizes of texts and links below
        if node.parent >= 0 and (node.size or node.linked):
            nodes[node.parent].size += node.size
            nodes[node.parent].linked += node.linked
    return nodes
