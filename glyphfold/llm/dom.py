"""A small tolerant reader of HTML: a tree of elements and the text blocks in it.

It follows what browsers do as far as main text needs: comments, declarations
and raw-text elements are skipped, unknown or unclosed tags are tolerated,
paragraphs, list items and table parts end where the next one begins.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements whose text is not shown.
HIDDEN_TEXT = RAW | frozenset("head template noscript svg math canvas object audio video select button datalist".split()) - {"textarea"}
#: Elements that belong to the line they stand in.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split()
)
#: An element of the first kind is ended by the start of one of the second.
_BLOCKS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
ENDED_BY: dict[str, frozenset[str]] = {
    "p": _BLOCKS,
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot", "thead"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot", "thead"]),
    "head": frozenset(["body"]) | _BLOCKS,
}
#: How far up such an end looks.
SCOPE = frozenset("html table ul ol dl td th select button article section div main aside body nav footer header form".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_END_RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}


@dataclass(slots=True)
class Node:
    """A block element; inline elements are part of the block they stand in."""

    tag: str
    parent: int
    attributes: dict[str, str] = field(default_factory=dict)
    chars: int = 0
    link_chars: int = 0


@dataclass(slots=True)
class Block:
    """White-space-normalised text of one stretch of a block element."""

    node: int
    text: str


def attributes_of(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(source)}


_UNSHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.IGNORECASE)
#: What closes what, the other way round: the open elements that a start tag ends.
_ENDS = {tag: [over for over, by in ENDED_BY.items() if tag in by] for tag in {t for by in ENDED_BY.values() for t in by}}


def is_hidden(attributes: dict[str, str]) -> bool:
    """Whether an element's own attributes keep it and all inside it from being shown."""
    if "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true":
        return True
    return bool(_UNSHOWN.search(attributes.get("style", "")))


def parse(source: str) -> tuple[list[Node], list[Block]]:
    """Nodes, parents before children (0 is the root), and blocks in page order.

    Text inside hidden inline elements is left out.  Open elements are counted
    by name, so a tag that closes nothing costs no walk over what is open.
    """
    nodes, blocks = [Node("#root", -1)], []
    open_tags: list[tuple[str, int]] = [("#root", 0)]  # (tag, its block node)
    parts: list[str] = []
    links = 0
    # Open inline elements since each open block, open blocks of all, and what a start tag may end since each scope.
    inline_open: list[dict[str, int]] = [{}]
    blocks_open: dict[str, int] = {}
    endable: list[dict[str, int]] = [{}]
    unshown: list[int] = []  # depths of hidden inline elements
    at, size = 0, len(source)
    no_comment_end = False

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                node = nodes[open_tags[-1][1]]
                node.chars += len(text)
                blocks.append(Block(open_tags[-1][1], text))

    def push(tag: str, node: int) -> None:
        open_tags.append((tag, node))
        if tag in INLINE:
            here = inline_open[-1]
            here[tag] = here.get(tag, 0) + 1
        else:
            inline_open.append({})
            blocks_open[tag] = blocks_open.get(tag, 0) + 1
        if tag in SCOPE:
            endable.append({})
        elif tag in ENDED_BY:
            here = endable[-1]
            here[tag] = here.get(tag, 0) + 1

    def close(upto: int) -> None:
        nonlocal links
        if any(tag not in INLINE for tag, _ in open_tags[upto:]):
            flush()
        for tag, _ in reversed(open_tags[upto:]):
            if tag in SCOPE:
                endable.pop()
            elif tag in ENDED_BY:
                endable[-1][tag] -= 1
            if tag in INLINE:
                inline_open[-1][tag] -= 1
                links -= tag == "a"
            else:
                inline_open.pop()
                blocks_open[tag] -= 1
        while unshown and unshown[-1] >= upto:
            unshown.pop()
        del open_tags[upto:]

    while at < size:
        opened = source.find("<", at)
        if opened < 0:
            opened = size
        if opened > at:
            text = "" if unshown else html.unescape(source[at:opened])
            parts.append(text)
            if links:
                nodes[open_tags[-1][1]].link_chars += len(text.strip())
        if opened == size:
            break
        if source.startswith("<!--", opened):
            end = -1 if no_comment_end else source.find("-->", opened + 4)
            no_comment_end = end < 0
            at = size if end < 0 else end + 3
            continue
        if source.startswith(("<!", "<?"), opened):
            end = source.find(">", opened)
            at = size if end < 0 else end + 1
            continue
        match = _TAG.match(source, opened)
        if match is None:
            if source[opened + 1 : opened + 2].isalpha() or source.startswith("</", opened):
                end = source.find(">", opened)  # a tag with an open quote
                at = size if end < 0 else end + 1
            else:
                parts.append("" if unshown else "<")
                at = opened + 1
            continue
        at = match.end()
        tag = match[2].lower()
        if match[1]:
            if not (inline_open[-1] if tag in INLINE else blocks_open).get(tag):
                continue
            for depth in range(len(open_tags) - 1, 0, -1):
                if open_tags[depth][0] == tag:
                    close(depth)
                    break
                if tag in INLINE and open_tags[depth][0] not in INLINE:
                    break
            continue
        if tag in VOID:
            if tag in ("br", "wbr", "hr"):
                parts.append(" " if tag != "wbr" else "")
            if tag == "hr":
                flush()
            continue
        if tag in _ENDS and endable[-1] and any(endable[-1].get(over) for over in _ENDS[tag]):
            for depth in range(len(open_tags) - 1, 0, -1):
                over = open_tags[depth][0]
                if tag in ENDED_BY.get(over, ()):
                    close(depth)
                    break
                if over in SCOPE:
                    break
        if tag in INLINE:
            push(tag, open_tags[-1][1])
            links += tag == "a"
            if match[3].strip() and is_hidden(attributes_of(match[3])):
                unshown.append(len(open_tags) - 1)
            continue
        flush()
        nodes.append(Node(tag, open_tags[-1][1], attributes_of(match[3]) if match[3].strip() else {}))
        if tag in RAW:
            end = _END_RAW[tag].search(source, at)
            if end is None:
                break
            at = end.start()
            skipped = source.find(">", at)
            at = size if skipped < 0 else skipped + 1
            continue
        push(tag, len(nodes) - 1)
    flush()
    return nodes, blocks


_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.IGNORECASE | re.DOTALL)


def title_and_links(source: str) -> tuple[str, list[str]]:
    """The page's title and the addresses its links lead to, in page order."""
    found = _TITLE.search(source)
    title = " ".join(html.unescape(found[1]).split()) if found else ""
    links = []
    for tag in _TAG.finditer(source):
        if not tag[1] and tag[2].lower() in ("a", "area"):
            target = attributes_of(tag[3]).get("href", "").strip()
            if target:
                links.append(target)
    return title, links
