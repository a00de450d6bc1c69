"""Leaf blocks of an HTML page: runs of text between block-level tags, with their ancestors."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q "
    "rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table "
    "ul".split()
)
CLOSES_SAME = {  # a start tag that ends an open element of these kinds, up to the given limits
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}

# Only a quote right after the equals sign opens a quoted value; in others it is a plain character.
_VALUE = r"\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<rest>(?:=\s*(?:" + _VALUE + r")|[^>])*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(" + _VALUE + ")")
_NAMES = re.compile(r"[a-z]+")


@dataclass
class Block:
    """Text of one leaf block, white space runs turned to one space, and where it stands."""

    text: str
    path: tuple[str, ...]  # ancestors, outermost first, each "tag name name ..."
    link_chars: int
    links: int
    label: str | None  # of labelled training pages


@dataclass
class _Open:
    tag: str
    marks: str
    label: str | None
    is_link: bool = False


@dataclass
class _Reader:
    stack: list[_Open] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    link_parts: int = 0
    links: int = 0
    in_link: int = 0

    def text(self, raw: str) -> None:
        if raw:
            self.parts.append(html.unescape(raw) if "&" in raw else raw)
            if self.in_link:
                self.link_parts += len(raw)

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                path = tuple(o.marks for o in self.stack if o.tag not in INLINE)
                label = next((o.label for o in reversed(self.stack) if o.label), None)
                self.blocks.append(Block(text, path, self.link_parts, self.links, label))
            self.parts, self.link_parts = [], 0
        self.links = 0

    def open(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self.flush()
            if tag in CLOSES_P:
                self.close("p", CLOSES_P - {"p"})
            kinds, limits = CLOSES_SAME.get(tag, ((), ()))
            for kind in kinds:
                self.close(kind, limits)
        if tag in VOID:
            if tag == "br":
                self.text(" ")
            return
        marks, label = tag, None
        if attributes and "=" in attributes:
            found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
            names = [found.get(k, "") for k in ("class", "id", "role")]
            marks = " ".join([tag, *_NAMES.findall(" ".join(names).lower())])
            label = found.get("data-label")
        self.stack.append(_Open(tag, marks, label, tag == "a"))
        if tag == "a":
            self.links += 1
            self.in_link += 1

    def close(self, tag: str, limits: frozenset[str] | tuple = frozenset()) -> None:
        """End the innermost open ``tag``, and what is open inside it; nothing if there is none."""
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at].tag == tag:
                if any(o.tag not in INLINE for o in self.stack[at:]):
                    self.flush()
                self.in_link -= sum(o.is_link for o in self.stack[at:])
                del self.stack[at:]
                return
            if self.stack[at].tag in limits:
                return


def leaf_blocks(page: str) -> list[Block]:
    """Blocks with text in page order.

    Scripts, styles, comments, the head's title and markup hold no text. Elements that the page
    leaves open end where HTML ends them, or with the page; a page cut anywhere is read up to
    there.
    """
    reader, at, size = _Reader(), 0, len(page)
    while at < size:
        token = _TOKEN.search(page, at)
        if token is None:
            reader.text(re.sub(r"</?\Z", "", page[at:]))  # the page may be cut inside a tag
            break
        reader.text(page[at : token.start()])
        at = token.end()
        tag = (token["tag"] or "").lower()
        if not tag:
            continue
        if token["end"]:
            if tag == "p" and not any(o.tag == "p" for o in reader.stack):
                reader.flush()
            reader.close(tag)
        elif tag in RAW:
            reader.flush()
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
        else:
            reader.open(tag, token["rest"] or "")
    reader.flush()
    return reader.blocks
