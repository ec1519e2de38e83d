"""A small HTML tree on the standard library's tokenizer, with the selectors and text rules that page parsing needs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

# Elements without an end tag, and which open elements a start tag closes.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
CLOSES_P = frozenset(
    ("address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul")
)
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
BLOCK_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "pre", "dt", "dd")
NOISE = ("script", "style", "noscript", "nav", "aside", "header", "footer", ".sidebar", "#sidebar", ".mobile-topbar", ".search-form", ".theme-picker", ".nav-wide-wrapper", ".out-of-band", "button")
LANGUAGES = {"shell": "console", "bash": "console", "sh": "console", "zsh": "console"}
SKIPPED_TEXTS = ("Show Railroad",)

_SPACE = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: Node | None = None
    children: list[Node | str] = field(default_factory=list)

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self) -> Iterator[Node]:
        """Descendants in document order, without recursion."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def strings(self, skip: frozenset[str] = frozenset(), marks: bool = False) -> Iterator[str]:
        """Text pieces in order, without what is under a tag of ``skip``; with ``marks`` an outermost code element is one piece between backticks."""
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                yield item
            elif item.tag in skip:
                continue
            elif marks and item.tag == "code":
                if text := joined(item.strings(skip)):
                    yield f"`{text}`"
            else:
                stack += reversed(item.children)

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None


def joined(pieces: Iterator[str]) -> str:
    """Stripped pieces with one blank between."""
    return _SPACE.sub(" ", " ".join(p for x in pieces if (p := x.strip()))).strip()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.at = self.root

    def _close(self, tags: tuple[str, ...], scope: tuple[str, ...]) -> None:
        node = self.at
        while node.parent is not None and node.tag not in scope:
            if node.tag in tags:
                self.at = node.parent
                return
            node = node.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES_P:
            self._close(("p",), ("li", "dd", "td", "th", "blockquote", "div", "section", "article", "main", "body"))
        if tag in CLOSES:
            self._close(CLOSES[tag], SCOPES[tag])
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self.at = self.at.parent or self.root

    def handle_endtag(self, tag: str) -> None:
        node: Node | None = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    """The tree of a page; a page of any form gives one."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


_SIMPLE = re.compile(r"(?P<tag>[a-zA-Z][\w-]*)?(?P<rest>(?:[.#][\w-]+|\[[\w-]+(?:=[^\]]*)?\])*)")
_PART = re.compile(r"\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:=([^\]]*))?\]")


def _matches(node: Node, simple: str) -> bool:
    m = _SIMPLE.fullmatch(simple)
    if m is None or (m["tag"] and node.tag != m["tag"].lower()):
        return False
    for cls, ident, attr, value in _PART.findall(m["rest"]):
        if (cls and cls not in node.classes) or (ident and node.attrs.get("id") != ident):
            return False
        if attr and (attr not in node.attrs or (value and node.attrs[attr] != value.strip("\"'"))):
            return False
    return True


def select(root: Node, selector: str) -> list[Node]:
    """Descendants that match a comma list of selectors of tags, classes, ids, attributes and descent."""
    chains = [s.split() for s in selector.split(",")]

    def hit(node: Node, chain: list[str]) -> bool:
        if not _matches(node, chain[-1]):
            return False
        rest = chain[:-1]
        for up in node.ancestors():
            if rest and _matches(up, rest[-1]):
                rest = rest[:-1]
        return not rest

    return [n for n in root.walk() if any(hit(n, c) for c in chains if c)]


def first(root: Node, selector: str) -> Node | None:
    return next(iter(select(root, selector)), None)


def remove_all(root: Node, selectors: tuple[str, ...]) -> None:
    for node in select(root, ",".join(selectors)):
        node.remove()


def inline_text(node: Node, skip: frozenset[str] = frozenset()) -> str:
    """One line of text, code between backticks."""
    if node.tag == "code":
        text = joined(node.strings(skip))
        return f"`{text}`" if text else ""
    return joined(node.strings(skip, marks=True))


def heading_text(node: Node) -> str:
    text = re.sub(r"^[§ｧ]+\s*", "", inline_text(node))
    return re.sub(r"\s*[§ｧ]+$", "", text).strip()


def code_language(pre: Node) -> str:
    """From the classes of the code element, then of the block."""
    code = first(pre, "code")
    for name in [*(code.classes if code else []), *pre.classes]:
        if name.lower() == "rust":
            return "rust"
        if name.startswith("language-"):
            language = name.removeprefix("language-").lower()
            return LANGUAGES.get(language, language)
    return "text"


def anchor_of(node: Node) -> str | None:
    """The id of the node or of the nearest element around it."""
    return next((n.attrs["id"] for n in (node, *node.ancestors()) if n.attrs.get("id")), None)


def blocks_of(root: Node) -> list[dict]:
    """Typed blocks in document order, each with the titles of the headings that it stands under."""
    out: list[dict] = []
    open_: list[tuple[int, str, str | None]] = []

    def add(kind: str, text: str, node: Node, anchor: str | None, **more) -> None:
        blank = {"heading_level": None, "list_depth": None, "code_language": None}
        out.append({"block_type": kind, "text": text, "html_tag": node.tag, **blank, **more, "anchor": anchor, "section_path": [t for _, t, _ in open_]})

    for node in root.walk():
        if node.tag not in BLOCK_TAGS or any(a.tag == "pre" for a in node.ancestors()):
            continue
        near = anchor_of(node)
        here = near or next((a for _, _, a in reversed(open_) if a), None)
        above = node.parent.tag if node.parent else ""
        match node.tag:
            case "p":
                if above != "li" and (text := inline_text(node)) and text not in SKIPPED_TEXTS:
                    add("paragraph", text, node, here)
            case "li":
                if (text := inline_text(node, frozenset(("ul", "ol")))) and text not in SKIPPED_TEXTS:
                    add("list_item", text, node, here, list_depth=max(sum(a.tag in ("ul", "ol") for a in node.ancestors()) - 1, 0))
            case "pre":
                if text := "".join(node.strings()).strip("\n"):
                    add("code_block", text, node, here, code_language=code_language(node))
            case "dt" | "dd":
                if above == "dl" and (text := inline_text(node)):
                    add("definition_term" if node.tag == "dt" else "definition_desc", text, node, near)
            case _:
                if text := heading_text(node):
                    level = int(node.tag[1])
                    while open_ and open_[-1][0] >= level:
                        open_.pop()
                    open_.append((level, text, near))
                    add("heading", text, node, near, heading_level=level)
    return out
