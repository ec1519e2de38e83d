"""Parsing of raw pages into documents, by the layout of their crate."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import metadata
from docloom.functions.text import render_blocks
from docloom.operators.html_kernel import NOISE, Node, blocks_of, first, joined, parse, remove_all, select
from docloom.runtime import materialize
from docloom.schemas import BLOCK

# Where the content of a page stands and what else is noise, by layout.
MAIN = {
    "book": ("main", "div#content", "section.normal"),
    "cargo": ("main", "div#content"),
    "reference": ("main", "main.content", "div#content"),
    "rustdoc": ("main.content", "main", "div#content"),
}
EXTRA_NOISE = {
    "book": (".chapter .nav", ".nav-chapters", ".menu-bar", ".menu-title"),
    "cargo": (".sidebar", ".pagetoc"),
    "reference": ("div.rule", ".rule-link", "wbr", ".toctitle", ".menu-title"),
    "rustdoc": (".item-info", ".stab", ".portability"),
}
CHECK_MAIN = ("main", "section.normal", "article", "div#content", "body")
CHECK_NOISE = ("script", "style", "noscript", "nav", "aside", "header", "footer", ".sidebar", "#sidebar", "button")
CONTENT_TAGS = ("p", "li", "pre", "table", "blockquote", "dl")


def layout_of(crate: str) -> str:
    return crate if crate in ("book", "cargo", "reference") else "rustdoc"


def has_content(html: str) -> bool:
    """Whether a page has more than headings, noise apart."""
    return tree_has_content(parse(html))


def tree_has_content(root: Node) -> bool:
    """The same of a parsed page, which stays as it is."""
    main = next((n for s in CHECK_MAIN if (n := first(root, s))), None)
    if main is None:
        return False
    noise = {id(n) for s in CHECK_NOISE for n in select(main, s)}
    waiting = [main]
    while waiting:
        node = waiting.pop()
        if node.tag in CONTENT_TAGS:
            return True
        waiting += [c for c in node.children if isinstance(c, Node) and id(c) not in noise]
    return False


def _file_title(path: PurePosixPath) -> str | None:
    """What special pages of the standard library are called by their file."""
    if "std" not in path.parts:
        return None
    rest = path.parts[path.parts.index("std") + 1 :]
    if rest in ((), ("index.html",)):
        return "std"
    kind, _, name = path.stem.partition(".")
    return {"primitive": f"std::primitive::{name}", "keyword": f"std::keyword::{name}", "macro": f"std::{name}!"}.get(kind) if name else None


def _api_title(root: Node, path: PurePosixPath) -> str | None:
    crumbs = [t for n in select(root, ".rustdoc-breadcrumbs a") if (t := joined(n.strings()))]
    if own := _file_title(path):
        return "::".join([*crumbs, own]) if crumbs and not own.startswith(f"{crumbs[0]}::") else own
    name = None
    if h1 := first(root, "main h1"):
        span = first(h1, "span")
        name = "".join(s.strip() for s in span.strings()) if span else ""
        if not name:
            name = next((s.strip() for s in reversed(h1.children) if isinstance(s, str) and s.strip()), None)
    return "::".join([*crumbs, *([name] if name else [])]) or None


def title_of(root: Node, source_path: str, crate: str) -> str:
    path, layout = PurePosixPath(source_path), layout_of(crate)
    if layout == "rustdoc" and (name := _api_title(root, path)):
        return name
    if tag := first(root, "title"):
        text = joined(tag.strings())
        if layout != "rustdoc":
            return text
        if text := text.removesuffix(" - Rust").strip():
            return text
    elif layout != "rustdoc" and (h1 := first(root, "main h1" if layout == "reference" else "main h1, h1")):
        return joined(h1.strings())
    return path.stem


def breadcrumbs_of(root: Node) -> list[str]:
    found = select(root, "nav.sub a") or select(root, ".breadcrumbs a")
    return [t for n in found if (t := joined(n.strings()))]


def version_facts(root: Node, source_path: str) -> str | None:
    """The version that a crate's key page states: null on every other page."""
    match source_path:
        case "book/index.html":
            m = re.search(r"Rust (\d+\.\d+\.\d+)", joined(root.strings()))
            return m[1] if m else None
        case "std/index.html":
            meta = first(root, "meta[name=rustdoc-vars]")
            if meta and meta.attrs.get("data-channel"):
                return meta.attrs["data-channel"]
            side = first(root, ".sidebar-crate .version")
            return joined(side.strings()) or None if side else None
        case "cargo/CHANGELOG.html":
            h2 = first(root, "main h2")
            m = re.search(r"Cargo (\d+\.\d+)", joined(h2.strings())) if h2 else None
            return m[1] if m else None
    return None


@dataclass
class Parsed:
    title: str | None = None
    blocks: list[dict] | None = None
    breadcrumbs: list[str] | None = None
    body_classes: list[str] | None = None
    version: str | None = None
    reason: str | None = None
    message: str | None = None
    meaningful: bool = True


def parse_page(html: str | None, source_path: str, crate: str) -> Parsed:
    """One page, parsed once; ``meaningful`` says whether it has content beside headings, and is True where it can't be told. Whatever goes wrong becomes a reason: read_error, missing_title, missing_main_content, empty_text, unsupported_source or unexpected_error."""
    if html is None:
        return Parsed(reason="read_error", message="no content")
    meaningful = True
    try:
        root, layout = parse(html), layout_of(crate)
        meaningful = tree_has_content(root)
        facts = Parsed(title_of(root, source_path, crate), meaningful=meaningful, breadcrumbs=breadcrumbs_of(root), version=version_facts(root, source_path))
        body = first(root, "body")
        facts.body_classes = body.classes if body else []
        if not facts.title:
            return Parsed(reason="missing_title", message="no title", meaningful=meaningful)
        main = next((n for s in MAIN[layout] if (n := first(root, s))), body)
        if main is None:
            return Parsed(facts.title, reason="missing_main_content", message="no main content", meaningful=meaningful)
        remove_all(main, (*NOISE, *EXTRA_NOISE[layout]))
        facts.blocks = blocks_of(main)
        if not facts.blocks:
            return Parsed(facts.title, reason="empty_text", message="no blocks", meaningful=meaningful)
        if crate not in metadata.BASE_URLS or "/" not in source_path:
            return Parsed(facts.title, reason="unsupported_source", message=f"no address for crate {crate}", meaningful=meaningful)
        return facts
    except Exception as e:  # a page never ends the job
        return Parsed(reason="unexpected_error", message=f"{type(e).__name__}: {e}", meaningful=meaningful)


def with_content_check(pages: DataFrame, html: str = "html", out: str = "meaningful") -> DataFrame:
    """Adds whether a page has content beside headings; unreadable pages count as having it. Pages come in batches."""

    @F.pandas_udf("boolean")
    def check(column: pd.Series) -> pd.Series:
        return column.map(lambda h: True if h is None else has_content(h))

    return pages.withColumn(out, check(F.col(html)))


_FACTS = ("title", "blocks", "breadcrumbs", "body_classes", "version", "reason", "message", "meaningful")


def parse_facts(pages: DataFrame) -> DataFrame:
    """(source_path, crate) and what one pass over each page (source_path, crate, html) tells: title, blocks, breadcrumbs, body_classes, version, reason, message, meaningful. No shuffle; other columns are ignored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p.source_path, p.crate, *(getattr(x, n) for n in _FACTS)) for p in batch.itertuples() for x in [parse_page(p.html, p.source_path or "", p.crate or "unknown")]]
            yield pd.DataFrame(rows, columns=["source_path", "crate", *_FACTS])

    schema = f"source_path string, crate string, title string, blocks array<{BLOCK}>, breadcrumbs array<string>, body_classes array<string>, version string, reason string, message string, meaningful boolean"
    return pages.select("source_path", "crate", "html").mapInPandas(run, schema)


def failures_of(facts: DataFrame) -> DataFrame:
    """(source_path, crate, reason, message) of the pages that gave no document."""
    return facts.filter("reason IS NOT NULL").select("source_path", "crate", "reason", "message")


def versions_of(facts: DataFrame) -> DataFrame:
    """(crate, rust_version): one row for each crate whose key page states a version."""
    return facts.filter("version IS NOT NULL").groupBy("crate").agg(F.min("version").alias("rust_version"))


def documents_of(facts: DataFrame, versions: DataFrame) -> DataFrame:
    """Documents (source_path, crate, title, text, url, item_path, item_type, rust_version, blocks) of parsed pages; ``versions`` has one row a crate."""
    c = F.col
    good = facts.filter("reason IS NULL").withColumn("text", render_blocks(F.col("blocks")))
    return good.join(versions, "crate", "left").select(
        "source_path", "crate", "title", "text", metadata.document_url(c("source_path"), c("crate")).alias("url"),
        metadata.item_path(c("source_path"), c("crate"), c("title"), c("breadcrumbs")).alias("item_path"),
        metadata.item_type(c("source_path"), c("crate"), c("title"), c("text"), c("body_classes")).alias("item_type"), "rust_version", "blocks",
    )


def parse_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, failures) of pages (source_path, crate, html), parsed once: the facts are written to the shared folder, as versions, documents and failures all read them. Versions come from key pages among ``pages``."""
    facts = materialize(parse_facts(pages), "parsed")
    return documents_of(facts, versions_of(facts)), failures_of(facts)
