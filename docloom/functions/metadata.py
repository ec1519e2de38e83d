"""Derivation of a document's metadata from its path, title, text and page facts."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
DETECTED_CRATES = ("book", "cargo", "reference", "std")
RUSTDOC_CRATES = ("std", "core", "alloc", "proc_macro", "test")
PAGE_CRATES = ("book", "cargo", "reference")
BASE_URLS = {
    "book": "https://doc.rust-lang.org/book/",
    "reference": "https://doc.rust-lang.org/reference/",
    "cargo": "https://doc.rust-lang.org/cargo/",
    "std": "https://doc.rust-lang.org/std/",
    "core": "https://doc.rust-lang.org/core/",
    "alloc": "https://doc.rust-lang.org/alloc/",
    "proc_macro": "https://doc.rust-lang.org/proc_macro/",
    "test": "https://doc.rust-lang.org/test/",
}
FILE_PREFIX_TYPES = {"fn.": "fn", "struct.": "struct", "trait.": "trait", "macro.": "macro", "enum.": "enum", "constant.": "constant", "type.": "type", "mod.": "module"}
BODY_CLASS_TYPES = {
    "mod": "module", "struct": "struct", "trait": "trait", "macro": "macro", "enum": "enum", "constant": "constant", "type": "type",
    "function": "fn", "fn": "fn", "method": "method", "impl": "impl",
}
TEXT_TYPES = {
    "fn": r"\b(fn|function)\b",
    "struct": r"\bstruct\b",
    "trait": r"\btrait\b",
    "method": r"\bmethod\b",
    "impl": r"\b(impl|implementation)\b",
    "module": r"\b(mod|module)\b",
    "macro": r"\bmacro\b",
    "enum": r"\benum\b",
    "constant": r"\b(const|constant)\b",
    "type": r"\btype\b",
}
SAMPLE_CHARS = 700


def relative_path(path: Column, root: str) -> Column:
    """The path under ``root`` with forward slashes; a path elsewhere stays as it is."""
    base = root.replace("\\", "/").rstrip("/") + "/"
    path = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^file:/+", "/")
    return F.when(F.startswith(path, F.lit(base)), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path)


def detect_crate(relative: Column) -> Column:
    """The first folder if it is a known crate, else unknown."""
    first = F.lower(F.substring_index(relative, "/", 1))
    return F.when(first.isin(*DETECTED_CRATES), first).otherwise(F.lit("unknown"))


def document_url(source_path: Column, crate: Column, base_urls: Mapping[str, str] = BASE_URLS) -> Column:
    """The base address of the crate and the path after its first folder; null without a folder or an address."""
    path = F.replace(source_path, F.lit("\\"), F.lit("/"))
    base = reduce(lambda c, kv: c.when(crate == kv[0], F.lit(kv[1])), list(base_urls.items())[1:], F.when(crate == next(iter(base_urls)), F.lit(next(iter(base_urls.values())))))
    return F.when(F.contains(path, F.lit("/")), F.concat(base, F.regexp_replace(path, "^[^/]*/", "")))


def stem(file_name: Column) -> Column:
    """A file name without its last suffix."""
    return F.regexp_replace(file_name, r"(?<=.)\.[^.]*$", "")


def item_path(source_path: Column, crate: Column, title: Column, breadcrumbs: Column) -> Column:
    """The title in API crates, else the breadcrumbs, else the path's parts without ``index``."""
    parts = F.split(F.regexp_replace(source_path, "^[^/]*/", ""), "/")
    last = F.size(parts)
    named = F.filter(F.concat(F.slice(parts, F.lit(1), last - 1), F.array(stem(F.element_at(parts, -1)))), lambda p: ~p.isin("index", "."))
    by_path = F.when(F.size(named) == 0, crate).otherwise(F.concat(crate, F.lit("::"), F.array_join(named, "::")))
    return (
        F.when(crate.isin(*RUSTDOC_CRATES), F.when(title != "", title))
        .when(F.size(breadcrumbs) > 0, F.array_join(breadcrumbs, "::"))
        .when(F.startswith(source_path, F.concat(crate, F.lit("/"))), by_path)
    )


def item_type(source_path: Column, crate: Column, title: Column, text: Column, body_classes: Column) -> Column:
    """The first rule that speaks decides: file prefix, index, body class, title forms, words of the title, words of the text's beginning."""
    name = F.substring_index(source_path, "/", -1)
    low = F.lower(F.coalesce(title, F.lit("")))
    sample = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, SAMPLE_CHARS))
    classes = F.transform(F.coalesce(body_classes, F.array().cast("array<string>")), lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in BODY_CLASS_TYPES.items() for x in kv]), c))
    rules = [F.when(F.startswith(stem(name), F.lit(p)), F.lit(t)) for p, t in FILE_PREFIX_TYPES.items()]
    rules += [
        F.when(name == "index.html", F.lit("module")),
        F.try_element_at(F.filter(classes, lambda c: c.isNotNull()), F.lit(1)),
        F.when(low == "std", F.lit("module")),
        F.when(F.endswith(F.substring_index(title, "::", -1), F.lit("!")), F.lit("macro")),
        F.when(F.contains(low, F.lit("::keyword::")), F.lit("keyword")),
        F.when(F.contains(low, F.lit("::primitive::")), F.lit("primitive")),
    ]
    rules += [F.when(low.rlike(p), F.lit(t)) for t, p in TEXT_TYPES.items()]
    rules += [F.when(sample.rlike(p), F.lit(t)) for t, p in TEXT_TYPES.items()]
    return F.when(crate.isin(*PAGE_CRATES), F.lit("page")).when(crate == "std", F.coalesce(*rules, F.lit("unknown")))


def section_title(section_path: Column) -> Column:
    """The last of the path, null without one."""
    return F.try_element_at(section_path, F.lit(-1))
