"""Predicates that decide which raw files are documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
DEFAULT_CRATES = ("std", "book", "cargo", "reference")
EXCLUDED_DIRS = ("theme", "css", "fonts", "FontAwesome", "images", "img", ".git", ".venv", "__pycache__", "first-edition", "second-edition", "2018-edition")
EXCLUDED_NAMES = (
    "*.js", "*.css", "*.png", "*.jpg", "*.jpeg", "*.svg", "*.gif", "*.ico", "*.woff", "*.woff2", "*.ttf", "*.eot", "*.json", "*.txt", "*.md",
    ".nojekyll", "search-index*.js", "searchindex*.js", "sidebar-items*.js", "print.html", "toc.html",
)
BOOK_FILES = ("README.html", "SUMMARY.html", "title-page.html")
STD_FILES = ("all.html",)
CARGO_FILES = ("CHANGELOG.html",)
REDIRECT_MARKS = ("<title>redirection</title>", "<title>redirecting...</title>", "redirecting to...", "window.location.replace(")
LEGACY_MARK = "there is a new edition of the book and this is an old link."


def glob_regex(pattern: str) -> str:
    """A whole-string regex for a glob whose stars cross slashes."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() else c for c in pattern) + r"\z"


def is_redirect(html: Column) -> Column:
    """A page that only leads elsewhere, told by its first 2,048 characters. Unreadable content is no redirect."""
    head = F.lower(F.substring(html, 1, 2048))
    marked = F.contains(head, F.lit(REDIRECT_MARKS[0]))
    for mark in REDIRECT_MARKS[1:]:
        marked = marked | F.contains(head, F.lit(mark))
    return F.coalesce(F.contains(head, F.lit('http-equiv="refresh"')) & F.contains(head, F.lit("url=")) & marked, F.lit(False))


def is_legacy(html: Column) -> Column:
    """A page that says so in its first 4,096 characters."""
    return F.coalesce(F.contains(F.lower(F.substring(html, 1, 4096)), F.lit(LEGACY_MARK)), F.lit(False))


def path_selected(source_path: Column, crate: Column) -> Column:
    """What the path alone decides."""
    name = F.substring_index(source_path, "/", -1)
    globs = "|".join(f"({glob_regex(p)})" for p in EXCLUDED_NAMES)
    return (
        ~F.exists(F.split(source_path, "/"), lambda p: p.isin(*EXCLUDED_DIRS))
        & ~(name.rlike(globs) | source_path.rlike(globs))
        & ~((crate == "book") & name.isin(*BOOK_FILES))
        & ~((crate == "cargo") & name.isin(*CARGO_FILES))
        & ~((crate == "std") & name.isin(*STD_FILES))
        & ~((crate == "reference") & F.endswith(name, F.lit("-redirect.html")))
    )


def selected(source_path: Column, crate: Column, html: Column, meaningful: Column) -> Column:
    """The whole decision; ``meaningful`` says whether the page has content beside headings."""
    return path_selected(source_path, crate) & ~is_redirect(html) & ~((crate == "book") & is_legacy(html)) & ((crate == "std") | meaningful)
