"""Scalar text functions as Column expressions; they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that Python's str methods and \s know.
WS = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
NOT_WS = WS[0] + "^" + WS[1:]

# Chunk texts that say nothing by themselves, words of a signature, and their limit in characters.
LOW_VALUE_TEXTS = ("added", "changed", "fixed", "removed", "nightly only", "documentation", "internal")
SIGNATURE = r"\b(fn|impl|trait|struct|enum|type|const|pub|unsafe)\b"
TINY = 80
MIN_DOCUMENT_CHARS = 30


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(F.regexp_replace(text, f"^{WS}+", ""), rf"{WS}+\z", "")


def collapsed(text: Column) -> Column:
    """Lower case, stripped, every run of white space as one blank."""
    return F.regexp_replace(strip(F.lower(text)), f"{WS}+", " ")


def text_hash(text: Column) -> Column:
    """SHA-256 of the collapsed text."""
    return F.sha2(collapsed(text), 256)


def unix_newlines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def _tidy_lines(text: Column) -> Column:
    """Line feeds only, no blanks before them, at most one empty line in a row."""
    return F.regexp_replace(F.regexp_replace(unix_newlines(text), "[ \t]+\n", "\n"), "\n{3,}", "\n\n")


def _no_blank_before_points(text: Column) -> Column:
    return F.regexp_replace(text, " +([,.;:!?])", "$1")


def normalize_text(text: Column) -> Column:
    """What rendered text goes through."""
    return strip(_no_blank_before_points(_tidy_lines(text)))


def without_section_marks(text: Column) -> Column:
    """Without section signs: those that open a line after at most eight characters, and any before a blank."""

    def line(x: Column) -> Column:
        return F.replace(F.regexp_replace(x, rf"^{NOT_WS}{{0,8}}§{WS}+", ""), F.lit("§ "), F.lit(""))

    return F.when(F.contains(text, F.lit("§")), F.array_join(F.transform(F.split(text, "\n", -1), line), "\n")).otherwise(text)


def clean_text(text: Column, crate: Column) -> Column:
    """The clean form of a text; rule labels on lines of their own go from the reference."""
    text = without_section_marks(_tidy_lines(text))
    text = F.when(crate == "reference", F.regexp_replace(text, rf"(?md)^\[[a-z0-9_.-]+\]{WS}*$\n?", "")).otherwise(text)
    text = F.regexp_replace(text, rf"\b([A-Za-z0-9]+)_{WS}+([A-Za-z0-9]+)\b", "$1_$2")
    text = F.regexp_replace(text, rf"`([^`\n]+)`{WS}+s\b", "`$1`s")
    return strip(_no_blank_before_points(text))


def clean_code(text: Column) -> Column:
    """Code keeps its form but for line ends, section signs and outer line feeds."""
    text = without_section_marks(unix_newlines(text))
    return F.regexp_replace(F.regexp_replace(text, "^\n+", ""), r"\n+\z", "")


def render_block(block: Column) -> Column:
    """The text of one block as it stands in a document; null for an unknown type."""
    kind, text = block["block_type"], block["text"]
    return (
        F.when(kind.isin("heading", "paragraph"), text)
        .when(kind == "list_item", F.concat(F.repeat(F.lit("  "), F.coalesce(block["list_depth"], F.lit(0))), F.lit("- "), text))
        .when(kind == "code_block", F.concat(F.lit("```"), F.when(block["code_language"] != "", block["code_language"]).otherwise(F.lit("text")), F.lit("\n"), text, F.lit("\n```")))
        .when(kind == "definition_term", F.concat(F.lit("- "), text))
        .when(kind == "definition_desc", F.concat(F.lit("  - "), text))
    )


def render_blocks(blocks: Column) -> Column:
    """Blocks joined by blank lines, then normalised. Null or no blocks give an empty text."""
    return F.coalesce(normalize_text(F.array_join(F.transform(blocks, render_block), "\n\n")), F.lit(""))


def clean_blocks(blocks: Column, crate: Column) -> Column:
    """Every block's text cleaned by its type; blocks that become empty go. Null gives no blocks."""

    def one(b: Column) -> Column:
        text = F.coalesce(b["text"], F.lit(""))
        return b.withField("text", F.when(b["block_type"] == "code_block", clean_code(text)).otherwise(clean_text(text, crate)))

    return F.coalesce(F.filter(F.transform(blocks, one), lambda b: b["text"] != ""), F.filter(blocks, lambda b: F.lit(False)), F.array())


def is_low_value(text: Column) -> Column:
    """A tiny chunk that says nothing: one of the stop texts, without code."""
    return (F.length(text) < TINY) & collapsed(text).isin(*LOW_VALUE_TEXTS) & ~F.contains(text, F.lit("```")) & ~strip(text).rlike(SIGNATURE)


def is_changelog_stub(text: Column, crate: Column, source_path: Column, section_path: Column, min_chars: int = 180) -> Column:
    """A short second-level entry of cargo's changelog with at most two lines that aren't blank."""
    lines = F.filter(F.split(text, "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]", -1), lambda x: strip(x) != "")
    return F.coalesce((crate == "cargo") & (source_path == "cargo/CHANGELOG.html") & (F.size(section_path) == 2) & (F.length(text) < min_chars) & (F.size(lines) <= 2), F.lit(False))


def is_heading_only(text: Column, section_path: Column) -> Column:
    """A chunk that is only the title of its section."""
    return F.coalesce((strip(text) != "") & ~F.contains(text, F.lit("```")) & (strip(text) == strip(F.try_element_at(section_path, F.lit(-1)))), F.lit(False))


def token_count(text: Column) -> Column:
    """Words and single marks: the default size of a text where no tokenizer is given."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([A-Za-z0-9_]+|[^\sA-Za-z0-9_])"), F.lit(0)))
