"""Schemas of the tables that the engine reads and writes, as DDL."""

BLOCK = "struct<block_type: string, text: string, html_tag: string, heading_level: int, list_depth: int, code_language: string, anchor: string, section_path: array<string>>"
DOCUMENT = f"source_path string, title string, text string, crate string, url string, item_path string, item_type string, rust_version string, blocks array<{BLOCK}>"
CHUNK = (
    "source_path string, chunk_index int, text string, start_offset int, end_offset int, section_path array<string>, section_anchor string"
)
EVAL_CASE = "id string, question string, expected array<map<string, string>>"
PARSE_FAILURE = "struct<reason: string, message: string>"
