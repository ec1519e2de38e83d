import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.operators import chunk_kernel as ck
from docloom.operators.chunk_kernel import Block, ChunkingError, Piece, chunk, cut_lines, cut_text, render
from docloom.operators.chunking import chunk_documents, clean_documents, split_message
from docloom.schemas import DOCUMENT


def doc(*blocks):
    return render(list(blocks)), list(blocks)


def H(text, *path, anchor=None):
    return Block("heading", text, anchor=anchor, path=path or (text,))


def P(text, *path):
    return Block("paragraph", text, path=path)


def test_one_chunk_for_each_section():
    text, blocks = doc(H("Vec", anchor="vec"), P("A" * 200 + ".", "Vec"), H("Use", "Vec", "Use"), P("B" * 200 + ".", "Vec", "Use"))
    got = chunk(text, "Vec", "std", "std/a.html", blocks)
    assert [(p.path, p.anchor) for p in got] == [(("Vec",), "vec"), (("Vec", "Use"), None)]
    assert text[got[0].start : got[0].end].startswith("Vec\n\nA") and text[got[1].start : got[1].end].startswith("Use\n\nB")


def test_large_paragraphs_and_cap():
    text, blocks = doc(H("T"), *[P(f"Sentence {k} is here. " * 12, "T") for k in range(20)])
    got = chunk(text, "T", "book", "book/a.html", blocks)
    assert len(got) > 2 and all(p.end - p.start <= 1500 for p in got) and all(text[p.start : p.end].strip() for p in got)
    assert "".join(text[p.start : p.end] for p in got).replace("\n", "").replace(" ", "") == text.replace("\n", "").replace(" ", "")


def test_code_is_cut_on_lines_with_its_heading():
    code = Block("code_block", "\n".join(f"let x{k} = {k};" for k in range(60)), language="rust", path=("T",))
    text, blocks = doc(Block("heading", "T", path=("T",)), code)
    got = chunk(text, "T", "std", "std/a.html", blocks, max_chars=180)
    assert text[got[0].start :].startswith("T\n\n```rust") and all(p.end - p.start <= 180 for p in got)
    assert all(text[p.end - 1] == "\n" or p is got[-1] for p in got)


def test_offsets_skip_the_indent_of_nested_items():
    text, blocks = doc(P("Intro " * 40, "T"), Block("list_item", "nested item " * 30, depth=1, path=("T",)))
    got = chunk(text, "T", "std", "s", blocks, max_chars=400)
    assert got[-1].end == len(text) and text[got[-1].start : got[-1].end].startswith("- nested")


def test_small_siblings_merge_under_their_parent():
    text, blocks = doc(H("A", "T", "S", "A"), P("short a", "T", "S", "A"), H("B", "T", "S", "B"), P("short b", "T", "S", "B"))
    assert [p.path for p in chunk(text, "T", "reference", "r", blocks)] == [("T", "S")]
    assert [p.path for p in chunk(text, "T", "std", "r", blocks)] == [("T", "S", "A"), ("T", "S", "B")]


def test_changelog_stub_and_low_value_go():
    text, blocks = doc(H("One", "Log", "One"), P("stub", "Log", "One"), H("Two", "Log", "Two"), P("Long entry. " * 30, "Log", "Two"))
    # the stub is short and not under the next section's path, so it stays a piece of its own and is dropped
    assert [p.path for p in chunk(text, "Log", "cargo", "cargo/CHANGELOG.html", blocks)] == [("Log", "Two")]
    own = "Added"
    assert ck.drop_empty_words(own, [Piece(0, 5, ("x",), None)], "std", "s", 180) == [Piece(0, 5, ("x",), None)]  # all would go: none goes


def test_lone_heading_goes_beside_its_section():
    text = "Intro" + "x" * 300
    pieces = [Piece(0, 5, ("T", "Intro"), None), Piece(5, len(text), ("T", "Intro"), None)]
    assert ck.drop_empty_words(text, pieces, "std", "s", 180) == pieces[1:]
    other = [pieces[0], Piece(5, len(text), ("T", "Else"), None)]
    assert ck.drop_empty_words(text, other, "std", "s", 180) == other


def test_tiny_tail_joins():
    text = ("Some words stand in here. " * 8).strip()
    cuts = cut_text(text, 170)
    assert len(cuts) == 2 and cuts[1] == len(text) and len(text[cuts[0] :].strip()) >= 80


def test_what_can_not_be_cut():
    with pytest.raises(ChunkingError):
        cut_text("x" * 240, 120)
    with pytest.raises(ChunkingError):
        cut_lines("y" * 220, 120)
    with pytest.raises(ChunkingError):
        ck.cap("```\n" + "a b\n" * 100 + "```", [Piece(0, 408, ("T",), None)], "T", 120)


def test_without_blocks_the_whole_text_is_one_chunk():
    assert chunk("x" * 9000, "T", "std", "s", []) == [Piece(0, 9000, ("T",), None)]
    text, blocks = doc(H("Only"), H("Headings"))
    assert chunk(text, "T", "std", "s", blocks) == [Piece(0, len(text), ("T",), None)]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from(["std", "book", "cargo", "reference", "rustc"]), st.integers(150, 700))
def test_pieces_are_ordered_slices_within_the_cap(seed, crate, limit):
    rng = random.Random(seed)
    blocks, path = [], ["T"]
    for _ in range(rng.randint(1, 14)):
        kind = rng.choice(("heading", "paragraph", "list_item", "code_block", "definition_term"))
        if kind == "heading":
            path = path[: rng.randint(1, len(path))] + [f"H{rng.randint(0, 9)}"]
        words = " ".join(rng.choices(("alpha", "beta.", "gamma", "`x`"), k=rng.randint(1, 3 if kind == "heading" else 120)))
        blocks.append(Block(kind, words.replace(" ", "\n") if kind == "code_block" else words, depth=rng.randint(0, 2), path=tuple(path)))
    text = render(blocks)
    try:
        got = chunk(text, "T", crate, "s", blocks, max_chars=limit)
    except ChunkingError:
        return
    if len(got) > 1 or got[0].end - got[0].start < len(text):
        assert all(p.end - p.start <= limit for p in got)
    assert all(a.end <= b.start for a, b in zip(got, got[1:])) and all(text[p.start : p.end].strip() and p.path for p in got)


def test_split_message():
    text = "word " * 2000
    parts = split_message(text, 400)
    assert all(len(p) <= 400 for p in parts) and " ".join(parts) == text.strip()
    assert split_message("x" * 900, 400) == ["x" * 400, "x" * 400, "x" * 100] and len(split_message("  ")) == 1


def row(path, text, blocks=(), crate="std", title="T"):
    full = [(k, t, None, None, None, None, None, ["T"]) for k, t in blocks]
    return (path, title, text, crate, "u", None, None, None, full)


def test_frames_with_nulls_empty_and_errors(spark):
    rows = [row("a", "ignored text", [("paragraph", "Clean , this  text that is long enough."), ("paragraph", " ")]), row("b", "A text without blocks that is long enough"), row("c", None), row("d", "tiny"), row("e", None, [("code_block", "q" * 2000)]), (None,) * 9]
    df = spark.createDataFrame(rows, DOCUMENT)
    clean = clean_documents(df)
    assert {r.source_path: r.text for r in clean.collect()} == {"a": "Clean, this  text that is long enough.", "b": rows[1][2], "e": "```text\n" + "q" * 2000 + "\n```"}
    got = {r.source_path: r for r in chunk_documents(clean, strict=False).collect()}
    assert got["e"].error and got["e"].text is None and got["a"].text == "Clean, this  text that is long enough." and list(got["b"].section_path) == ["T"]
    with pytest.raises(Exception, match="longer than"):
        chunk_documents(clean).collect()
    assert chunk_documents(clean_documents(spark.createDataFrame([], DOCUMENT))).count() == 0
