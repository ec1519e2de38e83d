import random

import pytest

from docloom.llm import split
from docloom.llm.split import Limits

SCHEMA = "kind string, item long, start_offset int, text string, piece_no string, base string"


def prose(n, seed=0):
    rng, out = random.Random(seed), []
    while sum(map(len, out)) < n:
        out.append(" ".join("wordé"[: rng.randint(1, 5)] for _ in range(rng.randint(3, 20))) + rng.choice([". ", ".\n", "\n\n", "! "]))
    return "".join(out)[:n]


def check(text, pieces, limits, base=0):
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (a, b, own), nxt in zip(pieces, [*pieces[1:], None]):
        assert text[a:b] == own and 0 < b - a <= limits.size
        if nxt:
            assert b - limits.overlap <= nxt[0] < b and nxt[1] > b


def run(spark, rows, limits=Limits()):
    out = {}
    for r in split.split_texts(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA), limits).orderBy("kind", "item", "piece_no").collect():
        out.setdefault((r.kind, r.item), []).append(r)
    return out


def test_pieces_cover_and_overlap(spark):
    rows = [("d", k, 7 * k, prose(1401 + 977 * k, k)) for k in range(12)] + [("d", 50, None, prose(3000)), ("d", 51, 0, "a" * 5000), ("d", 52, 0, "x " * 1000)]
    got = run(spark, [*rows, rows[0], ("d", 60, 0, None), ("d", 61, 0, ""), ("d", 62, 0, "z" * 1400), (None, 1, 0, "q" * 2000), ("d", None, 0, "q" * 2000)])
    assert set(got) == {(r[0], r[1]) for r in rows}
    for kind, item, base, text in rows:
        mine = got[kind, item]
        check(text, [(r.piece_start, r.piece_end, r.text) for r in mine], Limits())
        assert [r.piece_no for r in mine] == list(range(len(mine)))
        assert all(r.start_offset == (None if base is None else base + r.piece_start) and r.end_offset == (None if base is None else base + r.piece_end) for r in mine)


def test_cuts_at_boundaries(spark):
    text = prose(20_000, 5)
    pieces = [(r.piece_start, r.piece_end) for r in run(spark, [("d", 1, 0, text)])["d", 1]]
    assert all(text[b - 1].isspace() for _, b in pieces[:-1]) and all(text[a - 1].isspace() for a, _ in pieces[1:])
    hard = [(r.piece_start, r.piece_end) for r in run(spark, [("d", 1, 0, "a" * 5000)])["d", 1]]
    assert hard[0] == (0, 1400) and hard[1][0] == 1250


def test_giant_text_in_ranges(spark):
    limits = Limits(size=200, overlap=30, span=1000)
    for text in (prose(25_431, 9), "b" * 7_777, prose(1201, 3), "é" * 3000):
        mine = run(spark, [("d", 1, 0, text)], limits)["d", 1]
        check(text, [(r.piece_start, r.piece_end, r.text) for r in mine], limits)
        assert [r.piece_no for r in mine] == list(range(len(mine)))


@pytest.mark.parametrize("span", [1600, 4096])
def test_files_by_byte_ranges(spark, tmp_path, span):
    texts = {"a.txt": prose(30_000, 1), "b.txt": "é漢" * 9000, "c.txt": "short", "d.txt": "", "e.txt": prose(span, 2)}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "f.txt").write_bytes(b"\xff\xfe bad \xc3 " * 900)
    texts["f.txt"] = (b"\xff\xfe bad \xc3 " * 900).decode("utf-8", "replace")
    limits = Limits(size=200, overlap=30, span=1000, file_span=span)
    got = {}
    for r in split.split_files(spark, f"file://{tmp_path}", "*.txt", limits).orderBy("path", "piece_no").collect():
        got.setdefault(r.path.rsplit("/", 1)[-1], []).append(r)
    assert set(got) == set(texts) - {"d.txt"}
    for name, mine in got.items():
        check(texts[name], [(r.start_offset, r.end_offset, r.text) for r in mine], limits)
        assert [r.piece_no for r in mine] == list(range(len(mine)))


def test_empty_table_and_wrong_limits(spark):
    assert split.split_texts(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        Limits(size=100, overlap=60)
