from collections import Counter, defaultdict

from docloom.llm import lines

NOTICE = "All samples are given without any warranty"
SHARE = "Share this page with your friends"


def pages():
    rows = []
    for k in range(40):
        body = [f"Line {k} that is only here, number {k}", NOTICE if k % 2 else NOTICE.upper().replace(" ", "  "), SHARE, "short", ""]
        rows.append((k, "a", "\n".join(body)))
    rows += [(100 + k, "b", f"{NOTICE}\nown text of page {k} in b") for k in range(7)]
    rows += [(200, "a", None), (201, None, NOTICE), (202, "a", ""), (0, "a", rows[0][2])]
    return rows


def brute(rows, support=lines.Support()):
    docs = {d: (s, t or "") for d, s, t in rows}
    norm = lambda x: " ".join(p for p in x.replace("\t", " ").split(" ") if p).lower()
    seen, total = defaultdict(set), Counter(s for s, _ in docs.values())
    for d, (s, t) in docs.items():
        for line in t.split("\n"):
            seen[s, norm(line)].add(d)
    keep = {k for k, v in seen.items() if len(k[1]) >= support.characters and len(v) >= support.documents and len(v) >= support.share * total[k[0]]}
    return {(d, n) for d, (s, t) in docs.items() for n, line in enumerate(t.split("\n")) if (s, norm(line)) in keep}


def test_occurrences_blocks_and_cleaning(spark):
    rows = pages()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc long, source string, text string, line_no int, node string")
    blocks, found = lines.boilerplate(df)
    assert {(r.doc, r.line_no) for r in found.collect()} == brute(rows) and found.count() == len(brute(rows))
    by_line = {r.line: r.block for r in blocks.collect()}
    assert len(by_line) == 2 and len(set(by_line.values())) == 1  # notice and share line follow each other: one block
    clean = {r.doc: (r.text, r.removed) for r in lines.cleaned(df, found).collect()}
    assert clean[3] == ("Line 3 that is only here, number 3\nshort\n", 2)
    assert clean[100] == (f"{NOTICE}\nown text of page 0 in b", 0) and clean[200] == (None, 0) and clean[202] == ("", 0)


def test_share_of_pages_counts(spark):
    rows = [(k, "a", NOTICE if k < 9 else f"page {k} with its own words") for k in range(200)]
    df = spark.createDataFrame(rows, "doc long, source string, text string")
    assert lines.boilerplate(df)[1].count() == 0  # 9 pages, but under 5 %
    assert lines.boilerplate(df, lines.Support(share=0.04))[1].count() == 9


def test_without_broadcast_and_empty(spark, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_ROWS", 0)
    rows = pages()
    found = lines.boilerplate(spark.createDataFrame(rows, "doc long, source string, text string"))[1]
    assert {(r.doc, r.line_no) for r in found.collect()} == brute(rows)
    blocks, found = lines.boilerplate(spark.createDataFrame([], "doc long, source string, text string"))
    assert blocks.count() == 0 and found.count() == 0


def test_blocks_need_edges(spark):
    """Two notices of two lines each, equally frequent, that never stand side by side are two blocks; a third line that stands alone is none."""
    rows = []
    for k in range(40):
        pair = ("first notice, line one", "first notice, line two") if k % 2 else ("second notice, line one", "second notice, line two")
        rows.append((k, "s", "\n".join([f"some text of page {k} that is its own", *pair, f"more text of page {k} and only of it", f"and yet more of {k} that is its own", "a line that stands alone here", f"end of page {k} as it is"]), "x"))
    df = spark.createDataFrame(rows, "doc long, source string, text string, node string")
    blocks, _ = lines.boilerplate(df)
    got = {(r.block_line, r.lines, r.strongest) for r in lines.joined_blocks(blocks).collect()}
    assert got == {("first notice, line one", 2, 20), ("second notice, line one", 2, 20)}
    assert blocks.count() == 5
    mixed = spark.createDataFrame([(d, s, t.replace("\nmore text", "\na line that stands alone here\nmore text"), n) for d, s, t, n in rows], df.schema)
    assert [(r.lines) for r in lines.joined_blocks(lines.boilerplate(mixed)[0]).collect()] == [5]
