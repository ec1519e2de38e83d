import hashlib
import re
import uuid

import pytest
from pyspark.sql import functions as F

from docloom.functions import ids, metadata, selection, text

SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()]
TEXTS = ["", " ", "a", "A\r\nb\rc  \n\n\n\nd , e ; f", " x ", *(f"{s}a{s}{s}B{s}" for s in SPACES), "İstanbul ΑΣ", "§ Intro\nabc§ \tx\nplain § y", "foo_ bar `x` s `y` sun\n[a.b-c_1]  \nend", "tab\t\nx", "ends\n\n", "\n\n```rust\nfn a() {}\n```\n"]


def values(spark, column, rows=TEXTS):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string")
    return [r[0] for r in df.orderBy("k").select(column(F.col("t"))).collect()]


def test_strip_collapse_and_hash_equal_python(spark):
    assert values(spark, text.strip) == [t.strip() for t in TEXTS]
    assert values(spark, text.collapsed) == [" ".join(t.lower().split()) for t in TEXTS]
    assert values(spark, text.text_hash) == [hashlib.sha256(" ".join(t.lower().split()).encode()).hexdigest() for t in TEXTS]


# The patterns of the rules, as Python reads them.


def py_tidy(t):
    t = t.replace("\r\n", "\n").replace("\r", "\n")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", t))


def py_marks(t):
    return "\n".join(re.sub(r"^[^\s]{0,8}§\s+", "", x).replace("§ ", "") for x in t.split("\n"))


def py_clean(t, crate):
    t = py_marks(py_tidy(t))
    if crate == "reference":
        t = re.sub(r"(?m)^\[[a-z0-9_.-]+\]\s*$\n?", "", t)
    t = re.sub(r"\b([A-Za-z0-9]+)_\s+([A-Za-z0-9]+)\b", r"\1_\2", t)
    t = re.sub(r"`([^`\n]+)`\s+s\b", r"`\1`s", t)
    return re.sub(r" +([,.;:!?])", r"\1", t).strip()


@pytest.mark.parametrize("crate", ["std", "reference"])
def test_clean_text_equals_python(spark, crate):
    assert values(spark, lambda c: text.clean_text(c, F.lit(crate))) == [py_clean(t, crate) for t in TEXTS]


def test_normal_text_and_code(spark):
    assert values(spark, text.normalize_text) == [re.sub(r" +([,.;:!?])", r"\1", py_tidy(t)).strip() for t in TEXTS]
    assert values(spark, text.clean_code) == [py_marks(t.replace("\r\n", "\n").replace("\r", "\n")).strip("\n") for t in TEXTS]


def test_null_stays_null(spark):
    for f in (text.strip, text.collapsed, text.text_hash, text.normalize_text, text.clean_code, lambda c: text.clean_text(c, F.lit("std")), ids.document_id):
        assert values(spark, f, [None]) == [None]


def test_uuid5(spark):
    names = ["std/a.html", "", "ü/漢.html", "a" * 500]
    assert values(spark, ids.document_id, names) == [str(uuid.uuid5(uuid.UUID(ids.DOCUMENT_NAMESPACE), n)) for n in names]
    doc = str(uuid.uuid5(uuid.UUID(ids.DOCUMENT_NAMESPACE), "x"))
    got = values(spark, lambda c: ids.chunk_id(ids.document_id(c), F.lit(12)), ["x"])
    assert got == [str(uuid.uuid5(uuid.UUID(ids.CHUNK_NAMESPACE), f"{doc}:12"))]


def test_low_value_and_heading_only(spark):
    assert values(spark, text.is_low_value, ["  Added\n", "added more", "fn", "Nightly  only", "```\nadded\n```"]) == [True, False, False, True, False]
    lone = lambda c: text.is_heading_only(c, F.array(F.lit("T"), F.lit(" Intro ")))
    assert values(spark, lone, ["Intro", " Intro\n", "Intro x", "", None]) == [True, True, False, False, False]
    assert values(spark, lambda c: text.is_heading_only(c, F.array().cast("array<string>")), ["Intro"]) == [False]
    stub = lambda c: text.is_changelog_stub(c, F.lit("cargo"), F.lit("cargo/CHANGELOG.html"), F.array(F.lit("a"), F.lit("b")))
    assert values(spark, stub, ["one\n\ntwo", "1\n2\n3", "x" * 180, ""]) == [True, False, False, True]


def test_urls_and_crates(spark):
    paths = ["book/ch01.html", "std\\vec\\index.html", "nofolder", "rustc/a.html", None]
    crate = lambda c: metadata.detect_crate(F.replace(c, F.lit("\\"), F.lit("/")))
    assert values(spark, crate, paths) == ["book", "std", "unknown", "unknown", "unknown"]
    assert values(spark, lambda c: metadata.document_url(c, crate(c)), paths) == ["https://doc.rust-lang.org/book/ch01.html", "https://doc.rust-lang.org/std/vec/index.html", None, None, None]
    assert values(spark, lambda c: metadata.relative_path(c, "/data/raw"), ["file:/data/raw/std/a.html", "/data/raw/b.html", "/other/c.html"]) == ["std/a.html", "b.html", "/other/c.html"]


@pytest.mark.parametrize(
    "path,crate,title,body,classes,want",
    [
        ("std/vec/struct.Vec.html", "std", "Vec", "", [], "struct"), ("std/vec/index.html", "std", "x", "", ["struct"], "module"), ("std/x.html", "std", "t", "", ["foo", "type"], "type"),
        ("std/x.html", "std", "STD", "", [], "module"), ("std/x.html", "std", "std::println!", "", [], "macro"), ("std/x.html", "std", "std::keyword::as", "", [], "keyword"), ("std/x.html", "std", "std::primitive::u8", "", [], "primitive"),
        ("std/x.html", "std", "A trait object", "a function", [], "trait"), ("std/x.html", "std", "Plain", "This Enum and a struct", [], "struct"), ("std/x.html", "std", "Plain", "nothing", [], "unknown"),
        ("book/a.html", "book", "t", "", [], "page"), ("core/a.html", "core", "t", "", [], None),
    ],
)
def test_item_types(spark, path, crate, title, body, classes, want):
    df = spark.createDataFrame([(path, crate, title, body, classes)], "p string, c string, t string, x string, b array<string>")
    assert df.select(metadata.item_type(*(F.col(c) for c in "pctxb"))).first()[0] == want


@pytest.mark.parametrize(
    "path,crate,title,crumbs,want",
    [("std/a.html", "std", "Vec", ["x"], "Vec"), ("std/a.html", "std", "", [], None), ("book/a.html", "book", "t", ["A", "B"], "A::B"), ("book/ch/one.two.html", "book", "t", [], "book::ch::one.two"), ("book/index.html", "book", "t", [], "book"), ("else/a.html", "book", "t", [], None)],
)
def test_item_paths(spark, path, crate, title, crumbs, want):
    df = spark.createDataFrame([(path, crate, title, crumbs)], "p string, c string, t string, b array<string>")
    assert df.select(metadata.item_path(*(F.col(c) for c in "pctb"))).first()[0] == want


def test_selection_by_path(spark):
    rows = [("std/vec/index.html", "std", True), ("book/css/a.html", "book", False), ("std/all.html", "std", False), ("book/all.html", "book", True), ("cargo/CHANGELOG.html", "cargo", False), ("book/SUMMARY.html", "book", False), ("reference/old-redirect.html", "reference", False), ("book/print.html", "book", False), ("std/search-index1.js", "std", False), ("book/second-edition/a.html", "book", False)]
    df = spark.createDataFrame(rows, "p string, c string, want boolean")
    assert df.filter(selection.path_selected(F.col("p"), F.col("c")) != F.col("want")).count() == 0


def test_redirect_and_legacy(spark):
    redirect = '<html><head><meta HTTP-EQUIV="refresh" content="0;URL=x"><title>Redirection</title>'
    assert values(spark, selection.is_redirect, [redirect, redirect.replace("Redirection", "x"), " " * 2048 + redirect, None]) == [True, False, False, False]
    legacy = "There is a new edition of the book and this is an old link."
    assert values(spark, selection.is_legacy, [legacy, "x" * 4096 + legacy, None]) == [True, False, False]
