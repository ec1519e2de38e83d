import pytest

from docloom.functions.metadata import BASE_URLS
from docloom.operators import html_kernel as hk
from docloom.operators.parse import has_content, parse_page, parse_pages, title_of
from docloom.sources.files import crate_scope, discover

PAGE = """<!doctype html><html><head><title>Page - Rust</title></head><body class="rustdoc mod"><nav class="sub"><a href=x>std</a><a>vec</a></nav>
<main id=top><div class="rustdoc-breadcrumbs"><a>std</a>::<a>vec</a></div><h1>Struct <span>Vec</span><button>Copy</button></h1>
<p>A <b>growable <i>array</i></b> of <code>T&lt;U&gt;</code> .<p>Second &amp; last
<h2 id="use">§ Usage §</h2><ul><li>one<ul><li>inner <code>x</code></li></ul></li><li><p>two</p></ul>
<pre class="lang"><code class="language-bash">
$ ls
  -l
</code></pre><dl><dt>term<dd>meaning</dl><p>Show Railroad</p><div class="sidebar"><p>noise</p></div><script>var p = "<p>no</p>";</script>
<h3>Deep</h3><pre class="rust">fn a() {}
<p>kept as text</p></pre></main><footer><p>end</p></footer></body></html>"""


def blocks(html=PAGE):
    root = hk.parse(html)
    main = hk.first(root, "main")
    hk.remove_all(main, hk.NOISE)
    return hk.blocks_of(main)


def test_blocks_in_order_with_paths_and_anchors():
    got = [(b["block_type"], b["text"], b["section_path"], b["anchor"]) for b in blocks()]
    vec = "Struct Vec"
    assert got == [
        ("heading", vec, [vec], "top"), ("paragraph", "A growable array of `T<U>` .", [vec], "top"), ("paragraph", "Second & last", [vec], "top"),
        ("heading", "Usage", [vec, "Usage"], "use"), ("list_item", "one", [vec, "Usage"], "top"), ("list_item", "inner `x`", [vec, "Usage"], "top"), ("list_item", "two", [vec, "Usage"], "top"),
        ("code_block", "$ ls\n  -l", [vec, "Usage"], "top"), ("definition_term", "term", [vec, "Usage"], "top"), ("definition_desc", "meaning", [vec, "Usage"], "top"),
        ("heading", "Deep", [vec, "Usage", "Deep"], "top"), ("code_block", "fn a() {}\nkept as text", [vec, "Usage", "Deep"], "top"),
    ]


def test_languages_depth_and_levels():
    got = blocks()
    assert [b["code_language"] for b in got if b["block_type"] == "code_block"] == ["console", "rust"]
    assert [b["list_depth"] for b in got if b["block_type"] == "list_item"] == [0, 1, 0]
    assert [b["heading_level"] for b in got if b["block_type"] == "heading"] == [1, 2, 3]


def test_anchor_falls_back_to_the_heading():
    got = blocks("<main><h2 id=a>A</h2><p>x<h3>B</h3><p>y</main>")
    assert [(b["text"], b["anchor"]) for b in got] == [("A", "a"), ("x", "a"), ("B", None), ("y", "a")]


@pytest.mark.parametrize("html", ["", "<", "</p></p>", "<p>open", "<ul><li>a<li>b", "<b><p>x</b></p>", "<p" * 50, "<div>" * 3000 + "<p>deep</p>"])
def test_broken_pages_give_a_tree(html):
    hk.blocks_of(hk.parse(html))


def test_selectors():
    root = hk.parse('<div id=a class="x y"><p class=y data-k="v">1</p></div><p>2</p>')
    texts = lambda s: [hk.joined(n.strings()) for n in hk.select(root, s)]
    assert texts("p") == ["1", "2"] and texts("div.x p.y") == ["1"] and texts("#a") == ["1"] and texts("p[data-k=v]") == ["1"] and texts(".x .none, p") == ["1", "2"]


@pytest.mark.parametrize(
    "path,crate,html,want",
    [
        ("std/index.html", "std", "<main><h1>Crate <span>std</span></h1></main>", "std"), ("std/primitive.u8.html", "std", "<p>", "std::primitive::u8"), ("std/keyword.as.html", "std", "", "std::keyword::as"), ("std/macro.vec.html", "std", "", "std::vec!"),
        ("std/vec/struct.Vec.html", "std", PAGE, "std::vec::Vec"), ("std/x.html", "std", "<title>Name - Rust</title>", "Name"), ("std/x.y.html", "std", "", "x.y"), ("book/a.html", "book", "<title> The  Book </title>", "The Book"), ("book/a.html", "book", "<h1>Head</h1>", "Head"), ("reference/a.html", "reference", "<h1>Head</h1>", "a"),
    ],
)
def test_titles(path, crate, html, want):
    assert title_of(hk.parse(html), path, crate) == want


def test_failures_have_reasons():
    assert parse_page(None, "std/a.html", "std").reason == "read_error"
    assert parse_page("<title></title><body><p>x", "book/a.html", "book").reason == "missing_title"
    assert parse_page("<title>t</title>", "book/a.html", "book").reason == "missing_main_content"
    assert parse_page("<title>t</title><body><div>x</div></body>", "book/a.html", "book").reason == "empty_text"
    assert parse_page("<title>t</title><main><p>x</p></main>", "rustc/a.html", "unknown").reason == "unsupported_source"
    assert parse_page("<title>t</title><main><p>x</p></main>", "book/a.html", "book").reason is None


def test_content_check():
    assert has_content("<main><h1>x</h1><p>y</p></main>") and not has_content("<main><h1>x</h1><nav><p>y</p></nav></main>") and not has_content("")


def write(root, path, html):
    p = root / path
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(html if isinstance(html, bytes) else html.encode())


def test_scan_select_and_parse(spark, tmp_path):
    good = "<title>T</title><main><p>Some content of a page</p></main>"
    write(tmp_path, "std/index.html", "<body><main><h1>Crate <span>std</span></h1><p>x</p></main><meta name=rustdoc-vars data-channel=1.90.0></body>")
    write(tmp_path, "std/all.html", good)
    write(tmp_path, "book/index.html", good.replace("Some", "Made for Rust 1.85.0. Some"))
    write(tmp_path, "book/ch01.html", good.encode() + b"\xff<p>bad byte \xe9 in it</p>")
    write(tmp_path, "book/old.html", "There is a new edition of the book and this is an old link." + good)
    write(tmp_path, "book/empty.html", "<title>T</title><main><h1>only</h1></main>")
    write(tmp_path, "book/second-edition/a.html", good)
    write(tmp_path, "cargo/r.html", '<meta http-equiv="refresh" content="0; url=x"><title>Redirection</title><p>x</p>')
    write(tmp_path, "reference/a.html", good)
    write(tmp_path, "rustc/a.html", good)
    pages = discover(spark, str(tmp_path))
    assert sorted(r.source_path for r in pages.collect()) == ["book/ch01.html", "book/index.html", "reference/a.html", "std/index.html"]
    assert [r.source_path for r in discover(spark, str(tmp_path), ["book", "std", "book"], 2).collect()] == ["book/ch01.html", "book/index.html"]
    documents, failures = parse_pages(pages)
    got = {r.source_path: r for r in documents.collect()}
    assert failures.count() == 0 and got["book/ch01.html"].rust_version == "1.85.0" and got["std/index.html"].rust_version == "1.90.0" and got["reference/a.html"].rust_version is None
    assert got["std/index.html"].item_type == "module" and got["std/index.html"].url == BASE_URLS["std"] + "index.html" and got["book/index.html"].item_path == "book"
    with pytest.raises(ValueError):
        crate_scope(["nope"])
