import json

import pytest
from pyspark.sql import functions as F

from docloom.operators.chunking import chunk_documents
from docloom.operators.tokens import with_token_counts
from docloom.plans import pipeline
from docloom.plans.queries import QUERIES
from docloom.plans.sql import ORACLE
from docloom.schemas import DOCUMENT
from docloom.sources.eval_cases import read_cases
from docloom.sources.files import scan_pages
from docloom.sources.store import IntegrityError, KnowledgeBase, check, wrong_ids
from docloom.streaming import ingest as streams


def page(title, *paragraphs):
    return f"<title>{title}</title><main><h1>{title}</h1>{''.join(f'<p>{p}</p>' for p in paragraphs)}</main>"


@pytest.fixture
def raw(tmp_path):
    root = tmp_path / "raw"
    pages = {
        "book/a.html": page("Ownership", "Ownership moves a value to another owner and drops it later. " * 5),
        "book/b/copy.html": page("Ownership", "Ownership moves a value to another owner and drops it later. " * 5),
        "book/c.html": page("Traits", "A trait says which methods a type has to offer to callers. " * 5),
        "std/vec.html": page("Vec", "A growable array that keeps its items side by side in memory. " * 5),
    }
    for name, html in pages.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(html)
    return str(root)


def test_stages_store_and_retrieval(spark, raw, tmp_path):
    artifacts = pipeline.ingest(spark, raw)
    counts = artifacts.counts()
    assert counts["discover"] == counts["parse"] == counts["clean"] == 4 and counts["failures"] == 0 and counts["dedup"] == counts["chunk_dedup"] == 3
    assert set(pipeline.ingest(spark, raw, "clean").stages) == {"discover", "parse", "failures", "clean"}
    base = KnowledgeBase(spark, f"file://{tmp_path}/kb")
    assert base.version() is None
    first = pipeline.rebuild(base, artifacts)
    assert base.version() == first and wrong_ids(base.read("chunks")).count() == 0
    queries = spark.createDataFrame([("q1", "which methods has a trait"), ("q2", "  growable array in memory "), ("blank", "  "), ("long", "x " * 900)], "query_id string, question string")
    settings = pipeline.Settings(retrieval_limit=3, reranking_limit=2)
    for reranking in (True, False):
        got = pipeline.retrieve(base, queries, settings, use_reranking=reranking).filter("rank = 1").collect()
        assert {r.query_id: r.source_path for r in got} == {"q1": "book/c.html", "q2": "std/vec.html"}
    asked = queries.unionByName(spark.createDataFrame([("tokens", "a b " * 220), ("none", None)], queries.schema))
    made = {r.query_id: r for r in pipeline.chat_prompts(base, asked, pipeline.Settings(retrieval_limit=3, reranking_limit=2, max_query_tokens=300)).collect()}
    assert "[1] " in made["q1"].prompt and made["q2"].rejected is None
    assert {k: r.rejected for k, r in made.items() if r.prompt is None} == {"blank": "blank", "none": "blank", "long": "too_long", "tokens": "too_many_tokens"}
    one = base.read("chunks").first()
    assert base.chunk(one.id).count() == 1 and base.chunk("none").count() == 0
    assert [r.source_path for r in base.document(one.document_id).collect()] == [one.source_path] and base.document("none").count() == 0
    assert base.vector_space()[1] == "cosine" and base.vector_space()[0] == len(base.read("vectors").first().vector)
    with pytest.raises(ValueError, match="for cosine"):
        pipeline.retrieve(base, queries, pipeline.Settings(distance="dot"))
    assert [base._claim(), KnowledgeBase(spark, base.root)._claim()] == [1, 2]
    second = pipeline.rebuild(base, artifacts)
    assert base.version() == second != first


def test_a_bad_version_leaves_the_old_one(spark, raw, tmp_path):
    base = KnowledgeBase(spark, f"file://{tmp_path}/kb")
    artifacts = pipeline.ingest(spark, raw)
    good = pipeline.rebuild(base, artifacts)
    documents, chunks = base.read("documents"), base.read("chunks")
    for docs, parts, what in ((documents.filter("false"), chunks, "no documents"), (documents, chunks.filter("false"), "no chunks"), (documents, chunks.filter("crate = 'std'"), "documents without chunks: book/a.html, book/c.html"), (documents.filter("crate = 'book'"), chunks, "chunks without documents"), (documents, chunks.withColumn("id", F.lit("x")), "wrong ids"), (documents, chunks.unionByName(chunks), "repeated")):
        with pytest.raises(IntegrityError, match=what):
            base.replace(docs, parts)
    assert base.version() == good
    check(documents, chunks)


def test_options():
    for bad in (("half", False, None, False), ("clean", True, None, False), ("all", True, 5, False)):
        with pytest.raises(ValueError):
            pipeline.check_options(*bad)
    pipeline.check_options("all", True, 5, True)
    with pytest.raises(ValueError):
        pipeline.Settings(retrieval_limit=5, reranking_limit=6)


def test_settings_from_the_environment():
    got = pipeline.Settings.from_env({"DOCLOOM_RETRIEVAL_LIMIT": "30", "DOCLOOM_DISTANCE": "dot", "OTHER": "x"})
    assert got == pipeline.Settings(retrieval_limit=30, distance="dot")
    for bad in ({"DOCLOOM_RETRIEVAL_LIMIT": "many"}, {"DOCLOOM_RETRIEVAL_LIMIT": "0"}, {"DOCLOOM_DISTANCE": "far"}):
        with pytest.raises(ValueError):
            pipeline.Settings.from_env(bad)


def test_token_counts_by_file(spark, tmp_path):
    import base64

    path = tmp_path / "bytes.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(bytes([b])) + b" " + str(b).encode() for b in range(256)))
    df = spark.createDataFrame([(1, "abc", 9), (2, None, 9), (3, "é", 9)], "id int, text string, token_count int")
    assert {r.id: r.token_count for r in with_token_counts(df, str(path)).collect()} == {1: 3, 2: 0, 3: 2}
    with pytest.raises(Exception, match="unknown kind"):
        with_token_counts(df, "x.bin").collect()


def test_materialized_tables_are_released(spark):
    import os

    from docloom import runtime

    kept = runtime.materialize(spark.range(5), "t")
    path = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert kept.count() == 5 and os.path.isdir(path)
    runtime.release()
    assert not os.path.exists(path)


def test_cases_from_json_lines(spark, tmp_path):
    path = tmp_path / "cases.jsonl"
    path.write_text("\n".join([json.dumps({"id": "a", "question": "q", "expected": [{"title": "T"}]}), "", json.dumps({"question": "r", "expected": []})]))
    assert [(r.id, r.question) for r in read_cases(spark, str(path)).collect()] == [("a", "q"), ("line-3", "r")]
    path.write_text('{"id": "a"}')
    with pytest.raises(Exception, match="without question"):
        read_cases(spark, str(path)).collect()


def test_stream_counts_deliveries_once(spark, tmp_path):
    body = [("paragraph", "A paragraph that is long enough to stay.", "p", None, None, None, None, ["T"])]
    rows = [(f"book/{k}.html", "T", "x", "book", "u", None, None, None, body) for k in range(5)]
    documents = spark.createDataFrame(rows, DOCUMENT).withColumn("loaded_at", F.lit("2025-01-01 00:00:00").cast("timestamp"))
    source = tmp_path / "in"
    corrected = documents.limit(1).withColumn("source_path", F.lit("book/0.html")).withColumn("title", F.lit("Corrected"))
    documents.unionByName(documents.limit(2)).unionByName(corrected).write.parquet(str(source))
    stream = spark.readStream.schema(documents.schema).parquet(str(source))
    query = streams.write_chunks(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = chunk_documents(documents.unionByName(corrected).select("source_path", "crate", "title", "text", "blocks"))
    assert sorted(r.source_path for r in got.collect()) == sorted(r.source_path for r in want.collect())


def test_arrivals_by_windows(spark):
    rows = [("2025-01-01 10:00:00", "a", 1.0), ("2025-01-01 23:00:00", "a", 3.0), ("2025-01-02 01:00:00", "a", None)]
    hits = spark.createDataFrame(rows, "t string, mode string, score double").withColumn("searched_at", F.col("t").cast("timestamp"))
    got = [(str(r.start)[:10], r.hits, r.mean_score) for r in streams.arrivals(hits).orderBy("start").collect()]
    assert got == [("2025-01-01", 2, 2.0), ("2025-01-02", 1, None)]


def test_every_sql_has_its_query():
    assert set(ORACLE) <= set(QUERIES)


def test_nothing_imports_the_optional_package():
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "docloom"
    bad = [p for p in root.rglob("*.py") if "llm" not in p.parts and "docloom.llm" in p.read_text()]
    assert not bad


def test_ingest_reads_and_parses_once(spark, raw):
    plan = pipeline.ingest(spark, raw).stages["chunk_dedup"]._jdf.queryExecution().toString()
    assert "binaryFile" not in plan and "MapInPandas" not in plan and "PythonUDF" not in plan


def test_versions_come_from_key_pages_outside_of_the_selection(spark, tmp_path):
    root = tmp_path / "raw"
    text = "A paragraph that tells enough to be kept as a document of its own. " * 3
    pages = {"cargo/CHANGELOG.html": "<title>c</title><main><h1>Log</h1><h2>Cargo 1.84 (2025)</h2><p>x</p></main>", "cargo/guide.html": page("Guide", text), "book/index.html": "<title>b</title><main><h1>Book</h1><p>uses Rust 1.85.0 or later</p></main>", "book/z.html": page("Z", text), "core/fn.a.html": page("a", text), "elsewhere/x.html": page("X", text)}
    for name, html in pages.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(html)
    got = {r.source_path: r.rust_version for r in pipeline.ingest(spark, str(root), "parse", ["cargo", "book"], 2).stages["parse"].collect()}
    assert got == {"cargo/guide.html": "1.84", "book/index.html": "1.85.0"}
    scanned = {(r.source_path, r.crate) for r in scan_pages(spark, str(root), crates=["core", "unknown"]).collect()}
    assert scanned == {("core/fn.a.html", "core"), ("elsewhere/x.html", "unknown")}
    with pytest.raises(FileNotFoundError):
        scan_pages(spark, str(root / "none"))
    with pytest.raises(NotADirectoryError):
        scan_pages(spark, str(root / "book/z.html"))


def test_a_document_that_cannot_be_cut_is_left_out_if_not_strict(spark):
    body = lambda t: [("paragraph", t, "p", None, None, None, None, ["T"])]
    rows = [("book/a.html", "A", "x", "book", "u", None, None, None, body("Words that can be cut. " * 20)), ("book/b.html", "B", "x", "book", "u", None, None, None, body("x" * 9000))]
    stages = pipeline.ingest_documents(spark.createDataFrame(rows, DOCUMENT), strict=False).stages
    assert [r.source_path for r in stages["uncut"].collect()] == ["book/b.html"] and [r.source_path for r in stages["dedup"].collect()] == ["book/a.html"]
    assert {r.source_path for r in stages["chunk_dedup"].collect()} == {"book/a.html"}


def test_only_the_absence_of_the_optional_package_is_passed_over(monkeypatch):
    import builtins

    import __spark_entry__ as entry

    real = builtins.__import__

    def without(missing):
        def load(name, *args, **kwargs):
            if name.startswith("docloom.llm"):
                raise ModuleNotFoundError(name=missing)
            return real(name, *args, **kwargs)

        return load

    monkeypatch.setattr(builtins, "__import__", without("docloom.llm"))
    assert entry._optional() == ({}, {})
    monkeypatch.setattr(builtins, "__import__", without("xxhash"))
    with pytest.raises(ModuleNotFoundError):
        entry._optional()
