import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import batching, dedup, embed, evaluate, prompt, ranking, rerank, search

CHUNK = "crate string, source_path string, chunk_index int, text string, start_offset int, end_offset int, section_path array<string>, rank int, id2 string"


def chunk_rows():
    return [("book", "book/a/deep.html", 0, "Same  text", 0, 9, ["T"]), ("book", "book/b.html", 0, "same text", 0, 9, ["T"]), ("book", "book/b.html", 2, "own", 30, 33, ["T"]), ("book", "book/b.html", 1, "more", 12, 16, None), ("std", "std/x.html", 0, "same text", 0, 9, ["T"]), (None, None, 5, None, None, None, None)]


def test_unique_chunks_restores_orphans_and_renumbers(spark):
    df = spark.createDataFrame([(*r, 1, "x") for r in chunk_rows()], CHUNK)
    got = {(r.source_path, r.chunk_index): r for r in dedup.dedup_chunks(df).collect()}
    # the deep page loses its only chunk to the shallow page and gets it back
    assert set(got) == {("book/a/deep.html", 0), ("book/b.html", 0), ("book/b.html", 1), ("book/b.html", 2), ("std/x.html", 0), ("", 0)}
    assert [got["book/b.html", k].text for k in range(3)] == ["same text", "more", "own"] and len({r.id for r in got.values()}) == 6
    assert dedup.dedup_chunks(spark.createDataFrame([], CHUNK)).count() == 0


def test_index_order_is_that_of_strings(spark):
    rows = [("book", "book/a.html", k, "same", k, k + 1, ["T"], 1, "x") for k in (2, 10)]
    assert dedup.dedup_chunks(spark.createDataFrame(rows, CHUNK)).first().start_offset == 10


def test_renumbering_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(dedup, "STRETCH_CHARS", 50)
    monkeypatch.setattr(dedup, "STRETCH_ROWS", 3)
    rows = [("c", "p", 1000 + k, "t", 7 * k, 7 * k + 5, None, 1, "x") for k in range(60)] + [("c", "p", k, "t", None, None, None, 1, "x") for k in range(10)]
    got = dedup.reindex(spark.createDataFrame(rows, CHUNK)).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in got] == list(range(70)) and [r.start_offset for r in got] == [None] * 10 + [7 * k for k in range(60)]


def test_unique_documents(spark):
    rows = [("book", "book/x/y.html", "p", "A  b"), ("book", "book/z.html", None, "a b"), ("book", "book/z.html", None, "a b"), ("std", "book/z.html", "p", "a b"), (None, None, None, None), (None, None, None, None)]
    got = dedup.dedup_documents(spark.createDataFrame([(*r, 7) for r in rows], "crate string, source_path string, item_path string, text string, rank int")).collect()
    assert sorted((r.crate or "", r.source_path or "") for r in got) == [("", ""), ("book", "book/z.html"), ("std", "book/z.html")] and "rank" in got[0].asDict()


@pytest.mark.parametrize("distance", search.DISTANCES)
def test_top_k_against_numpy(spark, distance, monkeypatch):
    monkeypatch.setattr(search, "PASS_ROWS", 3)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(150, 8)).astype(np.float32)
    corpus = spark.createDataFrame([(k, [float(a) for a in v], "c") for k, v in enumerate(x)] + [(900, None, "c"), (901, [1.0], "c"), (902, [None] * 8, "c")], "id int, vector array<float>, score string")
    queries = spark.createDataFrame([(k, [float(a) for a in x[k]]) for k in range(7)] + [(8, None)], "query_id int, vector array<float>")
    got = {(r.query_id, r["rank"]): r.id for r in search.top_k(queries, corpus, 5, distance).collect()}
    sign = 1 if distance in ("euclid", "manhattan") else -1
    s = sign * search.scores(x[:7].astype(float), x.astype(float), distance)
    assert got == {(q, r + 1): int(i) for q in range(7) for r, i in enumerate(np.argsort(s[q], kind="stable")[:5])}


def test_threshold_filter_and_empty(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.9, 0.1], "b"), (3, [0.0, 1.0], "a"), (4, [1.0, 0.0], "a")], "id int, vector array<float>, crate string")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<float>")
    assert [r.id for r in search.top_k(q, corpus, 9, threshold=0.5).orderBy("rank").collect()] == [1, 4, 2]
    assert [r.id for r in search.filtered_top_k(q, corpus, F.col("crate") == "a", k=9).orderBy("rank").collect()] == [1, 4, 3]
    assert search.top_k(q.filter("false"), corpus).count() == 0 and search.top_k(q, corpus.filter("false")).count() == 0
    with pytest.raises(ValueError):
        search.top_k(q, corpus, distance="hamming")


def test_lexical_hits_and_rerank(spark):
    q = spark.createDataFrame([("q", "read the buffer cache"), ("none", None)], "query_id string, text string")
    corpus = spark.createDataFrame([("a", "the cache reads"), ("b", "buffer and cache, read THE"), ("c", None), ("a", "the cache reads")], "id string, text string")
    got = [(r.query_id, r.id, round(r.score, 2), r["rank"]) for r in search.lexical_top_k(q, corpus).orderBy("rank").collect()]
    assert got == [("q", "b", 1.0, 1), ("q", "a", 0.5, 2)]
    cand = spark.createDataFrame([("q", "buffer", "no", 1), ("q", "buffer", "a buffer", 2), ("q", "buffer", "buffer", 3), ("q", "buffer", None, 4)], "query_id string, query string, text string, rank int")
    assert [(r["rank"], r.rerank_rank) for r in rerank.rerank(cand, 3).orderBy("rerank_rank").collect()] == [(2, 1), (3, 2), (1, 3)]

    class Length:
        def score(self, queries, texts):
            return [float(len(t)) for t in texts]

    class Wrong:
        def score(self, queries, texts):
            return [True]

    assert [r["rank"] for r in rerank.rerank(cand, 2, Length()).orderBy("rerank_rank").collect()] == [2, 3]
    with pytest.raises(Exception, match="one number"):
        rerank.rerank(cand, 2, Wrong()).collect()


def test_budget_prefix_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([("q", 1, 10), ("q", 2, None), ("q", 3, 95), ("q", 4, 1), ("r", 1, 200)], "query_id string, rank int, token_count int")
    assert [(r.query_id, r["rank"]) for r in prompt.within_budget(df, 100).orderBy("rank").collect()] == [("q", 1), ("q", 2)]


def test_prompts(spark):
    asked = spark.createDataFrame([("q", "Why?"), ("empty", "What?")], "query_id string, question string")
    ctx = spark.createDataFrame([("q", 3, None, "Title", None, 5, "second"), ("q", 1, "a::b", "T", "std", None, "first")], "query_id string, rank int, item_path string, title string, crate string, token_count int, text string")
    got = {r.query_id: r for r in prompt.prompts(asked, ctx).collect()}
    assert got["q"].prompt == "Question:\nWhy?\n\nContext:\n[1] a::b | std | token_count=0\nfirst\n\n[2] Title | unknown | token_count=5\nsecond"
    assert got["empty"].prompt is None and got["empty"].answer == prompt.NO_CONTEXT and got["empty"].blocks == 0 and got["q"].blocks == 2


def test_batches(spark):
    assert list(batching.capped([5, 5, 1, None, 100, 1], 3, 10)) == [0, 0, 1, 1, 2, 3] and list(batching.capped([], 1, 1)) == []
    df = spark.createDataFrame([(k, k % 2, None if k == 7 else 10) for k in range(10)], "id int, k int, token_count int").coalesce(1)
    fixed = batching.fixed_batches(df, ["k"], "id", 2, stretch=3).orderBy("k", "id").collect()
    assert [r.batch_no for r in fixed] == [0, 0, 1, 1, 2] * 2
    totals = batching.batch_totals(batching.token_batches(df, max_items=4, max_tokens=30)).collect()
    assert sum(r["items"] for r in totals) == 10 and sum(r.tokens is None for r in totals) == 1 and all(r["items"] <= 4 for r in totals)
    with pytest.raises(ValueError):
        batching.fixed_batches(df, ["k"], "id", 0)


def test_embedding(spark):
    df = spark.createDataFrame([(1, "a word here"), (2, None), (3, "a word here")], "id int, text string")
    got = {r.id: r.vector for r in embed.embed(df, embed.HashingEmbedder(16)).collect()}
    assert got[1] == got[3] and abs(sum(x * x for x in got[1]) - 1) < 1e-5 and set(got[2]) == {0.0}

    class Bad:
        size = 3

        def embed(self, texts):
            return [[1.0]] * len(texts)

    with pytest.raises(Exception, match="one vector"):
        embed.embed(df, Bad()).collect()


def cases(spark):
    rows = [("c1", "q", [{"title": "A"}, {"title_contains": "zz"}]), ("c2", "q", [{"title_contains": "lph", "text_contains": "BODY"}]), ("c3", "q", [{"item_path_contains": "non"}]), ("c4", "q", [{"title": "A"}]), ("c5", "q", [])]
    return spark.createDataFrame(rows, "id string, question string, expected array<map<string,string>>")


def test_first_ranks_and_metrics(spark):
    hits = [("c1", 1, 0.9, "B", "x", None), ("c1", 2, 0.8, "A", "x", None), ("c2", 1, 0.5, "Alpha", "body text", None), ("c3", 1, 0.5, "t", "x", None), ("c5", 1, 0.1, "A", "x", None)]
    df = spark.createDataFrame(hits, "case_id string, rank int, score double, title string, text string, item_path string")
    ranks = evaluate.first_ranks(cases(spark), df)
    assert {r.case_id: r["rank"] for r in ranks.collect()} == {"c1": 2, "c2": 1, "c3": 1, "c4": None, "c5": None}
    s = evaluate.summary(ranks).first()
    assert (s.total, s.matched, s.hit_rate, round(s.mrr, 4)) == (5, 3, 0.6, 0.5)
    assert {r.case_id for r in evaluate.weak_cases(ranks).collect()} == {"c1", "c4", "c5"} and not evaluate.passes(ranks) and evaluate.passes(ranks, 0.6)
    other = spark.createDataFrame([("c1", 1), ("c2", None), ("c3", 1), ("c4", 9)], "case_id string, rank int")
    d = evaluate.deltas(ranks, other).first()
    one, two = evaluate.summary(ranks).first(), evaluate.summary(other).first()
    assert abs(d.hit_rate_delta - (two.hit_rate - one.hit_rate)) < 1e-9 and abs(d.mrr_delta - (two.mrr - one.mrr)) < 1e-9 and (d.improved, d.regressed, d.same) == (2, 1, 1)
    failed = evaluate.with_errors(other, spark.createDataFrame([("c1", "timed out"), ("c1", "later")], "case_id string, error string"))
    assert {r.case_id: (r.error, r["rank"]) for r in failed.collect() if r.error} == {"c1": ("later", None)}
    assert {r.case_id: r.change for r in evaluate.compare(ranks, other).collect()} == {"c1": "improved", "c2": "regressed", "c3": "same", "c4": "improved"}
    nothing = evaluate.summary(ranks.filter("false")).first()
    assert nothing.total == 0 and nothing.hit_rate == 0.0 and nothing.mrr == 0.0


def test_ranks_and_neighbours_in_stretches(spark):
    rows = [("a", k, f"v{k}") for k in range(0, 200, 3)] + [("b", 5, "x"), (None, 1, "n"), (None, 2, "m")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "g string, at int, v string, stretch int")
    got = ranking.ranked(df, ["g"], F.floor(F.col("at") / 10), ["at"])
    want = {("a", 3 * k): k for k in range(67)} | {("b", 5): 0, (None, 1): 0, (None, 2): 1}
    assert {(r.g, r.at): r["rank"] for r in got.collect()} == want and got.columns == ["g", "at", "v", "stretch", "rank"]
    near = {r.at: (r.before, r.after) for r in ranking.with_neighbours(got, ["g"], "rank", "v").filter("g = 'a'").collect()}
    assert near[0] == (None, "v3") and near[99] == ("v96", "v102") and near[198] == ("v195", None)
    assert ranking.ranked(df.filter("false"), ["g"], F.col("at"), ["at"]).count() == 0


def test_payload_round_trip_and_validation(spark):
    df = spark.createDataFrame([("a", "d", None, 3), ("b", "e", "t", None)], "chunk_id string, document_id string, section_title string, chunk_index int")
    maps = df.select("chunk_id", search.payload_map(df, ["document_id", "section_title", "chunk_index"]).alias("p"))
    back = maps.select("chunk_id", *search.payload_columns(F.col("p"), ["document_id"], ["section_title", "chunk_index"]))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(Exception, match="payload without section_title"):
        maps.select(*search.payload_columns(F.col("p"), ["section_title"], [])).collect()
    wrong = spark.createDataFrame([({"chunk_index": "many"},)], "p map<string,string>")
    with pytest.raises(Exception, match="no number"):
        wrong.select(*search.payload_columns(F.col("p"), [], ["chunk_index"])).collect()


def test_lexical_search_beyond_the_broadcast(spark, monkeypatch):
    corpus = spark.createDataFrame([(k, f"the word w{k % 7}x and the n{k % 3}y") for k in range(300)], "id int, text string")
    asked = spark.createDataFrame([(k, f"the w{k}x n{k % 3}y") for k in range(7)], "query_id int, text string")
    want = sorted(map(tuple, search.lexical_top_k(asked, corpus, 5).collect()))
    monkeypatch.setattr(search, "BROADCAST_WORDS", 0)
    assert sorted(map(tuple, search.lexical_top_k(asked, corpus, 5).collect())) == want and len(want) == 35


def test_vector_search_in_written_passes(spark, monkeypatch):
    rows = [(k, [float(k % 5), float(k % 7), 1.0]) for k in range(90)]
    df = spark.createDataFrame(rows, "id int, vector array<float>")
    asked = df.withColumnRenamed("id", "query_id")
    want = sorted(map(tuple, search.top_k(asked, df, 3).collect()))
    monkeypatch.setattr(search, "PASS_ROWS", 20)
    assert sorted(map(tuple, search.top_k(asked, df, 3).collect())) == want
