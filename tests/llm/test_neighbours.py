import numpy as np

from docloom.llm import neighbours as nb

SCHEMA = "id string, vector array<float>, crate string, list int, query string"


def brute(rows, queries, k=10):
    x = {i: np.array(v, float) for i, v in rows}
    out = set()
    for q in queries:
        sims = sorted(((-(x[q] @ v / np.linalg.norm(x[q]) / np.linalg.norm(v)), i) for i, v in x.items() if i != q))
        out |= {(q, i) for _, i in sims[:k]}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(a) for a in v], "c", 1, "x") for i, v in rows], SCHEMA)


def data(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, 64))
    return [(f"p{k:05d}", (centres[k % 30] + rng.normal(size=64) * rng.uniform(0.05, 1.2)).astype(np.float32)) for k in range(n)]


def test_recall_against_brute_force(spark):
    rows = data(6000)
    asked = [f"p{k:05d}" for k in range(0, 6000, 100)]
    queries = spark.createDataFrame([(q,) for q in asked], "id string")
    got = nb.search(frame(spark, rows), queries, nb.IndexSettings(sample=1500, min_probes=8))
    pairs = {(r.query, r.neighbour) for r in got.collect()}
    want = brute([(i, v) for i, v in rows], asked)
    assert len(pairs) == len(want) == 600
    assert len(pairs & want) / len(want) >= 0.97


def test_unusable_repeated_and_tied_rows(spark):
    good = [(f"g{k}", np.eye(64)[k % 4] * (k + 1)) for k in range(12)]
    bad = [("null", None), ("short", np.ones(3)), ("zero", np.zeros(64)), ("nan", np.full(64, np.nan)), ("inf", np.full(64, np.inf)), (None, np.ones(64))]
    points = frame(spark, [*good, *bad, good[0], good[5]])
    queries = spark.createDataFrame([("g0",), ("g0",), ("null",), ("gone",), (None,)], "id string")
    got = [(r.query, r.neighbour, r["rank"]) for r in nb.search(points, queries).orderBy("rank").collect()]
    assert {q for q, _, _ in got} == {"g0"} and [r for _, _, r in got] == list(range(1, 11))
    assert [n for _, n, _ in got[:2]] == ["g4", "g8"]
    assert [n for _, n, _ in got[2:]] == sorted(n for n, _ in good if n not in ("g0", "g4", "g8"))[:8]


def test_few_points_and_none(spark):
    queries = spark.createDataFrame([("a",)], "id string")
    two = frame(spark, [("a", np.ones(64)), ("b", -np.ones(64))])
    assert [(r.query, r.neighbour) for r in nb.search(two, queries).collect()] == [("a", "b")]
    assert nb.search(frame(spark, [("a", np.ones(64))]), queries).count() == 0
    assert nb.search(spark.createDataFrame([], SCHEMA), queries).count() == 0


def test_hot_list_and_queries_in_passes(spark):
    rng = np.random.default_rng(3)
    same = [(f"h{k:04d}", np.ones(64) + rng.normal(size=64) * 1e-3) for k in range(700)]
    rows = same + data(700, 4)
    asked = [f"h{k:04d}" for k in range(0, 700, 25)]
    got = nb.search(frame(spark, rows), spark.createDataFrame([(q,) for q in asked], "id string"), nb.IndexSettings(pass_size=10, query_block=4))
    want = brute([(i, np.float32(v)) for i, v in rows], asked)
    assert len({(r.query, r.neighbour) for r in got.collect()} & want) / len(want) >= 0.97


def test_many_passes_read_only_what_they_visit(spark):
    rows = data(3000, 7)
    asked = [i for i, _ in rows]
    settings = nb.IndexSettings(sample=1000, min_probes=8, max_probes=24, pass_size=400)
    got = nb.search(frame(spark, rows), spark.createDataFrame([(q,) for q in asked], "id string"), settings)
    pairs = {(r.query, r.neighbour) for r in got.collect()}
    want = brute(rows, asked)
    assert len(pairs) == len(want) == 30_000 and len(pairs & want) / len(want) >= 0.95


def test_passes_hold_each_query_once(spark):
    df = spark.createDataFrame([(f"q{k}", 0 if k < 500 else k % 9) for k in range(900)], "id string, first int")
    conditions = nb._passes(df, nb.IndexSettings(pass_size=100))
    parts = [df.filter(c).count() for c in conditions]
    assert sum(parts) == 900 and max(parts) <= 300 and df.filter(sum(c.cast("int") for c in conditions) != 1).count() == 0


def test_stretches_hold_all_visited_lists():
    visited = np.zeros(100, bool)
    visited[[3, 4, 10, 50, 51, 99]] = True
    assert nb._stretches(visited, 3) == [(3, 10), (50, 51), (99, 99)] and nb._stretches(visited, 99) == [(3, 4), (10, 10), (50, 51), (99, 99)]
    assert nb._stretches(visited, 1) == [(3, 99)] and nb._stretches(visited & False, 3) == []
