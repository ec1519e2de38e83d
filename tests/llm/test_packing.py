import random
from collections import Counter

import numpy as np
import pytest

from docloom.llm import packing
from docloom.llm.packing import PackSettings, configurations, knapsack, plan

SCHEMA = "doc long, text string, container long, position int, n long"


def hist(n, mu, seed=1):
    rng = random.Random(seed)
    return Counter(min(2048, max(1, int(rng.lognormvariate(mu, 0.9)))) for _ in range(n))


@pytest.mark.parametrize("n,mu", [(1, 5), (50, 7), (3000, 5.5), (30_000, 6.5)])
def test_plan_is_whole_and_full(n, mu):
    h = hist(n, mu)
    p = plan(h, PackSettings())
    fill, seats, placed = np.zeros(p.containers, int), set(), Counter()
    for s, first, count, container, position in zip(p.size, p.first, p.count, p.container, p.position):
        fill[container : container + count] += s
        for k in range(count):
            assert (container + k, position) not in seats and (s, first + k) not in placed
            seats.add((container + k, position))
            placed[s, first + k] = 1
    assert Counter(s for s, _ in placed) == h and fill.max() <= 2048 and fill.min() > 0
    if n >= 3000:
        assert sum(s * c for s, c in h.items()) / (2048 * p.containers) >= 0.98


def test_work_follows_lengths_not_items():
    small, large = hist(2000, 6), {s: c * 1000 for s, c in hist(2000, 6).items()}
    assert len(plan(large, PackSettings()).size) < 20 * len(plan(small, PackSettings()).size)


def test_knapsack_and_configurations():
    value, counts = knapsack([5, 7, 11], [5.0, 7.5, 11.0], 24)
    assert sum(c * s for c, s in zip(counts, (5, 7, 11))) <= 24 and value == pytest.approx(sum(c * v for c, v in zip(counts, (5.0, 7.5, 11.0)))) and value >= 23.5
    used = sum(x for _, x in configurations([6, 5, 4], [30, 30, 30], 10))
    assert used == pytest.approx(30 * 15 / 10, abs=1.0)


def test_empty_plan():
    assert plan({}, PackSettings()).containers == 0


@pytest.fixture(scope="module")
def words_tokenizer(tmp_path_factory):
    """A rank file in which every byte is a token: lengths are known without one of the public vocabularies."""
    import base64

    path = tmp_path_factory.mktemp("tok") / "bytes.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(bytes([b])) + b" " + str(b).encode() for b in range(256)))
    return str(path)


def test_documents_into_containers(spark, words_tokenizer):
    rng = random.Random(2)
    texts = {k: "x" * rng.choice([1, 7, 30, 64, 65, 100, 150, 220]) for k in range(1, 400)} | {500: "", 501: None, 502: "y" * 1000, 503: "z" * 640}
    settings = PackSettings(tokenizer=words_tokenizer, capacity=64, rank_rows=20)
    rows = [(k, t, 1, 2, 3) for k, t in texts.items()] + [(7, texts[7], 1, 2, 3), (None, "x", 1, 2, 3)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), settings).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc, []).append(r)
    assert set(by_doc) == set(texts)
    for doc, parts in by_doc.items():
        parts.sort(key=lambda r: r.part)
        size = len(texts[doc] or "")
        assert sum(r.tokens for r in parts) == size and [r.start_token for r in parts] == [64 * k for k in range(len(parts))]
        assert len(parts) == max(1, -(-size // 64))
        assert (parts[0].container is None) == (size == 0)
    seats = [(r.container, r.position) for r in got if r.container is not None]
    fill = Counter()
    for r in got:
        fill[r.container] += r.tokens
    fill.pop(None, 0)
    assert len(seats) == len(set(seats)) and max(fill.values()) <= 64 and set(fill) == set(range(len(fill)))
    assert len(fill) <= 1.05 * -(-sum(fill.values()) // 64) + 1


def test_no_documents(spark, words_tokenizer):
    assert packing.pack(spark.createDataFrame([], SCHEMA), PackSettings(tokenizer=words_tokenizer)).count() == 0


def test_column_generation_runs_to_its_end():
    """No configuration is worth more than 1 at the end, however many rounds that takes."""
    rng = np.random.default_rng(2)
    sizes = sorted(rng.choice(np.arange(520, 2048), 150, replace=False).tolist(), reverse=True)
    demand = rng.integers(1, 500, 150).tolist()
    found = packing.configurations(sizes, demand, 2048)
    matrix = np.array([c for c, _ in found], float).T
    value, _ = packing.knapsack(sizes, np.linalg.solve(matrix.T, np.ones(150)).tolist(), 2048)
    assert value <= 1 + 1e-6
    assert (matrix @ np.array([x for _, x in found]) >= np.array(demand) - 1e-6).all()
