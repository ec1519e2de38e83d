import random
import re

import numpy as np
import pytest

from docloom.llm import leaks
from docloom.llm.leaks import LeakSettings, tiles

W = [f"word{k}" for k in range(300)]


def runs(t, n=12):
    w = re.findall(r"[a-z0-9]+", (t or "").lower())
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def data():
    rng = random.Random(6)
    passages = [(k, " ".join(rng.choices(W, k=rng.randint(14, 60)))) for k in range(1, 25)] + [(90, None), (91, ""), (92, "too short to match")]
    docs = []
    for k in range(1, 200):
        w = rng.choices(W, k=rng.randint(0, 120))
        if k % 3 == 0:
            p = rng.choice(passages[:24])[1].split()
            a = rng.randrange(len(p))
            part = p[a : a + rng.randint(5, 40)]
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() if rng.random() < 0.5 else x + rng.choice(["", ",", "."]) for x in part]
        docs.append((k, " ".join(w)))
    return docs, passages


def frames(spark, docs, passages):
    return spark.createDataFrame([(*d, 1, "x") for d in docs], "doc long, text string, item long, words string"), spark.createDataFrame([(*p, 2) for p in passages], "item long, text string, doc long")


@pytest.mark.parametrize("bound", [4_000_000, 0])
def test_equal_to_brute_force(spark, bound):
    docs, passages = data()
    d, p = frames(spark, [*docs, docs[5], (None, docs[5][1]), (800, None), (801, "")], [*passages, passages[0]])
    got = leaks.leaks(d, p, LeakSettings(broadcast_words=bound)).collect()
    want = {(i, j) for i, t in docs for j, q in passages if runs(t) & runs(q)}
    assert want and {(r.doc, r.item) for r in got if r.longest >= 12} == want
    assert len(got) == len({(r.doc, r.item) for r in got}) and all(r.longest >= 6 and r.covered >= r.longest and r.covered <= r.words for r in got)


def test_reordered_passage_is_caught_by_coverage(spark):
    p = [f"p{k}" for k in range(40)]
    shuffled = " ".join(w for a in (32, 8, 24, 0, 16) for w in p[a : a + 8])
    d, q = frames(spark, [(1, shuffled), (2, " ".join(p[:11]))], [(5, " ".join(p))])
    got = [(r.doc, r.longest, r.tiles, r.covered) for r in leaks.leaks(d, q).collect()]
    assert got == [(1, 8, 5, 40)]


def test_tiles_mark_the_longest_first_without_overlap():
    text, item = "a b c d e f g x a b c d e f".split(), "a b c d e f g h a b c d e f".split()
    n = 3
    pairs = [(i, j) for i in range(len(item) - n + 1) for j in range(len(text) - n + 1) if item[i : i + n] == text[j : j + n]]
    found = tiles(np.array([i for i, _ in pairs]), np.array([j for _, j in pairs]), n)
    assert found == [(0, 0, 7), (8, 8, 6)]


def test_empty_sides_and_long_text(spark):
    docs, passages = data()
    d, p = frames(spark, [], passages)
    assert leaks.leaks(d, p).count() == 0
    d, p = frames(spark, docs, [])
    assert leaks.leaks(d, p).count() == 0
    long = " ".join(random.Random(2).choices(W, k=200_000)) + " " + passages[0][1]
    d, p = frames(spark, [(1, long)], passages[:1])
    assert [(r.doc, r.item) for r in leaks.leaks(d, p).collect()] == [(1, 1)]
