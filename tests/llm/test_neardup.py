import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from docloom.llm import neardup, words

W = [f"w{k}" for k in range(400)]


def shingled(text, n):
    w = re.findall(r"[a-z0-9_]+", (text or "").lower())
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def brute(rows, n, t):
    sets = {i: shingled(x, n) for i, x in rows}
    ids = sorted(i for i in sets if sets[i])
    return {(a, b) for a in ids for b in ids if a < b and Fraction(len(sets[a] & sets[b]), len(sets[a] | sets[b])) >= t}


def versions(seed, groups=12, each=5, size=90):
    rng, rows, k = random.Random(seed), [], 1
    for _ in range(groups):
        base = rng.choices(W, k=size)
        for _ in range(each):
            w = list(base)
            for _ in range(rng.randint(0, 14)):
                at = rng.randrange(len(w))
                match rng.randint(0, 2):
                    case 0:
                        w[at] = rng.choice(W)
                    case 1:
                        w.insert(at, rng.choice(W))
                    case _:
                        del w[at]
            rows.append((k, " ".join(w)))
            k += 1
    return rows


def linked(spark, rows, settings, kind=0):
    df = spark.createDataFrame([(kind, i, t, "x") for i, t in rows], "kind int, item long, text string, rep string")
    return neardup.link(df, settings)


@pytest.mark.parametrize("n,t", [(3, Fraction(7, 10)), (5, Fraction(4, 5))])
def test_pairs_equal_brute_force(spark, n, t):
    rows = versions(n)
    links = linked(spark, rows, neardup.Settings(shingle=n, threshold=t))
    rep = {r.item: r.rep for r in links.members.collect()}
    pairs = {(r.rep_a, r.rep_b) for r in links.pairs.collect()}
    want = brute(rows, n, t)
    assert want and {(min(rep[a], rep[b]), max(rep[a], rep[b])) for a, b in want if rep[a] != rep[b]} == pairs
    assert all(rep[a] == rep[b] or (min(rep[a], rep[b]), max(rep[a], rep[b])) in pairs for a, b in want)


SEVEN = Fraction(7, 10)


@pytest.mark.parametrize("hot,salt", [(4, 4096), (2, 3)])
def test_hot_buckets_lose_no_pair(spark, hot, salt):
    """Versions of one text, and texts that share two thirds of their words but little more."""
    rng = random.Random(3)
    shared = " ".join(rng.choices(W, k=120))
    rows = versions(7, groups=1, each=50, size=200)
    rows += [(100 + k, shared + " " + " ".join(rng.choices(W, k=60))) for k in range(60)]
    links = linked(spark, rows, neardup.Settings(shingle=3, threshold=SEVEN, hot=hot, salt=salt))
    rep = {r.item: r.rep for r in links.members.collect()}
    want = {tuple(sorted((rep[a], rep[b]))) for a, b in brute(rows, 3, SEVEN) if rep[a] != rep[b]}
    assert len(want) > 300 and {(r.rep_a, r.rep_b) for r in links.pairs.collect()} == want


def test_large_ids_are_kept(spark):
    top = (1 << 63) - 10
    rows = [(top + k, t) for k, (_, t) in enumerate(versions(5, groups=1, each=6))]
    links = linked(spark, rows, neardup.Settings(shingle=3, threshold=SEVEN))
    rep = {r.item: r.rep for r in links.members.collect()}
    assert {(r.rep_a, r.rep_b) for r in links.pairs.collect()} == {tuple(sorted((rep[a], rep[b]))) for a, b in brute(rows, 3, SEVEN) if rep[a] != rep[b]}


def test_groups_of_near_equal_pages_need_no_list_of_all_pairs(spark, monkeypatch):
    base = " ".join(W[:150])
    rows = [(k, f"{base} page {k}") for k in range(1, 3001)] + [(5000, " ".join(W[200:300]))]
    asked = []
    real = neardup.verified
    monkeypatch.setattr(neardup, "verified", lambda signed, pairs: (asked.append(pairs.count()), real(signed, pairs))[1])
    df = spark.createDataFrame([(0, k, t) for k, t in rows], "kind int, item long, text string")
    got = {r.item: r.group for r in neardup.groups(df, neardup.Settings(shingle=3, threshold=SEVEN)).collect()}
    assert got == {**dict.fromkeys(range(1, 3001), 1), 5000: 5000}
    assert sum(asked) < 40 * len(rows)


def test_groups_equal_brute_force(spark):
    rows = versions(11, groups=8, each=7) + [(500 + k, t) for k, (_, t) in enumerate(versions(11, groups=8, each=2))]
    df = spark.createDataFrame([(0, k, t) for k, t in rows], "kind int, item long, text string")
    for hot in (128, 3):
        got = {r.item: r.group for r in neardup.groups(df, neardup.Settings(shingle=3, threshold=SEVEN, hot=hot)).collect()}
        want = {k: k for k, _ in rows}
        links = brute(rows, 3, SEVEN)
        while any(want[a] != want[b] for a, b in links):
            for a, b in links:
                want[a] = want[b] = min(want[a], want[b])
        assert got == want


def test_copies_are_one_class_and_nulls_match_nothing(spark):
    text = " ".join(W[:50])
    rows = [(k, text) for k in range(1, 41)] + [(50, None), (51, ""), (52, "a b"), (53, text.upper()), (1, text)]
    links = linked(spark, rows, neardup.Settings())
    members = {r.item: r.rep for r in links.members.collect()}
    assert members == {k: 1 for k in [*range(1, 41), 53]}
    assert links.pairs.count() == 0


def test_groups_follow_links_of_any_length(spark):
    base = W[:100]
    chain = [(10 - k, " ".join([*base[6 * k :], *(f"n{j}" for j in range(6 * k))])) for k in range(6)]  # each like the next, ends unlike
    rows = [*chain, (20, chain[0][1]), (30, "some other words that nobody else has at all"), (31, None)]
    settings = neardup.Settings(shingle=3, threshold=Fraction(7, 10))
    df = spark.createDataFrame([(0, k, t, "x") for k, t in rows], "kind int, item long, text string, rep string")
    got = {r.item: r for r in neardup.groups(df, settings).collect()}
    want = brute(rows, 3, Fraction(7, 10))
    assert (5, 10) not in want and set(got) == {5, 6, 7, 8, 9, 10, 20, 30}
    assert {got[k].group for k in (5, 6, 7, 8, 9, 10, 20)} == {5} and got[30].group == 30
    assert got[20]["class"] == 10 and got[10].copies == 2


@pytest.mark.parametrize("bound", [50_000, 0])
def test_differing_deliveries_count_once(spark, monkeypatch, bound):
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", bound)
    a, b = " ".join(W[:60]), " ".join(W[100:160])
    links = linked(spark, [(1, a), (1, b), (2, a), (3, b)], neardup.Settings())
    rep = {r.item: r.rep for r in links.members.collect()}
    assert links.members.count() == 3 and (rep[1] == rep[2]) != (rep[1] == rep[3])


def test_empty_table_and_long_text(spark):
    empty = spark.createDataFrame([], "kind int, item long, text string")
    links = neardup.link(empty)
    assert links.members.count() == 0 and links.pairs.count() == 0
    long = " ".join(random.Random(1).choices(W, k=60_000))
    links = linked(spark, [(1, long), (2, long + " tail of it"), (3, "other words than those at all here")], neardup.Settings())
    assert [(r.rep_a, r.rep_b) for r in links.pairs.collect()] == [(1, 2)]


def test_chunk_copies_are_left_out_but_their_partners_kept(spark):
    base = " ".join(W[:60])
    near = " ".join([*W[:59], "changed"])
    docs = spark.createDataFrame([(1, base), (2, base)], "pk long, text_content string")
    chunks = spark.createDataFrame([(1, base), (2, base.upper().replace(" ", "  ")), (3, near)], "pk long, text string")
    got = {tuple(r) for r in neardup.near_pairs(docs, chunks, neardup.Settings(shingle=3, threshold=Fraction(7, 10))).collect()}
    assert got == {("document_record", 1, 2), ("chunk_record", 1, 3), ("chunk_record", 2, 3)}


def test_least_matches_is_monotonous_and_safe():
    s = neardup.Settings(shingle=3, threshold=Fraction(7, 10))
    least = neardup.least_matches(s)
    assert least == sorted(least) and least[-1] < 0.7 * s.hashes


def test_word_hashes_equal_regex():
    texts = pa.array(["Ab c_d1 é x", None, "", "..a", "b" * 700_000 + " c", "a b"])
    word, text, start, end = words.words(pa.array([None if t is None else t.lower() for t in texts.to_pylist()]), words.word_class("_"))
    flat = [(k, m) for k, t in enumerate(texts.to_pylist()) for m in re.findall(r"[a-z0-9_]+", (t or "").lower())]
    assert text.tolist() == [k for k, _ in flat] and len(word) == len(flat)
    seen = {}
    assert all(seen.setdefault(m, h) == h for (_, m), h in zip(flat, word)) and len(set(seen.values())) == len(seen)
    assert (np.diff(start) > 0).all() and (end > start).all()


def test_slices_of_sliced_columns():
    texts = pa.array(["ab", None, "c" * 50, "", "de"])
    for part in (texts, texts.slice(2), texts.slice(1, 3), texts.slice(0, 0)):
        cuts = words.slices(part, 10)
        assert [k for lo, hi in cuts for k in range(lo, hi)] == list(range(len(part)))
