import random
import re
from collections import defaultdict

import pytest

from docloom.llm import canonical

SCHEMA = "pk long, text string, hash string, key string, kept long"


def red(t):
    return "".join(c for c in (t or "").lower() if c.isalnum())


def fields(t):
    parts = [p for p in re.split(r"[\n;|]", t or "") if p.strip()]
    if len(parts) >= 3 and all(re.match(r"^[ \t]*[A-Za-z_][A-Za-z_ \t]*:\s*\S", p) for p in parts):
        return tuple(sorted(map(red, parts)))
    return None


def brute(rows):
    text = dict(rows)
    parent = {k: k for k in text}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    groups = defaultdict(list)
    for k, t in text.items():
        groups["p", red(t)].append(k)
        if fields(t):
            groups["f", fields(t)].append(k)
    for ks in groups.values():
        for k in ks[1:]:
            a, b = sorted((root(ks[0]), root(k)))
            parent[b] = a
    return {(root(k), k) for k in text if root(k) != k}


def rows():
    rng, out = random.Random(4), []
    for k in range(1, 200):
        if k % 3:
            words = rng.choices(["Alpha", "beta", "Gämma", "delta9", "漢字"], k=rng.randint(0, 3))
            out.append((k, rng.choice([" ", "  ", ", ", "-"]).join(w.upper() if rng.random() < 0.3 else w for w in words)))
        else:
            parts = [f"{n} : {v}" for n, v in zip(("owner", "module path", "since_x"), rng.choices(["a", "b"], k=3))]
            rng.shuffle(parts)
            out.append((k, rng.choice(["\n", " ; ", "|"]).join(parts)))
    # one text that is no field record but equal to one when reduced, linking two orders
    return [*out, (900, "a: x\nb: y\nc: z"), (901, "c: z\nb: y\na: x"), (902, "c z, b y, a x"), (903, None), (904, "...")]


def frame(spark, rs):
    return spark.createDataFrame([(*r, "h", "k", 5) for r in rs], SCHEMA)


def test_equal_to_brute_force(spark):
    rs = rows()
    got = [tuple(r) for r in canonical.hidden_copies(frame(spark, [*rs, rs[0], rs[7], (None, "alpha")])).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rs)
    assert {k for g, k in got if g == 900} == {901, 902}


def test_batches_give_the_same_ledger(spark):
    rs = rows()
    sizes = {}
    for batches in (1, 3):
        ledger = canonical.collapse(frame(spark, rs), batches=batches)
        sizes[batches] = sorted({(r.kept, r.copies) for r in ledger.groups().collect()})
    assert sizes[1] == sizes[3] and sum(n for _, n in sizes[1]) == len(rs)


def keys(spark, xs):
    return spark.createDataFrame([(i, bytearray(p), None if f is None else bytearray(f)) for i, p, f in xs], "item long, plain binary, fields binary")


def state(ledger):
    return {(bytes(r.plain), r.copies, r.kept) for r in ledger.groups().collect()}


def test_ledger_adds_counts_and_keeps_the_earliest(spark, tmp_path):
    ledger = canonical.Ledger(spark, f"file://{tmp_path}", buckets=4)
    assert ledger.update(keys(spark, [(5, b"a", None), (6, b"a", None), (9, b"b", None)]), "one")
    before = ledger._version()[1]["tables"]["counts"]["at"]
    assert ledger.update(keys(spark, [(2, b"a", None)]), "two") and ledger.update(keys(spark, []), "none")
    assert state(ledger) == {(b"a", 3, 2), (b"b", 1, 9)}
    after = ledger._version()[1]["tables"]["counts"]["at"]
    assert sum(before[b] != after[b] for b in before) == 1  # only the bucket that the batch touched


def test_ledger_reopened_and_batches_or_ids_repeated(spark, tmp_path):
    path = f"file://{tmp_path}"
    first = [(1, b"a", None), (2, b"a", None), (3, b"b", None), (3, b"c", None)]
    assert canonical.Ledger(spark, path).update(keys(spark, first), "one")
    again = canonical.Ledger(spark, path)
    assert state(again) == {(b"a", 2, 1), (b"b", 1, 3)}
    assert not again.update(keys(spark, first), "one")
    assert again.update(keys(spark, [*first, (4, b"a", None)]), "same ids under another name")
    assert state(canonical.Ledger(spark, path)) == {(b"a", 3, 1), (b"b", 1, 3)}


def test_late_record_links_groups_of_earlier_batches(spark, tmp_path):
    ledger = canonical.Ledger(spark, f"file://{tmp_path}", buckets=2)
    ledger.update(keys(spark, [(1, b"p1", b"f1"), (2, b"p2", b"f2"), (3, b"p3", b"f3"), (4, b"p4", None)]), "one")
    assert len({bytes(r.group) for r in ledger.groups().collect()}) == 4
    ledger.update(keys(spark, [(5, b"p1", b"f2")]), "joins the first two")
    assert {(bytes(r.plain), r.copies, r.kept) for r in ledger.groups().collect()} == {(b"p1", 3, 1), (b"p2", 3, 1), (b"p3", 1, 3), (b"p4", 1, 4)}
    ledger.update(keys(spark, [(6, b"p3", b"f2"), (7, b"p9", b"f9")]), "and the third")
    ledger.update(keys(spark, [(8, b"p9", b"f1")]), "and one more")
    got = {bytes(r.plain): (r.copies, r.kept) for r in ledger.groups().collect()}
    assert got == {b"p1": (7, 1), b"p2": (7, 1), b"p3": (7, 1), b"p9": (7, 1), b"p4": (1, 4)}


def test_second_writer_is_told(spark, tmp_path, monkeypatch):
    ledger = canonical.Ledger(spark, f"file://{tmp_path}")
    ledger.update(keys(spark, [(1, b"a", None)]), "one")
    stale = ledger._version()
    ledger.update(keys(spark, [(2, b"a", None)]), "two")
    monkeypatch.setattr(ledger, "_version", lambda: stale)
    with pytest.raises(canonical.LedgerConflict):
        ledger.update(keys(spark, [(3, b"a", None)]), "three")
    assert state(canonical.Ledger(spark, f"file://{tmp_path}")) == {(b"a", 2, 1)}


def test_buckets_grow_with_the_rows(spark, tmp_path):
    ledger = canonical.Ledger(spark, f"file://{tmp_path}", buckets=2, bucket_rows=50, folders=2)
    for k in range(3):
        ledger.update(keys(spark, [(k * 300 + j, f"k{k}-{j // 2}".encode(), None) for j in range(300)]), f"batch {k}")
    tables = ledger._version()[1]["tables"]
    assert tables["items"]["buckets"] == 32 and tables["counts"]["buckets"] >= 16
    assert ledger.tidy() > 0
    assert len(state(ledger)) == 450 and all(n == 2 for _, n, _ in state(ledger)) and ledger.read("items").count() == 900


def test_hot_group_and_empty(spark):
    rs = [(k, "Same  TEXT" if k % 2 else "same-text!") for k in range(1, 3001)] + [(5000 + k, f"own {k}") for k in range(1000)]
    got = canonical.hidden_copies(frame(spark, rs))
    assert got.count() == 2999 and got.select("kept_pk").distinct().collect()[0][0] == 1
    assert canonical.hidden_copies(frame(spark, [])).count() == 0


def test_long_prose_with_colons_is_quick(spark):
    text = ("some words without any mark " * 4000) + "name: value\n" * 2000
    assert canonical.hidden_copies(frame(spark, [(1, text), (2, text.upper())])).count() == 1
