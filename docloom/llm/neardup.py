"""Problem 1: near-duplicate records by banded minhash signatures and sequential Bayesian verification.

1. Every record becomes the set of its runs of three words (64-bit hashes), a 128-bit fingerprint of that set and a
   signature of ``bands * rows`` minhashes of 16 bits. Records with equal sets form one class; only its representative
   (smallest id) goes on, so a group of copies costs one row, however large it is.
2. Representatives meet where all minhashes of a band agree. At similarity s a pair is missed with (1 - s**rows)**bands,
   1.5e-4 at 0.7. A bucket with more than ``hot`` representatives isn't paired; its members meet by an exact prefix join
   instead, which loses no pair: of each set, sorted by how rare its runs are among such members, as many runs are
   joined as a partner must share one of. What a hot bucket has in common is frequent there and so isn't joined on.
3. Candidate pairs compare their signatures in batches. After n minhashes of which m agree, a pair is dropped if the
   posterior probability that its similarity reaches the threshold (uniform prior) is below ``miss``.
4. Survivors are verified exactly on the word sets of the whole texts.

Groups need no list of all pairs: first every member of a bucket, hot or not, is compared with the bucket's smallest
representative only; what these verified links connect is one group, and only buckets that more than one group still
meets in are paired, between groups. So n near-equal records cost n candidates a band.

All stages are equi-joins on hash keys; a key with very many rows is spread over salts; no stage depends on the number
of rows, and nothing but counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import words
from docloom.llm.canonical import field_key, plain_key
from docloom.llm.components import components
from docloom.runtime import materialize


@dataclass(frozen=True)
class Settings:
    """``shingle`` words a run, a pair counts from ``threshold`` on; ``bands`` times ``rows`` minhashes; members of buckets over ``hot`` meet by the prefix join; a key over ``salt`` rows is spread; ``batch`` minhashes are compared at a time and ``miss`` is the posterior below which a pair is dropped."""

    shingle: int = 5
    threshold: Fraction = Fraction(4, 5)
    bands: int = 32
    rows: int = 4
    hot: int = 128
    salt: int = 4096
    batch: int = 16
    miss: float = 1e-4
    word_extra: str = "_"

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def least_matches(settings: Settings) -> list[int]:
    """For each batch end n: the fewest agreeing minhashes m with P(similarity >= threshold | m of n) >= miss. With a uniform prior the posterior is Beta(m+1, n-m+1), whose upper tail at t is P(Binomial(n+1, t) <= m)."""
    t, out = float(settings.threshold), []
    for n in range(settings.batch, settings.hashes + 1, settings.batch):
        total, m = 0.0, -1
        while total < settings.miss:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def signatures(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """(len(starts), n) minhashes of 16 bits of the sets that begin at ``starts``."""
    a, b = _multipliers(n)
    out = np.empty((len(starts), n), np.uint16)
    step = 1 << 15  # the hashes of a few sets at a time stay in the cache
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + step)))
        end = starts[hi] if hi < len(starts) else len(hashes)
        part, at = hashes[starts[lo] : end], starts[lo:hi] - starts[lo]
        for k in range(n):
            least = np.minimum.reduceat(part * a[k] + b[k], at)
            out[lo:hi, k] = (words.mix(least) & np.uint64(0xFFFF)).astype(np.uint16)
        lo = hi
    return out


def _word_sets(texts: pa.Array, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    word, text, _, _ = words.words(texts, words.word_class(settings.word_extra))
    hashes, at = words.shingles(word, text, settings.shingle)
    return words.sets(hashes, text[at])


def _sign(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in words.slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                hashes, text = _word_sets(part.column("text"), settings)
                if not len(hashes):
                    continue
                starts = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
                rows = pa.array(text[starts])
                sums = [np.add.reduceat(words.mix(hashes ^ np.uint64(seed)), starts).view(np.int64) for seed in (0x51ED270B, 0x7F4A7C15)]
                sig = signatures(hashes, starts, settings.hashes)
                size = np.diff(np.append(starts, len(hashes))).astype(np.int32)
                blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * settings.hashes), len(sig), [None, pa.py_buffer(sig.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(rows) for c in ("kind", "item", "digest")), pa.array(sums[0]), pa.array(sums[1]), pa.array(size), blob],
                    names=["kind", "item", "digest", "set1", "set2", "size", "sig"],
                )

    return run


def _sig_matrix(column: pa.Array, settings: Settings) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), settings.hashes)


def _band_keys(sig: np.ndarray, kind: np.ndarray, settings: Settings) -> np.ndarray:
    """(records, bands) keys; the kind of record and the band are part of a key."""
    keys = np.zeros((len(sig), settings.bands), np.uint64)
    parts = sig.reshape(len(sig), settings.bands, settings.rows)
    for r in range(settings.rows):
        keys = words.mix(keys * np.uint64(0x9FB21C651E98DF25) + parts[:, :, r].astype(np.uint64) + np.uint64(1))
    return words.mix(keys + np.arange(1, settings.bands + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F) + kind[:, None].astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))


def _low(keys: np.ndarray) -> np.ndarray:
    """32 bits of a key."""
    return (keys >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _band(settings: Settings):
    """(key, prev, kind, rep, size, place): a row for each band; ``prev`` is of the band before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = _band_keys(_sig_matrix(batch.column("sig"), settings), batch.column("kind").to_numpy(), settings)
                prev = np.zeros(keys.shape, np.int32)
                prev[:, 1:] = _low(keys[:, :-1])
                at = pa.array(np.repeat(np.arange(len(keys)), settings.bands))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(prev.ravel()), batch.column("kind").take(at), batch.column("rep").take(at)], names=["key", "prev", "kind", "rep"])

    return run


#: Counts by which runs of words are sorted: a table of fixed size. Any order gives the same pairs; a good one gives few candidates.
COUNT_BITS = 20


def _count_runs(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            for lo, hi in words.slices(batch.column("text")):
                hashes, _ = _word_sets(batch.column("text").slice(lo, hi - lo), settings)
                held += np.bincount((hashes >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=1 << COUNT_BITS)
        full = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(held[full])], names=["bucket", "n"])

    return run


def _prefix(settings: Settings, counts):
    """(key, prev, kind, rep, size, place): the rarest runs of each set, one more than a partner at the threshold can lack; ``prev`` is of the run before."""
    num, den = settings.threshold.numerator, settings.threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in words.slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                hashes, text = _word_sets(part.column("text"), settings)
                if not len(hashes):
                    continue
                often = counts.value[(hashes >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
                order = np.lexsort((hashes, often, text))
                hashes, text = hashes[order], text[order]
                start = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
                size = np.diff(np.append(start, len(hashes)))
                owner = np.repeat(np.arange(len(start)), size)
                place = np.arange(len(hashes)) - start[owner]
                keep = place < (size - -(-size * num // den) + 1)[owner]
                prev = np.concatenate((np.zeros(1, np.uint64), hashes[:-1]))
                prev[start] = 0
                at = pa.array(text[keep])
                kind = part.column("kind").to_numpy()[text[keep]].astype(np.uint64)
                keys = words.mix(hashes[keep] ^ words.mix(kind + np.uint64(0x3C6EF372)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(_low(prev[keep])), part.column("kind").take(at), part.column("rep").take(at), pa.array(size[owner[keep]].astype(np.int32)), pa.array(place[keep].astype(np.int32))],
                    names=["key", "prev", "kind", "rep", "size", "place"],
                )

    return run


def _compare(settings: Settings):
    least = least_matches(settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (_sig_matrix(batch.column(c), settings) for c in ("sig_a", "sig_b"))
            alive, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for k, m in enumerate(least):
                cols = slice(k * settings.batch, (k + 1) * settings.batch)
                matches = matches + (left[alive, cols] == right[alive, cols]).sum(axis=1)
                keep = matches >= m
                alive, matches = alive[keep], matches[keep]
                if not len(alive):
                    break
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(alive)) for c in ("kind", "rep_a", "rep_b")], names=["kind", "rep_a", "rep_b"])

    return run


def _verify(settings: Settings):
    num, den = settings.threshold.numerator, settings.threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in words.slices(batch.column("text_a"), 2 << 20):
                part = batch.slice(lo, hi - lo)
                (ha, ta), (hb, tb) = (_word_sets(part.column(c), settings) for c in ("text_a", "text_b"))
                n = part.num_rows
                sizes = np.bincount(ta, minlength=n) + np.bincount(tb, minlength=n)
                both_h, both_t = np.concatenate((ha, hb)), np.concatenate((ta, tb))
                order = np.lexsort((both_h, both_t))
                both_h, both_t = both_h[order], both_t[order]
                twice = (both_h[1:] == both_h[:-1]) & (both_t[1:] == both_t[:-1])
                shared = np.bincount(both_t[1:][twice], minlength=n)
                union = sizes - shared
                keep = np.flatnonzero((shared * den >= union * num) & (union > 0))
                rows = pa.array(keep)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(rows) for c in ("kind", "rep_a", "rep_b")), pa.array(shared[keep] / np.maximum(union[keep], 1))],
                    names=["kind", "rep_a", "rep_b", "similarity"],
                )

    return run


@dataclass(frozen=True)
class Links:
    """``members``: kind, item, rep (the smallest item of the records with the same set). ``pairs``: kind, rep_a < rep_b, similarity of every two representatives at or over the threshold."""

    members: DataFrame
    pairs: DataFrame


@dataclass(frozen=True)
class Signed:
    """``records``: kind, item, digest, text in lower case. ``members``: kind, item, rep. ``reps``: kind, rep, digest, sig. ``buckets``: key, prev, kind, rep, n (members of the bucket), of buckets of two and more."""

    records: DataFrame
    members: DataFrame
    reps: DataFrame
    buckets: DataFrame
    settings: Settings


#: Ids with differing texts up to which they are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 50_000


def _one_text(signed: DataFrame) -> DataFrame:
    """Rows of the smallest digest of each id. Only ids are aggregated; signatures move only if there are ids with differing texts."""
    differing = signed.groupBy("kind", "item").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).filter("least < most")
    differing = materialize(differing.select("kind", "item", "least"), "p1-differing")
    n = differing.count()
    if not n:
        return signed
    small = F.broadcast(differing) if n <= BROADCAST_ROWS else differing
    return signed.join(small, ["kind", "item"], "left").filter("least IS NULL OR digest = least").drop("least")


def sign(records: DataFrame, settings: Settings) -> Signed:
    """Classes, signatures and buckets of ``records`` (kind, item, text)."""
    lowered = records.select(F.col("kind").cast("int"), F.col("item").cast("long"), F.lower("text").alias("text")).filter("kind IS NOT NULL AND item IS NOT NULL")
    lowered = lowered.withColumn("digest", F.xxhash64("text"))
    signed = lowered.mapInArrow(_sign(settings), "kind int, item long, digest long, set1 long, set2 long, size int, sig binary")
    signed = _one_text(materialize(signed, "p1-signatures"))
    same = ["kind", "set1", "set2", "size"]
    reps = materialize(signed.groupBy(*same).agg(F.min("item").alias("rep"), F.min_by("digest", "item").alias("digest"), F.min("sig").alias("sig")), "p1-classes")
    members = signed.select(*same, "item").distinct().join(reps.select(*same, "rep"), same).select("kind", "item", "rep")
    reps = reps.select("kind", "rep", "digest", "sig")
    keys = reps.mapInArrow(_band(settings), "key long, prev int, kind int, rep long")
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return Signed(lowered, members, reps, materialize(keys.join(counts, "key"), "p1-buckets"), settings)


def _paired(rows: DataFrame, settings: Settings, when: Column | None = None) -> DataFrame:
    """(kind, rep_a, rep_b) of all rows (key, prev, kind, rep, n, ...) with equal keys; ``when`` is a further condition on the columns with _a and _b. A pair whose previous keys agree met there already and isn't emitted again. The rows of a large key meet in many tasks: one side is spread over salts, the other repeated for each."""
    salts = F.ceil(F.col("n") / settings.salt).cast("int")
    names = [c for c in rows.columns if c not in ("key", "kind", "n")]
    left = rows.withColumn("salt", F.pmod(F.xxhash64("rep"), salts).cast("int")).select("key", "salt", "kind", *[F.col(c).alias(f"{c}_a") for c in names])
    right = rows.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).select("key", "salt", *[F.col(c).alias(f"{c}_b") for c in names])
    fresh = (F.col("rep_a") < F.col("rep_b")) & ((F.col("prev_a") != F.col("prev_b")) | (F.col("prev_a") == 0))
    return left.join(right, ["key", "salt"]).filter(fresh if when is None else fresh & when).select("kind", "rep_a", "rep_b")


def _prefix_rows(signed: Signed) -> DataFrame | None:
    """(key, prev, kind, rep, size, place, n) for the prefix join of the members of hot buckets; None where no bucket is hot."""
    settings = signed.settings
    hot = materialize(signed.buckets.filter(F.col("n") > settings.hot).select("kind", "rep").distinct(), "p1-hot")
    if not hot.limit(1).count():
        return None
    wanted = hot.join(signed.reps.select("kind", "rep", "digest"), ["kind", "rep"])
    texts = signed.records.withColumnRenamed("item", "rep").join(wanted, ["kind", "rep", "digest"], "left_semi").dropDuplicates(["kind", "rep"])
    texts = materialize(texts.select("kind", "rep", "text"), "p1-hot-texts")
    table = texts.mapInArrow(_count_runs(settings), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << COUNT_BITS, np.int64)
    counts[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    shared = hot.sparkSession.sparkContext.broadcast(counts)
    rows = materialize(texts.mapInArrow(_prefix(settings, shared), "key long, prev int, kind int, rep long, size int, place int"), "p1-prefixes")
    several = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(several, "key")


def _near_enough(settings: Settings) -> Column:
    """Whether two sets that share this run, and none before it, can share as many as the threshold asks for."""
    num, den = settings.threshold.numerator, settings.threshold.denominator
    most = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    return most * (num + den) >= (F.col("size_a") + F.col("size_b")) * num


def candidates(signed: Signed, group: DataFrame | None = None) -> DataFrame:
    """(kind, rep_a, rep_b): pairs that meet in a bucket or, where it is hot, by the prefix join; with ``group`` (kind, rep, group) only pairs of different groups, from keys that several groups share."""
    prefixes = _prefix_rows(signed)
    if group is None:
        found = _paired(signed.buckets.filter(F.col("n") <= signed.settings.hot), signed.settings)
        if prefixes is not None:
            found = found.unionByName(_paired(prefixes, signed.settings, _near_enough(signed.settings)))
        return found.distinct()

    def mixed(rows: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
        rows = rows.join(group, ["kind", "rep"])
        several = rows.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low <> high").select("key")
        return materialize(rows.join(several, "key").select("key", "prev", "kind", "rep", "n", "group", *extra), "p1-mixed")

    apart = F.col("group_a") != F.col("group_b")
    found = _paired(mixed(signed.buckets.filter(F.col("n") <= signed.settings.hot)), signed.settings, apart)
    if prefixes is not None:
        found = found.unionByName(_paired(mixed(prefixes, ("size", "place")), signed.settings, apart & _near_enough(signed.settings)))
    return found.distinct()


def verified(signed: Signed, pairs: DataFrame) -> DataFrame:
    """(kind, rep_a, rep_b, similarity) of the candidate pairs at or over the threshold: signatures in batches, then whole texts."""
    settings = signed.settings
    sig = signed.reps.select("kind", "rep", "sig")
    with_sig = pairs.join(sig.select("kind", F.col("rep").alias("rep_a"), F.col("sig").alias("sig_a")), ["kind", "rep_a"])
    with_sig = with_sig.join(sig.select("kind", F.col("rep").alias("rep_b"), F.col("sig").alias("sig_b")), ["kind", "rep_b"])
    alive = materialize(with_sig.mapInArrow(_compare(settings), "kind int, rep_a long, rep_b long"), "p1-alive")
    wanted = alive.select("kind", F.col("rep_a").alias("rep")).unionByName(alive.select("kind", F.col("rep_b").alias("rep"))).distinct()
    wanted = wanted.join(signed.reps.select("kind", "rep", "digest"), ["kind", "rep"])
    texts = signed.records.select("kind", F.col("item").alias("rep"), "digest", "text").join(wanted, ["kind", "rep", "digest"], "left_semi").dropDuplicates(["kind", "rep"])
    texts = materialize(texts, "p1-texts")
    both = alive.join(texts.select("kind", F.col("rep").alias("rep_a"), F.col("text").alias("text_a")), ["kind", "rep_a"])
    both = both.join(texts.select("kind", F.col("rep").alias("rep_b"), F.col("text").alias("text_b")), ["kind", "rep_b"])
    return materialize(both.mapInArrow(_verify(settings), "kind int, rep_a long, rep_b long, similarity double"), "p1-pairs")


def link(records: DataFrame, settings: Settings | None = None) -> Links:
    """Links of ``records`` (kind int, item long, text string; ids are unique within a kind, kinds are compared apart).

    Defined cases: a null, empty or short text has no set, is no member and matches nothing; a row without an id takes no
    part; a repeated id counts once, with the text of the smallest hash if they differ; the set of a long text covers
    all of it; ties don't arise, as every pair at or over the threshold comes out; an empty table gives empty results;
    other columns are ignored."""
    signed = sign(records, settings or Settings())
    pairs = materialize(candidates(signed), "p1-candidates")
    return Links(signed.members, verified(signed, pairs))


def groups(records: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(kind, item, class, group, copies): one row for each record with a set. ``class`` is the smallest id with the same set, ``copies`` the number of records of the class, ``group`` the smallest id that links at or over the threshold lead to, of any length. The defined cases are those of ``link``."""
    signed = sign(records, settings or Settings())
    members = materialize(signed.members, "p1-members")
    sizes = materialize(members.groupBy("kind", F.col("rep").alias("node")).agg(F.count(F.lit(1)).alias("copies")), "p1-sizes")
    centres = signed.buckets.groupBy("key").agg(F.min("rep").alias("rep_a"))
    stars = signed.buckets.select("key", "kind", F.col("rep").alias("rep_b")).join(centres, "key").filter("rep_a < rep_b")
    near = verified(signed, materialize(stars.select("kind", "rep_a", "rep_b").distinct(), "p1-stars"))
    first = components(near.select("kind", F.col("rep_a").alias("a"), F.col("rep_b").alias("b")), sizes.select("kind", "node"), ["kind"], "p1-first")
    between = candidates(signed, first.select("kind", F.col("node").alias("rep"), F.col("block").alias("group")))
    far = verified(signed, materialize(between, "p1-between"))
    label = first.select("kind", "node", "block")
    ends = far.join(label.select("kind", F.col("node").alias("rep_a"), F.col("block").alias("a")), ["kind", "rep_a"]).join(label.select("kind", F.col("node").alias("rep_b"), F.col("block").alias("b")), ["kind", "rep_b"])
    blocks = first.select("kind", F.col("block").alias("node")).distinct()
    second = components(ends.select("kind", "a", "b").filter("a <> b").distinct(), blocks, ["kind"], "p1-second")
    found = first.join(second.select("kind", F.col("node").alias("block"), F.col("block").alias("group")), ["kind", "block"]).select("kind", "node", "group")
    classes = found.join(sizes, ["kind", "node"]).withColumnRenamed("node", "rep")
    return members.join(classes, ["kind", "rep"]).select("kind", "item", F.col("rep").alias("class"), "group", "copies")


def record_pairs(links: Links, copies: DataFrame) -> DataFrame:
    """(kind, pk_a, pk_b) of all linked records. ``copies`` (kind, item, plain, fields) holds the formatting keys of records whose pairs don't count when a key is equal.

    Members of a class are first grouped by their keys, so a group of copies takes part as one row and is never paired
    within; what is then expanded is the result itself."""
    group = F.coalesce(F.concat(F.hex("plain"), F.coalesce(F.hex("fields"), F.lit(""))), F.col("item").cast("string"))
    members = links.members.join(copies, ["kind", "item"], "left").withColumn("group", group)
    groups = members.select("kind", "rep", "group", "plain", "fields").distinct()
    several = groups.groupBy("kind", "rep").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    within = several.select("kind", F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b"))

    def side(df: DataFrame, s: str) -> DataFrame:
        return df.select("kind", *[F.col(c).alias(f"{c}_{s}") for c in df.columns if c != "kind"])

    linked = links.pairs.select("kind", "rep_a", "rep_b").unionByName(within)
    linked = linked.join(side(groups, "a"), ["kind", "rep_a"]).join(side(groups, "b"), ["kind", "rep_b"])
    copy = F.coalesce(F.col("plain_a") == F.col("plain_b"), F.lit(False)) | F.coalesce(F.col("fields_a") == F.col("fields_b"), F.lit(False))
    linked = linked.filter(~copy & ((F.col("rep_a") != F.col("rep_b")) | (F.col("group_a") < F.col("group_b"))))
    linked = linked.select("kind", "rep_a", "group_a", "rep_b", "group_b")
    items = members.select("kind", "rep", "group", "item")
    pairs = linked.join(side(items, "a"), ["kind", "rep_a", "group_a"]).join(side(items, "b"), ["kind", "rep_b", "group_b"])
    return pairs.filter("item_a <> item_b").select("kind", F.least("item_a", "item_b").alias("pk_a"), F.greatest("item_a", "item_b").alias("pk_b"))


def _records(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    records = documents.select(F.lit(0).alias("kind"), F.col("pk").alias("item"), F.col("text_content").alias("text"))
    return records.unionByName(chunks.select(F.lit(1).alias("kind"), F.col("pk").alias("item"), "text"))


def _table_name():
    return F.when(F.col("kind") == 0, "document_record").otherwise("chunk_record").alias("rec_table")


def near_groups(documents: DataFrame, chunks: DataFrame, settings: Settings) -> DataFrame:
    """(rec_table, pk, class_pk, group_pk, copies) for ``documents`` (pk, text_content) and ``chunks`` (pk, text)."""
    found = groups(_records(documents, chunks), settings)
    return found.select(_table_name(), F.col("item").alias("pk"), F.col("class").alias("class_pk"), F.col("group").alias("group_pk"), "copies")


def near_pairs(documents: DataFrame, chunks: DataFrame, settings: Settings) -> DataFrame:
    """(rec_table, pk_a, pk_b) for ``documents`` (pk, text_content) and ``chunks`` (pk, text); chunks that are hidden copies of each other are left out."""
    links = link(_records(documents, chunks), settings)
    keys = chunks.select(F.lit(1).alias("kind"), F.col("pk").alias("item"), plain_key(F.col("text")).alias("plain"), field_key(F.col("text")).alias("fields")).dropDuplicates(["kind", "item"])
    links = Links(materialize(links.members, "p1-members"), links.pairs)
    return record_pairs(links, keys).select(_table_name(), "pk_a", "pk_b").distinct()
