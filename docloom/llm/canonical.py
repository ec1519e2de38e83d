"""Problem 6: duplicates hidden by formatting, collapsed through an incremental ledger of canonical keys.

The ledger is a set of tables bucketed by key: ``counts`` has for each canonical key the number of copies seen and the
earliest representative. A batch is first rid of ids that the ledger has already, then aggregated by key (map-side, so a
key that holds a third of all rows leaves each task as one row), then full-outer-joined with the matching buckets; counts
are added and the smaller representative stays.

Keys. ``plain`` is the text in lower case without anything but letters and digits of any script. A field record (three
or more non-blank parts between line feeds, semicolons and bars, each a name, a colon and a value) has also ``fields``:
its parts, reduced in the same way and sorted. Records with equal ``plain`` or equal ``fields`` are copies, and so are
records linked through others. Keys are 128-bit hashes. Which keys are linked is kept in the ledger too (``nodes``,
``merged``), so a record that comes later can join two groups of earlier batches.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.components import components
from docloom.runtime import materialize, scratch

FIELD_PART = r"^[ \t]*[A-Za-z_][A-Za-z_ \t]*:\s*\S"
#: What a field record begins with; it costs one look at the first words of other texts.
FIRST_PART = r"^[\s;|]*[A-Za-z_][A-Za-z_ \t]*:"


def reduced(text: Column) -> Column:
    """Lower case, letters and digits of any script only."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def key128(value: Column) -> Column:
    """A 128-bit key as 16 bytes; null stays null."""
    return F.unhex(F.md5(value.cast("binary")))


def plain_key(text: Column) -> Column:
    """Key of the reduced text. A null counts as an empty text, and texts without letters and digits are copies of each other."""
    return key128(reduced(F.coalesce(text, F.lit(""))))


def field_key(text: Column) -> Column:
    """Key of the sorted reduced parts of a field record; null for any other text."""
    parts = F.filter(F.split(text, r"[\n;|]"), lambda p: p.rlike(r"\S"))
    is_record = (F.size(parts) >= 3) & F.forall(parts, lambda p: p.rlike(FIELD_PART))
    return F.when(text.rlike(FIRST_PART) & is_record, key128(F.concat_ws("\u0000", F.array_sort(F.transform(parts, reduced)))))


class LedgerConflict(RuntimeError):
    """Another writer has added a batch meanwhile; nothing of this one was taken up."""


class Ledger:
    """Counts of canonical keys, kept as versions of four tables under ``path``.

    items: item, plain, the key of every id seen. counts: plain, copies, kept (the smallest id). nodes: node, root, the
    first label of every key that a field record links. merged: root, final, labels that later links made one.

    A version is a file that names the batches it holds and, for each table and bucket, the folders with its rows; it is
    created only when all of these are complete, and never over another, so a lost job or a second writer leaves the last
    version as it was. ``update`` reads the buckets that a batch touches only; of counts it writes these anew, to the
    other tables it adds. A table's buckets are doubled when they hold more than ``bucket_rows`` rows on average, and a table
    is written together when a bucket is spread over more than ``folders`` batches. ``tidy`` deletes what only older
    versions name."""

    TABLES = {"items": "item long, plain binary", "counts": "plain binary, copies long, kept long", "nodes": "node binary, root binary", "merged": "root binary, final binary"}

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, bucket_rows: int = 2_000_000, folders: int = 16) -> None:
        self.spark, self.path, self.buckets, self.bucket_rows, self.folders = spark, path.rstrip("/"), buckets, bucket_rows, folders

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _version(self) -> tuple[int, dict]:
        """(number, content) of the last version; 0 and an empty one before the first."""
        fs, folder = self._fs(f"{self.path}/versions")
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []
        if not names:
            return 0, {"batches": [], "tables": {t: {"buckets": self.buckets, "rows": 0, "at": {}} for t in self.TABLES}}
        return int(names[-1].split(".")[0]), json.loads(self.spark.read.text(f"{self.path}/versions/{names[-1]}", wholetext=True).first()[0])

    def _turn(self, number: int, content: dict) -> None:
        fs, p = self._fs(f"{self.path}/versions/{number:012d}.json")
        try:
            out = fs.create(p, False)
        except Exception as e:
            raise LedgerConflict(f"version {number} is there already") from e
        out.write(bytearray(json.dumps(content).encode()))
        out.close()

    def read(self, table: str, buckets: list[int] | None = None, content: dict | None = None) -> DataFrame:
        """The rows of a table, or of some of its buckets."""
        at = (content or self._version()[1])["tables"][table]["at"]
        paths = [f"{folder}/bucket={b}" for b, folders in at.items() if buckets is None or int(b) in buckets for folder in folders]
        if not paths:
            return self.spark.createDataFrame([], self.TABLES[table])
        return self.spark.read.schema(self.TABLES[table]).parquet(*paths)

    def _write(self, content: dict, table: str, rows: DataFrame, key: str, anew: bool) -> None:
        """Adds ``rows`` to their buckets, or puts them in the place of all that these hold."""
        state = content["tables"][table]
        folder = f"{self.path}/{table}/{uuid.uuid4().hex}"
        # a rebalance by bucket splits what is too large for one task and keeps small buckets in one file
        rows.withColumn("bucket", _bucket(F.col(key), state["buckets"])).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(folder)
        fs, p = self._fs(folder)
        if len([x for x in fs.listStatus(p) if x.isDirectory()]):
            sizes = {r[0]: r[1] for r in self.spark.read.schema(f"{self.TABLES[table]}, bucket int").parquet(folder).groupBy("bucket").count().collect()}  # one row a bucket
            for b in sizes:
                state["at"][str(b)] = [folder] if anew else [*state["at"].get(str(b), []), folder]
            state["rows"] += sum(sizes.values())

    def _touched(self, content: dict, table: str, rows: DataFrame, key: str) -> list[int]:
        """The buckets of ``rows``, at most as many as there are."""
        if not content["tables"][table]["at"]:
            return []
        return [r[0] for r in rows.select(_bucket(F.col(key), content["tables"][table]["buckets"])).distinct().collect()]

    def _grow(self, content: dict, table: str, key: str) -> None:
        """Doubles the buckets of a table until they are small enough, or brings its batches together, by writing it anew."""
        state, rows = content["tables"][table], self.read(table, content=content)
        if state["rows"] <= self.bucket_rows * state["buckets"] and max(map(len, state["at"].values()), default=0) <= self.folders:
            return
        state["rows"] = rows.count()
        while state["rows"] > self.bucket_rows * state["buckets"]:
            state["buckets"] *= 2
        state["at"], state["rows"] = {}, 0
        self._write(content, table, rows, key, True)

    def update(self, batch: DataFrame, name: str) -> bool:
        """Adds a batch (item long, plain, fields) under a name; False, and no change, for a name that the ledger has. Ids that it has count no more, and of ids that come twice in a batch the smallest keys count."""
        number, content = self._version()
        if name in content["batches"]:
            return False
        fresh = batch.groupBy("item").agg(F.min(F.struct("plain", "fields")).alias("k")).select("item", "k.plain", "k.fields")
        fresh = materialize(fresh, "p6-batch")
        if touched := self._touched(content, "items", fresh, "item"):
            fresh = materialize(fresh.join(self.read("items", touched, content).select("item"), "item", "left_anti"), "p6-fresh")
        if fresh.limit(1).count():
            self._link(content, fresh)
            counted = materialize(fresh.groupBy("plain").agg(F.count(F.lit(1)).alias("n"), F.min("item").alias("first")), "p6-counted")
            old = self.read("counts", self._touched(content, "counts", counted, "plain"), content)
            # the key's buckets on the other side are read whole, so that rows the batch doesn't touch stay
            summed = counted.join(old.withColumnRenamed("plain", "p"), F.col("plain") == F.col("p"), "full_outer").select(
                F.coalesce("plain", "p").alias("plain"), (F.coalesce("n", F.lit(0)) + F.coalesce("copies", F.lit(0))).alias("copies"), F.least("first", "kept").alias("kept")
            )
            self._write(content, "counts", summed, "plain", True)
            self._write(content, "items", fresh.select("item", "plain"), "item", False)
            for table, key in (("items", "item"), ("counts", "plain"), ("nodes", "node")):
                self._grow(content, table, key)
        content["batches"].append(name)
        self._turn(number + 1, content)
        return True

    def tidy(self) -> int:
        """Deletes the folders and versions that the last version doesn't need, and says how many; not to be called while another reads or writes."""
        number, content = self._version()
        needed = {folder for t in content["tables"].values() for folders in t["at"].values() for folder in folders}
        gone = 0
        for table in self.TABLES:
            fs, p = self._fs(f"{self.path}/{table}")
            for name in [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []:
                if f"{self.path}/{table}/{name}" not in needed:
                    gone += bool(fs.delete(self._fs(f"{self.path}/{table}/{name}")[1], True))
        fs, p = self._fs(f"{self.path}/versions")
        for name in sorted(s.getPath().getName() for s in fs.listStatus(p))[:-1] if fs.exists(p) else []:
            gone += bool(fs.delete(self._fs(f"{self.path}/versions/{name}")[1], False))
        return gone

    def _link(self, content: dict, fresh: DataFrame) -> None:
        """Takes up which keys the field records among ``fresh`` link; labels of earlier batches that they join become one."""
        pairs = materialize(fresh.filter("fields IS NOT NULL").select("plain", "fields").distinct(), "p6-pairs")
        if not pairs.limit(1).count():
            return
        ends = pairs.select(F.col("plain").alias("node")).unionByName(pairs.select(F.col("fields").alias("node"))).distinct()
        merged = self.read("merged", content=content)
        known = self.read("nodes", self._touched(content, "nodes", ends, "node"), content).join(ends, "node").join(merged, "root", "left")
        known = known.select("node", F.coalesce("final", "root").alias("old"))
        label = materialize(ends.join(known, "node", "left").select("node", F.coalesce("old", "node").alias("label"), F.col("old").isNull().alias("new")), "p6-labels")
        edges = pairs.join(label.select(F.col("node").alias("plain"), F.col("label").alias("a")), "plain").join(label.select(F.col("node").alias("fields"), F.col("label").alias("b")), "fields")
        found = components(edges.select("a", "b").filter("a <> b").distinct(), label.select(F.col("label").alias("node")).distinct(), [], "p6")
        found = found.select(F.col("node").alias("label"), F.col("block").alias("final"))
        self._write(content, "nodes", label.filter("new").join(found, "label").select("node", F.col("final").alias("root")), "node", False)
        # labels that stand for keys of earlier batches and changed
        moved = materialize(label.filter("NOT new").select("label").distinct().join(found.filter("final < label"), "label"), "p6-moved")
        if moved.limit(1).count():
            again = merged.join(moved.select(F.col("label").alias("final"), F.col("final").alias("further")), "final", "left").select("root", F.coalesce("further", "final").alias("final"))
            rows = again.unionByName(moved.select(F.col("label").alias("root"), "final"))
            rows = materialize(rows, "p6-merged")
            content["tables"]["merged"] |= {"at": {}, "rows": 0}
            self._write(content, "merged", rows, "root", True)

    def groups(self) -> DataFrame:
        """(plain, group, copies, kept): for each key its group, the group's number of copies and its smallest id."""
        _, content = self._version()
        label = self.read("nodes", content=content).join(self.read("merged", content=content), "root", "left").select(F.col("node").alias("plain"), F.coalesce("final", "root").alias("label"))
        keyed = self.read("counts", content=content).join(label, "plain", "left").withColumn("group", F.coalesce("label", "plain"))
        keyed = materialize(keyed.select("plain", "group", "copies", "kept"), "p6-groups")
        # only keys with a label share a group with others
        linked = keyed.join(label.select("plain"), "plain", "left_semi").groupBy("group").agg(F.sum("copies").alias("all"), F.min("kept").alias("least"))
        return keyed.join(linked, "group", "left").select("plain", "group", F.coalesce("all", "copies").alias("copies"), F.coalesce("least", "kept").alias("kept"))


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def canonical_keys(rows: DataFrame, item: str, text: str) -> DataFrame:
    """(item, plain, fields) of every row with an id."""
    keyed = rows.select(F.col(f"`{item}`").cast("long").alias("item"), plain_key(F.col(f"`{text}`")).alias("plain"), field_key(F.col(f"`{text}`")).alias("fields"))
    return keyed.filter("item IS NOT NULL")


def collapse(rows: DataFrame, item: str = "pk", text: str = "text", batches: int = 2, path: str | None = None) -> Ledger:
    """The ledger of ``rows``: one row in ``groups`` for each canonical key, with its group of hidden copies.

    The rows enter in ``batches`` batches by ranges of the id, as deliveries would; with a ``path`` the ledger stays there
    and what it has counts no more. Defined cases: repeated deliveries of an id count once (within a batch by the smallest
    keys if their texts differ, over batches by the first); a row without an id takes no part; a null text counts as
    empty; texts without letters and digits are copies of each other; an empty table gives an empty ledger; other columns
    are not read."""
    ledger = Ledger(rows.sparkSession, path or scratch(rows.sparkSession, "ledger"))
    keyed = materialize(canonical_keys(rows, item, text), "p6-keys")
    low, high = keyed.agg(F.min("item"), F.max("item")).first()
    if low is not None:
        step = (high - low) // batches + 1
        for k in range(batches):
            part = keyed.filter((F.col("item") >= low + k * step) & (F.col("item") < low + (k + 1) * step))
            ledger.update(part, f"{low + k * step}-{uuid.uuid4().hex}")
    return ledger


def hidden_copies(rows: DataFrame, item: str = "pk", text: str = "text") -> DataFrame:
    """(kept_pk, copy_pk) for every copy of a record with a smaller id. Groups of one are left before the join; a group that holds a third of all rows is split by AQE's skew join, as the ledger has one row for each of its keys."""
    ledger = collapse(rows, item, text)
    groups = ledger.groups().filter("copies > 1").select("plain", F.col("kept").alias("kept_pk"))
    return ledger.read("items").join(groups, "plain").filter("item > kept_pk").select("kept_pk", F.col("item").alias("copy_pk"))
