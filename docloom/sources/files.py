"""Raw pages from a folder tree, and the choice of those that are documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.metadata import detect_crate, relative_path
from docloom.functions.selection import DEFAULT_CRATES, is_legacy, is_redirect, path_selected
from docloom.operators.parse import with_content_check

CRATES = ("std", "core", "alloc", "proc_macro", "test", "book", "reference", "rustc", "cargo", "unknown")


def crate_scope(names: Sequence[str] | None) -> list[str]:
    """The crates to read, in order, each once; an unknown name is an error."""
    out = list(dict.fromkeys(names or DEFAULT_CRATES))
    if bad := [n for n in out if n not in CRATES]:
        raise ValueError(f"unknown crates: {', '.join(bad)}")
    return out


#: The pages that state the version of their crate; they needn't be documents.
KEY_PAGES = ("book/index.html", "std/index.html", "cargo/CHANGELOG.html")


def _folders(spark: SparkSession, root: str, crates: Sequence[str]) -> list[str]:
    """The folders under ``root`` that hold pages of the crates, and the files beside them if unknown ones are asked for; a root that is no folder is an error."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise FileNotFoundError(f"there is no folder {root}")
    if not fs.getFileStatus(p).isDirectory():
        raise NotADirectoryError(f"{root} is no folder")
    entries = [(s.getPath().getName(), s.getPath().toString(), s.isDirectory()) for s in fs.listStatus(p)]
    known = set(CRATES) - {"unknown"}
    return [path for name, path, folder in entries if (name.lower() in crates if folder and name.lower() in known else "unknown" in crates)]


def _pages(spark: SparkSession, paths: list[str], root: str, pattern: str) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], "source_path string, crate string, html string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(paths)
    path = relative_path(F.col("path"), root)
    top = F.lower(F.substring_index(path, "/", 1))
    crate = F.when(F.contains(path, F.lit("/")) & top.isin(*CRATES), top).otherwise(detect_crate(path))
    return files.select(path.alias("source_path"), crate.alias("crate"), F.make_valid_utf8(F.col("content").cast("string")).alias("html"))


def scan_pages(spark: SparkSession, root: str, pattern: str = "*.html", crates: Sequence[str] = CRATES) -> DataFrame:
    """(source_path, crate, html) of the pages under ``root`` whose first folder is one of ``crates`` (``unknown``: any other); bytes that aren't UTF-8 become replacement marks. Other folders are neither listed nor read."""
    return _pages(spark, _folders(spark, root, crates), root, pattern)


def key_pages(spark: SparkSession, root: str, crates: Sequence[str]) -> DataFrame:
    """The key pages of the crates, at most one each, whatever the selection of documents says of them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = [f"{root.rstrip('/')}/{k}" for k in KEY_PAGES if k.split("/")[0] in crates and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{k}"))]
    return _pages(spark, there, root, "*.html")


def scoped_pages(spark: SparkSession, root: str, crates: Sequence[str] | None = None) -> DataFrame:
    """Pages of the crates that path and head let through; whether they have content is told by parsing."""
    pages = scan_pages(spark, root, crates=crate_scope(crates))
    head = ~is_redirect(F.col("html")) & ~((F.col("crate") == "book") & is_legacy(F.col("html")))
    return pages.filter(path_selected(F.col("source_path"), F.col("crate"))).filter(head)


def first_by_crate(pages: DataFrame, crates: Sequence[str] | None, limit: int | None) -> DataFrame:
    """The first ``limit`` pages by crate order and path; all of them without a limit."""
    if not limit:
        return pages
    return pages.withColumn("__crate", F.array_position(F.lit(crate_scope(crates)), F.col("crate"))).orderBy("__crate", "source_path").limit(limit).drop("__crate")


def discover(spark: SparkSession, root: str, crates: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """Pages that are documents. A ``limit`` over 0 is a sample by crate order and path."""
    checked = with_content_check(scoped_pages(spark, root, crates)).filter((F.col("crate") == "std") | F.col("meaningful")).drop("meaningful")
    return first_by_crate(checked, crates, limit)
