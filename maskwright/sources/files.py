"""Files as rows: reading, classification with explained exclusions, decoding, extraction of documents."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import extract as X
from .rules import IGNORED_DIRECTORIES, ignored, in_ignored_directory, longest_extension

MOST_FILE, MOST_DOCUMENT = 100_000_000, 50_000_000
#: How long one file may take to read.
SECONDS = 60.0

DOCS = "path string, format string, text string, segments array<struct<start:int,label:string>>, codec string, bom binary, code string, reason string"


def links(spark: SparkSession, root: str) -> DataFrame:
    """(link) the symbolic links at and below a root on the driver's own disk, none of them followed; other stores have none."""
    here = root.removeprefix("file://") if root.startswith(("/", "file:///")) else None
    found = []
    if here is not None and os.path.lexists(here):
        found = [here] if os.path.islink(here) else []
        for folder, names, files in os.walk(here):
            found += [p for n in (*names, *files) if os.path.islink(p := os.path.join(folder, n))]
    return spark.createDataFrame([(x.rstrip("/"),) for x in found], "link string")


def discover(spark: SparkSession, roots: list[str], rules: list[str] = (), include: list[str] = (), exclude: list[str] = (), directories=IGNORED_DIRECTORIES, most: int = MOST_FILE) -> DataFrame:
    """path, length, issue for every file below the roots, each path once; issue names the rule that leaves a file out.

    Only metadata is read: content comes later, for files without an issue. Rules apply to the path below its root.
    """
    if set(map(str.lower, include)) & set(map(str.lower, exclude)):
        raise ValueError("an extension is both included and excluded")
    files = None
    for root in roots:
        part = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
        base = F.regexp_replace("path", r"^[a-z]+:/*", "/")
        clean = "/" + root.split(":", 1)[-1].strip("/") if ":" in root else root.rstrip("/")
        part = part.withColumn("relative", F.when(base.startswith(clean + "/"), F.substring(base, F.lit(len(clean) + 2), F.length(base))).otherwise(F.substring_index(base, "/", -1)))
        files = part if files is None else files.unionByName(part)
    files = files.dropDuplicates(["path"])
    # a file is behind a link if it or a folder above it is one: its path's beginnings meet the links, so no list is tried on each file
    linked = None
    for root in roots:
        part = links(spark, root)
        linked = part if linked is None else linked.union(part)
    local = F.regexp_replace("path", r"^file:/*", "/")
    steps = F.split(local, "/")
    above = files.select(F.col("path").alias("_p"), F.explode(F.transform(F.sequence(F.lit(2), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))).alias("link"))
    behind = above.join(linked.distinct(), "link", "left_semi").select("_p").distinct()
    files = files.join(behind.withColumn("_linked", F.lit(True)), F.col("path") == F.col("_p"), "left").drop("_p")
    rel, included, excluded = F.col("relative"), longest_extension(F.col("path"), list(include)), longest_extension(F.col("path"), list(exclude))
    issue = lambda code, rule: F.struct(F.lit(code).alias("code"), F.lit("discover").alias("stage"), rule.cast("string").alias("rule"))
    found = F.when(F.col("_linked"), issue("symlink", F.lit(None))).when(in_ignored_directory(rel, directories), issue("ignored_directory", F.lit(None)))
    found = found.when(ignored(rel, list(rules)), issue("ignore_rule", F.lit(None)))
    found = found.when(excluded.isNotNull(), issue("excluded_extension", excluded))
    if include:
        found = found.when(included.isNull(), issue("not_included", F.lit(None)))
    found = found.when(F.col("length") > most, issue("file_too_large", F.lit(most)))
    return files.withColumn("issue", found).drop("_linked")


def read_documents(files: DataFrame, seconds: float | None = SECONDS) -> DataFrame:
    """Texts of the files without an issue, by the columns of DOCS; code and reason say why a file has none.

    Files are read again by path from the same source, content only where it is wanted; each file is one row, and its
    size is bounded by the discovery limit.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [X.read(p, bytes(c), MOST_DOCUMENT, seconds) for p, c in zip(b["path"], b["content"])]
            yield pd.DataFrame(rows, columns=["path", "format", "text", "segments", "codec", "bom", "code", "reason"])

    return files.select("path", "content").mapInPandas(run, DOCS)


def contents(spark: SparkSession, roots: list[str]) -> DataFrame:
    """path, content of every file below the roots, each path once."""
    out = None
    for root in roots:
        part = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
        out = part if out is None else out.unionByName(part)
    return out.dropDuplicates(["path"])


def load(spark: SparkSession, roots: list[str], **how) -> tuple[DataFrame, DataFrame]:
    """(docs, skipped): what can be scanned, and every file that can't with code, stage and rule."""
    listed = discover(spark, roots, **how)
    wanted = listed.where("issue IS NULL").select("path")
    docs = read_documents(contents(spark, roots).join(wanted, "path", "left_semi"))
    skipped = listed.where("issue IS NOT NULL").select("path", "issue.code", "issue.stage", "issue.rule")
    failed = docs.where("code IS NOT NULL").select("path", "code", F.lit("extract").alias("stage"), F.lit(None).cast("string").alias("rule"))
    return docs.where("code IS NULL").drop("code", "reason"), skipped.unionByName(failed)


def fingerprints(spark: SparkSession, roots: list[str]) -> DataFrame:
    out = None
    for root in roots:
        part = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))
        out = part if out is None else out.unionByName(part)
    return out.dropDuplicates(["path"])


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose content differs, or that only one side has."""
    b, a = before.select("path", F.col("sha256").alias("was")), after.select("path", F.col("sha256").alias("now"))
    return b.join(a, "path", "full_outer").where(~F.col("was").eqNullSafe(F.col("now")))
