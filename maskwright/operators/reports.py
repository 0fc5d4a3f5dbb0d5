"""Reports of findings without their values: JSON rows, and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import masking as M
from .findings import PUBLIC, public

#: (codes, what a reader is told), the first that holds
GUIDANCE = (
    (("file_too_large", "document_too_large", "text_limit", "document_limit"), "Too large to scan"),
    (("unsupported_encoding", "binary_file"), "Not readable as text"),
    (("encrypted",), "Encrypted"),
    (("archive_limit", "unsafe_archive", "unsafe_xml"), "Unsafe to unpack"),
    (("corrupt_archive", "corrupt_document", "no_text"), "Damaged or empty"),
    (("ignored_directory", "ignore_rule", "excluded_extension", "not_included"), "Left out by settings"),
    (("detection_limit",), "Too many hits"),
    (("missing_extractor",), "No extractor installed"),
    (("symlink",), "A link, which isn't followed"),
    (("extraction_timeout",), "Took too long to read"),
)


def json_rows(findings: DataFrame) -> DataFrame:
    """One JSON object for each finding, of the public fields alone."""
    return public(safe_labels(findings)).select(F.to_json(F.struct(*PUBLIC)).alias("json"))


#: Longest label that leaves.
MOST_LABEL = 512


def plain(label: Column) -> Column:
    """A label without control characters and runs of white space, cut in its middle where it is too long."""
    out = F.trim(F.regexp_replace(F.regexp_replace(label, r"[\p{C}]", " "), r"(?U)\s+", " "))
    half = (MOST_LABEL - 1) // 2
    return F.when(F.length(out) > MOST_LABEL, F.concat(F.left(out, F.lit(half)), F.lit("\u2026"), F.right(out, F.lit(half)))).otherwise(out)


def safe_labels(findings: DataFrame) -> DataFrame:
    """The findings, path and location without any value found in the same file, and made plain.

    Values meet labels by file, so no list of values reaches the driver and none is compared with labels of other files.
    """
    values = findings.groupBy("path").agg(F.collect_set(F.when(F.length("value") >= 4, F.col("value"))).alias("_values")).withColumnRenamed("path", "_p")
    both = findings.join(values, F.col("path") == F.col("_p"))
    clean = lambda c: plain(M.scrubbed(F.col(c), F.col("_values"))).alias(c)
    return both.select(*(clean(c) if c in ("path", "location") else F.col(c) for c in findings.columns))


def inert(text: Column) -> Column:
    """Text that Markdown shows as it is."""
    return F.regexp_replace(F.regexp_replace(text, r"[\p{Cntrl}]", " "), r"([\\`*_{}\[\]()#+\-.!|<>~])", r"\\$1")


def markdown(findings: DataFrame) -> DataFrame:
    """(path, markdown): a section for each file with its findings in order."""
    line = F.concat(F.lit("- **"), F.col("tier"), F.lit("** "), inert(F.col("detector_id")), F.lit(" at line "), F.col("line"), F.lit(", column "), F.col("column"), F.coalesce(F.concat(F.lit(", "), inert(F.col("location"))), F.lit("")), F.lit(": "), inert(F.col("preview")), F.format_string(" (%.2f)", "confidence"))
    findings = safe_labels(findings)
    each = F.array_sort(F.collect_list(F.struct("line", "column", "id", line.alias("text"))))
    return findings.groupBy("path").agg(each.alias("_l")).select("path", F.concat(F.lit("## "), inert(F.col("path")), F.lit("\n\n"), F.array_join(F.transform("_l", lambda x: x["text"]), "\n")).alias("markdown"))


def guidance(code: Column) -> Column:
    out = F.lit("Other")
    for codes, told in reversed(GUIDANCE):
        out = F.when(code.isin(*codes), told).otherwise(out)
    return out


def skipped_groups(skipped: DataFrame) -> DataFrame:
    return skipped.groupBy(guidance(F.col("code")).alias("guidance")).agg(F.count(F.lit(1)).alias("files"), F.array_sort(F.collect_set("code")).alias("codes"))


def filtered(findings: DataFrame, tier: str | None = None, category: str | None = None, detector: str | None = None, path: str | None = None) -> DataFrame:
    for name, value in (("tier", tier), ("category", category), ("detector_id", detector), ("path", path)):
        if value is not None:
            findings = findings.where(F.col(name) == value)
    return findings


def size_text(n: Column) -> Column:
    """A number of bytes for people."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, F.format_string("%.1f KB", n / 1024)).when(n < 1024**3, F.format_string("%.1f MB", n / 1024**2)).otherwise(F.format_string("%.1f GB", n / 1024**3))


def duration_text(ms: Column) -> Column:
    """Milliseconds for people."""
    return F.when(ms < 1000, F.concat(F.round(ms).cast("long").cast("string"), F.lit(" ms"))).when(ms < 60_000, F.format_string("%.1f s", ms / 1000)).otherwise(F.format_string("%d min %02d s", F.floor(ms / 60_000), F.floor(ms / 1000) % 60))


def percent(done: Column, total: Column) -> Column:
    """Whole percents done; 0 of nothing."""
    return F.when(total > 0, F.least(F.lit(100), F.floor(100 * done / total))).otherwise(0).cast("int")


def display_name(name: Column) -> Column:
    """An id as words."""
    return F.initcap(F.trim(F.regexp_replace(name, "[_\\s-]+", " ")))


def short_paths(findings: DataFrame, roots: list[str]) -> DataFrame:
    """Adds short: the path below the longest root that it lies in, else its last name; where two files would have the same, the whole path."""
    out = F.substring_index(F.col("path"), "/", -1)
    for root in sorted(set(roots), key=len):
        base = root.rstrip("/") + "/"
        out = F.when(F.startswith(F.col("path"), F.lit(base)), F.substring(F.col("path"), F.lit(len(base) + 1), F.length("path"))).otherwise(out)
    names = findings.select("path").distinct().withColumn("short", out)
    again = names.groupBy("short").agg(F.count(F.lit(1)).alias("_n"))
    names = names.join(again, "short").select(F.col("path").alias("_p"), F.when(F.col("_n") > 1, F.col("path")).otherwise(F.col("short")).alias("short"))
    return findings.join(names, F.col("path") == F.col("_p")).drop("_p")


def tiered(findings: DataFrame) -> DataFrame:
    """(tier, text): the findings of each tier as lines in the order in which they are looked at."""
    line = F.concat(F.lit("  "), F.col("path"), F.lit(":"), F.col("line"), F.lit(":"), F.col("column"), F.coalesce(F.concat(F.lit(" ("), F.col("location"), F.lit(")")), F.lit("")), F.lit("  "), display_name(F.col("detector_id")), F.lit("  "), F.col("preview"), F.format_string("  %.2f", "confidence"))
    return safe_labels(findings).select("tier", line.alias("text"), "confidence", "path", "line", "column", "id").orderBy("tier", F.desc("confidence"), "path", "line", "column", "id").select("tier", "text")
