"""Which paths are scanned, and texts in overlapping windows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import detectors as D

IGNORED_DIRECTORIES = (".git", ".venv", "__pycache__", "build", "dist", "node_modules", "venv")
SPLIT_BYTES = 128 * 1024 * 1024
MOST_RULE_BYTES, MOST_RULES, MOST_RULE_CHARS, MOST_ALL_CHARS = 1_000_000, 1024, 1024, 65_536


def _segment(part: str) -> str:
    return "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in re.sub(r"\*+", "*", part))


def rule_pattern(rule: str) -> str:
    """One Java pattern for an ignore rule: * and ? within a segment, ** as a whole segment, / first or within anchors it,
    / last takes directories only, and what fits a directory takes all below it."""
    body = rule.removeprefix("!")
    below_only = body.endswith("/**")
    directory = body.endswith("/")
    body = body.removesuffix("/**").rstrip("/")
    anchored = "/" in body
    parts = body.lstrip("/").split("/")
    out = "" if anchored else "(?:.*/)?"
    for i, p in enumerate(parts):
        last = i == len(parts) - 1
        if p == "**":
            out += ".*" if last else "(?:[^/]+/)*"
        else:
            out += _segment(p) + ("" if last else "/")
    return f"^{out}{'/.+' if below_only or directory else '(?:/.*)?'}$"


def parse_rules(text: str) -> list[str]:
    """The rules of an ignore file; none if it is larger than any of the limits."""
    if len(text.encode()) > MOST_RULE_BYTES:
        return []
    rules = [r for r in (x.strip() for x in text.splitlines()) if r and not r.startswith("#")]
    if len(rules) > MOST_RULES or any(len(r) > MOST_RULE_CHARS for r in rules) or sum(map(len, rules)) > MOST_ALL_CHARS:
        return []
    return rules


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether the last rule that fits the path isn't a negation."""
    out = F.lit(False)
    for r in rules:
        out = F.when(path.rlike(rule_pattern(r)), F.lit(not r.startswith("!"))).otherwise(out)
    return out


def in_ignored_directory(path: Column, names=IGNORED_DIRECTORIES) -> Column:
    parents = F.slice(F.split(F.lower(path), "/"), 1, F.size(F.split(path, "/")) - 1)
    return F.arrays_overlap(parents, F.array(*(F.lit(n.lower()) for n in names)))


def longest_extension(path: Column, extensions: list[str]) -> Column:
    """The longest of the extensions that the lower-case file name ends with, or null."""
    name = F.lower(F.substring_index(path, "/", -1))
    out = F.lit(None).cast("string")
    for e in sorted(set(extensions), key=len):
        out = F.when(name.endswith(e.lower()), F.lit(e)).otherwise(out)
    return out


def windows(docs: DataFrame, core: int, overlap: int) -> DataFrame:
    """(the columns of docs, window's text as text, _first, _own, _end, _lines, _last): the texts in windows of ``core`` characters and the rest of the line that
    they end in, with ``overlap`` more on either side; _first is the window's place in the text, _lines the line feeds before it, and _last the place of the last of these."""
    pieces = F.when(F.length("text") <= core, F.array("text")).otherwise(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{core}}}[^\n]*\n?"), F.lit(0)))
    feeds = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    kind = "array<struct<own:int,text:string,first:int,end:int,lines:int,last:int>>"

    def cut(p):
        start = F.struct(F.lit(0).alias("own"), F.lit(0).alias("lines"), F.lit(-1).alias("last"), F.array().cast(kind).alias("out"))

        def step(a, i):
            def made(x):
                # x: the piece, what of the one before it is seen again, and what of that is not
                lines = lambda t, n: n + feeds(t)
                at = lambda t, first, last: F.when(F.contains(t, F.lit("\n")), first + F.length(t) - F.length(F.substring_index(t, "\n", -1)) - 1).otherwise(last)
                behind = a["own"] - F.length(x["back"])
                row = F.struct(a["own"].alias("own"), F.concat(x["back"], x["piece"], x["ahead"]).alias("text"), behind.alias("first"), (a["own"] + F.length(x["piece"])).alias("end"), lines(x["gone"], a["lines"]).alias("lines"), at(x["gone"], behind - F.length(x["gone"]), a["last"]).alias("last"))
                # before the next piece lies what is gone now and what was seen again
                return F.struct((a["own"] + F.length(x["piece"])).alias("own"), lines(F.concat(x["gone"], x["back"]), a["lines"]).alias("lines"), at(F.concat(x["gone"], x["back"]), behind - F.length(x["gone"]), a["last"]).alias("last"), F.concat(a["out"], F.array(row)).alias("out"))

            before = F.coalesce(F.get(p, i - 1), F.lit(""))
            far = F.greatest(F.length(before) - overlap, F.lit(0))
            seen = F.struct(F.get(p, i).alias("piece"), F.substring(before, far + 1, F.lit(overlap)).alias("back"), F.substring(before, F.lit(1), far).alias("gone"), F.substring(F.coalesce(F.get(p, i + 1), F.lit("")), 1, overlap).alias("ahead"))
            return T.let(seen, made)

        return F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), start, step, lambda a: a["out"])

    rest = [c for c in docs.columns if c != "text"]
    out = docs.where(F.length("text") > 0).select(*rest, F.explode(T.let(pieces, cut)).alias("w"))
    return out.select(*rest, F.col("w.text").alias("text"), F.col("w.first").alias("_first"), F.col("w.own").alias("_own"), F.col("w.end").alias("_end"), F.col("w.lines").alias("_lines"), F.col("w.last").alias("_last"))


def chunked_hits(docs: DataFrame, detectors: list[D.Detector], core: int, overlap: int | None = None, keep: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """``detectors.hits`` of long texts window by window: no task holds more of a text than a window, and each hit belongs to the
    window in whose core it starts. ``overlap`` is the longest match, 100 characters around it and one by default, and less is
    an error. Places are those in the whole text. A budget ``most`` holds for each window. As windows begin with a line, a run that a detector cuts
    into several matches is cut as in the whole text, however long it is; only matches one after the other across line feeds, for longer
    than the overlap, can be cut elsewhere."""
    least = max((d.max_match_length for d in detectors), default=0) + 101
    overlap = least if overlap is None else overlap
    if overlap < least:
        raise ValueError(f"these detectors need an overlap of {least} or more")
    core = max(core, overlap)
    names = ("_first", "_own", "_end", "_lines", "_last")
    segments = ["segments"] if "segments" in docs.columns else []
    pieces = windows(docs.select("path", *keep, *segments, "text").withColumnRenamed("segments", "_segments"), core, overlap)
    got = D.hits(pieces, detectors, (*keep, *names, *(["_segments"] if segments else ())), most)
    start = F.col("start") + F.col("_first")
    moved = got.withColumns({
        "column": F.when(F.col("line") == 1, start - F.col("_last")).otherwise(F.col("column")), "line": F.col("line") + F.col("_lines"),
        "start": start, "end": F.col("end") + F.col("_first"),
    })
    if segments:
        moved = moved.withColumn("location", T.location(F.col("_segments"), F.col("start")))
    return moved.where(F.col("over") | ((F.col("start") >= F.col("_own")) & (F.col("start") < F.col("_end")))).drop(*names, "_segments")


def chunked_detections(docs: DataFrame, detectors: list[D.Detector], core: int, overlap: int | None = None, **how) -> DataFrame:
    """``detectors.detect`` by ``chunked_hits``."""
    docs = docs.withColumn("can_anonymize", how.pop("can_anonymize", F.lit(True)))
    return D.scored(chunked_hits(docs, detectors, core, overlap, ("can_anonymize",)), detectors, keep=("can_anonymize",), **how)


def spread(df: DataFrame) -> DataFrame:
    """An input of less than one default split for each core, dealt over all cores: a small file of one row group would be one
    task. Larger ones stay where they are read, without a shuffle."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPLIT_BYTES else df
