"""Overlap islands, containment components, canonical findings and their summaries."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def islands(spans: DataFrame, *order, by: tuple[str, ...] = ("path",)) -> DataFrame:
    """Adds island: spans of a path that overlap, directly or through others, have one number. One window over each path."""
    by_start = W.partitionBy(*by).orderBy("start", F.desc("end"), *order)
    reach = F.max("end").over(by_start.rowsBetween(W.unboundedPreceding, -1))
    out = spans.withColumn("_new", F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0))
    return out.withColumn("island", F.sum("_new").over(by_start.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def labelled(members: list[dict]) -> list[int]:
    """Of the detections of one island, the number of the first one in the component of each: equal spans, or containment with
    suppression.

    Suppressed detectors' spans are looked up by their starts, so an island costs its links and not the square of its size.
    """
    root = list(range(len(members)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(i, j):
        i, j = find(i), find(j)
        root[max(i, j)] = min(i, j)

    spans: dict[tuple[int, int], int] = {}
    by_kind: dict[str, list[tuple[int, int, int]]] = {}
    for i, m in enumerate(members):
        join(i, spans.setdefault((m["start"], m["end"]), i))
        by_kind.setdefault(m["detector_id"], []).append((m["start"], m["end"], i))
    for rows in by_kind.values():
        rows.sort()
    for i, m in enumerate(members):
        for kind in m["suppresses"] if m["suppresses"] is not None else ():
            rows = by_kind.get(kind, [])
            k = bisect_left(rows, (m["start"], -1, -1))
            while k < len(rows) and rows[k][0] <= m["end"]:
                if rows[k][1] <= m["end"] and rows[k][2] != i:
                    join(i, rows[k][2])
                k += 1
    return [find(i) for i in range(len(members))]


def _labels(members: pd.Series) -> pd.Series:
    """Labels of islands of several detections; lone ones come as nulls and cost nothing here."""
    return members.map(lambda rows: None if rows is None else labelled(list(rows)))


_MEMBER = ("detector_id", "category", "start", "end", "value", "line", "column", "confidence", "tier", "specificity", "suppresses", "origin", "category_selected", "can_anonymize", "priority", "location", "evidence", "near")


def grouped(detections: DataFrame) -> DataFrame:
    """(path, members): the detections of each group that is one finding, in the order of their spans.

    Groups lie inside overlap islands, which one window over each path finds; nearly all islands are one detection, and only the
    others go through Python. One shuffle in all, by path.
    """
    for c, kind in (("priority", "int"), ("location", "string"), ("evidence", "array<string>"), ("near", "string")):
        if c not in detections.columns:
            detections = detections.withColumn(c, F.lit(0 if kind == "int" else None).cast(kind))
    placed = islands(detections, "detector_id").groupBy("path", "island").agg(F.array_sort(F.collect_list(F.struct(F.col("start").alias("a"), (-F.col("end")).alias("z"), F.col("detector_id").alias("d"), F.struct(*_MEMBER).alias("m")))).alias("m"))
    placed = placed.select("path", F.transform("m", lambda x: x["m"]).alias("all"))
    spans = F.transform("all", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["detector_id"].alias("detector_id"), x["suppresses"].alias("suppresses")))
    placed = placed.withColumn("labels", F.pandas_udf(_labels, "array<int>")(F.when(F.size("all") > 1, spans)))
    of = lambda label: F.transform(F.filter(F.arrays_zip("all", "labels"), lambda z: z["labels"] == label), lambda z: z["all"])
    parts = F.when(F.col("labels").isNull(), F.array("all")).otherwise(F.transform(F.array_distinct("labels"), of))
    return placed.select("path", F.explode(parts).alias("members"))


def consolidate(detections: DataFrame) -> DataFrame:
    """A canonical finding for each component: its primary detection, its extent, and the others as supporting evidence.

    The primary is the least by (suppressed, -specificity, -priority, -length, detector, start, end). Supporting detectors give
    their highest confidence, the first in the primary's order on ties, and its span; relationship: suppressed, same_span or overlap_chain.
    """
    members = grouped(detections)
    m = F.col("members")
    hidden = lambda x: F.exists(m, lambda o: F.array_contains(o["suppresses"], x["detector_id"]) & (o["start"] <= x["start"]) & (o["end"] >= x["end"]))
    # arrays of structs sort by their fields from the first
    keyed = F.array_sort(F.transform(m, lambda x: F.struct(hidden(x).alias("suppressed"), (-x["specificity"]).alias("s"), (-x["priority"]).alias("p"), (x["start"] - x["end"]).alias("l"), x["detector_id"].alias("d"), x["start"].alias("a"), x["end"].alias("z"), x.alias("m"))))
    out = members.withColumn("keyed", keyed).withColumn("primary", F.get("keyed", F.lit(0)))
    p, at = F.col("primary.m"), F.array_sort(F.transform(m, lambda x: F.struct(x["start"].alias("a"), x["end"].alias("z"), x["detector_id"].alias("d"))))
    signature = F.array_join(F.transform(at, lambda x: F.concat_ws(":", x["d"], x["a"].cast("string"), x["z"].cast("string"))), "|")
    first, last = F.array_min(F.transform(m, lambda x: x["start"])), F.array_max(F.transform(m, lambda x: x["end"]))
    relation = lambda x: F.when(x["suppressed"], "suppressed").when((x["a"] == p["start"]) & (x["z"] == p["end"]), "same_span").otherwise("overlap_chain")
    rest = F.slice("keyed", 2, F.size("keyed"))
    best = lambda x: ~F.exists(F.filter("others", lambda o: (o["d"] == x["d"])), lambda o: (o["m"]["confidence"] > x["m"]["confidence"]) | ((o["m"]["confidence"] == x["m"]["confidence"]) & (F.struct(o["s"], o["p"], o["l"], o["d"], o["a"], o["z"]) < F.struct(x["s"], x["p"], x["l"], x["d"], x["a"], x["z"]))))
    out = out.withColumn("others", rest)
    # repeated detections are equally good, and equal here
    support = F.array_sort(F.array_distinct(F.transform(F.filter("others", best), lambda x: F.struct(x["d"].alias("detector_id"), x["m"]["confidence"].alias("confidence"), relation(x).alias("relationship"), x["a"].alias("start"), x["z"].alias("end")))))
    return out.select(
        "path", T.stable_id(F.col("path"), first, F.concat(F.lit("canonical:"), last.cast("string"), F.lit(":"), signature)).alias("id"),
        p["detector_id"].alias("detector_id"), p["category"].alias("category"), p["start"].alias("start"), p["end"].alias("end"), p["line"].alias("line"), p["column"].alias("column"), p["value"].alias("value"),
        p["confidence"].alias("confidence"), p["tier"].alias("tier"), p["can_anonymize"].alias("can_anonymize"), p["category_selected"].alias("category_selected"),
        F.exists(m, lambda x: x["origin"] == "user_target").alias("has_user_target"), first.alias("group_start"), last.alias("group_end"),
        F.size(m).alias("raw_count"), F.size(F.filter(F.slice("keyed", 2, F.size("keyed")), lambda x: x["suppressed"])).alias("suppressed_count"), F.transform(m, lambda x: x["detector_id"]).alias("raw_detectors"), support.alias("supporting"),
        F.when(p["can_anonymize"] & (p["tier"] == "A"), "anonymize").otherwise("review").alias("suggested_action"), T.preview(p["value"]).alias("preview"),
        p["location"].alias("location"), p["evidence"].alias("evidence"), p["near"].alias("near"),
    )


def visible(findings: DataFrame) -> DataFrame:
    """Findings of the categories asked for, or with a user's target among their detections."""
    return findings.where(F.col("category_selected") | F.col("has_user_target"))


def canonical_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy("path", "start", "end", "detector_id", "id")


def triage_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy("tier", F.desc("confidence"), "path", "line", "column", "id")


PUBLIC = ("id", "path", "location", "line", "column", "detector_id", "category", "confidence", "tier", "suggested_action", "can_anonymize", "preview", "raw_count", "suppressed_count")


def public(findings: DataFrame) -> DataFrame:
    """The fields that may leave: no value, no offsets."""
    return findings.select(*PUBLIC)


def summary(findings: DataFrame) -> DataFrame:
    """Counts in all, by tier and by category, in one pass over grouping sets."""
    out = findings.groupingSets([[], ["tier"], ["category"]], "tier", "category").agg(F.count(F.lit(1)).alias("n"), F.sum("raw_count").cast("long").alias("raw"), F.sum("suppressed_count").cast("long").alias("suppressed"))
    return out.select(F.coalesce("tier", F.lit("*")).alias("tier"), F.coalesce("category", F.lit("*")).alias("category"), "n", "raw", "suppressed")


def combined(summaries: DataFrame) -> DataFrame:
    """One ``summary`` of several over separate files."""
    return summaries.groupBy("tier", "category").agg(*(F.sum(c).alias(c) for c in ("n", "raw", "suppressed")))


def progress(findings: DataFrame, scanned: DataFrame, skipped: DataFrame, seconds: float) -> DataFrame:
    """One row: findings by tier, files scanned and skipped, characters, files and characters a second."""
    parts = [findings.agg(F.count(F.lit(1)).alias("findings"), F.count_if(F.col("tier") == "A").alias("tier_a")), scanned.agg(F.count(F.lit(1)).alias("scanned"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("chars")), skipped.agg(F.count(F.lit(1)).alias("skipped"))]
    names = [c for p in parts for c in p.columns]
    rows = None
    for p in parts:
        part = p.select(*((F.col(n) if n in p.columns else F.lit(0).cast("long")).alias(n) for n in names))
        rows = part if rows is None else rows.unionByName(part)
    out = rows.agg(*(F.sum(n).alias(n) for n in names))
    return out.withColumn("files_per_second", F.col("scanned") / seconds).withColumn("chars_per_second", F.col("chars") / seconds)
