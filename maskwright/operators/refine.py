"""Second opinions of a local judge on unsure findings, and targets given as descriptions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .detectors import TIER_LIMIT
from .findings import islands

# The band that is judged, and the bounds of a description scan.
LOW, HIGH = 0.45, 0.80
MOST_LINES, MOST_CHARS, MOST_REASON = 40, 16_384, 300

#: prompt -> (is_sensitive, confidence, reason), or None where the judge can't say
Judge = Callable[[str], "tuple[bool, float, str] | None"]


def unsure(confidence: Column) -> Column:
    return confidence.between(LOW, HIGH)


def prompt(detector: Column, preview: Column, near: Column) -> Column:
    return F.concat(F.lit("Is this value sensitive? Detector: "), detector, F.lit("; value: "), preview, F.lit("; context: "), near)


def verdicts(rows: DataFrame, judge: Judge, key: str = "id") -> DataFrame:
    """(key, is_sensitive, verdict, reason) for rows with key and prompt; a judge that fails or answers out of range says nothing."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, p in zip(b[key], b["prompt"]):
                try:
                    got = judge(p)
                except Exception:  # noqa: BLE001  the judge is the user's code
                    got = None
                if got is not None and 0 <= got[1] <= 1:
                    out.append((k, bool(got[0]), float(got[1]), str(got[2])[:MOST_REASON]))
            yield pd.DataFrame(out, columns=[key, "is_sensitive", "verdict", "reason"])

    return rows.select(key, "prompt").mapInPandas(run, f"{key} {kind}, is_sensitive boolean, verdict double, reason string")


def refine(findings: DataFrame, judge: Judge, tier_limit: float = TIER_LIMIT) -> DataFrame:
    """Findings in the band get the mean of their confidence and the judge's, its reason, and their tier anew; ids stay.

    Only the band goes to Python; the verdicts come back by an equi-join on the finding's id.
    """
    # the characters around the value, with the value itself masked
    near = F.replace(F.col("near"), F.col("value"), F.col("preview"))
    asked = findings.where(unsure(F.col("confidence"))).select("id", prompt(F.col("detector_id"), F.col("preview"), near).alias("prompt"))
    said = verdicts(asked, judge).withColumnRenamed("id", "_id")
    out = findings.join(said, F.col("id") == F.col("_id"), "left").drop("_id")
    merged = F.when(F.col("verdict").isNotNull(), (F.col("confidence") + F.col("verdict")) / 2).otherwise(F.col("confidence"))
    out = out.withColumn("confidence", merged).withColumn("tier", F.when(F.col("confidence") >= tier_limit, "A").otherwise("B"))
    return out.withColumn("suggested_action", F.when(F.col("can_anonymize") & (F.col("tier") == "A"), "anonymize").otherwise("review"))


def candidate_lines(docs: DataFrame) -> DataFrame:
    """(path, start, line_text): the first non-blank lines of each text, within the bounds in lines and characters."""
    lines = docs.select("path", F.posexplode(F.split("text", "\n", -1)).alias("number", "raw"), "text")
    from pyspark.sql import Window as W

    by_line = W.partitionBy("path").orderBy("number")
    start = F.coalesce(F.sum(F.length("raw") + 1).over(by_line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lines = lines.drop("text").withColumn("_at", start).where(F.trim("raw") != "")
    lead = F.length("raw") - F.length(F.ltrim("raw"))
    lines = lines.select("path", "number", (F.col("_at") + lead).cast("int").alias("start"), F.trim("raw").alias("line_text"))
    lines = lines.withColumn("_n", F.row_number().over(by_line)).withColumn("_c", F.sum(F.length("line_text")).over(by_line))
    return lines.where((F.col("_n") <= MOST_LINES) & (F.col("_c") <= MOST_CHARS)).select("path", "start", "line_text")


def described(docs: DataFrame, descriptions: list[str], judge: Judge, tier_limit: float = TIER_LIMIT) -> DataFrame:
    """Whole lines that the judge takes for one of the descriptions, as detections of specificity 0."""
    targets = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(descriptions)))).alias("_t")
    lines = candidate_lines(docs).select("path", "start", "line_text", targets)
    lines = lines.withColumn("key", F.concat_ws("\u0001", "path", "start", "_t.i")).withColumn("prompt", F.concat(F.lit("Does this line match the description? "), F.col("_t.d"), F.lit("; line: "), F.col("line_text")))
    said = verdicts(lines, judge, "key").where("is_sensitive")
    out = lines.join(said, "key")
    return out.select("path", F.concat(F.lit("user_target_desc_"), F.col("_t.i").cast("string")).alias("detector_id"), F.col("_t.d").alias("target"), F.lit("request").alias("category"), "start", (F.col("start") + F.length("line_text")).alias("end"), F.col("line_text").alias("value"), F.col("verdict").alias("confidence"), F.lit(0).alias("specificity"), F.when(F.col("verdict") >= tier_limit, "A").otherwise("B").alias("tier"))


#: Canonical findings of a line that are asked about one by one; a line with more stays a finding of its own.
MOST_CONFIRMED = 8


def reconciled(opinions: DataFrame, findings: DataFrame, judge: Judge, tier_limit: float = TIER_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(merged, standing) of opinions about whole lines (``described``, with target) and canonical findings.

    Each finding inside a line is shown to the judge; where exactly one of at most MOST_CONFIRMED is what the description
    means, the opinion moves to its span with the lesser of both confidences (merged: path, finding_id, detector_id, start, end, value,
    confidence, tier). All other opinions stand as they are. Lines and findings meet by path and island of overlap.
    """
    line = opinions.select("path", "start", "end", F.lit(1).alias("kind"), F.concat_ws("\u0001", "detector_id", "start", "end").alias("key"))
    span = findings.select("path", "start", "end", F.lit(0).alias("kind"), F.col("id").alias("key"))
    placed = islands(line.unionByName(span), "kind", "key")
    lines = placed.where("kind = 1").select("path", "island", F.col("key").alias("opinion"), F.col("start").alias("_a"), F.col("end").alias("_z"))
    inside = lines.join(placed.where("kind = 0").select("path", "island", F.col("key").alias("finding_id"), "start", "end"), ["path", "island"]).where("_a <= start AND end <= _z").select("path", "opinion", "finding_id")
    few = inside.groupBy("path", "opinion").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= MOST_CONFIRMED).select("path", "opinion")
    named = opinions.withColumn("opinion", F.concat_ws("\u0001", "detector_id", "start", "end"))
    asked = inside.join(few, ["path", "opinion"]).join(findings.select(F.col("id").alias("finding_id"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("value").alias("_v")), "finding_id")
    asked = asked.join(named.select("path", "opinion", "detector_id", "target", F.col("confidence").alias("_c")), ["path", "opinion"])
    asked = asked.withColumn("key", F.concat_ws("\u0001", "path", "opinion", "finding_id")).withColumn("prompt", F.concat(F.lit("Does this value match the description? "), F.col("target"), F.lit("; value: "), F.col("_v")))
    said = verdicts(asked, judge, "key").where("is_sensitive").select("key", "verdict")
    confirmed = asked.join(said, "key")
    one = confirmed.groupBy("path", "opinion").agg(F.count(F.lit(1)).alias("_k"), F.first(F.struct("finding_id", "detector_id", F.col("_s").alias("start"), F.col("_e").alias("end"), F.col("_v").alias("value"), F.least("_c", "verdict").alias("confidence"))).alias("m")).where("_k = 1")
    merged = one.select("path", "m.*").withColumn("tier", F.when(F.col("confidence") >= tier_limit, "A").otherwise("B"))
    return merged, named.join(one.select("path", "opinion"), ["path", "opinion"], "left_anti").drop("opinion")


def tier_shifts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Findings whose tier a refinement changed, with the direction."""
    a = after.select("path", "start", "end", "category", F.col("tier").alias("now"), F.col("confidence").alias("then"))
    return before.join(a, ["path", "start", "end", "category"]).where("tier <> now").select("path", "start", "end", "category", F.col("tier").alias("was"), "now", F.when(F.col("now") == "A", "raised").otherwise("lowered").alias("direction"))
