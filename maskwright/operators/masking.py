"""Masked values, replacement spans, redacted texts and their verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .findings import islands

# How each detector's, else category's, values are replaced.
BY_DETECTOR = {"credit_card": "partial_mask", "us_ssn": "partial_mask", "email": "synthetic", "phone": "synthetic"}
BY_CATEGORY = {"credential": "full_mask", "financial": "partial_mask", "personal_id": "synthetic"}
SYNTHETIC = {"email": "redacted.user@example.invalid", "phone": "000-000-0000"}
KEEP_END = 4


def _case(column: Column, values: dict[str, str], default: Column) -> Column:
    out = default
    for k, v in reversed(values.items()):
        out = F.when(column == k, F.lit(v)).otherwise(out)
    return out


def strategy(detector: Column, category: Column) -> Column:
    return _case(detector, BY_DETECTOR, _case(category, BY_CATEGORY, F.lit("full_mask")))


def replacement(detector: Column, category: Column, value: Column) -> Column:
    """What stands for the value; never anything that contains it."""
    n, how = F.length(value), strategy(detector, category)
    partial = F.when(n > KEEP_END, F.concat(F.repeat(F.lit("*"), n - KEEP_END), F.right(value, F.lit(KEEP_END))))
    made = F.when(how == "partial_mask", partial).when(how == "synthetic", _case(detector, SYNTHETIC, F.lit(None).cast("string")))
    return T.safe(made, value)


def replacement_spans(findings: DataFrame, checked: bool = False) -> DataFrame:
    """(path, start, end, text) that don't overlap: a lone finding has its replacement, overlapping ones are masked over their union.
    With ``checked`` also the value that stands there, which ``redacted`` compares."""
    own = replacement(F.col("detector_id"), F.col("category"), F.col("value"))
    spans = islands(findings.select("path", "id", "start", "end", "value", own.alias("own")), "id")
    out = spans.groupBy("path", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"), F.first("own").alias("own"), F.first("value").alias("value"))
    return out.select("path", "start", "end", F.when(F.col("n") == 1, F.col("own")).otherwise(F.repeat(F.lit("*"), F.col("end") - F.col("start"))).alias("text"), *([F.when(F.col("n") == 1, F.col("value")).alias("value")] if checked else []))


def redacted(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(path, text) with the spans replaced, for the documents that have some. Raises where a span lies outside the text, or
    where its text isn't the value that the span names."""
    value = F.col("value") if "value" in spans.columns else F.lit(None).cast("string")
    by_path = spans.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "end", "text", value.alias("value")))).alias("spans"))
    both = docs.select("path", F.col("text").alias("whole")).join(by_path, "path")
    whole = F.col("whole")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(F.substring(whole, a["at"] + 1, s["start"] - a["at"]), s["text"])).alias("out"))
    text = F.aggregate("spans", start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(whole, a["at"] + 1, F.length(whole))))
    inside = F.forall("spans", lambda s: (s["start"] >= 0) & (s["end"] <= F.length(whole)))
    same = F.forall("spans", lambda s: s["value"].isNull() | (F.substring(whole, s["start"] + 1, s["end"] - s["start"]) == s["value"]))
    wrong = F.when(~inside, F.raise_error(F.lit("a span lies outside its text"))).otherwise(F.raise_error(F.lit("a span holds another value")))
    return both.select("path", F.when(inside & same, text).otherwise(wrong).alias("text"))


#: What stands for a value in names and labels; the first one that holds none of the values.
MARKERS = ("[redacted]", "[hidden]", "[...]", "***", "###")


def scrub(text: Column, values: list[str], marker: str = "[redacted]") -> Column:
    """The text without any of the values, longest first, in any case."""
    for v in sorted(set(values), key=lambda x: (-len(x), x)):
        text = F.regexp_replace(text, T.literal_pattern(v), marker)
    return text


def scrubbed(text: Column, values: Column) -> Column:
    """The text without any of an array of values, longest first, in any case; a marker that holds none of them stands for each."""
    longest = F.array_sort(F.transform(F.array_distinct(F.filter(values, lambda v: F.length(v) > 0)), lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v"))))
    marker = F.lit("")
    for m in reversed(MARKERS):
        marker = F.when(~F.exists(values, lambda v: (F.length(v) > 0) & F.contains(F.lit(m), F.lower(v))), F.lit(m)).otherwise(marker)
    quoted = lambda v: F.concat(F.lit("(?iu)\\Q"), F.replace(v, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return T.let(marker, lambda m: F.aggregate(longest, text, lambda a, x: F.regexp_replace(a, quoted(x["v"]), m)))


def output_path(path: Column) -> Column:
    """The name of a redacted copy: the mark stands before the last suffix."""
    return F.regexp_replace(path, r"(?s)^(.*?[^/])(\.[^./]+)?$", "$1-auto-redacted-copy$2")
