"""Plans of what is masked in which file, their states, and publishing of redacted copies."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import files as S
from ..sources import rewrite as V
from . import detectors as D
from . import masking as M

#: Values that are shown at a time.
MOST_REVEALED = 250
DECISIONS = ("pending", "included", "ignored")


class Conflict(Exception):
    """The plan has moved on since the caller read it."""


def new_plan(findings: DataFrame) -> DataFrame:
    """A row for each finding: pending, or read_only where its file can't be rewritten."""
    state = F.when(F.col("can_anonymize"), "pending").otherwise("read_only")
    return findings.select("id", "path", "tier", state.alias("state"))


def decide(plan: DataFrame, revision: int, seen: int, include: list[str] = (), ignore: list[str] = ()) -> tuple[DataFrame, int]:
    """The plan with decisions applied, and its next revision; ids in both lists, read-only ids and stale callers are refused."""
    if seen != revision:
        raise Conflict(f"the plan is at revision {revision}")
    if set(include) & set(ignore):
        raise ValueError("an id is both included and ignored")
    wanted = sorted({*include, *ignore})
    if wanted and plan.where(F.col("id").isin(wanted) & (F.col("state") != "read_only")).select("id").distinct().count() != len(wanted):
        raise ValueError("an id is unknown or read-only")
    state = F.when(F.col("id").isin(list(include)), "included").when(F.col("id").isin(list(ignore)), "ignored").otherwise(F.col("state"))
    return plan.withColumn("state", state), revision + 1


def counts(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count_if(F.col("state") == "included").alias("selected"), F.count_distinct(F.when(F.col("state") == "included", F.col("path"))).alias("files"), F.count_if(F.col("state") == "read_only").alias("read_only"))


def output_state(made_from: Column, plan_now: Column, output_sha: Column, expected_sha: Column, included: Column) -> Column:
    """not_created, conflict, obsolete, regeneration_required or current."""
    return F.when(made_from.isNull(), "not_created").when(~output_sha.eqNullSafe(expected_sha), "conflict").when(included == 0, "obsolete").when(made_from != plan_now, "regeneration_required").otherwise("current")


def effective_state(state: Column, can_anonymize: Column) -> Column:
    """A state that is unknown, or that the file can't have, counts as read_only."""
    known = state.isin(*DECISIONS)
    return F.when(F.coalesce(can_anonymize, F.lit(False)) & F.coalesce(known, F.lit(False)), state).otherwise("read_only")


def rendered(files: DataFrame, docs: DataFrame, findings: DataFrame) -> DataFrame:
    """(path, target, output, code, reason): the redacted copy of each file with findings, or why there is none.

    files: path, content; docs: path, format, text, codec, bom; findings: those to replace. Texts are encoded as they were read;
    documents are rewritten in place and read again. A file is one row, whole or refused.
    """
    spans = M.replacement_spans(findings, checked=True)
    plain = M.redacted(docs.where("format = 'text'"), spans).join(docs.select("path", "codec", "bom"), "path")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text, codec, bom in zip(b["path"], b["text"], b["codec"], b["bom"]):
                try:
                    rows.append((path, (bom or b"") + text.encode(codec), None, None))
                except UnicodeEncodeError:
                    rows.append((path, None, "not_rewritable", f"the replaced text isn't {codec}"))
            yield pd.DataFrame(rows, columns=["path", "output", "code", "reason"])

    schema = "path string, output binary, code string, reason string"
    texts = plain.select("path", "text", "codec", "bom").mapInPandas(encode, schema)
    packed = spans.join(docs.where("format <> 'text'").select("path"), "path").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "end", "text"))).alias("spans"))
    others = V.rewritten(files.join(packed, "path"))
    return texts.unionByName(others).select("path", M.output_path(F.col("path")).alias("target"), "output", "code", "reason")


def results(plan: DataFrame, outputs: DataFrame) -> DataFrame:
    """The plan with each file's output: a row for each finding with target, code and whether a copy was made."""
    made = outputs.select("path", "target", "code", F.col("output").isNotNull().alias("made"))
    out = plan.join(made, "path", "left")
    return out.withColumn("made", F.coalesce("made", F.lit(False)) & (F.col("state") == "included"))


def remaining(outputs: DataFrame, detectors: list) -> DataFrame:
    """(path, left): detections that are still in the copies, read again from their bytes; replacements of the kind that masks use count too."""
    again = S.read_documents(outputs.where("output IS NOT NULL").select("path", F.col("output").alias("content")))
    counts = D.detect(again.where("code IS NULL").select("path", "text"), detectors).groupBy("path").agg(F.count(F.lit(1)).alias("left"))
    return again.select("path").join(counts, "path", "left").select("path", F.coalesce("left", F.lit(0)).alias("left"))


def revealed(findings: DataFrame, ids: list[str]) -> DataFrame:
    """(id, value) of at most MOST_REVEALED findings, in no order."""
    wanted = list(dict.fromkeys(ids))
    if len(wanted) > MOST_REVEALED:
        raise ValueError(f"at most {MOST_REVEALED} values are shown at a time")
    return findings.where(F.col("id").isin(wanted)).select("id", "value")


def publish(outputs: dict[str, bytes]) -> None:
    """Puts files in place, all or none: each is staged beside its place, then all are renamed; on failure what was there returns.

    For the few files of an interactive remediation; datasets go through Spark's commit protocol.
    """
    tag, staged, backups, placed = uuid.uuid4().hex[:8], {}, {}, []
    try:
        for name, data in outputs.items():
            part = Path(f"{name}.{tag}.part")
            with part.open("xb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            staged[name] = part
        for name, part in staged.items():
            if os.path.lexists(name):
                backups[name] = Path(f"{name}.{tag}.old")
                os.replace(name, backups[name])
            placed.append(name)
            os.replace(part, name)
        for name, data in outputs.items():
            if Path(name).read_bytes() != data:
                raise OSError(f"{name} changed while it was published")
    except BaseException:
        for name in placed:
            if name in backups:
                os.replace(backups.pop(name), name)
            else:
                Path(name).unlink(missing_ok=True)
        raise
    finally:
        for part in staged.values():
            part.unlink(missing_ok=True)
        for old in backups.values():
            old.unlink(missing_ok=True)
