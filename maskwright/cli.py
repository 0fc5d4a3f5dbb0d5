"""python -m maskwright.cli scan PATH...: findings of files, as text or JSON, without their values.
python -m maskwright.cli redact PATH...: copies of the files in which they are replaced."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import detectors as D
from .operators import findings as G
from .operators import remediation as RM
from .operators import reports as P
from .sources import files as S
from .sources import rewrite as V
from .sources import rules as R
from .sources.store import written

#: Characters of a text that one task scans at a time.
CORE = 4_000_000
TIERS = {"A": "almost certain", "B": "to be looked at"}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="maskwright")
    commands = out.add_subparsers(dest="command", required=True)
    scan = commands.add_parser("scan", help="findings of files, without their values")
    redacted = commands.add_parser("redact", help="copies of files without their certain findings, beside them")
    for command in (scan, redacted):
        _options(command)
    scan.add_argument("--json", action="store_true", help="one JSON object a line")
    scan.add_argument("--markdown", action="store_true", help="a section for each file")
    redacted.add_argument("--all", action="store_true", help="findings that aren't certain as well")
    redacted.add_argument("--partial", action="store_true", help="copies of the files that can be rewritten, though others can't")
    return out


def _options(scan: argparse.ArgumentParser) -> None:
    scan.add_argument("paths", nargs="+")
    scan.add_argument("--category", action="append", default=[], help="only findings of this category")
    scan.add_argument("--target", action="append", default=[], help="also find this literal")
    scan.add_argument("--threshold", type=float, default=D.TIER_LIMIT)
    scan.add_argument("--detectors", help="a folder of YAML detectors, beside the built-in ones")
    scan.add_argument("--include", action="append", default=[], help="only this extension")
    scan.add_argument("--exclude", action="append", default=[], help="not this extension")
    scan.add_argument("--ignore-dir", action="append", default=[])
    scan.add_argument("--ignore-file", help="rules of paths to leave out")
    scan.add_argument("--max-size", type=int, default=S.MOST_FILE)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    if not 0 <= a.threshold <= 1:
        raise SystemExit("the threshold lies between 0 and 1")
    spark = spark or SparkSession.builder.appName("maskwright").getOrCreate()
    detectors = D.checked([*D.BUILT_IN, *(D.load_yaml(a.detectors) if a.detectors else [])]) + [D.literal_target(i, t) for i, t in enumerate(a.target)]
    rules = R.parse_rules(open(a.ignore_file, encoding="utf-8").read()) if a.ignore_file else []
    started = time.time()
    docs, skipped = S.load(spark, a.paths, rules=rules, include=a.include, exclude=a.exclude, directories=(*S.IGNORED_DIRECTORIES, *a.ignore_dir), most=a.max_size)
    # files are opened once and texts scanned once, whatever is made of them below
    docs = written(docs, "texts").withColumn("can_anonymize", F.col("format").isin("text", *V.FORMATS))
    hits = written(R.chunked_hits(docs, detectors, CORE, keep=("can_anonymize",), most=D.MOST_CANDIDATES), "hits")
    skipped = written(skipped.unionByName(D.over_budget(hits)), "skipped")
    found = D.scored(hits, detectors, tuple(a.category), a.threshold, keep=("can_anonymize",)).join(D.over_budget(hits).select("path"), "path", "left_anti")
    found = written(G.visible(G.consolidate(found)), "findings")
    if a.command == "redact":
        return redact(spark, a, docs, found, detectors)
    if a.json:
        for r in P.json_rows(G.canonical_order(found)).toLocalIterator():
            print(r["json"])
    else:
        if a.markdown:
            for r in P.markdown(found).orderBy("path").toLocalIterator():
                print(r["markdown"] + "\n")
        else:
            tier = None
            for r in P.tiered(found).toLocalIterator():
                if r["tier"] != tier:
                    tier = r["tier"]
                    print(f"Tier {tier}: {TIERS[tier]}")
                print(r["text"])
        for r in P.skipped_groups(skipped).orderBy("guidance").collect():
            print(f"{r['guidance']}: {r['files']} files ({', '.join(r['codes'])})")
    print(json.dumps(G.progress(found, docs, skipped, time.time() - started).first().asDict()), file=sys.stderr)
    return 0


def redact(spark: SparkSession, a: argparse.Namespace, docs: DataFrame, found: DataFrame, detectors: list[D.Detector]) -> int:
    """Writes a copy of each file whose findings are replaced, all or none; nothing is written over."""
    wanted = found.where(F.col("can_anonymize") & ((F.col("tier") == "A") | F.lit(a.all)))
    outputs = written(RM.rendered(S.contents(spark, a.paths), docs, wanted), "outputs")
    refused = outputs.where("output IS NULL").select("path", "code", "reason").collect()
    for r in refused:
        print(json.dumps({"path": r["path"], "code": r["code"], "reason": r["reason"]}), file=sys.stderr)
    if refused and not a.partial:
        return 1
    copies = {r["target"].removeprefix("file:"): bytes(r["output"]) for r in outputs.where("output IS NOT NULL").select("target", "output").toLocalIterator()}
    RM.publish(copies)
    left = {r["path"]: r["left"] for r in RM.remaining(outputs, detectors).collect()}
    print(json.dumps({"copies": len(copies), "refused": len(refused), "detections_left": sum(left.values())}), file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
