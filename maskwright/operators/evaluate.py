"""Quality of findings against labelled values: one-to-one matching, metrics, sweeps, calibration."""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .findings import islands


#: What must hold of tier A, and of all findings, before a scan is let out.
TARGETS = {"tier_a_precision": 0.90, "tier_a_recall": 0.50, "any_tier_recall": 0.95}
#: Weight profiles that are tried: what is added to each base, and what scales each context weight.
PROFILES = tuple((f"base{offset:+.2f}-contextx{scale:.2f}-v1", offset, scale) for offset in (-0.05, 0.0, 0.05) for scale in (0.75, 1.0, 1.25))


_PAIR = ("plant_id", "finding_id", "start", "end", "category", "overhang", "length", "other_detector", "confidence")


def _met(plants: DataFrame, findings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(file, by, island, pairs): the pairs of each island of overlapping spans that has plants and findings. One shuffle, by file."""
    key = ("file", *by)
    span = lambda df, kind: df.select(*key, "category", "start", "end", F.lit(kind).alias("kind"), F.col("plant_id" if kind else "finding_id").cast("string").alias("id"), "detector_id", (F.lit(None).cast("double") if kind else F.col("confidence")).alias("confidence"))
    spans = islands(span(plants, 1).unionByName(span(findings, 0)).where("start >= 0 AND end > start"), "kind", "id", by=key)
    of = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.struct("start", "end", "category", "id", "detector_id", "confidence")))
    met = spans.groupBy(*key, "island").agg(of(1).alias("_p"), of(0).alias("_f")).where((F.size("_p") > 0) & (F.size("_f") > 0))

    def pair(p, f):
        overhang = p["start"] - f["start"] + f["end"] - p["end"]
        values = (p["id"].cast("long"), f["id"], f["start"], f["end"], f["category"], overhang, f["end"] - f["start"], (p["detector_id"] != f["detector_id"]).cast("int"), f["confidence"])
        return F.struct(*(v.alias(n) for n, v in zip(_PAIR, values)))

    fits = lambda p: F.filter("_f", lambda f: (f["category"] == p["category"]) & (f["start"] <= p["start"]) & (f["end"] >= p["end"]))
    pairs = F.flatten(F.transform("_p", lambda p: F.transform(fits(p), lambda f: pair(p, f))))
    return met.select(*key, "island", pairs.alias("pairs")).where(F.size("pairs") > 0)


def candidate_pairs(plants: DataFrame, findings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Plants and findings of one file and category, the finding's span around the plant's.

    Such pairs lie in one island of overlapping spans, so they are made within it and no file is compared with itself.
    ``by`` names columns that both have and that are matched apart.
    """
    return _met(plants, findings, by).select("file", *by, "island", F.inline("pairs"))


def _assign(rows: pd.DataFrame) -> pd.DataFrame:
    """Most pairs, then the least of (overhang, length, other detectors, -confidence, rank) in total, exact.

    Successive shortest augmenting paths with tuples as costs. Findings of one span and category are one unit; plants of two categories
    are two, whatever their ids.
    """
    rows = rows.sort_values(["plant_id", "finding_id"], kind="stable").reset_index(drop=True)
    best: dict[tuple, tuple] = {}
    zero = (0, 0, 0, Fraction(0), 0)
    for rank, r in enumerate(rows.itertuples(index=False)):
        cost = (int(r.overhang), int(r.length), int(r.other_detector), -Fraction(float(r.confidence)), rank)
        key = ((r.plant_id, r.category), (int(r.start), int(r.end), r.category))
        if key not in best or cost < best[key][0]:
            best[key] = (cost, r.finding_id)
    plants = sorted({k[0] for k in best})
    edges: dict = {p: {} for p in plants}
    for (p, unit), (cost, _) in best.items():
        edges[p][unit] = cost
    taken: dict = {}  # unit: plant
    add = lambda a, b: tuple(x + y for x, y in zip(a, b))
    neg = lambda a: tuple(-x for x in a)
    free = set(plants)
    while free:
        # Bellman-Ford from all free plants over the residual graph
        cost_p = {p: zero for p in free}
        cost_u: dict = {}
        came: dict = {}
        changed = True
        while changed:
            changed = False
            for p, c in list(cost_p.items()):
                for u, w in edges[p].items():
                    if taken.get(u) != p and (u not in cost_u or add(c, w) < cost_u[u]):
                        cost_u[u], came[u], changed = add(c, w), p, True
            for u, p in taken.items():
                if u in cost_u:
                    c = add(cost_u[u], neg(edges[p][u]))
                    if p not in cost_p or c < cost_p[p]:
                        cost_p[p], changed = c, True
        ends = [(c, u) for u, c in cost_u.items() if u not in taken]
        if not ends:
            break
        u = min(ends)[1]
        while True:
            p = came[u]
            before = next((v for v, q in taken.items() if q == p), None)
            taken[u] = p
            if p in free:
                free.discard(p)
                break
            del taken[before]
            u = before
    return pd.DataFrame([(p[0], best[p, u][1]) for u, p in sorted(taken.items())], columns=["plant_id", "finding_id"])


def _solved(islands_: pd.Series) -> pd.Series:
    """``_assign`` of each island; those that need no search come as nulls and cost nothing here."""
    solve = lambda rows: _assign(pd.DataFrame([{c: r[c] for c in _PAIR} for r in rows])).to_dict("records")
    return islands_.map(lambda rows: None if rows is None else solve(rows))


def matched(plants: DataFrame, findings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(file, by, plant_id, finding_id): the one-to-one matching, solved in each island of overlapping spans.

    An island with one plant or one unit of findings has its cheapest pair, one in which each plant and each unit has a single pair
    has all of them; nearly all are such, and only the others go through Python.
    """
    met = _met(plants, findings, by)
    plant, unit = lambda x: F.struct(x["plant_id"], x["category"]), lambda x: F.struct(x["start"], x["end"], x["category"])
    n, n_plants, n_units = F.size("pairs"), F.size(F.array_distinct(F.transform("pairs", plant))), F.size(F.array_distinct(F.transform("pairs", unit)))
    lone = (n_plants == 1) | (n_units == 1)
    met = met.withColumn("_kind", F.when(lone, 1).when((n_plants == n) & (n_units == n), 2).otherwise(3))
    kind = "array<struct<plant_id:bigint,finding_id:string>>"
    both = lambda x: F.struct(x["plant_id"].alias("plant_id"), x["finding_id"].alias("finding_id"))
    # structs are compared by their fields from the first
    cost = lambda x: F.struct(x["overhang"].alias("o"), x["length"].alias("l"), x["other_detector"].alias("d"), (-x["confidence"]).alias("c"), x["plant_id"].alias("plant_id"), x["finding_id"].alias("finding_id"))
    met = met.withColumn("_hard", F.pandas_udf(_solved, kind)(F.when(F.col("_kind") == 3, F.col("pairs"))))
    best = T.let(F.array_min(F.transform("pairs", cost)), lambda x: F.array(both(x)))
    out = F.when(F.col("_kind") == 1, best).when(F.col("_kind") == 2, F.transform("pairs", both)).otherwise(F.col("_hard"))
    return met.select("file", *by, F.inline(out))


def outcomes(plants: DataFrame, findings: DataFrame) -> DataFrame:
    """Each finding with hit: whether it is matched to a plant that is a real value."""
    real = plants.where("is_positive")
    hits = matched(real, findings).select(F.col("file").alias("_f"), F.col("finding_id").alias("_i"))
    out = findings.join(hits, (F.col("file") == F.col("_f")) & (F.col("finding_id") == F.col("_i")), "left")
    return out.withColumn("hit", F.col("_i").isNotNull()).drop("_f", "_i")


def sweep(rated: DataFrame, positives: int, thresholds: list[float]) -> DataFrame:
    """Precision, recall and F1 at each threshold; no findings: precision 0; no positives: recall 1.

    Every finding is put to the highest threshold it reaches, so each counts once, and sums run over the thresholds.
    """
    from pyspark.sql import Window as W

    levels = sorted(set(thresholds))
    reached = F.element_at(F.filter(F.array(*map(F.lit, levels)), lambda t: t <= F.col("confidence")), -1)
    counts = rated.where(F.col("confidence") >= levels[0]).groupBy(reached.alias("threshold")).agg(F.count_if("hit").alias("_tp"), F.count_if(~F.col("hit")).alias("_fp"))
    grid = rated.sparkSession.createDataFrame([(t,) for t in levels], "threshold double").join(counts, "threshold", "left")
    above = W.orderBy(F.desc("threshold")).rowsBetween(W.unboundedPreceding, 0)
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).over(above)
    out = grid.select("threshold", total("_tp").alias("tp"), total("_fp").alias("fp"))
    precision = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    recall = F.col("tp") / F.lit(positives) if positives else F.lit(1.0)
    out = out.select("threshold", "tp", "fp", precision.alias("precision"), recall.alias("recall"))
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def choose(swept: DataFrame, least_precision: float = 0.90, preferred: float = 0.85) -> DataFrame:
    """The threshold with the best recall, then precision, then nearness to the preferred one, among precise enough ones."""
    return swept.where(F.col("precision") >= least_precision).orderBy(F.desc("recall"), F.desc("precision"), F.abs(F.col("threshold") - preferred), "threshold").limit(1)


def calibration(rated: DataFrame, buckets: int = 10) -> DataFrame:
    """Count, mean confidence and hit rate of each bucket of equal width; the last one is closed on the right."""
    b = F.least(F.floor(F.col("confidence") * buckets), F.lit(buckets - 1)).cast("int")
    y = F.col("hit").cast("double")
    return rated.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg(y).alias("hit_rate"), F.sum(F.pow(F.col("confidence") - y, 2)).alias("squares"))


def calibration_error(table: DataFrame) -> DataFrame:
    """Brier score and expected calibration error from the buckets."""
    n = F.sum("n")
    return table.agg((F.sum("squares") / n).alias("brier"), (F.sum(F.col("n") * F.abs(F.col("mean_confidence") - F.col("hit_rate"))) / n).alias("ece"))


def _ratio(a, b, empty: float):
    return F.when(b > 0, a / b).otherwise(F.lit(empty))


def _f1(precision, recall):
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def metrics(findings: DataFrame, plants: DataFrame) -> DataFrame:
    """One row: counts, precision, recall and F1 of all findings and of tier A, and what tier B adds to recall.

    Tier A is matched for itself, as a finding of tier B may hold the plant of one of tier A in the common matching.
    """
    real = plants.where("is_positive")
    both = findings.withColumn("grp", F.explode(F.when(F.col("tier") == "A", F.array(F.lit("all"), F.lit("A"))).otherwise(F.array(F.lit("all")))))
    again = real.withColumn("grp", F.explode(F.array(F.lit("all"), F.lit("A"))))
    hits = matched(again, both, ("grp",)).agg(F.count_if(F.col("grp") == "all").alias("tp"), F.count_if(F.col("grp") == "A").alias("tp_a"))
    found = findings.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("tier") == "A").alias("n_a"))
    there = plants.agg(F.count_if("is_positive").alias("p"), F.count_if(~F.col("is_positive")).alias("decoys"))
    c = F.col
    out = _together([t.withColumn("one", F.lit(1)) for t in (hits, found, there)], "one")
    out = out.select(
        c("n").alias("findings"), c("p").alias("positive_plants"), c("decoys").alias("decoy_plants"), c("n_a").alias("tier_a_findings"), c("tp_a").alias("tier_a_true_positives"), c("tp").alias("true_positives"),
        (c("n") - c("tp")).alias("false_positives"), (c("p") - c("tp")).alias("false_negatives"), _ratio(c("tp"), c("n"), 0.0).alias("precision"), _ratio(c("tp"), c("p"), 1.0).alias("any_tier_recall"),
        _ratio(c("tp_a"), c("n_a"), 0.0).alias("tier_a_precision"), _ratio(c("tp_a"), c("p"), 1.0).alias("tier_a_recall"),
    )
    return out.withColumn("f1", _f1(c("precision"), c("any_tier_recall"))).withColumn("rescue_recall", c("any_tier_recall") - c("tier_a_recall"))


def user_impact(measured: DataFrame, files: int) -> DataFrame:
    """Of ``metrics``: false positives in 1,000 files, and findings for each planted value."""
    return measured.select((F.col("false_positives") / F.lit(files) * 1000 if files else F.lit(0.0)).alias("false_positives_per_1000_files"), _ratio(F.col("findings"), F.col("positive_plants"), 0.0).alias("findings_per_plant"))


def category_breakdown(findings: DataFrame, plants: DataFrame) -> DataFrame:
    """Measures of each category that a finding or a real plant has; matches never cross categories."""
    real = plants.where("is_positive")
    hits = matched(real.withColumn("grp", F.col("category")), findings.withColumn("grp", F.col("category")), ("grp",))
    count = lambda df, name, key: df.groupBy(F.col(key).alias("category")).agg(F.count(F.lit(1)).alias(name))
    out = _together([count(findings, "findings", "category"), count(real, "plants", "category"), count(hits, "tp", "grp")], "category")
    precision, recall = _ratio(F.col("tp"), F.col("findings"), 0.0), _ratio(F.col("tp"), F.col("plants"), 1.0)
    return out.select("category", "findings", "plants", (F.col("findings") - F.col("tp")).alias("false_positives"), (F.col("plants") - F.col("tp")).alias("false_negatives"), precision.alias("precision"), recall.alias("recall"), _f1(precision, recall).alias("f1"))


def _together(tables: list[DataFrame], key: str) -> DataFrame:
    """Counts of the same key side by side, 0 where one lacks it; small tables, one aggregate instead of joins."""
    names = [c for t in tables for c in t.columns if c != key]
    rows = None
    for t in tables:
        part = t.select(key, *((F.col(n) if n in t.columns else F.lit(0).cast("long")).alias(n) for n in names))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(key).agg(*(F.sum(n).alias(n) for n in names))


def detector_breakdown(findings: DataFrame, opinions: DataFrame, plants: DataFrame) -> DataFrame:
    """Each detector by its own raw opinions, and by the canonical findings that it leads or supports.

    findings: file, finding_id, start, end, category, detector_id, confidence, supporting (array of detector ids); opinions:
    the detections, as findings. Precision asks whether an opinion is right at all, recall whether the detector's own plants are covered.
    """
    real = plants.where("is_positive")
    ids = F.array_union(F.array("detector_id"), "supporting")
    parts = findings.withColumn("by_detector", F.explode(ids))
    own = opinions.withColumn("by_detector", F.col("detector_id"))
    columns = ["file", "finding_id", "start", "end", "category", "detector_id", "confidence"]
    asked = None
    # four matchings in one: raw or canonical, against all plants or the detector's own
    for kind, rows in (("raw", own), ("canonical", parts)):
        for scope in ("all", "own"):
            part = rows.select(*columns, F.concat_ws("|", F.lit(kind), F.lit(scope), "by_detector").alias("grp"))
            asked = part if asked is None else asked.unionByName(part)
    detectors = opinions.select("detector_id").union(findings.select("detector_id")).union(real.select("detector_id")).distinct()
    groups = detectors.select(F.col("detector_id").alias("d"), F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(s).alias("scope")) for k in ("raw", "canonical") for s in ("all", "own")))).alias("g"))
    grp = F.concat_ws("|", "g.kind", "g.scope", "d").alias("grp")
    # detectors are few; a plant is asked for by those only whose spans meet it, so all of them would be the same rows again
    against = real.join(F.broadcast(groups), (F.col("g.scope") == "all") | (F.col("d") == F.col("detector_id"))).select(*real.columns, grp)
    hits = matched(against, asked, ("grp",)).select(F.split("grp", "[|]", 3).alias("g"))
    count = lambda df, name, key="detector_id": df.groupBy(key).agg(F.count(F.lit(1)).alias(name)).withColumnRenamed(key, "detector_id")
    of = lambda kind, scope: hits.where((F.get("g", F.lit(0)) == kind) & (F.get("g", F.lit(1)) == scope)).select(F.get("g", F.lit(2)).alias("detector_id"))
    out = _together([count(findings, "emitted"), count(parts, "contributions", "by_detector"), count(real, "expected"), count(opinions, "raw"), *(count(of(k, s), f"{k}_{s}") for k in ("raw", "canonical") for s in ("all", "own"))], "detector_id")
    c = F.col
    return out.select(
        "detector_id", _ratio(c("raw_all"), c("raw"), 0.0).alias("precision"), _ratio(c("raw_own"), c("expected"), 1.0).alias("recall"), (c("raw") - c("raw_all")).alias("false_positives"), (c("expected") - c("raw_own")).alias("false_negatives"),
        c("emitted").alias("emitted_findings"), c("contributions").alias("canonical_contributions"), _ratio(c("canonical_all"), c("contributions"), 0.0).alias("canonical_precision"), _ratio(c("canonical_own"), c("expected"), 1.0).alias("canonical_recall"),
        (c("contributions") - c("canonical_all")).alias("canonical_false_positives"), (c("expected") - c("canonical_own")).alias("canonical_false_negatives"), c("expected").alias("expected_plants"), c("raw").alias("raw_opinions"),
        (c("raw") - c("emitted")).alias("consolidated_opinions"), (c("raw") - c("contributions")).alias("unrepresented_opinions"), _ratio(c("raw") - c("emitted"), c("raw"), 0.0).alias("consolidation_rate"),
    )


def threshold_candidates(findings: DataFrame, preferred: float = 0.85) -> DataFrame:
    """Every threshold that can give another set of findings, with 0, 1 and the preferred one."""
    fixed = findings.sparkSession.createDataFrame([(0.0,), (1.0,), (preferred,)], "threshold double")
    return findings.select(F.col("confidence").alias("threshold")).union(fixed).distinct()


def choose_profile(rows: DataFrame, deployed: str) -> DataFrame:
    """Of (profile, brier, ece, recall, precision, eligible) the profile with the least loss; ties: recall, precision, the
    deployed one, the name."""
    return rows.where("eligible").orderBy(F.col("brier") + F.col("ece"), F.desc("recall"), F.desc("precision"), (F.col("profile") != deployed).cast("int"), "profile").limit(1)


def gates(measured: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """(gate, value, target, support, passed) of ``metrics``; a gate without support fails."""
    support = {"tier_a_precision": "tier_a_findings"}
    rows = F.array(*(F.struct(F.lit(g).alias("gate"), F.col(g).alias("value"), F.lit(t).alias("target"), F.col(support.get(g, "positive_plants")).alias("support")) for g, t in (targets or TARGETS).items()))
    return measured.select(F.explode(rows).alias("g")).select("g.*", ((F.col("g.support") > 0) & (F.col("g.value") >= F.col("g.target"))).alias("passed"))


def shared_values(a: DataFrame, b: DataFrame, *columns: str) -> DataFrame:
    """Values that two corpora share and shouldn't, as one was used to choose what the other judges."""
    return a.select(*columns).intersect(b.select(*columns))


def compared(before: DataFrame, after: DataFrame, percent: float = 20.0, noise_ms: float = 25.0) -> DataFrame:
    """Of (fixture, environment, wall_ms) runs: median times of the same fixture and environment, and whether the later is slower than
    the budget in percent and in milliseconds of noise."""
    median = lambda df, name: df.groupBy("fixture", "environment").agg(F.median("wall_ms").alias(name))
    both = median(before, "was").join(median(after, "now"), ["fixture", "environment"])
    return both.withColumn("regressed", (F.col("now") > F.col("was") * (1 + percent / 100)) & (F.col("now") - F.col("was") > noise_ms))
