import json

import pytest

from maskwright.operators import detectors as D
from maskwright.operators import findings as G
from maskwright.operators import masking as M
from maskwright.operators import refine as L
from maskwright.operators import remediation as R
from maskwright.operators import reports as P
from pyspark.sql import functions as F

ROWS = [("a/x.txt", "call 555-123-4567 or mail jo@site.org\nssn 123-45-6789"), ("b.txt", "nothing here")]


@pytest.fixture(scope="module")
def found(spark):
    return G.consolidate(D.detect(spark.createDataFrame(ROWS, "path string, text string"), list(D.BUILT_IN))).cache()


def test_reports(spark, found):
    rows = [json.loads(r["json"]) for r in P.json_rows(found).collect()]
    assert {r["detector_id"] for r in rows} == {"phone", "email", "us_ssn"}
    assert not any("555-123-4567" in str(r) or "value" in r or "start" in r for r in rows)
    text = P.markdown(found).first()["markdown"]
    assert text.startswith("## a/x\\.txt") and "**A** us\\_ssn at line 2, column 5" in text and "123-45-6789" not in text
    skipped = spark.createDataFrame([("p", "encrypted"), ("q", "archive_limit"), ("r", "unsafe_xml"), ("s", "what")], "path string, code string")
    assert {r["guidance"]: r["files"] for r in P.skipped_groups(skipped).collect()} == {"Encrypted": 1, "Unsafe to unpack": 2, "Other": 1}
    assert P.filtered(found, tier="A", category="personal_id").where("detector_id = 'us_ssn'").count() == 1
    assert [r[0] for r in spark.createDataFrame([(5,), (2048,), (3 << 20,)], "n long").select(P.size_text(F.col("n"))).collect()] == ["5 B", "2.0 KB", "3.0 MB"]


def test_refinement(found):
    seen = []
    before = {r["detector_id"]: r for r in found.collect()}

    def judge(prompt):
        if "phone" in prompt:
            return (True, 1.0, "r" * 900)
        if "email" in prompt:
            raise RuntimeError("no answer")
        return (False, 7.0, "out of range")

    after = {r["detector_id"]: r for r in L.refine(found, judge).collect()}
    assert after["phone"]["confidence"] == pytest.approx((before["phone"]["confidence"] + 1) / 2) and len(after["phone"]["reason"]) == 300
    assert after["email"]["confidence"] == before["email"]["confidence"] and after["us_ssn"]["verdict"] is None
    assert {r["id"] for r in after.values()} == {r["id"] for r in before.values()} and not seen


def test_descriptions(spark):
    text = "\n\n  first line \n" + "\n".join(f"line {i}" for i in range(60))
    docs = spark.createDataFrame([("p", text)], "path string, text string")
    lines = L.candidate_lines(docs).collect()
    assert len(lines) == 40 and all(text[r["start"] :].startswith(r["line_text"]) for r in lines)
    got = L.described(docs, ["anything", "the first"], lambda p: ("the first" in p and "first line" in p, 0.9, "")).collect()
    assert [(r["detector_id"], r["start"], r["value"], r["tier"]) for r in got] == [("user_target_desc_1", 4, "first line", "A")]


def test_plan(spark, found):
    plan = R.new_plan(found.withColumn("can_anonymize", F.col("detector_id") != "phone"))
    ids = {r["id"]: r["state"] for r in plan.collect()}
    assert sorted(ids.values()) == ["pending", "pending", "read_only"]
    first, *_ = [i for i, s in ids.items() if s == "pending"]
    plan, revision = R.decide(plan, 0, 0, include=[first])
    assert revision == 1 and list(R.counts(plan).first()) == [1, 1, 1]
    with pytest.raises(R.Conflict):
        R.decide(plan, 1, 0)
    with pytest.raises(ValueError):
        R.decide(plan, 1, 1, include=[i for i, s in ids.items() if s == "read_only"])
    states = spark.createDataFrame([(None, 1, None, None, 1), (1, 1, "a", "a", 1), (1, 2, "a", "a", 1), (1, 1, "b", "a", 1), (1, 1, "a", "a", 0)], "m int, p int, o string, e string, i int")
    assert [r[0] for r in states.select(R.output_state(*(F.col(c) for c in "mpoei"))).collect()] == ["not_created", "current", "regeneration_required", "conflict", "obsolete"]


def test_publish(tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    R.publish({a: b"1", b: b"2"})
    R.publish({a: b"3"})
    assert (tmp_path / "a").read_bytes() == b"3" and (tmp_path / "b").read_bytes() == b"2"
    with pytest.raises(OSError):
        R.publish({a: b"4", str(tmp_path / "none" / "c"): b"5"})
    assert (tmp_path / "a").read_bytes() == b"3" and sorted(p.name for p in tmp_path.iterdir()) == ["a", "b"]


def test_matching_like_brute_force(spark):
    import itertools
    import random

    from maskwright.operators import evaluate as E

    r = random.Random(4)
    plants, found = [], []
    for f in range(25):
        for k in range(r.randint(1, 3)):
            s = r.randint(0, 6)
            plants.append((f"f{f}", f * 10 + k, s, s + r.randint(1, 4), "c", r.choice("ab"), True))
        for k in range(r.randint(1, 4)):
            s = r.randint(0, 5)
            found.append((f"f{f}", f"{f}-{k}", s, s + r.randint(1, 9), "c", r.choice("ab"), r.choice([0.25, 0.5, 0.75])))
    p = spark.createDataFrame(plants, "file string, plant_id long, start int, end int, category string, detector_id string, is_positive boolean")
    q = spark.createDataFrame(found, "file string, finding_id string, start int, end int, category string, detector_id string, confidence double")
    pairs = {}
    for x in E.candidate_pairs(p, q).collect():
        pairs.setdefault(x["file"], []).append(x)
    got = {}
    for x in E.matched(p, q).collect():
        got.setdefault(x["file"], []).append((x["plant_id"], x["finding_id"]))
    for f, rows in pairs.items():
        best = None
        for n in range(len(rows), 0, -1):
            for some in itertools.combinations(rows, n):
                if len({x["plant_id"] for x in some}) == n == len({(x["start"], x["end"]) for x in some}):
                    cost = (-n, sum(x["overhang"] for x in some), sum(x["length"] for x in some), sum(x["other_detector"] for x in some), -sum(x["confidence"] for x in some))
                    best = min(best or cost, cost)
        by = {(x["plant_id"], x["finding_id"]): x for x in rows}
        mine = [by[m] for m in got[f]]
        assert (-len(mine), sum(x["overhang"] for x in mine), sum(x["length"] for x in mine), sum(x["other_detector"] for x in mine), -sum(x["confidence"] for x in mine)) == best


def test_scrubbing_and_labels(spark):
    rows = [("see Jo@Site.org and JO@site.org.x", ["jo@site.org", "site", ""]), ("a\\E.b", ["a\\E.b"]), ("[redacted] x", ["redact"]), ("none", [])]
    df = spark.createDataFrame(rows, "t string, v array<string>")
    got = [r[0] for r in df.select(M.scrubbed(F.col("t"), F.col("v"))).collect()]
    assert got == ["see [redacted] and [redacted].x", "[redacted]", "[[hidden]ed] x", "none"]
    labels = spark.createDataFrame([(" a\tb\u0000  c ",), ("x" * 2000,)], "t string").select(P.plain(F.col("t"))).collect()
    assert labels[0][0] == "a b c" and len(labels[1][0]) == 511 and "\u2026" in labels[1][0]


def test_reconciled_descriptions(spark):
    text = "badge 4711 of jo\nbadges 1 2 3\nplain line"
    findings = spark.createDataFrame([("p", "f1", 6, 10, "4711"), ("p", "f2", 14, 16, "jo"), ("p", "f3", 24, 25, "1"), ("p", "f4", 26, 27, "2")], "path string, id string, start int, end int, value string")
    lines = [("p", "user_target_desc_0", "a badge", "request", 0, 16, text[:16], 0.9, 0, "A"), ("p", "user_target_desc_0", "a badge", "request", 17, 29, text[17:29], 0.9, 0, "A"), ("p", "user_target_desc_0", "a badge", "request", 30, 40, text[30:], 0.9, 0, "A")]
    opinions = spark.createDataFrame(lines, "path string, detector_id string, target string, category string, start int, end int, value string, confidence double, specificity int, tier string")
    merged, standing = L.reconciled(opinions, findings, lambda p: (not p.endswith("jo"), 0.8, ""))
    assert [tuple(r) for r in merged.collect()] == [("p", "f1", "user_target_desc_0", 6, 10, "4711", 0.8, "B")]
    assert sorted(r["start"] for r in standing.collect()) == [17, 30] and standing.columns == opinions.columns


def test_spans_must_hold_their_values(spark):
    docs = spark.createDataFrame([("p", "abc def")], "path string, text string")
    spans = lambda v: spark.createDataFrame([("p", 4, 7, "***", v)], "path string, start int, end int, text string, value string")
    assert M.redacted(docs, spans("def")).first()["text"] == "abc ***" == M.redacted(docs, spans(None)).first()["text"]
    with pytest.raises(Exception, match="another value"):
        M.redacted(docs, spans("xyz")).collect()


def test_revealed(found):
    ids = [r["id"] for r in found.collect()]
    assert R.revealed(found, [ids[0], ids[0]]).count() == 1
    with pytest.raises(ValueError):
        R.revealed(found, [str(i) for i in range(251)])


def test_breakdowns_by_hand(spark):
    from maskwright.operators import evaluate as E

    plants = spark.createDataFrame([("f", 1, 0, 4, "x", "a", True), ("f", 2, 10, 14, "x", "b", True), ("g", 3, 0, 4, "y", "a", True), ("g", 4, 9, 12, "y", "a", False)], "file string, plant_id long, start int, end int, category string, detector_id string, is_positive boolean")
    rows = [("f", "1", 0, 4, "x", "a", 0.9, "A", ["b"]), ("f", "2", 9, 15, "x", "a", 0.5, "B", []), ("g", "3", 9, 12, "y", "a", 0.9, "A", []), ("g", "4", 20, 22, "z", "c", 0.1, "B", [])]
    found = spark.createDataFrame(rows, "file string, finding_id string, start int, end int, category string, detector_id string, confidence double, tier string, supporting array<string>")
    raw = spark.createDataFrame([(*r[:8],) for r in rows] + [("f", "5", 1, 3, "x", "b", 0.3, "B")], "file string, finding_id string, start int, end int, category string, detector_id string, confidence double, tier string")
    m = E.metrics(found, plants).first()
    assert (m["true_positives"], m["false_positives"], m["false_negatives"], m["tier_a_true_positives"], m["decoy_plants"]) == (2, 2, 1, 1, 1)
    assert m["precision"] == 0.5 and m["any_tier_recall"] == pytest.approx(2 / 3) and m["rescue_recall"] == pytest.approx(1 / 3)
    d = {r["detector_id"]: r for r in E.detector_breakdown(found, raw, plants).collect()}
    assert (d["a"]["precision"], d["a"]["recall"], d["a"]["false_positives"], d["a"]["expected_plants"]) == (2 / 3, 0.5, 1, 2)
    assert (d["b"]["precision"], d["b"]["recall"], d["b"]["canonical_contributions"], d["b"]["consolidated_opinions"], d["b"]["raw_opinions"]) == (0.0, 0.0, 1, 1, 1)
    c = {r["category"]: (r["findings"], r["plants"], r["false_positives"], r["false_negatives"]) for r in E.category_breakdown(found, plants).collect()}
    assert c == {"x": (2, 2, 0, 0), "y": (1, 1, 1, 1), "z": (1, 0, 1, 0)}
    assert {r["gate"]: r["passed"] for r in E.gates(E.metrics(found, plants)).collect()} == {"tier_a_precision": False, "tier_a_recall": False, "any_tier_recall": False}
    assert sorted(r[0] for r in E.threshold_candidates(found).collect()) == [0.0, 0.1, 0.5, 0.85, 0.9, 1.0]
    best = spark.createDataFrame([("p", 0.1, 0.1, 0.5, 0.9, True), ("q", 0.1, 0.1, 0.6, 0.9, True), ("r", 0.0, 0.0, 1.0, 1.0, False)], "profile string, brier double, ece double, recall double, precision double, eligible boolean")
    assert E.choose_profile(best, "p").first()["profile"] == "q"
    runs = lambda *ms: spark.createDataFrame([("f", "e", float(x)) for x in ms], "fixture string, environment string, wall_ms double")
    assert not E.compared(runs(100, 90, 500), runs(119)).first()["regressed"] and E.compared(runs(100), runs(126)).first()["regressed"] and not E.compared(runs(10), runs(30)).first()["regressed"]


def test_names_for_people(spark):
    df = spark.createDataFrame([(5.4, 1, 3, "us_ssn"), (61_500.0, 5, 5, "x"), (1500.0, 0, 0, "a-b")], "ms double, done int, total int, id string")
    got = [tuple(r) for r in df.select(P.duration_text(F.col("ms")), P.percent(F.col("done"), F.col("total")), P.display_name(F.col("id"))).collect()]
    assert got == [("5 ms", 33, "Us Ssn"), ("1 min 01 s", 100, "X"), ("1.5 s", 0, "A B")]
    paths = spark.createDataFrame([("/r/a/x.txt",), ("/r/b/y.txt",), ("/other/z.txt",), ("/q/z.txt",)], "path string")
    assert {r["path"]: r["short"] for r in P.short_paths(paths, ["/r", "/r/a/"]).collect()} == {"/r/a/x.txt": "x.txt", "/r/b/y.txt": "b/y.txt", "/other/z.txt": "/other/z.txt", "/q/z.txt": "/q/z.txt"}
    states = spark.createDataFrame([("included", True), ("included", False), ("odd", True), (None, True), ("ignored", None)], "s string, c boolean")
    assert [r[0] for r in states.select(R.effective_state(F.col("s"), F.col("c"))).collect()] == ["included", "read_only", "read_only", "read_only", "read_only"]
    assert D.has_lookaround("a(?=b)") and D.has_lookaround("(?<!x)y") and not D.has_lookaround(r"\(?=b") and not D.has_lookaround("[(?=]x(?:y)")
    one, two = G.summary(G.consolidate(D.detect(spark.createDataFrame(ROWS, "path string, text string"), list(D.BUILT_IN)))), None
    two = G.combined(one.unionByName(one))
    assert {(r["tier"], r["category"]): r["n"] for r in two.collect()} == {(r["tier"], r["category"]): 2 * r["n"] for r in one.collect()}


def test_matching_needs_no_group_in_python(spark):
    from maskwright.operators import evaluate as E

    # one file with a lone pair, a plant in two findings, a finding around two plants, two plants of one id in two categories, and a search
    plants = [("f", 1, 0, 4, "x"), ("f", 2, 10, 14, "x"), ("f", 3, 20, 22, "x"), ("f", 4, 23, 26, "x"), ("f", 5, 30, 34, "x"), ("f", 5, 30, 38, "y"), ("f", 6, 40, 44, "x"), ("f", 7, 41, 43, "x"), ("f", 8, 90, 95, "x")]
    found = [("f", "a", 0, 4, "x"), ("f", "b", 9, 14, "x"), ("f", "c", 9, 15, "x"), ("f", "d", 19, 26, "x"), ("f", "e", 30, 34, "x"), ("f", "g", 30, 38, "y"), ("f", "h", 40, 44, "x"), ("f", "i", 40, 45, "x"), ("f", "j", 60, 70, "x")]
    p = spark.createDataFrame([(*r, "e" if r[1] == 7 else "d", True) for r in plants], "file string, plant_id long, start int, end int, category string, detector_id string, is_positive boolean")
    q = spark.createDataFrame([(*r, "e" if r[1] == "h" else "d", 0.5) for r in found], "file string, finding_id string, start int, end int, category string, detector_id string, confidence double")
    out = E.matched(p, q)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["plant_id"], r["finding_id"]) for r in out.collect()) == [(1, "a"), (2, "b"), (4, "d"), (5, "e"), (5, "g"), (6, "i"), (7, "h")]
    assert "FlatMapGroupsInPandas" not in plan and "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
