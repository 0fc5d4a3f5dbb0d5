import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from maskwright.llm import host_rules as H

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_features_like_brute_force():
    r = random.Random(1)
    texts = [None, "", " \n", "a", "a b c a b c", "x\ny\nx\n\n x", "é # | ü\x85\x1c z"]
    texts += [" ".join(r.choice("ab c\nd é# \t".split(" ")) for _ in range(r.randint(0, 80))) for _ in range(200)]
    for t in texts:
        assert H.features(t) == brute(t), repr(t)


def docs(spark, bad_host=40, seed=2):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    good = lambda: " ".join(word() for _ in range(90))
    rows = [(i, good(), "good") for i in range(60)] + [(100 + i, "short text", "good") for i in range(3)]
    rows += [(200 + i, "too short", "bad") for i in range(bad_host)] + [(300, good(), "bad"), (400, good(), None), (401, None, None), (402, "", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_host_verdicts(spark):
    out = {r["doc_id"]: r for r in H.judge(docs(spark)).collect()}
    assert len(out) == 107
    assert all(out[i]["kept"] for i in range(60)) and not any(out[i]["kept"] for i in range(100, 103))
    assert not out[300]["base_failed"] and not out[300]["kept"]  # a host that fails nearly always
    assert out[400]["kept"] and not out[401]["kept"] and not out[402]["kept"]
    few = {r["doc_id"]: r for r in H.judge(docs(spark, bad_host=1)).collect()}
    assert few[300]["kept"]  # two documents say little about a host


def test_prior():
    a, b = H.beta_prior(1000, 100, 10, 0.01 * 1000 + 20)
    assert a / (a + b) == pytest.approx(0.1) and a + b > 1
    assert H.beta_prior(0, 0, 0, 0.0) == (1.0, 1.0)
    assert H.beta_prior(100, 10, 5, 1.0)[0] / 1e6 == pytest.approx(0.1)  # hosts don't differ: all strength in the prior


def test_limit_follows_the_prior():
    assert H.limit(1e5, 9e5) == pytest.approx(0.2)  # hosts alike: twice the mean
    assert 0.2 < H.limit(5, 45) < 0.3  # hosts differ: three standard deviations
    assert H.limit(0.3, 0.3) == H.limit(3e5, 2e5) == H.MOST


def mixed_hosts(bad):
    """20 hosts of 60 documents; ``bad`` gives the share of failing documents of some and how they fail."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    good = lambda: " ".join(word() for _ in range(90))
    fails = {"short": lambda: "too short", "symbols": lambda: good() + " #" * 12, "lines": lambda: good() + f"\n{word()}" + "\nmore\nmore\nmore\nmore\nmore\nmore"}
    rows = []
    for h in range(20):
        share, rule = bad.get(h, (0.08, "short"))
        rows += [(len(rows) + i, fails[rule]() if i < 60 * share else good(), f"h{h}", "en", 0) for i in range(60)]
    return rows


@pytest.mark.parametrize("bad", [{}, {3: (0.9, "short")}, {3: (0.7, "symbols"), 4: (0.6, "lines")}, {h: (0.9, "short") for h in range(8)}, {3: (0.12, "short")}])
def test_bad_hosts_are_rejected_by_the_query_and_its_sql(spark, tmp_path, bad):
    df = spark.createDataFrame(mixed_hosts(bad), "doc_id long, text string, source string, lang string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    out = H.op5_host_rules(spark, str(tmp_path)).collect()
    want = {f"h{h}": rule for h, (share, rule) in bad.items() if share > 0.5}
    sources = {r["doc_id"]: r["source"] for r in df.collect()}
    for r in out:
        assert r["host_rules"] == want.get(sources[r["doc_id"]], "")
        assert r["kept"] == (not r["base_failed"] and sources[r["doc_id"]] not in want)
    assert any(not r["kept"] and not r["base_failed"] for r in out) == bool(want)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    names = out[0].__fields__
    assert sorted(con.sql(f"SELECT {', '.join(names)} FROM ({H.ORACLE})").fetchall()) == sorted(map(tuple, out))


def test_long_and_empty(spark):
    df = spark.createDataFrame([(1, "w " * 300_000, "s", 7)], "doc_id long, text string, source string, kept int").withColumns({c: F.lit(1) for c in ("host", "_host", "n", "host_rules", "rate_short")})
    row = H.judge(df).first()
    assert (row["n_words"], row["n_repeat_words"], row["base_failed"]) == (300_000, 300_000, True)
    assert H.judge(df.limit(0)).count() == 0
