import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql.types import LongType, StringType, StructField, StructType

from maskwright.llm import mixing as M

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets():
    assert M.targets([10, 10, 10], [1, 1, 1]) == [10, 10, 10]
    t = M.targets([1, 100, 100], [3, 1, 2])
    assert t[0] == 3 and abs(t[1] - 66) < 1e-9 and abs(t[2] - 132) < 1e-9
    assert M.targets([], []) == [] and M.targets([0, 5], [1, 2]) == [0, 5]


def test_slot_counts():
    c = M.slot_counts([1000, 3, 0, 500], 16)
    assert c.sum(axis=0).tolist() == [1000, 3, 0, 500] and (c >= 0).all()
    assert len({tuple(x) for x in c.tolist()}) > 3
    assert np.array_equal(c, M.slot_counts([1000, 3, 0, 500], 16))


def test_permutation(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 300):
        rows = spark.range(n).select(M.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(1), F.lit(0)).alias("p"), "id").collect()
        assert sorted(r["p"] for r in rows) == list(range(n))
        assert n < 50 or sum(r["p"] == r["id"] for r in rows) < n / 10


def docs_of(seed, n=300):
    r = random.Random(seed)
    return [(i, " ".join("w" * r.randint(1, 5) for _ in range(r.choice([0, 3, 40, 900]))), r.choice(["a", "b", "b", "b", "c", None])) for i in range(n)]


def test_like_brute_force(spark):
    rows = docs_of(2) + [(1000, None, "z"), (7, "x y", "a"), (7, "x y", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = M.Mix(df)
    out = mix.taken().collect()
    assert len(out) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORDS.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, M.targets([sizes[s] for s in order], [1, 2, 3, 1, 2, 3][: len(order)])))
    taken = Counter()
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in order:
        assert abs(taken[s] - want[s]) <= M.BLOCK_WORDS + 0.02 * want[s]
    # the pieces of the real output add up to the same
    pieces = mix.output().groupBy("doc_id").sum("n_words").collect()
    by_id = Counter()
    for r in out:
        by_id[r["doc_id"]] += r["taken"]
    assert {r[0]: r[1] for r in pieces} == {k: v for k, v in by_id.items() if v}
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, M.Mix(df.repartition(3)).taken().collect()), key=str)


def test_empty(spark):
    df = spark.createDataFrame([(1, "", "a", 1)], "doc_id long, text string, source string, target int")
    assert [tuple(r)[5:] for r in M.Mix(df).taken().collect()] == [(0, 0, 0.0, 0)]
    assert M.Mix(df.limit(0)).taken().count() == 0


def test_columns_of_any_name_pass_through(spark):
    names = ["_text", "_pieces", "_id", "_hash", "row", "size", "block", "pass", "slot", "c0", "a.b"]
    schema = StructType([StructField("doc_id", LongType()), *(StructField(n, StringType()) for n in names), StructField("source", StringType()), StructField("text", StringType())])
    x = tuple(f"x{i}" for i in range(len(names)))
    df = spark.createDataFrame([(1, *x, "a", "x y z"), (2, *x, None, "u v"), (3, *x, "a", None)], schema)
    m = M.Mix(df)
    out = m.documents(df)
    rows = out.collect()
    assert out.schema == df.schema and {tuple(r)[:-1] for r in rows} <= {(1, *x, "a"), (2, *x, None)}
    assert sum(len(r["text"].split()) for r in rows) == sum(r["taken"] for r in m.taken().collect()) > 0
