import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql.types import LongType, StringType, StructField, StructType

from maskwright.llm import bag_minhash as M
from maskwright.llm.components import components
from maskwright.llm.shared import table


def text_of(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(4)) for _ in range(n))


def edit(r, text, k):
    w = text.split(" ")
    for _ in range(k):
        w[r.randrange(len(w))] = "zz" + str(r.randrange(10**6))
    return " ".join(w)


def test_signature_estimates_weighted_jaccard():
    r = random.Random(1)
    errors = []
    for _ in range(60):
        pool = [text_of(r, 6) for _ in range(30)]
        a = " ".join(r.choice(pool) for _ in range(40))
        b = " ".join([*a.split(" ")[:150], *(r.choice(pool) for _ in range(12))])
        ident = M.signatures(2, *M.bags([a.encode(), b.encode()])[:3])
        errors.append((ident[0] == ident[1]).mean() - M.similarity(M.bag(a), M.bag(b)))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07


def test_bags_count_like_python():
    texts = ["", "a", "a b c d", "a b c d e", "a b c d e a b c d e a b c d e", "\n x\ty  z ", "é ü é ü é ü é"]
    owner, _, weight, n = M.bags([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert sorted(weight[owner == i]) == sorted(M.bag(t).values()) and n[i] == sum(M.bag(t).values())
    whole = M.signatures(len(texts), *M.bags([t.encode() for t in texts])[:3])
    alone = [M.signatures(1, *M.bags([t.encode()])[:3])[0] for t in texts]
    assert np.array_equal(whole, np.array(alone))


def brute(rows, threshold=0.8):
    bags = [M.bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] is not None and (rows[i][1] == rows[j][1] or (bags[i] and M.similarity(bags[i], bags[j]) >= threshold)):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return {d: least[root(i)] for i, (d, _) in enumerate(rows)}


def test_like_brute_force(spark):
    r = random.Random(2)
    rows = []
    for _ in range(12):
        base = text_of(r, r.randint(30, 200))
        for _ in range(r.randint(1, 9)):
            rows.append(edit(r, base, r.randint(0, 6)))
    # a chain: each is near its neighbours only
    link = text_of(r, 200)
    for _ in range(14):
        rows.append(link)
        link = edit(r, link, 3)
    # repeated lines: weights above 1
    line = text_of(r, 12)
    rows += ["\n".join([line] * 9), "\n".join([line] * 10), "\n".join([line] * 20), "", "", "a b", "a b", "a c"]
    r.shuffle(rows)
    rows = [*enumerate(rows, 1), (500, None), (501, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["group_id"] for x in M.groups(df).collect()}
    assert got == {**brute([x for x in rows if x[1] is not None]), 500: 500, 501: 501}
    assert len(set(got.values())) < len(rows)


def test_large_group_needs_no_all_pairs(spark):
    r = random.Random(3)
    base = text_of(r, 400)
    rows = [(i, edit(r, base, r.randint(0, 3))) for i in range(300)] + [(1000 + i, base) for i in range(200)] + [(5000, text_of(r, 120))]
    got = {x["doc_id"]: (x["class_id"], x["group_id"]) for x in M.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert Counter(g for _, g in got.values()) == {0: 500, 5000: 1}
    assert {c for i, (c, _) in got.items() if i >= 1000 and i < 5000} <= set(range(300)) | {1000}


def test_graded_group_like_brute_force(spark):
    """Texts at all distances from one base: buckets hold many that link to nothing, or only through few others."""
    r = random.Random(5)
    base = text_of(r, 150)
    rows = [(i, edit(r, base, r.randint(0, 12))) for i in range(260)]
    got = {x["doc_id"]: x["group_id"] for x in M.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert got == want and 20 < len(set(want.values())) < 250


def test_third_step_in_small_blocks_and_slices(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 5)
    monkeypatch.setattr(M, "SLICE", 7)
    test_graded_group_like_brute_force(spark)


def test_sketches_meet():
    r = random.Random(6)
    base = text_of(r, 120)
    texts = [edit(r, base, k) for k in (0, 1, 2, 60)] + [text_of(r, 120)]
    ident = M.signatures(5, *M.bags([t.encode() for t in texts])[:3]).astype(np.uint8)
    rows = [(bytes([c]), 116, x.tobytes()) for c, x in zip([1, 2, 1, 3, 4], ident)]
    hit = M._meets(rows[:2], rows, 0.8)
    assert hit.tolist() == [[False, True, False, False, False], [True, False, True, False, False]]
    assert not M._meets(rows[:1], [(b"x", 200, rows[1][2])], 0.8).any()


def test_groups_of_the_corpus_are_those_of_all_exact_pairs(spark):
    """sf0.01, against an index of all shingles."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    bags, at, parent = [M.bag(t or "") for _, t in rows], defaultdict(list), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs, first = 0, {}
    for i, b in enumerate(bags):
        if rows[i][1] is None:
            continue
        if rows[i][1] in first:
            parent[root(i)] = root(first[rows[i][1]])
            continue
        first[rows[i][1]] = i
        for j in {j for s in b for j in at[s]}:
            if M.similarity(b, bags[j]) >= M.THRESHOLD:
                pairs += 1
                parent[root(i)] = root(j)
        for s in b:
            at[s].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    assert pairs >= 4
    assert {r["doc_id"]: r["group_id"] for r in M.groups(docs).collect()} == {d: least[root(i)] for i, (d, _) in enumerate(rows)}


def test_columns_of_any_name_pass_through(spark):
    names = ["_md5", "_id", "_digest", "row", "digest", "comp", "bucket", "n", "sketch", "label", "v", "a.b"]
    schema = StructType([StructField("doc_id", LongType()), *(StructField(n, StringType()) for n in names), StructField("text", StringType())])
    x = tuple(f"x{i}" for i in range(len(names)))
    rows = [(1, *x, "a b c"), (2, *x, "a b c"), (3, *x, None), (4, *x, "d")]
    out = M.keep_one(spark.createDataFrame(rows, schema))
    assert out.columns == ["doc_id", *names, "text"] and sorted(tuple(r) for r in out.collect()) == [rows[0], rows[2], rows[3]]


def test_edge_cases(spark):
    rows = [(None, "x y z", 1), (3, "x y z", 2), (3, "x y z", 2), (4, None, 3), (5, "w " * 50_000, 4), (6, "w " * 50_001, 5)]
    out = M.groups(spark.createDataFrame(rows, "doc_id long, text string, digest int")).collect()
    assert sorted((x["doc_id"] or 0, x["group_id"]) for x in out) == [(0, 3), (3, 3), (3, 3), (4, 4), (5, 5), (6, 5)]
    assert M.groups(spark.createDataFrame(rows, "doc_id long, text string, n int").limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (200, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 102)} == {100} and got[200] == 200


def test_components_of_odd_edges(spark):
    got = components(spark.createDataFrame([(1, 2), (2, 1), (1, 2), (5, 5)], "a long, b long")).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 1), (5, 5)]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert sorted(map(tuple, components(spark.createDataFrame([(1, 2), (3, None)], "a long, b long")).collect())) == [(1, 1), (2, 1)]


def test_rounds_of_components_write_few_files(spark, monkeypatch):
    from maskwright.llm import components as C

    written, cut = [], C.cut

    def counted(df, name):
        out = cut(df, name)
        written.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(C, "cut", counted)
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        edges = spark.createDataFrame([(i, i + 1) for i in range(100) if i % 10 != 9], "a int, b int")
        got = {r["v"]: r["label"] for r in C.components(edges).collect()}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert got == {i: i - i % 10 for i in range(100)} and len(written) > 3 and max(written) <= 4


def test_tables_between_steps_are_few_files(spark, monkeypatch):
    """With many shuffle partitions only the signed rows, which are written where they are read, may follow these."""
    from maskwright.llm import bag_minhash

    written, cut = [], bag_minhash.cut

    def counted(df, name):
        out = cut(df, name)
        written.append((name, len(out.inputFiles())))
        return out

    monkeypatch.setattr(bag_minhash, "cut", counted)
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        rows = [(i, " ".join(f"w{i // 10}_{k}" for k in range(100)) + f" x{i}") for i in range(100)]
        got = {r["doc_id"]: r["group_id"] for r in bag_minhash.groups(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert got == {i: i - i % 10 for i in range(100)}
    few = [n for name, n in written if name not in ("bag-signed", "bag-buckets")]
    assert len(few) >= 7 and max(few) <= 4, written
