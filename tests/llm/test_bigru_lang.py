import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from maskwright.llm import bigru_lang as G
from maskwright.llm.shared import table

DATA = "/root/testdata/sf0.01"


def test_gradients_by_differences():
    net = G.Network(["a", "b", "c"], hidden=3)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 256, (6, 4))
    x[4:, 1] = G.PAD
    y = np.array([0, 1, 2, 0])
    _, grads = net.gradients(x, y)
    for k, p in net.p.items():
        for _ in range(6):
            at = (rng.integers(p.shape[0]), int(x[0, rng.integers(4)]) if k[0] == "w" else rng.integers(p.shape[1]))
            old = p[at]
            p[at] = old + 1e-3
            up = net.gradients(x, y)[0]
            p[at] = old - 1e-3
            down = net.gradients(x, y)[0]
            p[at] = old
            assert abs((up - down) / 2e-3 - grads[k][at]) < 2e-3, k


def test_held_out_accuracy_and_edges(spark):
    docs = table(spark, DATA, "documents")
    net = G.train(docs)
    langs = {r["doc_id"]: r["lang"] for r in docs.where(G.held_out()).collect()}
    out = [r for r in G.predict(docs, net).collect() if r["doc_id"] in langs]
    right = np.mean([langs[r["doc_id"]] == r["lang_pred"] for r in out])
    print("held-out accuracy", right)
    assert len(out) > 150 and right > 0.95
    raw = docs.where("lang = 'de'").first()["text"]
    assert len(net.positions(raw)) == len(raw.encode()) and net.positions(raw).count("de") > 0.5 * len(raw)
    rows = [(1, None, "x"), (2, "", "x"), (3, "123 !!", "x"), (None, raw, "x"), (4, raw * 40, None), (5, "é", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = {r["doc_id"]: r for r in G.predict(df, net).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[None]["lang_pred"] == got[4]["lang_pred"] == "de"
    assert got[5]["lang_pred"] in net.labels and all(0 <= r["score"] <= 1 for r in got.values())
    assert G.predict(df.limit(0), net).count() == 0
    assert G.train(df.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r["lang_pred"] for r in G.predict(df, None).collect()} == {"und"}
    # kept rows are as they were
    kept = G.accepted(docs, net)
    sure = {r["doc_id"] for r in G.predict(docs, net).collect() if r["lang_pred"] != "und" and r["score"] >= G.LEAST_SCORE}
    assert kept.schema == docs.schema and sorted(map(tuple, kept.collect())) == sorted(tuple(r) for r in docs.collect() if r["doc_id"] in sure)


def test_windows_and_lengths():
    """A text's probabilities are the means over its bytes, also at the borders of windows and among other texts."""
    net = G.Network(["a", "b", "c"], seed=5)
    texts = [bytes(range(1, 200))[:n] for n in (0, 1, 127, 128, 129, 199)] + [bytes(300), b"\xff" * 128]
    got = net.pooled(texts)
    for t, g in zip(texts, got):
        want = np.zeros(3)
        for s in range(0, len(t), G.WINDOW):
            want += net.probabilities(np.frombuffer(t[s : s + G.WINDOW], np.uint8).astype(np.int64)[:, None])[:, :, 0].sum(axis=0)
        assert np.allclose(g, want / max(1, len(t)), atol=1e-5)


def test_columns_of_any_name_pass_through(spark):
    names = ["score", "lang_pred", "_text_", "_hash", "window", "a.b"]
    schema = StructType([StructField("doc_id", LongType()), *(StructField(n, StringType()) for n in names), StructField("lang", StringType()), StructField("text", StringType())])
    x = tuple(f"x{i}" for i in range(len(names)))
    rows = [(i, *x, "de", "der die das und nicht ein " * 9) for i in range(8)] + [(9, *x, None, None), (10, *x, "de", "12")]
    df = spark.createDataFrame(rows, schema)
    net = G.train(df)
    assert sorted(map(tuple, G.accepted(df, net).collect())) == rows[:8]
    assert G.predict(df, net).columns == ["doc_id", "lang_pred", "score"]
