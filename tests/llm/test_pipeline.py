import random
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from tokenizers import Tokenizer

import corpus_pipeline as P
from maskwright.llm import bag_minhash, mixing
from maskwright.llm.shared import cut, table

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    columns, kept, lib = docs.columns, [docs.collect()], Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for name, stage in P.STAGES:
        docs = cut(stage(spark, docs, DATA), name)
        kept.append(docs.collect())
        if name != "encode":
            assert docs.columns == columns
    first, lang, lines, near, mix, ids = kept
    texts = {r["doc_id"]: r["text"] for r in first}
    # clean documents stay
    for r in first:
        if len(r["text"] or "") > 200 and any(c.isalpha() for c in r["text"]):
            assert r["doc_id"] in {x["doc_id"] for x in lang}
    assert len(lines) == len(lang)
    for r in lines:
        assert r["n_chars"] == len(r["text"]) and set(r["text"].split("\n")) <= set(texts[r["doc_id"]].split("\n")) | {""}
    bags = [bag_minhash.bag(r["text"]) for r in near]
    assert not any(bag_minhash.similarity(a, b) >= 0.8 for i, a in enumerate(bags) for b in bags[:i] if a)
    assert {r["text"] for r in near} <= {r["text"] for r in lines}
    words, sizes = Counter(), Counter()
    for r in mix:
        words[r["source"]] += len(r["text"].split())
    for r in near:
        sizes[r["source"]] += len(r["text"].split())
    order = sorted(sizes)
    for s, t in zip(order, mixing.targets([sizes[s] for s in order], [1 + i % 3 for i in range(len(order))])):
        assert abs(words[s] - t) <= mixing.BLOCK_WORDS + 0.02 * t
    assert len(ids) == len(mix) and all(r["exact"] for r in ids)
    assert sorted(tuple(r["ids"]) for r in ids) == sorted(tuple(lib.encode(r["text"], add_special_tokens=False).ids) for r in mix)


def test_mixed_texts(spark):
    r = random.Random(8)
    rows = [(i, "  ".join("w%d_%d" % (i, k) for k in range(r.choice([0, 1, 50, 700]))), r.choice(["a", "b", "c"]), "x") for i in range(60)]
    rows += [(7, "p q", "a", "x"), (7, "p q", "a", "x"), (None, "n1 n2", None, "x"), (8, None, "b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, pass string")
    m = mixing.Mix(df)
    want, got = Counter(), Counter()
    for x in m.taken().collect():
        want[x["doc_id"], x["source"]] += x["taken"]
    for x in m.documents(df).collect():
        got[x["doc_id"], x["source"]] += len(x["text"].split())
        assert x["pass"] == "x"
    assert got == +want


def test_keep_one_edges(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, "a b c"), (None, "a b c"), (3, None), (None, None), (4, ""), (5, ""), (6, "q"), (6, "z z z z z z"), (6, "z z z z z z")]
    out = bag_minhash.keep_one(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, comp int"))
    assert Counter((x["doc_id"], x["text"]) for x in out.collect()) == Counter([(1, "a b c"), (3, None), (None, None), (4, ""), (6, "q"), (6, "z z z z z z")])
    assert bag_minhash.keep_one(out.where(F.lit(False))).count() == 0


def test_lines_stage_takes_planted_passages(spark):
    """Passages of 1 to 6 lines and 51 to 80 words in different surroundings: each stays in its first document alone."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    line = lambda n: " ".join(word() for _ in range(n))
    texts, planted = [[line(r.randint(1, 30)) for _ in range(r.randint(1, 4))] for _ in range(54)], []
    for lines in range(1, 7):
        for words in (51, 65, 80):
            cuts = sorted(r.sample(range(1, words), lines - 1))
            passage = [line(b - a) for a, b in zip([0, *cuts], [*cuts, words])]
            at = sorted(r.sample(range(len(texts)), 3))
            for i in at:
                texts[i] += [*passage, line(r.randint(1, 30))]
            planted.append((at, passage))
    rows = [(i, "\n".join(t), "en", "s", len("\n".join(t))) for i, t in enumerate(texts)]
    got = {x["doc_id"]: x for x in P.lines(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), DATA).collect()}
    left = {i: got[i]["text"].split("\n") for i in got}
    for at, passage in planted:
        assert set(passage) <= set(left[at[0]])
        assert not any(set(passage) & set(left[i]) for i in at[1:])
    of_passages = {x for _, p in planted for x in p}
    assert all([x for x in t if x not in of_passages] == [x for x in left[i] if x not in of_passages] for i, t in enumerate(texts))
    assert all(x["n_chars"] == len(x["text"]) for x in got.values())


def test_stages_keep_columns_of_any_name_and_odd_rows(spark):
    names = ["score", "lang_pred", "_key", "_h", "_lines", "_ends", "_text", "_md5", "digest", "block", "row", "a.b"]
    schema = StructType([StructField("doc_id", LongType()), *(StructField(n, StringType()) for n in names), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType()), StructField("text", StringType())])
    extra = tuple(f"x{i}" for i in range(len(names)))
    text = "der hund und die katze sind nicht im haus " * 8
    texts = [(i, f"{text} {i} " + "wort " * (30 * i), "de") for i in range(1, 6)] + [(7, None, "de"), (8, "", None), (9, "1 2 3", "de"), (None, text, None), (10, text, "de"), (10, text, "de"), (11, text * 2000, "de")]
    docs = spark.createDataFrame([(d, *extra, lang, "s", 0, t) for d, t, lang in texts], schema)
    for name, stage in P.STAGES[:-1]:
        docs = cut(stage(spark, docs, DATA), name)
        assert docs.columns == schema.names, name
        rows = docs.collect()
        assert rows and all(tuple(r)[1 : 1 + len(names)] == extra for r in rows), name
        if name == "language":
            assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(d) for d, t, _ in texts if d not in (7, 8, 9))
    out = P.encode(spark, docs, DATA).collect()
    assert len(out) == docs.count() and all(r["exact"] for r in out)
    none = spark.createDataFrame([], schema)
    for _, stage in P.STAGES:
        assert stage(spark, none, DATA).count() == 0
