import random
from collections import Counter

from pyspark.sql import Row
from pyspark.sql.types import LongType, StringType, StructField, StructType

from maskwright.llm import line_chunks as L
from maskwright.llm.shared import table


def line(r, n=12):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def test_repeated_passage_goes_and_clean_text_stays(spark):
    r = random.Random(4)
    passage = [line(r, 20) for _ in range(24)]
    docs = [(i, "\n".join([line(r) for _ in range(3)] + (passage if i % 2 else []) + [line(r) for _ in range(3)])) for i in range(12)]
    clean = {i: t for i, t in docs if i % 2 == 0}
    out = {x["doc_id"]: x for x in L.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(out) == 12
    for i, t in clean.items():
        assert out[i]["text"] == t and out[i]["removed_chunks"] == 0
    assert out[1]["text"] == dict(docs)[1]  # the first place keeps it
    for i in (3, 5, 7, 9, 11):
        assert out[i]["removed_lines"] >= 8
        left, had = out[i]["text"].split("\n"), dict(docs)[i].split("\n")
        assert len(left) == len(had) - out[i]["removed_lines"]
        assert set(had) - set(left) <= set(passage)


def enough(lines):
    words = sum(len(x.split()) for x in lines)
    return words >= L.LONG_WORDS or words >= L.MIN_WORDS and sum(bool(x.split()) for x in lines) >= L.MIN_LINES


def expected(texts):
    """Against all pairs of lines, without the chunker: the lines that runs cover which an earlier place has as well."""
    first, gone = {}, [set() for _ in texts]
    for i, t in enumerate(texts):
        for a in range(len(t)):
            for z in range(a, len(t)):
                if t[a].split() and t[z].split() and enough(t[a : z + 1]):
                    d, _, end = first.setdefault(tuple(t[a : z + 1]), (i, a, z))
                    if (d, end) != (i, z):
                        gone[i] |= set(range(a if d != i else max(a, end + 1), z + 1))
    return gone


def left_of(spark, texts):
    """What is left of the texts, without empty lines, and what is expected to be."""
    got = {x["doc_id"]: x for x in L.dedup(spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    gone = expected(texts)
    assert all(got[i]["removed_lines"] >= len(g) for i, g in enumerate(gone))
    return [[x for x in got[i]["text"].split("\n") if x.split()] for i in range(len(texts))], [[x for k, x in enumerate(t) if x.split() and k not in g] for t, g in zip(texts, gone)]


def test_repeated_runs_go_brute_force(spark):
    r = random.Random(5)
    pool = [line(r, 3) for _ in range(3)]
    texts = [[r.choice(pool) for _ in range(r.randint(1, 12))] + [str(i)] for i in range(40)]
    got, want = left_of(spark, texts)
    assert got == want and sum(map(len, got)) < 0.8 * sum(map(len, texts))


def test_chunks_alone_are_content_defined(spark):
    """A passage is cut at the same places wherever it stands, but for its first and last chunk."""
    r = random.Random(12)
    passage = [line(r) for _ in range(30)]
    rows = [(i, "\n".join([line(r) for _ in range(i)] + passage + [line(r)])) for i in range(4)]
    cuts = [{e - c["doc_id"] for e in c["_ends"] if c["doc_id"] + 1 < e <= c["doc_id"] + 30} for c in L.chunked(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(cuts[0]) > 5 and all(c == cuts[0] for c in cuts)


def test_recall_on_the_corpus(spark):
    """Windows of two adjacent lines with 10 words or more: nearly none is left twice."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    distinct = {(x["doc_id"], x["text"]) for x in docs.collect()}

    def windows(texts):
        out = Counter()
        for t in texts:
            lines = (t or "").split("\n")
            out.update((a, b) for a, b in zip(lines, lines[1:]) if a.split() and b.split() and len(a.split()) + len(b.split()) >= 10)
        return out

    again = lambda c: sum(n - 1 for n in c.values())
    before = again(windows(t for _, t in distinct))
    after = again(windows(t for _, t in {(x["doc_id"], x["text"]) for x in L.dedup(docs).collect()}))
    assert before > 300 and after <= 0.02 * before


def test_edge_cases(spark):
    r = random.Random(6)
    two = "\n".join(line(r, 30) for _ in range(6))
    rows = [Row(doc_id=1, text=None, hash="a"), Row(doc_id=2, text="", hash="b"), Row(doc_id=None, text="x", hash=None), Row(doc_id=3, text=two, hash="c"), Row(doc_id=3, text=two, hash="d"), Row(doc_id=4, text="\n\n\n", hash="e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, hash string")
    out = L.dedup(df).collect()
    assert sorted((x["doc_id"] or 0, x["text"] or "", x["hash"] or "") for x in out) == sorted((x.doc_id or 0, x.text or "", x.hash or "") for x in rows)
    assert L.dedup(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "a b\n" * 200_000), (2, "a b\n" * 200_000)], "doc_id long, text string")
    assert L.dedup(long).count() == 2


def test_runs_go_whatever_stands_around_brute_force(spark):
    r = random.Random(7)
    texts = [[line(r, r.choice([1, 3, 12, 20, 60])) for _ in range(r.randint(0, 4))] for _ in range(60)]
    for lines in range(1, 7):
        for words in (9, 10, 30, 51, 60, 80):
            if lines <= words:
                cuts = sorted(r.sample(range(1, words), lines - 1))
                passage = [line(r, b - a) for a, b in zip([0, *cuts], [*cuts, words])]
                for i in r.sample(range(60), 3):
                    texts[i] += [*passage, *(line(r, r.choice([1, 12, 60])) for _ in range(r.randint(1, 3)))]
    texts += [["", *texts[5][:3], " ", *texts[5][3:]], [line(r, 2)] * 90, [line(r, 1), "", ""] * 30]
    got, want = left_of(spark, texts)
    assert got == want
    assert len(got[61]) == 5 and len(got[62]) == 10  # the first 10 words of texts that repeat themselves


def test_columns_of_any_name_pass_through(spark):
    r = random.Random(8)
    two = "\n".join(line(r, 30) for _ in range(4))
    names = ["_key", "_h", "_lines", "_ends", "_gone", "row", "digest", "hash", "chunk", "removed_chunks", "a.b`c"]
    schema = StructType([StructField("doc_id", LongType()), *(StructField(n, StringType()) for n in names), StructField("text", StringType())])
    x = tuple(f"x{i}" for i in range(len(names)))
    out = L.dedup(spark.createDataFrame([(1, *x, two), (2, *x, f"x\n{two}"), (3, *x, None)], schema), counts=False)
    assert out.columns == ["doc_id", *names, "text"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, *x, two), (2, *x, "x"), (3, *x, None)]
