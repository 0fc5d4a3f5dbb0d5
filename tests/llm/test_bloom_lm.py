import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from maskwright.llm import bloom_lm as L


def corpus(seed=1, n=200):
    r = random.Random(seed)
    parts = ["the", "an", "ing", "st", "re", "ou", "ly", "ed"]
    return [(i, " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))).capitalize() for _ in range(r.randint(0, 120)))) for i in range(n)]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def toks(text):
    return [*L.tokens(text), b""]


def thue_morse(n):
    return bytes(b"ab"[bin(i).count("1") & 1] for i in range(n))


def test_sequence_and_ngrams():
    ids, lengths = np.array([5, 6, 7]), np.array([2, 0, 1])
    seq, place, owner = L.sequence(ids, lengths, 9)
    assert seq.tolist() == [9, 5, 6, 9, 9, 9, 9, 7, 9]
    assert place.tolist() == [0, 1, 2, 3, 0, 1, 0, 1, 2] and owner.tolist() == [0, 0, 0, 0, 1, 1, 2, 2, 2]
    hashes = L.word_hashes([bytes([i]) for i in range(10)])[seq]
    found = {order: (at.tolist(), keys) for order, at, keys in L.gram_keys(hashes, place, 7)}
    assert found[2][0] == [1, 2, 3, 5, 7, 8] and found[3][0] == [2, 3, 8]
    assert len(set(found[2][1].tolist())) == 6 and ((found[2][1] >> np.uint64(L.KEY_BITS)) < 7).all()
    # the same n-gram has the same key wherever it stands
    again = {order: keys for order, _, keys in L.gram_keys(np.concatenate([hashes[:4], hashes[:4]]), np.concatenate([place[:4], place[:4]]), 7)}
    assert np.array_equal(again[3][:2], again[3][2:]) and np.array_equal(again[3][:2], found[3][1][:2])


def test_packed_columns_come_back():
    for x in ([], [0], [255, 256, 1], [2**40 - 1, 0], list(range(1000))):
        assert L._unpack(L._pack(np.array(x, np.int64))).tolist() == x
    for words in ([b""], [b"a"], [b"", b"a"], [b"a", b"", "ü\x1c".encode()]):
        assert L._unpack_words(L._pack_words(words)) == words


def test_filter_reads_back_quantised_counts():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(1, 2**63, 20_000, np.uint64))
    counts = np.maximum(1, (rng.pareto(1.0, len(keys)) * 3).astype(np.int64))
    bloom = L.Filter(keys, counts)
    q = L.levels(counts)
    got = bloom.levels(keys)
    assert bloom.entries == q.sum() and bloom.bits == q.sum() * L.BITS_PER_ENTRY
    assert (got >= q).all() and (got == q).mean() > 0.97
    assert (np.abs(L._VALUES[q] / counts - 1) < 0.42).all()
    assert (bloom.levels(rng.integers(1, 2**63, 20_000, np.uint64)) == 0).mean() > 0.97


def brute(rows):
    """N, V, base scores and model scores from exact n-gram counts."""
    c, grams = Counter(), Counter()
    for i, t in rows:
        if not held(i):
            s = [b"", *toks(t)]
            c.update(s[1:])
            for o in range(2, L.ORDER + 1):
                grams.update(tuple(s[k : k + o]) for k in range(len(s) - o + 1))
    n, v = sum(c.values()), len(c)

    def model(text):
        s, total = [b"", *toks(text)], 0.0
        for k in range(1, len(s)):
            p, context = (c[s[k]] + 0.5) / (n + 0.5 * (v + 1)), c[s[k - 1]]
            for o in range(2, min(L.ORDER, k + 1) + 1):
                if o > 2:
                    context = grams[tuple(s[k - o + 1 : k])]
                p = (grams[tuple(s[k - o + 1 : k + 1])] + L.WORD_SMOOTHING * p) / (context + L.WORD_SMOOTHING)
            total += math.log10(p)
        return total

    return n, v, c, model


def check(out, rows):
    n, v, c, model = brute(rows)
    texts = dict(rows)
    assert len(out) == len(rows)
    for r in out:
        ws = toks(texts[r["doc_id"]])
        assert r["held_out"] == held(r["doc_id"]) and r["train_tokens"] == n
        assert (r["n_tokens"], r["n_known"]) == (len(ws), sum(c[w] > 0 for w in ws))
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9, abs_tol=1e-9)
        assert r["score"] < 0
    return n, v, model, texts


def test_scores_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_BYTES", 5000)
    rows = [*corpus(), (1000, None), (1001, ""), (1001, ""), (1002, " \n\t "), (None, "the AN zz"), (1003, "long " * 5000)]
    model = L.Model(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    out = model.score().collect()
    n, v, exact, texts = check(out, rows)
    assert (model.n, model.v) == (n, v) and model.bits >= 10 * model.entries > 0
    # the filter's quantised counts give nearly what exact counts give
    long = [r for r in out if r["n_tokens"] > 40 and r["doc_id"] != 1003]
    assert abs(sum(r["score"] for r in long) / sum(exact(texts[r["doc_id"]]) for r in long) - 1) < 0.05
    same = [r for r in out if r["doc_id"] == 1001]
    assert same[0] == same[1]


def test_words_that_polynomial_hashes_confuse(spark):
    """Two words of a and b in Thue-Morse order and its complement, which agree in every polynomial hash modulo 2^64."""
    a, flip = thue_morse(1024).decode(), thue_morse(1024).translate(bytes.maketrans(b"ab", b"ba")).decode()
    ids = [i for i in range(200) if not held(i)][:3] + [i for i in range(200) if held(i)][:2]
    rows = list(zip(ids, [f"x {a}", "x y", "y", f"x {flip}", f"x {a}"]))
    out = L.Model(spark.createDataFrame(rows, "doc_id long, text string")).score().collect()
    check(out, rows)
    known = {r["doc_id"]: r["n_known"] for r in out}
    assert known[ids[3]] == 2 and known[ids[4]] == 3


def test_empty_and_untrained(spark):
    df = spark.createDataFrame([(1, "a b", 0)], "doc_id long, text string, score int")
    assert L.Model(df.limit(0)).score().count() == 0
    no = next(i for i in range(100) if held(i))
    r = L.Model(spark.createDataFrame([(no, "a b")], "doc_id long, text string")).score().first()
    assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (True, 3, 0, 0, 0.0)


def test_extra_columns_play_no_part(spark):
    extra = ["score", "held", "block", "ids", "words", "keys", "part", "n", "held_out", "text_", "a.b"]
    rows = [(i, t, *[i] * len(extra)) for i, t in corpus(n=8)]
    out = L.Model(spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{x}` long" for x in extra))).score()
    assert out.count() == 8 and out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def test_order_of_words_counts(spark):
    """Fluent held-out texts score better than their own words shuffled, which a sum of single words' scores can't tell."""
    r = random.Random(3)
    follows = {f"w{i}": [f"w{r.randrange(60)}" for _ in range(3)] for i in range(60)}

    def fluent(n=60):
        out = ["w0"]
        while len(out) < n:
            out.append(r.choice(follows[out[-1]]))
        return out

    ids = [i for i in range(2000) if held(i)]
    rest = [i for i in range(2000) if not held(i)]
    rows = [(i, " ".join(fluent())) for i in rest[:300]]
    for a, b in zip(ids[:40:2], ids[1:40:2]):
        words = fluent()
        rows += [(a, " ".join(words)), (b, " ".join(r.sample(words, len(words))))]
    out = {x["doc_id"]: x for x in L.Model(spark.createDataFrame(rows, "doc_id long, text string")).score().collect()}
    for a, b in zip(ids[:40:2], ids[1:40:2]):
        assert math.isclose(out[a]["base_score"], out[b]["base_score"])
        assert out[a]["score"] > out[b]["score"] + 10


def test_columns_of_words_are_those_of_each_text():
    """Splitting, hashes and distinct keys of whole columns, against one text, word or key at a time."""
    r = random.Random(4)
    chars = [chr(i) for i in range(128)] + ["é", "\x85", "\xa0", "\u2003", "\U0001d4b3", "İ"] + [" "] * 40
    texts = ["".join(r.choice(chars) for _ in range(r.randint(0, 60))) for _ in range(500)] + [None, "", " ", " a ", "x" * 200 + " " + "y" * 65]
    words, ids, lengths = L.split(pa.array(texts))
    found = [words[i].as_py() for i in ids.tolist()]
    assert found == [w for t in texts for w in L.tokens(t)] and lengths.tolist() == [len(L.tokens(t)) for t in texts]
    hashes = L.word_hashes(words)
    assert len(set(hashes.tolist())) == len(words) == len(set(words.to_pylist()))
    assert np.array_equal(L.word_hashes(words.slice(7, 50)), hashes[7:57]) and np.array_equal(L.word_hashes(words.to_pylist()[:9]), hashes[:9])
    near = [bytes(64), bytes(63), bytes(65), bytes(8), bytes(9), bytes(16), b"", b"a", b"a\0", b"\0a"]
    assert len(set(L.word_hashes(near).tolist())) == len(near)
    assert L._unpack_words(L._pack_words(words.slice(3, 20))) == words.slice(3, 20).to_pylist()
    for keys in ([], [5], [2**40 - 1, 0, 2**40 - 1], np.random.default_rng(1).integers(0, 500, 2000)):
        keys = np.array(keys, np.uint64)
        for a, b in zip(L.distinct_keys(keys), np.unique(keys, return_inverse=True)):
            assert np.array_equal(a, b)
