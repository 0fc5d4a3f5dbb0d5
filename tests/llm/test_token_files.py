import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from maskwright.llm import token_files as T
from maskwright.llm.shared import scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 30_000))
    ph = T.PerfectHash.build(keys)
    assert sorted(ph.slots(keys)) == list(range(len(keys)))
    assert T.PerfectHash.build(keys[:0]).slots(keys[:5]).tolist() == [-1] * 5


def want(rows):
    out, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = LIB.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4"))))
        at += len(ids)
    return out


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(T, "SHARD_ROWS", 40)
    r = random.Random(3)
    rows = [(i * 7 - 300, " ".join(r.choice(["the", "thst.", "über\nso", "  ", "x"]) for _ in range(r.randint(0, 50)))) for i in range(200)]
    rows += [(5, None), (6, ""), (-10**15, "a<|endoftext|> b")]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    tokens = T.write(df, scratch(spark, "t"), PATH)
    assert len(tokens.shards) >= 4
    got = sorted(map(tuple, T.read(spark, tokens).collect()), key=lambda x: x[1])
    assert got == want(rows)
    number, records, *_ = tokens.shards[1]
    shard = T.Shard(tokens.folder, number)
    key = int(shard.keys[3])
    first, n = shard.find(np.array([key, 10**12]))
    assert n.tolist() == [1, 0]
    assert shard.ids(int(first[0])).tolist() == LIB.encode(dict(rows)[key] or "", add_special_tokens=False).ids + [2]


def test_encoder_like_the_library():
    r = random.Random(6)
    marks = ["", ".", ",", "!!", "'s", "'", "**", "|", "<|endoftext|>", "...", "'ll!", "-", "$%"]
    texts = [" ".join("".join(r.choice("abcdeéüßñıž²½中'") for _ in range(r.randint(0, 6))) + r.choice(marks) for _ in range(30)) for _ in range(300)]
    texts += ["a\nb\tc", "x  y", "don't I'LL", "ª º", "\u017fs", "1a a1 a.1"]
    enc = T.LibraryEncoder(PATH, 2)
    for text, got in zip(texts, enc.encode(texts)):
        assert np.frombuffer(got, "<u2").tolist() == LIB.encode(text, add_special_tokens=False).ids, text


def test_edge_cases(spark):
    rows = [(None, "x y"), (None, "z"), (4, "same"), (4, "same"), (4, "same"), (1, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int")
    got = sorted(map(tuple, T.read(spark, T.write(df, scratch(spark, "t"), PATH)).collect()), key=lambda x: x[1])
    assert sorted((x[0] or 0, x[2], x[3]) for x in got) == sorted((x[0] or 0, x[2], x[3]) for x in want(rows))
    assert T.read(spark, T.write(df.limit(0), scratch(spark, "t"), PATH)).count() == 0
