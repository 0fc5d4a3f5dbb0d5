import hashlib
import random
import subprocess
import sys
from pathlib import Path

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from maskwright.llm import bpe_trie as B

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
V = B.vocabulary(PATH, public_tokenizers.PATTERN)


def ours(texts):
    return [[int.from_bytes(x[i : i + 4], "little") for i in range(0, len(x), 4)] for x in V.encode_texts(texts)]


def check(texts):
    for text, ids in zip(texts, ours(texts)):
        want = LIB.encode(text, add_special_tokens=False).ids
        assert ids == want, text
        assert V.decode(ids) == LIB.decode(want, skip_special_tokens=False)


def test_edge_texts():
    check(["", " ", "\n", "  a  b", "a\n \nb", " \n a", "a b  c", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "<|endoftext|>", "x <|endoftext|>\ny<|endoftext|><|endoftext|>", "I'll we've 's it''s", "naïve 数据 😀😀", "\x1c\x1d a\x85b", "----------" * 30, "\t\t\tx\r\ny", "٣٤ ½ x²", "a" * 5000 + "b" * 5000, "\x00\x01"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\tabcdethnioé.'0<|>"), st.characters(codec="utf-8")), max_size=60), max_size=8))
def test_like_the_library(texts):
    check(texts)


def test_random_words():
    r = random.Random(1)
    check([" ".join("".join(r.choice("abcdefghilmnorstuüéñ.,") for _ in range(r.randint(1, 14))) for _ in range(400)) for _ in range(10)])


def test_frame(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "hello  world", "z"), (3, "a b", "w"), (3, "a b", "w")], "doc_id long, text string, ids string")
    out = {r["doc_id"]: r for r in B.encode(df, decoded=True).collect()}
    assert out[1]["ids"] == [] and out[2]["decoded"] == "" and out[None]["decoded"] == "hello  world"
    assert B.encode(df).count() == 5 and B.encode(df.limit(0)).count() == 0
    assert {r["decoded"] for r in B.decode(B.encode(df)).collect()} == {"", "a b", "hello  world"}
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_workers_give_back_what_texts_took():
    """After a task neither the vocabulary nor the process holds what was made for its texts, and ids stay the same."""
    code = """
import random, re
import pyarrow as pa
from maskwright.llm import bpe_trie
from maskwright.llm.shared import trim

def held():
    with open("/proc/self/smaps_rollup") as f:
        return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", f.read()))) // 1024

v = bpe_trie.vocabulary(*bpe_trie.default_vocabulary())
r = random.Random(5)
texts = [" ".join("".join(r.choices("etaoinshrdlu", k=r.randint(2, 9))) for _ in range(500)) for _ in range(900)]
v.encode_texts(texts[:1])
v.forget()
before = held()
first = v.encode_texts(texts)
peak = held()
v.forget()
assert len(v._states) == len(v._ends) == len(v._number) == 1 and not (v._goto or v._fits or v._whole or v._left or v._right or v.heads or v.tails)
assert v.encode_texts(texts) == first
del first
v.forget()
trim()
assert held() - before < 0.3 * (peak - before), (before, peak, held())
print(before, peak, held())
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], capture_output=True, text=True)
    assert not done.returncode, done.stderr
    print(done.stdout)
