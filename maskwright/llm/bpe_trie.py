"""BPE encoding by a depth-first walk over a trie of distinct words, and decoding.

The encoding of a prefix ends with one certain token: the only vocabulary token that is a suffix of the prefix and goes
with the last token of what stands before it, in the sense that merging the two tokens' bytes gives these two tokens.
So each trie node needs one last token, found from those of its ancestors, and words share the work of their common
prefixes. Distinct words are visited in sorted order: that is the trie's depth-first order, and the stack of last
tokens is the path from the root, of which a word keeps what it shares with the word before. Which tokens end at a node
comes from an automaton over the vocabulary's bytes, whose states are on the same stack.

Nulls and empty texts have no ids. Repeated rows get equal results; empty tables give no rows. Very long words cost time
in proportion to their length. Other columns, of any name, play no part. No row is shuffled.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import Cache, encode_texts
from .shared import runs, table, uncollected

#: Units kept between batches in a task, about 120 MB.
MOST_UNITS = 600_000
#: Remembered pairs of tokens, about 100 MB at most.
MOST_FITS = 1_000_000
#: Bytes of text encoded at a time.
GROUP = 4_000_000
_NEVER = 1 << 60


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(extra))
        extra += b not in plain
    return out


class Vocabulary:
    """A byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        byte = {s: b for b, s in enumerate(byte_symbols())}
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.bytes: list[bytes] = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, i in ids.items():
            self.bytes[i] = token.encode() if token in self.special else bytes(byte[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.ids = {b: i for i, b in enumerate(self.bytes) if b and i not in self.special.values()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: left, right, rank of the merge that makes it
        for r, m in enumerate(model["merges"]):
            left, right = m.split(" ") if isinstance(m, str) else m
            pair, made = (ids[left], ids[right]), ids[left + right]
            self.rank.setdefault(pair, r)
            self.parts.setdefault(made, (*pair, r))
        self.pattern = regex.compile(pattern)
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._sizes = list(map(len, self.bytes))
        self._begins = {b[:k] for b in self.ids for k in range(len(b) + 1)}
        self.forget()

    def _edge(self, token: int, side: int, known: dict) -> list[tuple[int, int]]:
        """The parts at a token's edge from its byte up to itself, each with the rank at which it is merged away."""
        out = known.get(token)
        if out is None:
            chain, t = [(token, _NEVER)], token
            while t in self.parts:
                rank = self.parts[t][2]
                t = self.parts[t][side]
                chain.append((t, rank))
            out = known[token] = chain[::-1]
        return out

    def fits(self, a: int, b: int, until: int = _NEVER) -> bool:
        """Whether no merge crosses the border of a and b before rank ``until`` while each is made of its parts."""
        left, right = self._edge(a, 1, self._right), self._edge(b, 0, self._left)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            r = self.rank.get((x, y))
            # at equal rank the merge further left goes first
            if r is not None and r < x_ends and r <= y_ends and r < until:
                return False
            if x_ends == y_ends == _NEVER:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def whole(self, token: int) -> bool:
        """Whether the token's own bytes are encoded as the token."""
        out = self._whole.get(token)
        if out is None:
            if token in self.parts:
                left, right, rank = self.parts[token]
                out = self.whole(left) and self.whole(right) and self.fits(left, right, rank)
            else:
                out = len(self.bytes[token]) == 1
            self._whole[token] = out
        return out

    def _next(self, state: int, byte: int) -> int:
        """The state after one more byte: the longest end of what was read that begins a token. Made when first reached."""
        here = self._states[state] + bytes((byte,))
        while here not in self._begins:
            here = here[1:]
        number = self._number.get(here)
        if number is None:
            if here not in self.ids and len(here) < 2:
                raise ValueError(f"the vocabulary lacks the byte {here!r}")
            number = self._number[here] = len(self._states)
            self._states.append(here)
            ends = ((n, self.ids.get(here[len(here) - n :])) for n in range(len(here), 0, -1))
            self._ends.append(tuple((n, t) for n, t in ends if t is not None and self.whole(t)))
        self._goto[state << 8 | byte] = number
        return number

    def encode_sorted(self, words: list[bytes]) -> Iterator[list[int]]:
        """The ids of distinct words given in sorted order."""
        fits, size, goto, ends = self._fits, self._sizes, self._goto, self._ends
        last: list[int] = [-1]
        states = [0]
        before = b""
        for word in words:
            n = len(word)
            shared, most = 0, min(n, len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], states[shared + 1 :]
            state = states[shared]
            for i in range(shared, n):
                byte = word[i]
                state = goto.get(state << 8 | byte) or self._next(state, byte)
                states.append(state)
                # of the tokens that end here, the longest that goes with the last token before it
                for length, t in ends[state]:
                    start = i + 1 - length
                    if not start:
                        last.append(t)
                        break
                    key = last[start] << 32 | t
                    good = fits.get(key)
                    if good is None:
                        if len(fits) >= MOST_FITS:
                            fits.clear()
                        good = fits[key] = self.fits(last[start], t)
                    if good:
                        last.append(t)
                        break
                else:
                    raise ValueError(f"the vocabulary lacks a byte of {word[: i + 1]!r}")
            before, i, out = word, n, []
            while i:
                out.append(last[i])
                i -= size[last[i]]
            out.reverse()
            yield out

    def _pieces(self, unit: str) -> list:
        """Words of a unit, or ids of special tokens."""
        out: list = []
        for k, part in enumerate(self.special_re.split(unit)):
            out += [self.special[part]] if k % 2 else self.pattern.findall(part)
        return out

    def encode_units(self, texts: list[str]) -> list[bytes]:
        """32-bit little-endian ids of each text; the distinct words of all of them share one trie."""
        if self.special_re is None or not any(s in t for s in self.special for t in texts):
            pieces = list(map(self.pattern.findall, texts))
        else:
            pieces = list(map(self._pieces, texts))
        distinct = set(chain.from_iterable(pieces))
        made = {p: array("I", [p]).tobytes() for p in self.special.values() if p in distinct}
        words = sorted((p.encode("utf-8", "surrogatepass"), p) for p in distinct if p not in made)
        made.update((p, array("I", ids).tobytes()) for (_, p), ids in zip(words, self.encode_sorted([w for w, _ in words])))
        get = made.__getitem__
        return [b"".join(map(get, ps)) for ps in pieces]

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """32-bit little-endian ids of each whole text."""
        return encode_texts(texts, self.heads, self.tails, self.encode_units, self.encode_units)

    def forget(self) -> None:
        """Gives up all that was made for texts, so that workers don't hold it for other work.

        What is kept of it would lie strewn among the rest, and hold the memory around it.
        """
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._fits: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        # an automaton over the tokens' bytes, by which each place in a word knows the tokens that end there
        self._states, self._number, self._goto = [b""], {b"": 0}, {}
        self._ends: list[tuple[tuple[int, int], ...]] = [()]
        self.heads, self.tails = Cache(MOST_UNITS // 4), Cache(MOST_UNITS)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One for each worker process."""
    return Vocabulary(path, pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: tuple[str, str] | None = None, decoded: bool = False) -> DataFrame:
    """doc_id, ids (array of int) of each whole text; with ``decoded``, also the text that the ids decode to."""
    vocab = vocab or default_vocabulary()
    id_type = docs.select(F.col(id_col).alias("doc_id")).schema[0].dataType.simpleString()

    @uncollected
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(*vocab)
        for b in batches:
            for start, end in runs(b.column(1), GROUP):
                raw = v.encode_texts([x or "" for x in b.column(1).slice(start, end - start).to_pylist()])
                offsets = np.zeros(len(raw) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in raw], out=offsets[1:])
                values = np.frombuffer(b"".join(raw), np.int32)
                columns = [b.column(0).slice(start, end - start), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))]
                if decoded:
                    columns.append(pa.array([v.decode(values[a:z].tolist()) for a, z in zip(offsets, offsets[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])
        v.forget()

    schema = f"doc_id {id_type}, ids array<int>" + ", decoded string" * decoded
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, vocab: tuple[str, str] | None = None) -> DataFrame:
    """Adds decoded: the text of the ids; null ids decode to an empty text."""
    vocab = vocab or default_vocabulary()

    @F.pandas_udf("string")
    def text(ids):
        v = vocabulary(*vocab)
        return ids.map(lambda x: v.decode([] if x is None else x.tolist()))

    return encoded.withColumn("decoded", text("ids"))


def op2_bpe_trie(spark, sf_dir: str) -> DataFrame:
    out = encode(table(spark, sf_dir, "documents"), decoded=True)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
