"""LM scoring from a log-frequency Bloom filter of word n-gram counts.

Tokens are the words of a text with A-Z lower-cased and one end. A text is read after an end, and every run of 2 to ORDER
tokens in it is an n-gram, across all borders of words. Counts are those of the training texts, quantised to powers of
LOG_BASE: an n-gram of level q is put into a Bloom filter as (n-gram, 1) to (n-gram, q), and read back by probing 1, 2, ...
until a probe fails. Probabilities are smoothed from the token up:

    p(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1))            exact counts; all unseen words share the last 0.5
    p(w | h) = (c(h w) + W * p(w | h less its first)) / (c(h) + W)       c(h w) and c(h) as probed, W = WORD_SMOOTHING

Quantised counts make the sums over all next words only nearly 1.

The filter grows with the corpus, so no size of it could be promised to a broadcast: it stays in ranges of the n-grams'
hashes, whose number grows with the documents, each range with a filter part of BITS_PER_ENTRY bits an entry, however
many there are (``entries`` and ``bits`` say how many). Probes come to the parts instead: texts are read once, in blocks
of about BLOCK_BYTES, and written as numbers of each block's distinct words; a block sends each range its distinct n-grams
with their training counts, the range adds up all blocks' counts, makes its part of the filter and sends each block the
levels that it reads there. So an n-gram that a third of all texts have is one number in each block. False positives
are about (1 - exp(-PROBES / BITS_PER_ENTRY)) ** PROBES = 1.2 % for a probed level, at every size.

Token counts go the same way but are exact: the words themselves are added up, not hashes of them. In a range n-grams are
told apart by KEY_BITS bits of a hash over 64-bit hashes of their words; as a range holds some millions at any size,
one in about 10^5 meets another, far below the filter's own rate. A range's filter is made and read in pieces of SLICE
n-grams, each with its own bits, so that a piece and its probes stay in a core's cache.

Nulls and empty texts are an end alone. A null id is not held out. Repeated rows count each and get equal scores. A very
long text is a block of its own. Extra columns play no part, whatever their names. Empty tables give no rows; without
training rows, all counts are 0.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bag_minhash import _mix
from .shared import cut, table, uncollected

ORDER = 3
WORD_SMOOTHING = 20.0
LOG_BASE = 1.5
BITS_PER_ENTRY, PROBES = 10, 4
BLOCK_BYTES = 6_000_000
#: Documents for each range of hashes, and the least number of ranges.
RANGE_DOCS, LEAST_RANGES = 2048, 24
#: Bits of an n-gram's hash besides its range.
KEY_BITS = 40
#: N-grams of a piece of a range's filter.
SLICE = 1 << 16
#: Bytes of a word that are hashed in columns; longer words go through BLAKE2b.
LONG_WORD = 64

_P = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << KEY_BITS) - 1)


# ---- words and n-grams

def tokens(text: str | None) -> list[bytes]:
    """The words with A-Z lower-cased; the end, which every text has, is left to the callers as the empty word."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, their numbers in all texts one after the other, words of each text): the ``tokens`` of many texts at once.
    Arrow parts at the same six bytes, and leaves an empty word where a text begins or ends with one."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten().dictionary_encode()
    words, ids = flat.dictionary.cast(pa.binary()), flat.indices.to_numpy().astype(np.int64)
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.index(words, pa.scalar(b"", pa.binary())).as_py()
    if empty >= 0:
        real = ids != empty
        owner = np.repeat(np.arange(len(lengths)), lengths)
        ids, lengths = ids[real], np.bincount(owner[real], minlength=len(lengths))
    return words, ids, lengths


def _array(words: pa.Array | list[bytes]) -> pa.Array:
    return words if isinstance(words, pa.Array) else pa.array(words, pa.binary())


def word_hashes(words: pa.Array | list[bytes]) -> np.ndarray:
    """64 bits of each word: its bytes, eight at a time, through a mixing function; BLAKE2b of words of more than LONG_WORD bytes."""
    words = _array(words)
    if not len(words):
        return np.empty(0, np.uint64)
    _, places, data = words.buffers()
    places = np.frombuffer(places, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    starts, ends, sizes = places[:-1], places[1:], np.diff(places)
    raw = np.frombuffer(b"".join([data or b"", bytes(8)]), np.uint8)
    eights = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    out = _mix(sizes.astype(np.uint64) + _P)
    left = np.flatnonzero((sizes > 0) & (sizes <= LONG_WORD))
    done = 0
    while len(left):
        rest = np.minimum(sizes[left] - done, 8).astype(np.uint64)
        part = eights[starts[left] + done] & np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * rest)
        out[left] = _mix(out[left] * _P + _mix(part + np.uint64(done)))
        done += 8
        left = left[sizes[left] > done]
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        out[i] = int.from_bytes(blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) * np.uint64(ranges) >> np.uint64(24)).astype(np.int64)


def sequence(ids: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, place in the text, text) of the tokens of all texts, each with an end before and after it."""
    sizes = lengths + 2
    owner = np.repeat(np.arange(len(lengths)), sizes)
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.full(len(owner), end, np.int64)
    out[(place > 0) & (place <= lengths[owner])] = ids
    return out, place, owner


def gram_keys(hashes: np.ndarray, place: np.ndarray, ranges: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each order from 2: where its n-grams end, and their keys, which are the range and KEY_BITS more bits."""
    h = hashes
    for order in range(2, ORDER + 1):
        h = np.concatenate([np.zeros(1, np.uint64), _mix(h[:-1] * _P + hashes[1:] + np.uint64(order))])
        at = np.flatnonzero(place >= order - 1)
        yield order, at, range_of(h[at], ranges).astype(np.uint64) << np.uint64(KEY_BITS) | (_mix(h[at]) & _LOW)


def distinct_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys of KEY_BITS bits in order, the place of each key among them), sorted with their places as one number."""
    spare = 64 - KEY_BITS
    if not 0 < len(keys) < 1 << spare:
        return np.unique(keys, return_inverse=True)
    both = keys << np.uint64(spare) | np.arange(len(keys), dtype=np.uint64)
    both.sort()
    at = (both & np.uint64((1 << spare) - 1)).astype(np.int64)
    both >>= np.uint64(spare)
    new = np.concatenate([[True], both[1:] != both[:-1]])
    back = np.empty(len(keys), np.int64)
    back[at] = np.cumsum(new) - 1
    return both[new], back


# ---- the filter

def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(LOG_BASE) + 1e-9).astype(np.int64)


#: The count that a level stands for.
_VALUES = np.concatenate([[0.0, 1.0], LOG_BASE ** np.arange(1, 120) * (1 + LOG_BASE) / 2])


class Filter:
    """The log-frequency filter of one range of n-grams: distinct keys and their counts (at least 1)."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        q = levels(counts)
        self.entries = int(q.sum())
        self.bits = max(64, self.entries * BITS_PER_ENTRY)
        self.set = np.zeros(self.bits, bool)
        for level in range(1, int(q.max(initial=0)) + 1):
            for at in self._places(keys[q >= level], level):
                self.set[at] = True

    def _places(self, keys: np.ndarray, level: int) -> Iterator[np.ndarray]:
        h = _mix(keys + np.uint64(level * int(_P) & (1 << 64) - 1))
        step = (h >> np.uint64(32)) | np.uint64(1)
        for k in range(PROBES):
            yield ((h + np.uint64(k) * step & np.uint64(0xFFFFFFFF)) * np.uint64(self.bits) >> np.uint64(32)).astype(np.int64)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels of keys, by probing one level after the other."""
        q, left, level = np.zeros(len(keys), np.int64), np.arange(len(keys)), 1
        while len(left) and level < len(_VALUES):
            hit = np.ones(len(left), bool)
            for at in self._places(keys[left], level):
                hit &= self.set[at]
            left = left[hit]
            q[left] = level
            level += 1
        return q


# ---- packed columns

def _pack(x: np.ndarray) -> bytes:
    """Non-negative integers, byte plane by byte plane, compressed."""
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    planes = x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return b"".join([bytes([width]), len(x).to_bytes(8, "little"), pa.compress(planes, codec="zstd", asbytes=True)])


def _unpack(raw: bytes) -> np.ndarray:
    width, n = raw[0], int.from_bytes(raw[1:9], "little")
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(raw[9:], decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def _pack_words(words: pa.Array | list[bytes]) -> bytes:
    """Words hold no space, so one between them parts them again."""
    words = _array(words)
    one = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    raw = pc.binary_join(one, pa.scalar(b" ", pa.binary()))[0].as_buffer()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack_words(raw: bytes) -> list[bytes]:
    return _unpack_array(raw).to_pylist()


def _unpack_array(raw: bytes) -> pa.Array:
    joined = pa.decompress(raw[8:], decompressed_size=int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)
    return pc.split_pattern(pa.array([joined], pa.binary()), " ").flatten()


# ---- data frames

def held_out(id_col: str = "doc_id", parts: int = 5, part: int = 1):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def blocks(docs: DataFrame, id_col: str, text_col: str, ranges: int) -> DataFrame:
    """One pass over the texts, written: a row for each block, with its rows' ids and flags, its distinct words in the
    order of their ranges, and its texts as numbers of these words."""
    id_type = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def block(rows: pa.Table) -> list[bytes]:
        words, ids, lengths = split(_whole(rows.column(2)))
        if pc.index(words, pa.scalar(b"", pa.binary())).as_py() < 0:
            words = pa.concat_arrays([words, pa.array([b""], pa.binary())])
        order = np.argsort(range_of(word_hashes(words), ranges), kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        held = rows.column(1).to_numpy().astype(np.int64)
        return [_pack(held), _pack(lengths), _pack_words(words.take(pa.array(order))), _pack(rank[ids])]

    names = ["block", "doc_ids", "held", "lengths", "words", "ids"]

    @uncollected
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = uuid.uuid4().hex  # a task that runs again makes blocks of its own; only one attempt's rows are kept
        waiting: list[pa.RecordBatch] = []
        size = made = 0

        def packed() -> pa.RecordBatch:
            nonlocal made
            rows = pa.Table.from_batches(waiting)
            waiting.clear()
            made += 1
            ids = _whole(rows.column(0))
            offsets = pa.array([0, rows.num_rows], pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([f"{own}-{made}"]), pa.ListArray.from_arrays(offsets, ids), *(pa.array([x], pa.binary()) for x in block(rows))], names)

        for b in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < b.num_rows:
                before = int(ends[start - 1]) if start else 0
                end = int(np.searchsorted(ends, BLOCK_BYTES - size + before)) + 1
                waiting.append(b.slice(start, end - start))
                if end > b.num_rows:
                    size += int(ends[-1]) - before
                    break
                yield packed()
                size, start = 0, end
        if waiting:
            yield packed()

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return cut(rows.mapInArrow(run, f"block string, doc_ids array<{id_type}>, held binary, lengths binary, words binary, ids binary"), "lm-blocks")


class _Texts:
    """A block's texts, unpacked."""

    def __init__(self, held: bytes, lengths: bytes, words: bytes, ids: bytes):
        self.held, self.lengths = _unpack(held).astype(bool), _unpack(lengths).astype(np.int64)
        self.words = _unpack_array(words)
        self.hashes = word_hashes(self.words)
        self.end = pc.index(self.words, pa.scalar(b"", pa.binary())).as_py()
        self.seq, self.place, self.owner = sequence(_unpack(ids).astype(np.int64), self.lengths, self.end)

    def grams(self, ranges: int):
        return gram_keys(self.hashes[self.seq], self.place, ranges)


def _requests(rows: DataFrame, ranges: int) -> DataFrame:
    """What the blocks send to the ranges: order 1, words; from order 2, keys of n-grams; each with training counts."""
    low = np.uint64(KEY_BITS)

    @uncollected
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tag, *packed in zip(*(c.to_pylist() for c in b.columns)):
                x = _Texts(*packed)
                own = ~x.held[x.owner]
                counts = np.bincount(x.seq[own & (x.place > 0)], minlength=len(x.words))
                out = []
                edges = np.searchsorted(range_of(x.hashes, ranges), np.arange(ranges + 1))
                for r, (a, z) in enumerate(zip(edges, edges[1:])):
                    if z > a:
                        out.append((1, r, tag, _pack_words(x.words.slice(a, z - a)), _pack(counts[a:z])))
                for order, at, keys in x.grams(ranges):
                    keys, back = np.unique(keys, return_inverse=True)
                    counts = np.bincount(back, own[at], len(keys)).astype(np.int64)
                    edges = np.searchsorted(keys >> low, np.arange(ranges + 1, dtype=np.uint64))
                    for r, (a, z) in enumerate(zip(edges, edges[1:])):
                        if z > a:
                            out.append((order, r, tag, _pack(keys[a:z] & _LOW), _pack(counts[a:z])))
                kinds = [pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([y[i] for y in out], t) for i, t in enumerate(kinds)], ["ord", "part", "block", "keys", "counts"])

    return rows.select("block", "held", "lengths", "words", "ids").mapInArrow(run, "ord int, part int, block string, keys binary, counts binary")


_ANSWER = "ord int, part int, block string, found binary, n long, v long"


def _answers(group: pa.Table) -> pa.Table:
    """Of one range: for each block what was found of its keys, in their order (words: counts; n-grams: levels), and a row
    with sums (words: all counts, distinct words in training; n-grams: the filter's entries and bits)."""
    order, part = group.column("ord")[0].as_py(), group.column("part")[0].as_py()
    tags = group.column("block").to_pylist()
    asked = group.column("keys").to_pylist()
    counts = [_unpack(x).astype(np.int64) for x in group.column("counts").to_pylist()]
    if order == 1:
        lists = [_unpack_array(x) for x in asked]
        back = pa.concat_arrays(lists).dictionary_encode().indices.to_numpy()
        sums = np.bincount(back, np.concatenate(counts)).astype(np.int64)
        found = sums[back]
        n, v = int(sums.sum()), int((sums > 0).sum())
    else:
        lists = [_unpack(x) for x in asked]
        distinct, back = distinct_keys(np.concatenate(lists))
        sums = np.bincount(back, np.concatenate(counts), len(distinct)).astype(np.int64)
        q, n, v = np.empty(len(distinct), np.int64), 0, 0
        for a in range(0, len(distinct), SLICE):
            keys, c = distinct[a : a + SLICE], sums[a : a + SLICE]
            bloom = Filter(keys[c > 0], c[c > 0])
            q[a : a + SLICE] = bloom.levels(keys)
            n, v = n + bloom.entries, v + bloom.bits
        found = q[back]
    found = np.split(found, np.cumsum([len(x) for x in lists])[:-1])
    m = len(tags)
    columns = [[order] * (m + 1), [part] * (m + 1), [*tags, None], [*map(_pack, found), None], [None] * m + [n], [None] * m + [v]]
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["ord", "part", "block", "found", "n", "v"])


class Model:
    """What the corpus gave: N, V, the size of the filter, and each block's answers."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.ranges = max(LEAST_RANGES, docs.count() // RANGE_DOCS)
        self.rows = blocks(docs, id_col, text_col, self.ranges)
        self.answers = cut(_requests(self.rows, self.ranges).groupBy("ord", "part").applyInArrow(_answers, _ANSWER), "lm-answers")
        sums = {r["ord"]: r for r in self.answers.where("block IS NULL").groupBy("ord").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}
        self.n, self.v = (int(sums[1]["n"]), int(sums[1]["v"])) if 1 in sums else (0, 0)
        #: Entries and bits of the filter, whose parts never leave their ranges.
        self.entries, self.bits = (sum(int(r[c]) for k, r in sums.items() if k > 1) for c in ("n", "v"))

    def score(self) -> DataFrame:
        """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
        ranges, n, v = self.ranges, self.n, self.v
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

        def run(block: pa.Table, answers: pa.Table) -> pa.Table:
            x = _Texts(*(block.column(c)[0].as_py() for c in ("held", "lengths", "words", "ids")))
            parts: dict[int, list[tuple[int, bytes]]] = {}
            for order, part, raw in zip(*(answers.column(c).to_pylist() for c in ("ord", "part", "found"))):
                parts.setdefault(order, []).append((part, raw))
            found = {order: np.concatenate([_unpack(raw) for _, raw in sorted(p)]).astype(np.int64) for order, p in parts.items()}
            counts = found[1][x.seq]
            base = np.log10(counts + 0.5) - np.log10(n + 0.5 * (v + 1))
            p, context = (counts + 0.5) / (n + 0.5 * (v + 1)), counts.astype(float)
            for order, at, keys in x.grams(ranges):
                own = np.zeros(len(p))
                own[at] = _VALUES[found[order][np.unique(keys, return_inverse=True)[1]]]
                # the n-gram without its last token ends one place before
                before = context[at - 1]
                p[at] = (np.minimum(own[at], before) + WORD_SMOOTHING * p[at]) / (before + WORD_SMOOTHING)
                context = own
            real = x.place > 0
            sums = lambda values: np.bincount(x.owner[real], values[real], len(x.lengths))
            m = len(x.lengths)
            columns = [block.column("doc_ids").combine_chunks().flatten(), pa.array(x.held), pa.array(x.lengths + 1), pa.array(sums(counts > 0).astype(np.int64)), pa.array(np.full(m, n, np.int64)), pa.array(sums(base)), pa.array(sums(np.log10(p)))]
            return pa.Table.from_arrays(columns, names=names)

        id_type = self.rows.schema["doc_ids"].dataType.elementType.simpleString()
        answers = self.answers.where("block IS NOT NULL").select("block", "ord", "part", "found")
        return self.rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_bloom_lm(spark, sf_dir: str) -> DataFrame:
    return Model(table(spark, sf_dir, "documents")).score()
