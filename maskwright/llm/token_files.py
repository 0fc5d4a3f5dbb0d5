"""Token ids in binary shard files with keyed access through a minimal perfect hash.

Shard file, little-endian:

    8 bytes   magic
    6 x u64   bytes for each id (2 or 4), records R, ids I, keys K, hash levels L, records with a null key at the front
    ids       I ids of all records one after the other
    offsets   u64[R + 1], first id of each record
    keys      i64[R], keys of the records, ascending (0 for null keys)
    levels    u64[L], bits of each level; then each level's bits, packed; then u32 ranks of each byte of all levels
    slots     K x (u32 fingerprint, u64 first record, u32 records)

A key's slot is its rank among the set bits of the first level in which its bit is set; the stored fingerprint tells
keys that the shard lacks. Shards hold ascending, disjoint ranges of keys, so the shards in order hold all documents
in ascending order; equal keys are in one shard, next to each other.

Nulls: null texts are empty; null ids come first. Repeated rows are records each, those of one key in the order
of their ids' bytes. Empty tables
write no shard. A very long text is one record, whose ids one task holds. Other columns, of any name, play no part.
Files are written under a temporary name and then renamed, so a task that runs again after a lost executor writes the
same file again. All of them are in the shared folder, reached through pyarrow's file systems.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pretokens import units
from .shared import runs, scratch, table, uncollected

MAGIC = b"MWTOKEN1"
#: Documents in a shard, about; and the most shards, above which shards grow.
SHARD_ROWS, MOST_SHARDS = 4096, 16_384
#: Records that are read at a time.
RUN = 1024
#: Units that a worker remembers, of each kind.
MOST_UNITS = 1_000_000
END_ID = 2

_SLOT = np.dtype([("print", "<u4"), ("first", "<u8"), ("count", "<u4")])


# ---- minimal perfect hash

def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """splitmix64 of each key."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1_000_003) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Levels of bits: a key's bit is set in the first level where no other remaining key falls on it."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        packed = np.concatenate([np.packbits(x, bitorder="little") for x in levels]) if levels else np.zeros(0, np.uint8)
        self.starts = np.cumsum([0, *(-(-len(x) // 8) for x in levels)])
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(packed))]).astype(np.uint32)
        self.packed = packed

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels = keys, []
        while len(left):
            size = max(8, 2 * len(left))
            at = (mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            counts = np.bincount(at, minlength=size)
            levels.append(counts == 1)
            left = left[counts[at] != 1]
            if len(levels) > 200:
                raise ValueError("keys repeat")
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, in constant time on average; -1 for some that aren't in the set."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for d, bits in enumerate(self.levels):
            at = (mix(keys[left], d) % np.uint64(len(bits))).astype(np.int64)
            byte = self.starts[d] + (at >> 3)
            value, bit = self.packed[byte], (at & 7).astype(np.uint8)
            found = (value >> bit) & 1 == 1
            below = np.bitwise_count(value & ((1 << bit.astype(np.int64)) - 1).astype(np.uint8))
            out[left[found]] = self.ranks[byte[found]] + below[found]
            left = left[~found]
        return out


# ---- files

def _fs(uri: str):
    return pyarrow.fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes one shard; records come in ascending order of keys, null keys first."""

    def __init__(self, folder: str, number: int, width: int):
        self.fs, base = _fs(folder)
        self.path, self.width = f"{base}/shard-{number:06d}.tokens", width
        self.temporary = f"{base}/.{uuid.uuid4().hex}"
        self.ids, self.nulls = self.fs.open_output_stream(self.temporary + ".ids"), 0
        self.sizes: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []

    def add(self, keys: pa.Array, payloads: list[bytes]) -> None:
        self.nulls += keys.null_count
        self.keys.append(keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        self.sizes.append(np.array([len(x) // self.width for x in payloads], np.uint64))
        self.ids.write(b"".join(payloads))

    def close(self) -> tuple[int, int]:
        """Puts the file in place; (records, ids)."""
        self.ids.close()
        keys, sizes = np.concatenate(self.keys), np.concatenate(self.sizes)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")
        distinct, first, counts = np.unique(keys[self.nulls :], return_index=True, return_counts=True)
        ph = PerfectHash.build(distinct)
        slots = np.zeros(len(distinct), _SLOT)
        at = ph.slots(distinct)
        slots["print"][at], slots["first"][at], slots["count"][at] = fingerprints(distinct), first + self.nulls, counts
        with self.fs.open_output_stream(self.temporary) as out:
            out.write(MAGIC + np.array([self.width, len(keys), offsets[-1], len(distinct), len(ph.levels), self.nulls], "<u8").tobytes())
            with self.fs.open_input_stream(self.temporary + ".ids") as ids:
                while part := ids.read(1 << 22):
                    out.write(part)
            for x in (offsets, keys.astype("<i8"), np.array([len(x) for x in ph.levels], "<u8"), ph.packed, ph.ranks.astype("<u4"), slots):
                out.write(x.tobytes())
        self.fs.delete_file(self.temporary + ".ids")
        self.fs.move(self.temporary, self.path)
        return len(keys), int(offsets[-1])


class Shard:
    """Keyed and sequential access to one shard; the ids stay in the file."""

    def __init__(self, folder: str, number: int):
        fs, base = _fs(folder)
        self.file = fs.open_input_file(f"{base}/shard-{number:06d}.tokens")
        if self.file.read(8) != MAGIC:
            raise ValueError("not a shard file")
        self.width, self.records, self.n_ids, n_keys, n_levels, self.nulls = map(int, np.frombuffer(self.file.read(48), "<u8"))
        self.file.seek(56 + self.n_ids * self.width)
        array = lambda kind, n: np.frombuffer(self.file.read(np.dtype(kind).itemsize * n), kind)
        self.offsets, self.keys = array("<u8", self.records + 1).astype(np.int64), array("<i8", self.records)
        sizes = array("<u8", n_levels)
        levels = [np.unpackbits(array("u1", -(-int(s) // 8)), count=int(s), bitorder="little").astype(bool) for s in sizes]
        self.hash = PerfectHash(levels)
        if not np.array_equal(array("<u4", len(self.hash.ranks)), self.hash.ranks):
            raise ValueError("the shard's index is damaged")
        self.slots = array(_SLOT, n_keys)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first record, records) of each key; (-1, 0) for keys that the fingerprints show to be absent."""
        at = self.hash.slots(keys)
        slot = self.slots[np.maximum(at, 0)] if len(self.slots) else np.zeros(len(keys), _SLOT)
        there = (at >= 0) & (slot["print"] == fingerprints(keys)) & (len(self.slots) > 0)
        return np.where(there, slot["first"].astype(np.int64), -1), np.where(there, slot["count"].astype(np.int64), 0)

    def ids(self, record: int, until: int | None = None) -> np.ndarray:
        """Ids of a record, or of the records from it up to ``until``."""
        a, z = int(self.offsets[record]), int(self.offsets[(record if until is None else until - 1) + 1])
        return np.frombuffer(self.file.read_at((z - a) * self.width, 56 + a * self.width), f"<u{self.width}")


# ---- encoding with the tokenizers library

#: A letter run and ASCII punctuation after it, which byte-level splitting parts in two and leaves whole otherwise.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ž]+)([!-&(-/:-@\[-`{-~]*)")


class _Units(dict):
    """Encodings of units, made when first asked for; it empties itself at MOST_UNITS, which changes no result."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, unit):
        out = self.make(unit)
        if len(self) >= MOST_UNITS:
            self.clear()
        self[unit] = out
        return out


class LibraryEncoder:
    """Encodes with the tokenizers library: each distinct unit once for as long as it is remembered.

    A letter run, and the punctuation behind it, go to the library's BPE model directly, all other units through the
    whole tokenizer; that needs the byte-level splitting of the vocabulary file to be the plain one, else all do.
    """

    def __init__(self, path: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        from .bpe_trie import byte_symbols

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.model, self.kind = self.lib.model, f"<u{width}"
        self.code = {2: "H", 4: "I"}[width]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        self.plain = not spec.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        self.symbols = dict(enumerate(byte_symbols()))
        self.stems = _Units(self._word)
        self.heads, self.tails = _Units(self._head), _Units(self._tail)

    def _word(self, word: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.symbols))]).tobytes()

    def _unit(self, before: str, unit: str) -> bytes:
        m = _SIMPLE.fullmatch(unit) if self.plain else None
        if m is None:
            return self._encode([before + unit])[0]
        word, marks = m.groups()
        return self.stems[before + word] + (self.stems[marks] if marks else b"")

    def _head(self, unit: str) -> bytes:
        return self._unit("", unit)

    def _tail(self, unit: str) -> bytes:
        return self._unit(" ", unit)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.kind).tobytes() for x in self.lib.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        feed, head, tail = self.heads["\n"], self.heads.__getitem__, self.tails.__getitem__
        out = []
        for t in texts:
            lines = units(t)
            if lines is None:
                out += self._encode([t])
            else:
                out.append(feed.join([head(p[0]) + b"".join(map(tail, p[1:])) for p in lines]))
        return out


@lru_cache(maxsize=2)
def _encoder(path: str, width: int) -> LibraryEncoder:
    return LibraryEncoder(path, width)


# ---- data frames

@dataclass
class TokenSet:
    """Written shards: (number, records, ids, id position of the first) each, at most MOST_SHARDS of them."""

    folder: str
    shards: list[tuple[int, int, int, int]]


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text") -> TokenSet:
    """Encodes whole texts and writes them to shard files in ascending order of the integer ids.

    Texts are encoded where they are read; what is shuffled is ids of 2 bytes where the vocabulary fits. The ranges of
    the shards come from a bounded quantile sketch of the ids alone.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)
    top = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", ())), end_id or 0])
    width = 2 if top < 1 << 16 else 4
    n = docs.count()
    count = max(1, min(MOST_SHARDS, -(-n // SHARD_ROWS)))
    cuts = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), F.array(*(F.lit(k / count) for k in range(1, count))), min(100 * count, 1_000_000))).first()[0] if count > 1 else []
    cuts = np.unique(np.array(cuts or [], np.int64))
    fs, base = _fs(folder)
    fs.create_dir(base, recursive=True)

    @uncollected
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer, width)
        end = b"" if end_id is None else end_id.to_bytes(width, "little")
        for b in batches:
            shard = pa.array(np.searchsorted(cuts, b.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), "right").astype(np.int32))
            for s, e in runs(b.column(1), 4_000_000):
                texts = [x or "" for x in b.column(1).slice(s, e - s).to_pylist()]
                yield pa.RecordBatch.from_arrays([shard.slice(s, e - s), b.column(0).slice(s, e - s), pa.array([x + end for x in enc.encode(texts)], pa.binary())], ["shard", "key", "ids"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, number, done = None, None, []
        for b in batches:
            shards = b.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shards)) + 1), len(shards)]
            for s, e in zip(edges, edges[1:]):
                if e > s:
                    if shards[s] != number:
                        if writer:
                            done.append((number, *writer.close()))
                        number = int(shards[s])
                        writer = ShardWriter(folder, number, width)
                    writer.add(b.column(1).slice(s, e - s), b.column(2).slice(s, e - s).to_pylist())
        if writer:
            done.append((number, *writer.close()))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.int64()) for k in range(3)], ["shard", "records", "n_ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text")).mapInArrow(encode, "shard int, key long, ids binary")
    rows = rows.repartition(max(count, spark.sparkContext.defaultParallelism), "shard").sortWithinPartitions("shard", F.asc_nulls_first("key"), "ids")
    shards, at = [], 0
    for r in sorted(rows.mapInArrow(store, "shard long, records long, n_ids long").collect()):
        shards.append((*r, at))
        at += r["n_ids"]
    return TokenSet(folder, shards)


def read(spark: SparkSession, tokens: TokenSet) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each record, found by its key through the hash and read from the files."""
    folder = tokens.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                shard = Shard(folder, number)
                # records with a null key have no slot and are read in order; the others are looked up
                distinct = np.unique(shard.keys[shard.nulls :])
                first, counts = shard.find(distinct)
                if (counts < 1).any() or counts.sum() != shard.records - shard.nulls:
                    raise ValueError("the shard's index lacks keys")
                records = np.concatenate([np.arange(shard.nulls), np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))]).astype(np.int64)
                for s in range(0, len(records), RUN):
                    part = records[s : s + RUN]
                    # neighbours are read together: one request for many records
                    first, last = int(part.min()), int(part.max())
                    near = shard.ids(first, last + 1).astype("<u4") if last - first < 4 * RUN else None
                    at = shard.offsets[part] - shard.offsets[first]
                    ids = [shard.ids(int(r)).astype("<u4") if near is None else near[a : a + n] for r, a, n in zip(part, at, shard.offsets[part + 1] - shard.offsets[part])]
                    crcs = [zlib.crc32(x) for x in ids]
                    keys = pa.array(shard.keys[part], mask=part < shard.nulls)
                    starts, ends = shard.offsets[part], shard.offsets[part + 1]
                    yield pa.RecordBatch.from_arrays([keys, pa.array(base + starts), pa.array(ends - starts), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = spark.createDataFrame([(s, at) for s, _, _, at in tokens.shards], "shard long, base long").repartition(max(1, len(tokens.shards)))
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokens = write(table(spark, sf_dir, "documents"), scratch(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"))
    return read(spark, tokens)
