"""Near-duplicates by weighted Jaccard similarity of word shingles, with BagMinHash signatures.

Texts are multisets of windows of SHINGLE words (a shorter text is one window). Every shingle carries a Poisson process
over time and weight; the process is put together from independent ones on the weight ranges [0,1), [1,2), [2,4), [4,8)...
whose points keep those that lie below the shingle's weight, so a lighter shingle has a subset of a heavier one's
points. Each point falls to one of BANDS * ROWS components, which keeps its earliest point; two texts agree in a component
with the probability of their weighted Jaccard similarity. A process is only followed until all components have a point.

Texts with equal signatures in a band share a bucket. Links are found in each bucket and verified on the words
themselves:

1. equal texts are one class from the start, so copies cost nothing below;
2. in each bucket all classes are compared with one, drawn by a hash of bucket and class, so that each bucket of a large
   group brings other links;
3. where a bucket still holds classes of several components, all outside its largest component are compared with all
   of other components in the bucket: blocks of about BLOCK such classes are held while the bucket's classes stream
   past, a slice of about SLICE of them in each task, so that no task grows with a bucket and no pairs are made but those
   that are links. Links inside one component can't change the result and aren't looked for. First only sketches stream;
   texts go to the blocks and slices alone where their sketch met a likely one.

A sketch has one byte of each component of a signature: pairs are left out that agree in fewer than six standard
deviations below what a pair of the threshold's similarity has (a chance of 1e-9), and those whose sizes are too far apart.

Result: each document's class_id (the least doc_id with the same text) and group_id (the least doc_id of its component).

A null text is in no class but its own. Texts without words are alike only if equal. Null ids count after all others.
Repeated rows share class and group. Very long texts cost their length. Empty tables give no rows. Other columns, of
any name, play no part in ``groups`` and pass through ``keep_one``.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, few
from .shared import cut, packed, runs, table, trimmed, uncollected, words

SHINGLE = 5
THRESHOLD = 0.8
#: A pair of similarity 0.8 shares no bucket with a probability of (1 - 0.8**5)**25, which is 5e-5.
BANDS, ROWS = 25, 5
#: Classes held at a time in the third step, and classes that stream past them in one task.
BLOCK, SLICE = 256, 1024
#: Bytes of text hashed at a time.
GROUP = 1_000_000
#: Narrow rows that a row with a text counts for when files are dealt out.
TEXT_ROWS = 10

_M = BANDS * ROWS
_RNG = np.random.default_rng(42)
_BYTES = _RNG.integers(1, 2**63, 256, np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PLACES = _RNG.integers(1, 2**63, SHINGLE, np.uint64) | np.uint64(1)
_ROW_PLACES = _RNG.integers(1, 2**63, ROWS, np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = {1: np.ones(1, np.uint64), -1: np.ones(1, np.uint64)}


def _powers(n: int, sign: int) -> np.ndarray:
    if len(_POWERS[sign]) < n:
        with np.errstate(over="ignore"):
            steps = np.full(n + n // 4, _BASE if sign > 0 else _INVERSE, np.uint64)
            steps[0] = 1
            _POWERS[sign] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[sign][:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each word of all texts in order; a word's hash is a polynomial of its bytes modulo 2**64."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    space = _SPACE[data]
    edge = np.diff(space.view(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    starts, ends = starts[: len(ends)], ends[-len(starts) :] if len(starts) else ends[:0]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _powers(len(data), 1), out=sums[1:])
    hashes = _mix((sums[ends] - sums[starts]) * _powers(len(data), -1)[starts])
    limits = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.searchsorted(limits, starts, "right")


def bags(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all texts: (text number, shingle, weight), and each text's number of shingles."""
    w, doc = word_hashes(texts)
    per = np.bincount(doc, minlength=len(texts))
    n = np.where(per >= SHINGLE, per - SHINGLE + 1, (per > 0).astype(int))
    first = np.repeat(np.cumsum(per) - per, n) + _within(n)
    owner = np.repeat(np.arange(len(texts)), n)
    size = np.minimum(per, SHINGLE)[owner]
    s = size.astype(np.uint64)
    for j in range(SHINGLE):
        there = size > j
        s = s + np.where(there, w[np.minimum(first + j, len(w) - 1)] * _PLACES[j], np.uint64(0)) if len(w) else s
    s = _mix(s)
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], s[at], np.diff(np.append(at, len(s))), n


def _within(n: np.ndarray) -> np.ndarray:
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def signatures(count: int, owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """BagMinHash: for each of ``count`` texts and component, an identity of its earliest point; zeros for empty bags."""
    # a shingle's weight ranges: [0, 1), then [2**(k-1), 2**k) up to the one that its weight ends in
    ranges = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 2))).astype(int) + 1, 1)
    k = _within(ranges)
    row = np.repeat(np.arange(len(owner)), ranges)
    low = np.where(k == 0, 0.0, 2.0 ** (k - 1))
    length = np.where(k == 0, 1.0, low)
    doc, room = owner[row], np.minimum(weight[row] - low, length) / length
    seed = _mix(shingle[row] + k.astype(np.uint64) * _BASE)
    total = np.bincount(owner, weight, count)

    best, ident = np.full(count * _M, np.inf), np.zeros(count * _M, np.uint64)
    horizon = np.where(total > 0, _M * (np.log(_M) + 3) / np.maximum(total, 1), 0.0)
    x, j = np.zeros(len(row)), np.zeros(len(row), np.uint64)
    wanted = total > 0
    # the first point of each process
    h = _mix(seed + _BASE)
    x = -np.log1p(-((h >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / length
    j += np.uint64(1)
    live = np.arange(len(row))
    while len(live):
        todo = live[x[live] <= horizon[doc[live]]]
        found = []
        while len(todo):
            point = _mix(seed[todo] ^ (j[todo] * np.uint64(0xD6E8FEB86659FD93)))
            part = (point & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32
            good = part < room[todo]
            slot = (point >> np.uint64(32)) % np.uint64(_M)
            g = todo[good]
            found.append((doc[g] * _M + slot[good].astype(np.int64), x[g], _mix(point[good] + _BASE)))
            j[todo] += np.uint64(1)
            h = _mix(seed[todo] + j[todo] * _BASE)
            x[todo] += -np.log1p(-((h >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / length[todo]
            todo = todo[x[todo] <= horizon[doc[todo]]]
        if found:
            at, time, who = (np.concatenate(c) for c in zip(*found))
            order = np.argsort(-time, kind="stable")
            at, time, who = at[order], time[order], who[order]
            sooner = time < best[at]
            at, time, who = at[sooner], time[sooner], who[sooner]
            best[at], ident[at] = time, who  # the last one written, the earliest, stays
        full = np.isfinite(best.reshape(count, _M)).all(axis=1)
        wanted &= ~full
        horizon = np.where(wanted, 2 * horizon, 0.0)
        live = live[wanted[doc[live]]]
    return ident.reshape(count, _M)


def band_keys(ident: np.ndarray) -> np.ndarray:
    """(text, band): a key of the band's components; the band's number is part of it."""
    grouped = ident.reshape(len(ident), BANDS, ROWS)
    return _mix((grouped * _ROW_PLACES).sum(axis=2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _BASE).view(np.int64)


def bag(text: str) -> Counter:
    """The multiset of shingles itself."""
    w = words(text)
    if not w:
        return Counter()
    return Counter(zip(*(w[i:] for i in range(SHINGLE)))) if len(w) >= SHINGLE else Counter([tuple(w)])


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    common = sum(min(n, large[s]) for s, n in small.items() if s in large)
    total = sum(a.values()) + sum(b.values()) - common
    return common / total if total else 0.0


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, digest, n_shingles, bands, sketch for rows with a text; texts are read where they are."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    @uncollected
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, end in runs(b.column(1), GROUP):
                part = [x.encode("utf-8", "surrogatepass") for x in b.column(1).slice(start, end - start).to_pylist()]
                owner, shingle, weight, n = bags(part)
                ident = signatures(len(part), owner, shingle, weight)
                keys, sketches = band_keys(ident), ident.astype(np.uint8)
                sizes = np.where(n > 0, BANDS, 0)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[n > 0].reshape(-1)))
                digests = [hashlib.md5(t).digest() for t in part]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, end - start), pa.array(digests, pa.binary()), pa.array(n, pa.int64()), lists, pa.array([x.tobytes() for x in sketches], pa.binary())], ["doc_id", "digest", "n_shingles", "bands", "sketch"])

    return docs.where(F.col("text").isNotNull()).select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, digest binary, n_shingles long, bands array<long>, sketch binary")


def least_agreement(threshold: float) -> int:
    """Components that two sketches must share: six standard deviations below what the threshold's similarity gives."""
    return int(_M * threshold - 6 * (_M * threshold * (1 - threshold)) ** 0.5)


def likely(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow the threshold."""
    least = least_agreement(threshold)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, _M) for c in (b.column(2), b.column(3)))
            keep = pa.array(np.flatnonzero((x == y).sum(axis=1) >= least), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(i).take(keep) for i in (0, 1)], ["a", "b"])

    one = classes.select(F.col("digest").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    other = classes.select(F.col("digest").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    both = pairs.join(one, "a").join(other, "b").where(F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of digests whose texts are similar enough; the text of b is the one that many pairs share.

    Rows arrive sorted by b, so its shingles are counted once a run.
    """

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_bag = None, Counter()
        for batch in batches:
            keep = []
            for start, end in runs(batch.column(2), GROUP):
                part = batch.slice(start, end - start)
                for k, (key, one) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                    if key != last:
                        last, last_bag = key, bag(part.column(3)[k].as_py())
                    if similarity(bag(one), last_bag) >= threshold:
                        keep.append(start + k)
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(keep, pa.int64())) for i in (0, 1)], ["a", "b"])

    one = texts.select(F.col("digest").alias("a"), F.col("text").alias("ta"))
    other = texts.select(F.col("digest").alias("b"), F.col("text").alias("tb"))
    return pairs.join(one, "a").join(other, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary")


class _Held:
    """The classes of one block, against which others are compared by their shingles' hashes."""

    def __init__(self):
        self.rows: list[tuple[bytes, bytes, np.ndarray, np.ndarray, int]] = []
        self.all = np.zeros(0, np.uint64)

    def add(self, digests, comps, texts) -> None:
        for digest, comp, (shingle, weight, n) in zip(digests, comps, _bags_apart(texts)):
            self.rows.append((digest, comp, shingle, weight, n))

    def links(self, digests, comps, texts, threshold: float) -> list[tuple[bytes, bytes]]:
        """For each held class and other component among the given ones, the pair of the highest similarity, if that is enough."""
        if not self.rows or not len(digests):
            return []
        if not len(self.all):
            self.all = np.unique(np.concatenate([r[2] for r in self.rows]))
        owner, shingle, weight, n = bags(texts)
        at = np.searchsorted(self.all, shingle)
        at[at == len(self.all)] = 0
        known = self.all[at] == shingle
        at, weight, owner = at[known], weight[known], owner[known]
        scratch, out = np.zeros(len(self.all), np.int64), []
        for digest, comp, own, own_weight, own_n in self.rows:
            slots = np.searchsorted(self.all, own)
            scratch[slots] = own_weight
            common = np.bincount(owner, np.minimum(scratch[at], weight), len(digests))
            scratch[slots] = 0
            alike = common / np.maximum(own_n + n - common, 1)
            best: dict[bytes, tuple[float, bytes]] = {}
            for k in np.flatnonzero(alike >= threshold - 1e-9):
                if comps[k] != comp and alike[k] > best.get(comps[k], (0.0, b""))[0]:
                    best[comps[k]] = (float(alike[k]), digests[k])
            out += [(min(digest, d), max(digest, d)) for _, d in best.values()]
        return out


def _bags_apart(texts: list[bytes]):
    owner, shingle, weight, n = bags(texts)
    edges = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [(shingle[a:z], weight[a:z], int(k)) for a, z, k in zip(edges, edges[1:], n)]


def _meets(held: list[tuple[bytes, int, bytes]], past: list[tuple[bytes, int, bytes]], threshold: float) -> np.ndarray:
    """(held, past): whether two (component, shingles, sketch) are of different components and likely to be alike."""
    a, b = (np.frombuffer(b"".join([r[2] for r in rows]), np.uint8).reshape(-1, _M).T.copy() for rows in (held, past))
    agree = np.zeros((len(held), len(past)), np.uint8)
    for x, y in zip(a, b):
        agree += x[:, None] == y[None, :]
    n, m = (np.array([r[1] for r in rows]) for rows in (held, past))
    number: dict[bytes, int] = {}
    c, d = (np.array([number.setdefault(r[0], len(number)) for r in rows]) for rows in (held, past))
    close = np.minimum(n[:, None], m) >= threshold * np.maximum(n[:, None], m)
    return (agree >= least_agreement(threshold)) & close & (c[:, None] != d)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, int, pa.RecordBatch]]:
    """(key, kind, rows) for runs of rows that are equal in the first ``keys`` columns and the next one, the kind."""
    for b in batches:
        columns = [b.column(i).to_numpy() for i in range(keys + 1)]
        edges = np.flatnonzero(np.any([np.diff(c) != 0 for c in columns], axis=0)) + 1 if b.num_rows > 1 else []
        for a, z in zip([0, *edges], [*edges, b.num_rows]):
            if z > a:
                yield tuple(int(c[a]) for c in columns[:keys]), int(columns[keys][a]), b.slice(a, z - a)


def rest(open_: DataFrame, labels: DataFrame, classes: DataFrame, texts: DataFrame, threshold: float, count: int) -> DataFrame:
    """Pairs that link components: the third step over (bucket, digest) rows, ``count`` of them at most."""
    here = open_.join(labels, open_["digest"] == labels["v"], "left").select("bucket", "digest", F.coalesce("label", "digest").alias("comp"))
    # most buckets hold one component; their rows end here
    counts = here.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("_k")).groupBy("bucket").agg(F.max_by("comp", F.struct("_k", "comp")).alias("_main"), F.sum("_k").alias("_all"), (F.sum("_k") - F.max("_k")).alias("_others")).where("_others > 0")
    parts = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    here = here.join(counts.select("bucket", "_main", parts("_others", BLOCK).alias("_blocks"), parts("_all", SLICE).alias("_slices")), "bucket")
    here = cut(few(here.join(classes.select("digest", "n", "sketch"), "digest"), count), "bag-open")
    place = ("bucket", "block", "slice", "held")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    some = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "digest"), F.col(n)).cast("int")
    held = here.where("comp <> _main").withColumn("block", some("_blocks", 1)).withColumn("slice", each("_slices")).withColumn("held", F.lit(0))
    past = here.withColumn("block", each("_blocks")).withColumn("slice", some("_slices", 2)).withColumn("held", F.lit(1))

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition("bucket", "block", "slice").sortWithinPartitions(*place)

    @trimmed
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, keep, found = None, [], set()

        def put(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
            columns = [*([k] * len(rows) for k in key), [h for h, _ in rows], [d for _, d in rows]]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [*place, "digest"])

        for now, kind, rows in _groups(batches, 3):
            if now != key:
                if found:
                    yield put([(0, keep[i][0]) for i in sorted(found)])
                key, keep, found = now, [], set()
            listed = list(zip(*(rows.column(i).to_pylist() for i in (4, 5, 6, 7))))
            if kind == 0:
                keep += listed
                continue
            for s in range(0, len(listed), SLICE):
                part = listed[s : s + SLICE]
                for h in range(0, len(keep), BLOCK):
                    hit = _meets([r[1:] for r in keep[h : h + BLOCK]], [r[1:] for r in part], threshold)
                    found |= {h + int(i) for i in np.flatnonzero(hit.any(axis=1))}
                    yield put([(1, part[i][0]) for i in np.flatnonzero(hit.any(axis=0))])
        if found:
            yield put([(0, keep[i][0]) for i in sorted(found)])

    columns = [*place, "digest", "comp", "n", "sketch"]
    near = dealt(held.select(*columns).union(past.select(*columns))).mapInArrow(meet, "bucket long, block int, slice int, held int, digest binary")
    near = cut(few(near.distinct(), count), "bag-near")
    rows = near.join(here.select("digest", "comp").distinct(), "digest").join(texts, "digest")

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, _Held()
        for now, kind, rows in _groups(batches, 3):
            if now != key:
                key, block = now, _Held()
            digests, comps = (rows.column(i).to_pylist() for i in (4, 5))
            whole = [x.encode("utf-8", "surrogatepass") for x in rows.column(6).to_pylist()]
            if kind == 0:
                block.add(digests, comps, whole)
                continue
            out: set[tuple[bytes, bytes]] = set()
            for s in range(0, len(whole), 500):
                out.update(block.links(digests[s : s + 500], comps[s : s + 500], whole[s : s + 500], threshold))
            listed = sorted(out)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in listed], pa.binary()) for i in (0, 1)], ["a", "b"])

    return dealt(rows.select(*place, "digest", "comp", "text")).mapInArrow(run, "a binary, b binary").distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, digest, class_id, group_id for each row, and comp, which names the group even where ids repeat."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = cut(signed(docs), "bag-signed")
    count = rows.count()
    classes = rows.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = cut(few(classes, count), "bag-classes")
    placed = cut(classes.select("digest", F.explode("bands").alias("bucket")), "bag-buckets")
    leaders = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("_size"), F.min(F.struct(F.xxhash64("bucket", "digest").alias("h"), "digest")).alias("l")).where("_size > 1")
    shared = cut(placed.join(leaders.select("bucket", "_size", F.col("l.digest").alias("leader")), "bucket").transform(few, BANDS * count), "bag-shared")
    pairs = shared.where("digest <> leader").select(F.least("digest", "leader").alias("a"), F.greatest("digest", "leader").alias("b")).distinct()
    pairs = cut(few(likely(pairs, classes, threshold).distinct(), BANDS * count), "bag-pairs")

    # the texts of all classes that share a bucket, one row each: copies are dropped before the shuffle
    wanted = shared.select("digest").distinct()
    all_texts = docs.where(F.col("text").isNotNull()).select(F.unhex(F.md5("text")).alias("digest"), "text")
    texts = cut(few(all_texts.dropDuplicates(["digest"]).join(wanted, "digest", "left_semi"), TEXT_ROWS * count), "bag-texts")
    edges = cut(few(verified(pairs, texts, threshold).distinct(), BANDS * count), "bag-edges")
    labels = components(edges)

    # the leaders were compared with all in their buckets
    open_ = shared.where("_size > 2 AND digest <> leader").select("bucket", "digest")
    more = cut(few(verified(rest(open_, labels, classes, texts, threshold, BANDS * count), texts, threshold).distinct(), BANDS * count), "bag-edges")
    if more.limit(1).count():
        labels = components(edges.union(more))

    ids = classes.join(labels, classes["digest"] == labels["v"], "left").select("digest", "class_id", F.coalesce("label", "digest").alias("comp"))
    least = ids.groupBy("comp").agg(F.min("class_id").alias("group_id"))
    ids = ids.join(least, "comp").select("digest", "class_id", "group_id", "comp")
    out = rows.select("doc_id", "digest").join(ids, "digest")
    none = docs.where(F.col("text").isNull()).select("doc_id", F.lit(None).cast("binary").alias("digest"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("group_id"), F.lit(None).cast("binary").alias("comp"))
    return out.select("doc_id", "digest", "class_id", "group_id", "comp").unionByName(none)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the document with the least doc_id stays, of repeated rows one.

    Rows with a null text all stay.
    """
    found = groups(docs, threshold=threshold)
    first = found.where("comp IS NOT NULL").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("f")).select(F.col("f.doc_id").alias("_id"), F.col("f.digest").alias("_digest"))
    marked = docs.select(F.col("doc_id").alias("_id"), F.unhex(F.md5("text")).alias("_digest"), packed(docs).alias("row")).where("_digest IS NOT NULL")
    stay = marked.join(first, marked["_id"].eqNullSafe(first["_id"]) & (marked["_digest"] == first["_digest"]), "left_semi").dropDuplicates(["_id", "_digest"])
    return stay.select("row.*").unionByName(docs.where(F.col("text").isNull()))


def op4_bag_minhash(spark, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "group_id")
