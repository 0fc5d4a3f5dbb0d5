"""Mixing sources to target weights, block by block.

Each source's words, its documents one after the other, are packed into blocks of BLOCK_WORDS words. Output shards draw
multinomial counts of each source's slots, given what the targets still leave; slot t of a source is block
perm(t mod blocks) in a pseudorandom permutation of the source's blocks, one for each pass over them. Slots and the
documents' pieces of blocks are joined by (source, block).

Targets: sources in order of their code points, null last, weigh 1, 2, 3 and so on, and share the words of all; a target
above MOST_REPEATS times its source's size stops there, and the rest is shared by weight until none is above. So a
block, and with it a document, is taken MOST_REPEATS times at most.

Nulls: null texts have no words; a null source is a source. Empty documents are taken 0 times. Repeated rows are
documents each. A very long text is many blocks. Other columns, of any name, play no part and pass through
``documents``. Empty tables give no rows. Reruns agree: all draws follow from SEED, the sizes and the ids.

The driver sees one row for each source (words and blocks), never one for each document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import WORD, cut, packed, runs, table, trimmed

BLOCK_WORDS = 128
WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
OUTPUT_SHARDS = 64
#: Parts of each source in which positions are summed; a source with a third of all rows is so many tasks' work.
PARTS = 1024
SEED = 20_240_601
#: Rounds of the swap-or-not permutation.
ROUNDS = 24
_WORD = re.compile(WORD)
#: Slots that one row stands for before the last explode.
RUN = 4096


def targets(sizes: list[int], weights: list[float], most: float = MOST_REPEATS) -> list[float]:
    """Shares of all sizes by weight, none above ``most`` times its own size, the excess shared again by weight."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    open_, left = set(range(len(sizes))), total
    while open_:
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / w > most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


def slot_counts(wanted: list[int], shards: int = OUTPUT_SHARDS, seed: int = SEED) -> np.ndarray:
    """Slots of each source in each output shard: multinomial draws by what is still wanted, so that the sums are ``wanted``."""
    rng, left = np.random.default_rng(seed), np.array(wanted, np.int64)
    out = np.zeros((shards, len(wanted)), np.int64)
    for j in range(shards):
        total = int(left.sum())
        n = total // (shards - j)
        if j == shards - 1:
            draw = left.copy()
        else:
            draw = np.minimum(rng.multinomial(n, left / total), left) if n else np.zeros_like(left)
            # a source drawn beyond what it has left gives the difference to those that have most
            for i in np.argsort(-(left - draw), kind="stable"):
                missing = n - int(draw.sum())
                if not missing:
                    break
                draw[i] += min(missing, int(left[i] - draw[i]))
        out[j], left = draw, left - draw
    return out


def permuted(x: Column, n: Column, *salt: Column) -> Column:
    """Swap-or-not: a pseudorandom permutation of 0 to n - 1 for any n, different for each salt."""

    def step(at, r):
        key = F.pmod(F.xxhash64(F.lit(SEED), r, *salt), n)
        other = F.pmod(key - at, n)
        high = F.greatest(at, other)
        return F.when(F.xxhash64(F.lit(SEED + 1), r, high, *salt).bitwiseAND(F.lit(1)) == 1, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, step)


class Mix:
    """A mix of the documents; ``docs`` needs the named columns and may have others."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, shards: int = OUTPUT_SHARDS):
        self.block = block_words
        spark = docs.sparkSession
        sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("_text"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
        sized = sized.withColumn("_part", F.pmod(F.xxhash64("doc_id", "_text"), F.lit(PARTS)))
        # the last pass over the texts; all below reads narrow rows
        sized = cut(sized, "mix-sizes")
        totals = sized.groupBy("source", "_part").agg(F.sum("size").alias("_words"))
        sources = totals.groupBy("source").agg(F.sum("_words").alias("size")).collect()
        sources.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
        sizes = [r["size"] for r in sources]
        self.targets = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))])
        blocks = [-(-s // block_words) for s in sizes]
        wanted = [min(MOST_REPEATS * b, round(t / s * b)) if s else 0 for s, t, b in zip(sizes, self.targets, blocks)]
        counts = slot_counts(wanted, shards)
        firsts = np.cumsum(counts, axis=0) - counts

        names = [r["source"] for r in sources]
        self.sources = spark.createDataFrame([(n, i, s, t) for i, (n, s, t) in enumerate(zip(names, sizes, self.targets))], "_source string, _s int, source_size long, target double")
        runs = spark.createDataFrame([(i, j, int(firsts[j, i]), int(counts[j, i]), blocks[i]) for i in range(len(names)) for j in range(shards) if counts[j, i]], "_s int, shard int, first long, n long, blocks long")

        # positions in the source: sums over parts, then within the part
        before = F.coalesce(F.sum("_words").over(W.partitionBy("source").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        parts = totals.withColumn("_before", before).select(F.col("source").alias("_psource"), F.col("_part").alias("_ppart"), "_before")
        in_part = W.partitionBy("source", "_part").orderBy("doc_id", "_text")
        placed = sized.withColumn("_end", F.sum("size").over(in_part.rowsBetween(W.unboundedPreceding, 0))).withColumn("_row", F.row_number().over(in_part))
        placed = placed.join(parts, F.col("source").eqNullSafe(F.col("_psource")) & (F.col("_part") == F.col("_ppart")))
        placed = placed.join(self.sources, F.col("source").eqNullSafe(F.col("_source")))
        self.placed = placed.select("doc_id", "source", "_text", "_s", "_part", "_row", "size", "source_size", "target", (F.col("_before") + F.col("_end") - F.col("size")).alias("_start"))

        start, end, b = F.col("_start"), F.col("_start") + F.col("size"), F.lit(block_words)
        block = F.col("block")
        pieces = self.placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(start / b), F.floor((end - 1) / b))))
        lo, hi = F.greatest(start, block * b), F.least(end, (block + 1) * b)
        #: A row for each part of a block that comes from one document: first_word (0-based, in the document) and n_words.
        self.pieces = pieces.select("doc_id", "_text", "_s", "_part", "_row", "block", (lo - start).alias("first_word"), (hi - lo).alias("n_words"))

        chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN)))
        spread = max(shards, sum(wanted) // 1_000_000)
        slots = runs.withColumn("_k", chunk).repartition(spread, "_s", "shard", "_k")
        lo = F.col("first") + F.col("_k") * RUN
        hi = F.least(F.col("first") + F.col("n"), lo + RUN) - 1
        slots = slots.withColumn("slot", F.explode(F.sequence(lo, hi))).withColumn("pass", F.floor(F.col("slot") / F.col("blocks")))
        #: A row for each output slot: shard, slot (of its source), pass, block.
        self.slots = slots.select("shard", "_s", "slot", "pass", permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.col("_s"), F.col("pass")).alias("block"))

    def output(self) -> DataFrame:
        """The mix: a row for each piece of each slot, with shard, slot, pass, doc_id, first_word, n_words.

        Slots grow with the words, though the planner takes them for as small as the rows they are made from: hence the hint.
        """
        return self.slots.hint("merge").join(self.pieces, ["_s", "block"])

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken for each document, with the words its pieces give to the mix."""
        # how often a block was drawn is one row for each block before it meets the pieces
        times = self.slots.groupBy("_s", "block").agg(F.count(F.lit(1)).alias("_times"))
        used = self.pieces.join(times.hint("merge"), ["_s", "block"]).groupBy("_s", "_part", "_row").agg(F.sum(F.col("n_words") * F.col("_times")).alias("taken"))
        out = self.placed.join(used, ["_s", "_part", "_row"], "left")
        return out.select("doc_id", "source", "_text", "_part", "_row", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


    def documents(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The mix as rows of ``docs``: for each pass that takes words of a document, a row with the text of these words.

        A pass that takes all words has the whole text as it is; else the text has each run of taken words as it stands
        in the document, with a line feed between runs. Documents without a taken word have no row.
        """
        piece = F.struct("pass", "first_word", "n_words")
        taken = self.output().groupBy("doc_id", "_text", "_part", "_row").agg(F.collect_list(piece).alias("_pieces")).select(F.col("doc_id").alias("_id"), F.col("_text").alias("_hash"), "_pieces")
        marked = docs.select(F.col(id_col).alias("_row_id"), F.xxhash64(text_col).alias("_row_hash"), packed(docs).alias("row"))
        if self.placed.groupBy("doc_id", "_text").count().where("count > 1").limit(1).count():
            marked = marked.dropDuplicates(["_row_id", "_row_hash"])  # each of the equal rows has pieces of its own
        both = marked.join(taken, F.col("_row_id").eqNullSafe(F.col("_id")) & (F.col("_row_hash") == F.col("_hash")))
        at, names = docs.columns.index(text_col), docs.columns

        @trimmed
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (b.slice(start, end - start) for b in batches for start, end in runs(b.column(at), 4_000_000)):
                rows, texts = [], []
                for i, (text, pieces) in enumerate(zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist())):
                    passes: dict[int, list[tuple[int, int]]] = {}
                    for p in pieces:
                        passes.setdefault(p["pass"], []).append((p["first_word"], p["first_word"] + p["n_words"]))
                    spans = None
                    for number in sorted(passes):
                        taken_words = merged(passes[number])
                        if spans is None:
                            spans = [m.span() for m in _WORD.finditer(text)]
                        whole = taken_words == [(0, len(spans))]
                        rows.append(i)
                        texts.append(text if whole else "\n".join(text[spans[a][0] : spans[z - 1][1]] for a, z in taken_words))
                pick = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else b.column(k).take(pick) for k in range(len(names))], names)

        return both.select(*(F.col("row").getField(c).alias(f"c{k}") for k, c in enumerate(names)), "_pieces").mapInArrow(run, docs.schema)


def merged(pieces: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Adjacent half-open ranges put together, in order."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(pieces):
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], z)
        else:
            out.append((a, z))
    return out


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return Mix(table(spark, sf_dir, "documents")).taken().select("doc_id", "size", "source_size", "target", "taken")
