"""Line dedup by content-defined chunks of lines and by repeated runs of lines.

A text is cut at ``\\n`` into lines. A rolling hash over the hashes of the last WINDOW lines ends a chunk after a line when
it falls to 0 of DIVISOR parts, so the same passage is cut at the same places whatever stands before it. Chunks of at
least MIN_LINES lines and MIN_WORDS words count, and single lines from LONG_WORDS words.

The first and the last boundary in a passage depend on what stands around it, so chunks alone leave its edges, and short
passages, in place. Runs of lines count as well, wherever they begin: from each line with words the shortest run of
enough lines and words (the same limits, over lines with words) that starts there, and the shortest that ends there. Any
run of enough lines and words from a line with words to another is covered by such runs inside it.

A chunk or run that other places have too is removed everywhere but at its first place (by doc_id, then position), which is
found by SHA-256 of its bytes. A run that overlaps its first place loses only the lines after it. Everything is
DataFrame functions.

Nulls: a null text stays null; null ids sort first. Empty texts stay as they are. Rows with equal id and text are one
document: they don't make each other's chunks repeated, and get the same result. Empty tables give no rows. A very long
text costs its length. Columns of any names pass through, with ``counts`` any but
removed_chunks and removed_lines. A text can end up empty; no row is dropped. Lines without a word at a run's edges stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WORD, cut, packed, table

#: Lines whose hashes decide about a boundary.
WINDOW = 2
#: One line in so many ends a chunk, on average.
DIVISOR = 2
MIN_LINES, MIN_WORDS, LONG_WORDS = 2, 10, 50


def _ends(window: int, divisor: int):
    """1-based number of the last line of each chunk, from the line hashes in _h. Linear in the lines."""
    roll = lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.shiftrightunsigned(a, 63)).bitwiseXOR(x)
    rolled = lambda i: F.aggregate(F.slice("_h", F.greatest(i - (window - 1), F.lit(1)), F.least(i, F.lit(window))), F.lit(0).cast("long"), roll)
    n = F.size("_h")
    return F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.pmod(F.xxhash64(rolled(i)), F.lit(divisor)) == 0))


def chunked(docs: DataFrame, text_col: str = "text", window: int = WINDOW, divisor: int = DIVISOR) -> DataFrame:
    """Adds _lines, _h and _ends; chunk j is the lines after _ends[j - 1] up to _ends[j]."""
    return _with_chunks(docs.where(F.col(text_col).isNotNull()), text_col, window, divisor)


def _with_chunks(docs: DataFrame, text_col: str, window: int = WINDOW, divisor: int = DIVISOR) -> DataFrame:
    out = docs.withColumn("_lines", F.split(F.col(text_col), "\n", -1))
    out = out.withColumn("_h", F.transform("_lines", lambda x: F.xxhash64(x)))
    return out.withColumn("_ends", _ends(window, divisor))


def _start(j):
    return F.when(j == 0, F.lit(1)).otherwise(F.get("_ends", j - 1) + 1)


def _enough(lines, words):
    return ((lines >= MIN_LINES) & (words >= MIN_WORDS)) | (words >= LONG_WORDS)


def _shortest(array: str, i):
    """How many items from 0-based i on are enough together, and the words of these; null if all aren't."""
    start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("n"))
    done = lambda a: _enough(a["n"], a["words"])
    add = lambda a, x: F.when(done(a), a).otherwise(F.struct((a["words"] + F.least(x, F.lit(LONG_WORDS))).alias("words"), (a["n"] + 1).alias("n")))
    reach = lambda most: F.aggregate(F.slice(array, i + 1, most), start, add, lambda a: F.when(done(a), a))
    # each item has a word, so so many are enough; mostly two are
    return F.coalesce(reach(MIN_LINES), reach(max(MIN_LINES, MIN_WORDS)))


def _runs():
    """Spans of lines, from _w (words of each line that has any), _r (_w backwards) and _at (these lines' numbers)."""
    span = lambda a, z: F.struct(F.get("_at", a).alias("start"), F.get("_at", z).alias("end"))
    forward = F.transform(F.transform("_w", lambda x, i: F.struct(i.alias("i"), _shortest("_w", i)["n"].alias("n"))), lambda r: F.when(r["n"].isNotNull(), span(r["i"], r["i"] + r["n"] - 1)))
    last = lambda i: F.size("_w") - 1 - i
    back = F.transform("_r", lambda x, i: F.struct(i.alias("i"), F.least(x, F.lit(LONG_WORDS)).alias("own"), _shortest("_r", i).alias("s")))
    # without its last line still enough, so not the shortest from its start; else it is a forward run
    back = F.transform(back, lambda r: F.when(_enough(r["s"]["n"] - 1, r["s"]["words"] - r["own"]), span(last(r["i"] + r["s"]["n"] - 1), last(r["i"]))))
    return F.filter(F.concat(forward, back), lambda x: x.isNotNull())


def references(docs: DataFrame, **how) -> DataFrame:
    """A narrow row for each chunk and run of each document: _key, chunk (or run), start, end, hash."""
    out = chunked(docs, **how).withColumn("_n", F.transform("_lines", lambda x: F.regexp_count(x, F.lit(WORD))))
    out = out.withColumns({"_w": F.filter("_n", lambda x: x > 0), "_at": F.filter(F.transform("_n", lambda x, i: F.when(x > 0, i + 1)), lambda x: x.isNotNull())})
    out = out.withColumn("_r", F.reverse("_w"))
    chunks = F.transform("_ends", lambda end, j: F.struct(_start(j).alias("start"), end.alias("end")))
    words = lambda c: F.aggregate(F.slice("_n", c["start"], c["end"] - c["start"] + 1), F.lit(0), lambda a, x: F.least(a + x, F.lit(LONG_WORDS)))
    chunks = F.filter(chunks, lambda c: _enough(c["end"] - c["start"] + 1, words(c)))
    row = lambda kind: lambda c: F.struct(F.lit(kind).alias("chunk"), c["start"].alias("start"), c["end"].alias("end"), F.xxhash64(F.lit(kind), F.slice("_h", c["start"], c["end"] - c["start"] + 1)).alias("hash"))
    return out.select("_key", F.explode(F.concat(F.transform(chunks, row(True)), F.transform(_runs(), row(False)))).alias("_c")).select("_key", "_c.*")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = True, **how) -> DataFrame:
    """The rows of ``docs`` with repeated chunks and runs taken from the text, and with ``counts`` also removed_chunks,
    removed_lines (long; all lines that went, by a chunk or a run).

    Shuffles: narrow chunk and run rows by hash, and the documents by row key to bring them their repeated ones. No row
    holds more than one document; a hash that a third of all documents share is one row after partial aggregates, and AQE
    splits the join that brings it back.
    """
    # the rows pass through in one column, so that their columns' names meet no others
    base = docs.select(F.xxhash64(F.lit(17), F.col(id_col), F.col(text_col)).alias("_key"), packed(docs).alias("row"))
    named = docs.select(F.xxhash64(F.lit(17), F.col(id_col), F.col(text_col)).alias("_key"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    refs = cut(references(named, **how), "line-refs")
    # equal rows have equal keys and positions
    again = refs.groupBy("hash").agg(*(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("_key", "start")))
    again = again.where("min__key <> max__key OR min_start <> max_start").select("hash")
    suspects = cut(refs.join(again, "hash").groupBy("_key").agg(F.collect_set(F.struct("chunk", "start", "end")).alias("_hits")), "line-hits")

    found = named.join(suspects, "_key").withColumn("_lines", F.split("text", "\n", -1))
    digest = lambda h: F.unhex(F.sha2(F.concat(F.when(h["chunk"], "c").otherwise("r"), F.array_join(F.slice("_lines", h["start"], h["end"] - h["start"] + 1), "\n")), 256))
    parts = found.select("doc_id", "_key", F.explode(F.transform("_hits", lambda h: F.struct(h["chunk"].alias("chunk"), h["start"].alias("start"), h["end"].alias("end"), digest(h).alias("digest")))).alias("_c"))
    parts = cut(parts.select("_key", F.struct("doc_id", "_key", "_c.start", "_c.end").alias("place"), "_c.*"), "line-parts")
    gone = parts.join(parts.groupBy("digest").agg(F.min("place").alias("first")), "digest").where(~F.col("place").eqNullSafe(F.col("first")))
    after = F.when(F.col("first._key") == F.col("_key"), F.greatest("start", F.col("first.end") + 1)).otherwise(F.col("start"))
    gone = gone.select("_key", "chunk", after.alias("start"), "end").where("start <= end")
    gone = gone.groupBy("_key").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_gone"), F.count_distinct(F.when(F.col("chunk"), F.col("start"))).alias("removed_chunks"))

    # only documents that lose something are cut again; the others have null here and keep their text
    own = F.col("row").getField(text_col)
    out = base.join(gone, "_key", "left").withColumn("_l", F.split(F.when(F.col("_gone").isNotNull(), own), "\n", -1))
    # spans in order of their starts: what the one before has already is left out
    rest = lambda x, i: F.greatest(x["start"], F.coalesce(F.get("_gone", i - 1)["end"] + 1, F.lit(1)))
    numbers = F.flatten(F.transform("_gone", lambda x, i: F.when(rest(x, i) <= x["end"], F.sequence(rest(x, i), x["end"])).otherwise(F.array().cast("array<int>"))))
    out = out.withColumn("_stay", F.array_except(F.sequence(F.lit(1), F.size("_l")), numbers))
    text = F.array_join(F.transform("_stay", lambda i: F.get("_l", i - 1)), "\n")
    cols = [F.coalesce(text, own).alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns]
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    more = [count(F.col("removed_chunks")).alias("removed_chunks"), count(F.size("_l") - F.size("_stay")).alias("removed_lines")]
    return out.select(*cols, *(more if counts else ()))


def op9_line_chunks(spark, sf_dir: str) -> DataFrame:
    """doc_id, the text that is left, and what was removed."""
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
