"""A corpus pipeline: language ID, line dedup, near-dedup, mixing to target weights, BPE.

Each stage takes (spark, docs, sf_dir) and returns all its predecessor kept, changed by its operator's decisions. All
but the last return the columns of their input, whatever their names; texts that change get their new n_chars.

Null texts and texts without a letter go in the first stage, so the later ones see neither. A null doc_id, lang or source
is a value like any other; of documents with equal doc_id and text one stays. A text that line dedup empties stays as an empty
one until mixing, which takes no words from it. Ties are settled by the least doc_id. Very long texts cost their length;
empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import bag_minhash, bigru_lang, bpe_trie, line_chunks, mixing
from maskwright.llm.shared import cut, table

#: The stages have hashes, models and draws of their own; SQL can't express them.
ORACLE_SQL = None


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language that is clear enough, go."""
    return bigru_lang.accepted(docs, bigru_lang.train(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go from the texts; no document goes."""
    return _recounted(line_chunks.dedup(docs, counts=False))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return bag_minhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's words: up to three rows for a document of a source that is repeated, part of the documents of others."""
    return _recounted(mixing.Mix(docs).documents(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row's text, and whether they decode to it."""
    named = docs.select(F.struct("doc_id", "lang", "source", F.md5("text").alias("md5")).alias("row"), "text")
    out = bpe_trie.encode(named, id_col="row", decoded=True)
    return out.select("doc_id.doc_id", "doc_id.lang", "doc_id.source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.md5("decoded") == F.col("doc_id.md5")).alias("exact"))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
