"""From raw documents to token ids: toxicity, line dedup, near-dedup, mixing, byte-level BPE.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers as vocab
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bagminhash, bpe_tree, fuzzy_lines, mixing, toxicity
from quillspark.llm.common import Scratch, sized, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go; all others stay as they are.

    A null text counts as empty and stays null. Rows are judged one by one, so repeated rows and ids, ties and very long texts need no rule; without labels nothing
    goes. An empty table stays empty; other columns pass through.
    """
    marked = toxicity.toxicity(docs, table(spark, sf_dir, "labels"), keep_text=True)
    return marked.where(~F.col("is_toxic")).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of alike lines one stays; a document goes only if it had lines and lost them all.

    Null texts become empty and stay. Rows that share an id are told apart by their texts, and of those that are alike in both one keeps its lines; a row
    without an id loses only its own repeats. n_chars follows the text, if the table has that column. An empty table stays empty; other columns pass through.
    """
    clean = fuzzy_lines.dedup_lines(docs, short_lines=True).where("n_kept > 0 or n_lines = 0")
    changed = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast(docs.schema["n_chars"].dataType if "n_chars" in docs.columns else "long")}
    return clean.select(*(changed.get(c, F.col(c)).alias(c) for c in docs.columns))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates one row stays, one of those with the smallest id.

    Each row goes with its own text, whatever rows share its id; rows without an id stay, and so does one text without words of each id. An empty table stays empty;
    other columns pass through.
    """
    scratch = Scratch(spark, "near-dedup")
    key = F.xxhash64(*("`" + c.replace("`", "``") + "`" for c in docs.columns))  # a row among those of its id
    classes = scratch.keep(bagminhash.near_duplicates(docs, tag=key).select("doc_id", "tag", "kept"), "classes")
    alike = classes.groupBy("doc_id", "tag").agg(F.count("*").alias("n"), F.max("kept").alias("kept"))
    gone = scratch.keep(alike.where("not kept and doc_id is not null").select("doc_id", "tag"), "gone")
    left = docs.withColumn("__tag", key).join(sized(gone.select(F.col("doc_id").alias("__id"), F.col("tag").alias("__of"))), (F.col("doc_id") == F.col("__id")) & (F.col("__tag") == F.col("__of")), "left_anti")
    twice = scratch.keep(alike.where("n > 1 and kept and doc_id is not null").select(F.col("doc_id").alias("__id"), F.col("tag").alias("__of")), "twice")
    if twice.isEmpty():
        return left.select(*docs.columns)
    # rows that are alike in every column: one of them
    on = (F.col("doc_id") == F.col("__id")) & (F.col("__tag") == F.col("__of"))
    one = left.join(sized(twice), on, "left_semi").groupBy("doc_id", "__tag").agg(*(F.first(c).alias(c) for c in docs.columns if c != "doc_id"))
    return left.join(sized(twice), on, "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; documents of small sources up to twice, by temperature.

    A null source is a source, a null or blank text takes no budget, and a row without an id has its place by a hash of its columns. Rows that share a source and an id are used
    alike. An empty table stays empty; other columns pass through.
    """
    return mixing.mix(docs, repetition=2.0).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of what they decode to.

    Null counts as the empty text, which has no ids. Rows are independent; an empty table stays empty.
    """
    rows = docs.select("doc_id", "lang", "source", "text")
    return bpe_tree.bpe_round_trip(rows, vocab.path("byte_bpe_multi_50k.tiktoken"), vocab.PATTERN, keep_ids=True)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("near_dedup", dedup_documents), ("mixing", mix_sources), ("bpe", encode)]

#: The first stages cannot be put into SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
