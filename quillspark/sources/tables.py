"""Scans of the supported inputs, each with a fixed schema, and artefacts on disk."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import strings
from . import files, quoted

PAPER = "id string, title string, abstract string, publication_year int, authors array<string>, related_topics array<string>, citation_count int, reference_count int, references array<string>"
LIKED = "array<struct<paperId: string, title: string, abstract: string, fieldsOfStudy: array<string>>>"


def papers_csv(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, title, abstract) of CSV files with a header; other columns are dropped, nulls become empty. Large files are read by many tasks."""
    return quoted.read_csv(spark, path, ["paperId", "title", "abstract"]).select(F.col("paperId").alias("doc_id"), "title", "abstract").na.fill("")


def categorised_csv(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, title, abstract, category): the first of the listed terms is the category; one row for each title, then for each abstract, the first of
    them; ids number the rows from 0, file after file, whatever number of tasks reads them."""
    rows = quoted.read_csv(spark, path, ["titles", "abstracts", "terms"])
    # a row for each block gives the number of records in the blocks before it
    size = rows.groupBy("file", "start").agg(F.count("*").alias("n"))
    before = size.select("file", "start", (F.sum("n").over(Window.orderBy("file", "start")) - F.col("n")).alias("before"))
    rows = rows.join(before, ["file", "start"]).select((F.col("before") + F.col("nth")).alias("at"), F.col("titles").alias("title"), F.col("abstracts").alias("abstract"), strings.first_of_list_literal(F.col("terms")).alias("category"))
    for c in ("title", "abstract"):
        rows = rows.withColumn("r", F.row_number().over(Window.partitionBy(c).orderBy("at"))).where("r = 1").drop("r")
    return rows.select(F.col("at").cast("string").alias("doc_id"), "title", "abstract", "category")


def crawled_json(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Papers of several JSON arrays; of records with one id the one of the last file stays, and its last there."""
    parts = [spark.read.schema(PAPER).option("multiLine", True).json(p).withColumns({"file": F.lit(i), "at": F.monotonically_increasing_id()}) for i, p in enumerate(paths)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    last = Window.partitionBy("id").orderBy(F.desc("file"), F.desc("at"))
    return rows.withColumn("r", F.row_number().over(last)).where("r = 1").drop("r", "file", "at")


def judgements_json(spark: SparkSession, path: str) -> DataFrame:
    """(query, rank, doc_id) of a JSON object from query to ranked ids."""
    lists = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("query", "ids"))
    return lists.select("query", F.posexplode("ids").alias("rank", "doc_id")).withColumn("rank", F.col("rank") + 1)


def recommendations_json(spark: SparkSession, path: str) -> DataFrame:
    """(user, positive_papers, recommendedPapers): users numbered in order; null lists become empty."""
    rows = spark.read.schema(f"positive_papers {LIKED}, recommendedPapers {LIKED}").option("multiLine", True).json(path)
    empty = F.array().cast(LIKED)
    return rows.select(F.monotonically_increasing_id().alias("user"), *(F.coalesce(c, empty).alias(c) for c in ("positive_papers", "recommendedPapers")))


def matrix_npy(spark: SparkSession, path: str) -> DataFrame:
    """(vec_id, embedding) of a NumPy matrix, rows numbered from 0, read by row ranges in many tasks."""
    return files.read_matrix(spark, path)


def sample(df: DataFrame, n: int, id_col: str = "doc_id") -> DataFrame:
    """At most n rows without replacement, the same ones each time: those with the smallest hashes of their ids."""
    return df.orderBy(F.xxhash64(id_col), id_col).limit(n)


def bernoulli(df: DataFrame, share: float = 0.5, seed: int = 0) -> DataFrame:
    return df.sample(share, seed)


def unseen(candidates: DataFrame, stored: DataFrame, id_col: str = "id") -> DataFrame:
    """Candidates that are not stored yet: the read-through step of a crawl."""
    return candidates.join(stored.select(id_col), id_col, "left_anti")


def artefact(spark: SparkSession, folder: str, name: str, parameters: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that is built once for each set of parameters and read from its folder after that."""
    key = hashlib.sha256(json.dumps(parameters, sort_keys=True).encode()).hexdigest()[:16]
    path = f"{folder.rstrip('/')}/{name}-{key}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(jpath):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
