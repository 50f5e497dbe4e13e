"""Descriptions of a corpus: by category, of lengths, histograms, word clouds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def describe_by(docs: DataFrame, category: str, value: str) -> DataFrame:
    """(category, count, unique, top, freq) of a text column; ties of the most frequent value go to the smaller one. Values are counted first, so a
    category's rows never meet in one task."""
    counts = docs.groupBy(F.col(category).alias("category"), F.col(value).alias("value")).agg(F.count("*").alias("n"))
    best = counts.groupBy("category").agg(F.sum("n").alias("count"), F.count("*").alias("unique"), F.max("n").alias("freq"))
    top = counts.join(best.select("category", F.col("freq").alias("n")), ["category", "n"]).groupBy("category").agg(F.min("value").alias("top"))
    return best.join(top, "category").select("category", "count", "unique", "top", "freq")


def describe_numbers(df: DataFrame, column: str) -> DataFrame:
    """One row: count, mean, std (of a sample), min, quartiles (exact, interpolated), max."""
    c = F.col(column).cast("double")
    return df.agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), *(F.percentile(c, F.lit(q)).alias(f"p{round(q * 100)}") for q in (0.25, 0.5, 0.75)), F.max(c).alias("max"))


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin, n, density): equal bins from the smallest to the largest value, the last one closed."""
    c = F.col(column).cast("double")
    ends = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count(c).alias("all"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide(c - F.col("lo"), width), F.lit(0.0)))).cast("long")
    rows = df.where(c.isNotNull()).join(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.first("all").alias("all"), F.first(width).alias("width"))
    return rows.select("bin", "n", F.try_divide(F.col("n"), F.col("all") * F.col("width")).alias("density"))


def word_cloud(tokens_: DataFrame, categories: DataFrame, n: int = 100) -> DataFrame:
    """(category, term, n): the n most frequent terms of each category of categories (doc_id, category), and overall (category null), from one rollup."""
    counts = tokens_.join(categories, "doc_id").rollup("term", "category").agg(F.count("*").alias("n"), F.grouping_id().alias("g")).where("g < 3")
    order = Window.partitionBy("category").orderBy(F.desc("n"), "term")
    return counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).select("category", "term", "n")
