"""Spelling correction by shared bigrams and edit distance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strings


def bigram_index(words: DataFrame) -> DataFrame:
    """(bigram, word, cnt, n_chars) of the distinct values of a column `word` of surface forms."""
    grams = words.select("word").distinct().select("word", F.explode(strings.word_bigrams(F.col("word"))).alias("bigram"))
    return grams.groupBy("bigram", "word").agg(F.count("*").alias("cnt")).withColumn("n_chars", F.length("word").cast("long"))


def candidates(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, word, jaccard) of all words that share a bigram with a query word (column `query`)."""
    q = queries.select("query", F.explode(strings.word_bigrams(F.col("query"))).alias("bigram"))
    # the query's bigrams go to the index's tasks, the index itself is read once
    shared = index.join(F.broadcast(q), "bigram").groupBy("query", "word").agg(F.sum("cnt").alias("occ"), F.first("n_chars").alias("n_chars"))
    score = strings.multiset_jaccard(F.col("occ"), F.length("query").cast("long") + 1, F.col("n_chars") + 1)
    return shared.select("query", "word", F.col("occ").alias("occ"), score.alias("jaccard"))


def correct(index: DataFrame, queries: DataFrame, similar_words_limit: int = 20) -> DataFrame:
    """(query, corrected, distance): of the `similar_words_limit` words with the highest overlap the one nearest by edit distance; ties to the higher
    overlap, then alphabetical. A query without candidates is its own correction."""
    best = Window.partitionBy("query").orderBy(F.desc(F.round("jaccard", 9)), "word")
    top = candidates(index, queries).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= similar_words_limit)
    near = Window.partitionBy("query").orderBy(F.levenshtein("query", "word"), "rank")
    chosen = top.withColumn("r", F.row_number().over(near)).where("r = 1").select("query", F.col("word").alias("corrected"), F.levenshtein("query", "word").cast("long").alias("distance"))
    return queries.select("query").distinct().join(chosen, "query", "left").select("query", F.coalesce("corrected", "query").alias("corrected"), F.coalesce("distance", F.lit(0)).alias("distance"))


def correct_queries(index: DataFrame, queries: DataFrame, similar_words_limit: int = 20) -> DataFrame:
    """(query_id, query) with each word of each query replaced by its correction in place; a whole batch in one plan."""
    pieces = F.regexp_extract_all("query", F.lit(rf"{strings.TERM}|[^\p{{L}}\p{{N}}]+"), F.lit(0))
    rows = queries.select("query_id", F.posexplode(pieces).alias("at", "piece"))
    words = rows.where(F.rlike("piece", F.lit(strings.TERM))).select(F.col("piece").alias("query")).distinct()
    fixed = correct(index, words, similar_words_limit).select(F.col("query").alias("piece"), "corrected")
    back = rows.join(fixed, "piece", "left").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("corrected", "piece").alias("piece")))).alias("p"))
    return back.select("query_id", F.array_join("p.piece", "").alias("query"))


def correct_text(index: DataFrame, spark, text: str, similar_words_limit: int = 20) -> str:
    """A query text, each word replaced by its correction in place. The text is one request's, so its words meet on the driver."""
    import re

    words = re.findall(r"[^\W_]+", text)
    if not words:
        return text
    rows = correct(index, spark.createDataFrame([(w,) for w in dict.fromkeys(words)], "query string"), similar_words_limit).collect()
    fixed = {r["query"]: r["corrected"] for r in rows}
    return re.sub(r"[^\W_]+", lambda m: fixed.get(m[0], m[0]), text)
