"""Retrieval and classification metrics, all queries or classes in one plan."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def judged(runs: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, rank, doc_id, gain, n_actual, n_predicted) of runs (query_id, rank, doc_id) against qrels (query_id, rank, doc_id). Gains
    count from the end of the judged list; documents that are not judged have 0. Queries need a judgement and a prediction."""
    size = qrels.groupBy("query_id").agg(F.count("*").alias("n_actual"))
    gain = qrels.join(size, "query_id").select("query_id", "doc_id", "n_actual", (F.col("n_actual") - F.col("rank") + 1).alias("gain"))
    n = runs.groupBy("query_id").agg(F.count("*").alias("n_predicted"))
    rows = runs.join(size, "query_id").join(n, "query_id").join(gain.select("query_id", "doc_id", "gain"), ["query_id", "doc_id"], "left")
    return rows.select("query_id", "rank", "doc_id", F.coalesce("gain", F.lit(0)).alias("gain"), "n_actual", "n_predicted")


def retrieval_by_query(runs: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, precision, recall, f1, map, ndcg, mrr, ndcg_at_k). A query without a hit scores 0 everywhere."""
    rows = judged(runs, qrels)
    by_rank = Window.partitionBy("query_id").orderBy("rank")
    by_gain = Window.partitionBy("query_id").orderBy(F.desc("gain"), "rank")
    hit = (F.col("gain") > 0).cast("int")
    rows = rows.withColumns({"hits": F.sum(hit).over(by_rank.rowsBetween(Window.unboundedPreceding, 0)), "ideal": F.row_number().over(by_gain)})
    out = rows.groupBy("query_id").agg(
        F.sum(hit).alias("n_hit"),
        F.first("n_actual").alias("n_actual"),
        F.first("n_predicted").alias("n_predicted"),
        F.sum(F.when(hit > 0, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("precisions"),
        F.sum(F.col("gain") / F.log2(F.col("rank") + 1)).alias("dcg"),
        F.sum(F.col("gain") / F.log2(F.col("ideal") + 1)).alias("best"),
        F.min(F.when(hit > 0, F.col("rank"))).alias("first_hit"),
        F.sum(F.when((hit > 0) & (F.col("rank") <= k) & (F.col("n_actual") - F.col("gain") + 1 <= k), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg_k"),
    )
    zero = F.lit(0.0)
    ideal_k = F.lit(sum(1 / math.log2(i + 2) for i in range(k)))
    precision, recall = F.try_divide("n_hit", "n_predicted"), F.try_divide("n_hit", "n_actual")
    return out.select(
        "query_id",
        precision.alias("precision"),
        recall.alias("recall"),
        F.coalesce(F.try_divide(2 * precision * recall, precision + recall), zero).alias("f1"),
        F.coalesce(F.try_divide("precisions", "n_hit"), zero).alias("map"),
        F.coalesce(F.try_divide("dcg", "best"), zero).alias("ndcg"),
        F.coalesce(1 / F.col("first_hit"), zero).alias("mrr"),
        (F.col("dcg_k") / ideal_k).alias("ndcg_at_k"),
    )


def retrieval(runs: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """One row of means over the queries."""
    names = ["precision", "recall", "f1", "map", "ndcg", "mrr", "ndcg_at_k"]
    return retrieval_by_query(runs, qrels, k).agg(*(F.avg(n).alias(n) for n in names))


def confusion(predicted: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return predicted.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def class_report(predicted: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(class, precision, recall, f1, support) of every class that occurs as label or prediction; undefined ones are 0."""
    cells = confusion(predicted, label, prediction)
    right = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
    actual = cells.groupBy(F.col("label").alias("class")).agg(F.sum("n").alias("support"), right.alias("tp"))
    guessed = cells.groupBy(F.col("prediction").alias("class")).agg(F.sum("n").alias("guessed"))
    rows = actual.join(guessed, "class", "full").na.fill(0)
    p, r = (F.coalesce(F.try_divide("tp", c), F.lit(0.0)) for c in ("guessed", "support"))
    return rows.select("class", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "support")


def summary_report(predicted: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: accuracy (which is micro precision, recall and F1) and macro means."""
    right = (F.col(label) == F.col(prediction)).cast("double")
    macro = class_report(predicted, label, prediction).agg(*(F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")))
    return predicted.agg(F.avg(right).alias("accuracy")).join(F.broadcast(macro))


#: Ranges of values into which a running total is cut.
RANGES = 200


def running(rows: DataFrame, by: str, sums: list[str]) -> DataFrame:
    """`rows` with upto_<c> for each column of `sums`: its total over all rows of at least this row's `by`. Rows are dealt out by ranges of `by`
    (values are distinct), each range is summed up alone, and one row a range is added up before it, so no task has them all."""
    ends = rows.agg(F.percentile_approx(by, [i / RANGES for i in range(1, RANGES)], 2000).alias("ends"))
    placed = rows.join(F.broadcast(ends)).withColumn("range", F.size(F.filter("ends", lambda e: e > F.col(by)))).drop("ends")
    whole = placed.groupBy("range").agg(*(F.sum(c).alias(f"in_{c}") for c in sums))
    above = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows at most
    whole = whole.select("range", *(F.coalesce(F.sum(f"in_{c}").over(above), F.lit(0)).alias(f"above_{c}") for c in sums))
    order = Window.partitionBy("range").orderBy(F.desc(by))
    out = placed.join(F.broadcast(whole), "range")
    return out.select(*rows.columns, *((F.sum(c).over(order) + F.col(f"above_{c}")).alias(f"upto_{c}") for c in sums))


def _by_threshold(scored: DataFrame, label: str, score: str) -> tuple[DataFrame, DataFrame]:
    at = scored.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"))
    return running(at, "threshold", ["pos", "neg"]), at.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))


def roc_area(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row: the area under the curve of `roc_points`, by trapezoids, from the scores themselves."""
    at, total = _by_threshold(scored, label, score)
    under = F.sum(F.col("neg") * (2 * F.col("upto_pos") - F.col("pos")) / 2)
    return at.agg(under.alias("under")).join(F.broadcast(total)).select(F.try_divide("under", F.col("P") * F.col("N")).alias("auc"))


def roc_by_class(scored: DataFrame) -> DataFrame:
    """(class, auc) of scores (doc_id, label, class, score), one row a class of each document: the area of each class against the rest, 'micro' of all rows
    pooled, and 'macro', the mean over the classes. Scores are counted first."""
    named = scored.select("class", (F.col("label") == F.col("class")).cast("int").alias("hit"), "score")
    both = named.select(F.explode(F.array("class", F.lit("micro"))).alias("class"), "hit", "score")
    at = both.groupBy("class", "score").agg(F.sum("hit").alias("pos"), F.sum(1 - F.col("hit")).alias("neg"))
    # classes are few, distinct scores may be many: a range of scores is summed up alone
    ends = at.agg(F.percentile_approx("score", [i / RANGES for i in range(1, RANGES)], 2000).alias("ends"))
    at = at.join(F.broadcast(ends)).withColumn("range", F.size(F.filter("ends", lambda e: e > F.col("score")))).drop("ends")
    whole = at.groupBy("class", "range").agg(F.sum("pos").alias("in_pos"))
    above = Window.partitionBy("class").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("class", "range", F.coalesce(F.sum("in_pos").over(above), F.lit(0)).alias("above"))
    upto = F.sum("pos").over(Window.partitionBy("class", "range").orderBy(F.desc("score"))) + F.col("above")
    rows = at.join(whole, ["class", "range"]).withColumn("upto", upto)
    area = rows.groupBy("class").agg(F.try_divide(F.sum(F.col("neg") * (2 * F.col("upto") - F.col("pos")) / 2), F.sum("pos") * F.sum("neg")).alias("auc"))
    macro = area.where("class <> 'micro'").agg(F.avg("auc").alias("auc")).select(F.lit("macro").alias("class"), "auc")
    return area.unionByName(macro)


def roc_points(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(threshold, fpr, tpr) at each distinct score, highest first. Scores are counted first, so the ordered pass is over distinct values."""
    at, total = _by_threshold(scored, label, score)
    return at.join(F.broadcast(total)).select("threshold", F.try_divide("upto_neg", "N").alias("fpr"), F.try_divide("upto_pos", "P").alias("tpr"))


def auc(points: DataFrame) -> DataFrame:
    """One row: the area under (fpr, tpr) points by trapezoids, from the origin on. For curves of few points; `roc_area` works on scores."""
    order = Window.orderBy("fpr", "tpr")
    steps = points.select("fpr", "tpr", F.lag("fpr", 1, 0.0).over(order).alias("f0"), F.lag("tpr", 1, 0.0).over(order).alias("t0"))
    return steps.agg(F.sum((F.col("fpr") - F.col("f0")) * (F.col("tpr") + F.col("t0")) / 2).alias("auc"))
