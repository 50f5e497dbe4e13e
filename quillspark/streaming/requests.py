"""Search requests as a stream: each micro-batch is ranked as one plan for each method that it names, and answered exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import rank
from ..operators.index import Index

METHODS = ("okapi25", *(f"{d}-{q}" for d in rank.DOC_SCHEMES for q in rank.QUERY_SCHEMES))
REQUEST = T.StructType([T.StructField("request_id", T.LongType()), T.StructField("query", T.StringType()), T.StructField("method", T.StringType()), T.StructField("k", T.IntegerType())])
RESPONSE = "request_id long, rank int, doc_id long, score double, error string"


def answer(index: Index, requests: DataFrame, abstract_weight: float = 0.5) -> DataFrame:
    """(request_id, rank, doc_id, score, error) of requests (request_id, query, method, k), each method's as one batch of queries. k = -1 asks for all. A request
    that nothing matches has a row without document and error; one without query or with an unknown method, or a k that is null, 0 or below -1, has a row that says
    so. Of requests with one id the first in the order of their columns counts; those without id cannot be answered and have no row."""
    spark = requests.sparkSession
    one = requests.where("request_id IS NOT NULL").groupBy("request_id").agg(F.min(F.struct("query", "method", "k")).alias("r")).select("request_id", "r.*")
    known = F.coalesce(F.col("method").isin(*METHODS), F.lit(False))
    wrong = F.when(F.col("query").isNull(), "no query").when(~known, "unknown method").when(F.coalesce((F.col("k") < -1) | (F.col("k") == 0), F.lit(True)), "k must be positive or -1")
    one = one.withColumn("error", wrong)
    right = one.where("error IS NULL")
    hits = spark.createDataFrame([], RESPONSE).drop("error")
    for method in sorted(r["method"] for r in right.select("method").distinct().collect()):  # at most len(METHODS)
        own = right.where(F.col("method") == method)
        scores = rank.rank(index, own.select(F.col("request_id").alias("query_id"), "query"), method, abstract_weight)
        asked = own.select(F.col("request_id").alias("query_id"), "k")
        most, every = own.agg(F.max("k"), F.max(F.col("k") == -1)).first()
        # a known limit is applied before scores are shuffled by request
        best = None if most < 1 else rank.top_k(_of(scores, asked, "k > 0") if every else scores, most).join(asked, "query_id").where("rank <= k")
        if every:
            rest = rank.top_k(_of(scores, asked, "k = -1"), -1).join(asked, "query_id")
            best = rest if best is None else best.unionByName(rest)
        hits = hits.union(best.select(F.col("query_id").alias("request_id"), F.col("rank").cast("int"), F.col("doc_id").cast("long"), F.col("score").cast("double")))
    return one.select("request_id", "error").join(hits, "request_id", "left").select("request_id", "rank", "doc_id", "score", "error")


def _of(scores: DataFrame, asked: DataFrame, which: str) -> DataFrame:
    return scores.join(asked.where(which).select("query_id"), "query_id", "left_semi")


def serve(index: Index, stream: DataFrame, path: str, checkpoint: str, abstract_weight: float = 0.5, follow: bool = False) -> StreamingQuery:
    """Answers a stream of requests into Parquet files under path, a folder for each micro-batch. A batch that runs again after a failure overwrites its own folder, so each
    request has one answer. Without `follow` the stream ends when what is there is answered. `index` should be an `Index.cached`."""

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            answer(index, kept, abstract_weight).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        finally:
            kept.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer if follow else writer.trigger(availableNow=True)).start()


def responses(spark, path: str) -> DataFrame:
    """All answers that have been written."""
    return spark.read.parquet(path).drop("batch")
