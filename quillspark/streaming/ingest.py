"""Documents that keep arriving: postings are appended batch by batch, and term counts are kept by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import index as ix
from ..operators import text


def append_postings(stream: DataFrame, path: str, checkpoint: str, stops: DataFrame | None = None) -> StreamingQuery:
    """Tokenises each micro-batch of (doc_id, text) and appends its postings to a Parquet table, one folder for each batch; a batch that is run again
    replaces its own folder, so restarts add nothing twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        tokens = text.tokens(text.sections(batch))
        kept = tokens if stops is None else text.non_stop(tokens, stops)
        ix.postings(kept).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time_col: str, key_col: str, width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """(start, key, n): rows by window of event time and key; rows later than `delay` are left out."""
    late = stream.withWatermark(time_col, delay)
    return late.groupBy(F.window(time_col, width), F.col(key_col).alias("key")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "key", "n")
