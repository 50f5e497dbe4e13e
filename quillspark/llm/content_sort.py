"""Exact deduplication by sorting content.

Sampled splitters deal the normalised texts out by ranges of their beginnings, an external sort in each partition orders them by their whole content,
so equal texts are neighbours, and neighbours are compared in full. Texts that begin alike stay in one partition, unless they are too many: then their order is
that of their digests first, partitions are cut by digest and id, and a run of equal texts that crosses partitions is joined again at the
borders. So copies of one text, however many, are spread over as many partitions as they fill.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, tidy

#: Characters of a text that its splitter carries, and the number of texts from which on a common beginning may be cut.
SPLITTER_CHARS, LEAST_HOT = 64, 1000


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _runs(batches):
    """Rows sorted by content -> a row for each document with its run's first id and size within this partition.

    `edge` is 1 for the first run of the partition, 2 for its last, 3 for both, else 0; `border` holds the text of such a
    run once, on its first row.
    """
    part = TaskContext.get().partitionId()
    text, shas, ids = None, [], []  # the open run
    first = True

    def out(last):
        edge = first + 2 * last
        n = len(ids)
        border = pa.concat_arrays([pa.array([text if edge else None], pa.large_string()), pa.nulls(n - 1, pa.large_string())])
        return pa.record_batch(
            [pa.array(ids, pa.int64()), pa.array([ids[0]] * n, pa.int64()), pa.array([n] * n, pa.int64()), pa.array([shas[0]] * n, pa.string()), pa.array([part] * n, pa.int32()), pa.array([edge] * n, pa.int32()), border.cast(pa.string())],
            ["doc_id", "keep_id", "group_size", "text_sha256", "part", "edge", "border"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        texts, sha, doc = (batch.column(batch.schema.get_field_index(k)) for k in ("norm", "sha", "doc_id"))
        n = len(texts)
        if text is not None and texts[0].as_py() != text:
            yield out(False)
            text, shas, ids, first = None, [], [], False
        differs = pc.not_equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False).nonzero()[0] + 1
        starts = [0, *differs.tolist()]
        if len(starts) > 1:
            # the open run ends here
            stop = starts[1]
            if text is None:
                text = texts[0].as_py()
                shas = [sha[0].as_py()]
            ids += doc.slice(0, stop).to_pylist()
            yield out(False)
            first = False
            lo, hi = starts[1], starts[-1]
            if hi > lo:
                yield _closed(doc.slice(lo, hi - lo), sha.slice(lo, hi - lo), [s - lo for s in starts[1:-1]], part)
            text, shas, ids = texts[hi].as_py(), [sha[hi].as_py()], doc.slice(hi).to_pylist()
        else:
            if text is None:
                text, shas = texts[0].as_py(), [sha[0].as_py()]
            ids += doc.to_pylist()
    if ids:
        yield out(True)


def _closed(doc, sha, starts, part):
    """Rows of the runs that begin and end within one batch."""
    import numpy as np

    n = len(doc)
    size = np.diff([*starts, n])
    first = pa.array(np.repeat(np.array(starts), size))
    return pa.record_batch(
        [doc, doc.take(first), pa.array(np.repeat(size, size).astype("int64")), sha, pa.array(np.full(n, part, "int32")), pa.array(np.zeros(n, "int32")), pa.nulls(n, pa.string())],
        ["doc_id", "keep_id", "group_size", "text_sha256", "part", "edge", "border"],
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their forms with each run of ASCII white space made one space are identical; the smallest id of equal
    texts stays. Null counts as the empty text. Ids are whole numbers; rows that repeat an id are counted one by one (a repeated smallest
    id keeps each of its rows). A row without an id never stays beside equal texts that have one; of texts without any id keep_id is
    null and all rows are kept.
    An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "content-sort")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    rows = scratch.keep(rows.select("doc_id", "norm", F.sha2(F.col("norm"), 256).alias("sha"), F.substring("norm", 1, SPLITTER_CHARS).alias("head")), "normalised")
    # Texts go by their content. Only where more begin alike than fit into a partition, the partitions between them are cut by digest and id.
    most = max(rows.count() // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))), LEAST_HOT)
    hot = rows.groupBy("head").agg(F.count("*").alias("n")).where(F.col("n") > most).select("head", F.lit(True).alias("hot"))  # four a partition at most
    rows = rows.join(F.broadcast(hot), "head", "left")
    rows = rows.select("doc_id", "norm", "sha", "head", F.when(F.col("hot"), F.col("sha")).alias("tie"), F.when(F.col("hot"), F.col("doc_id")).alias("part_id"))
    ordered = rows.repartitionByRange(*(F.asc_nulls_last(c) for c in ("head", "tie", "part_id"))).sortWithinPartitions(*(F.asc_nulls_last(c) for c in ("head", "tie", "norm", "doc_id")))
    schema = "doc_id long, keep_id long, group_size long, text_sha256 string, part int, edge int, border string"
    runs = scratch.keep(ordered.select("doc_id", "norm", "sha").mapInArrow(tidy(_runs), schema), "runs")
    scratch.drop("normalised")

    # Border runs: two for each partition at most. Only flags and counts meet in one task, texts are compared where they lie.
    border = runs.where("border is not null").select("part", "edge", "keep_id", "group_size", "border")
    place = border.select("part").distinct().withColumn("nth", F.row_number().over(Window.orderBy("part")))
    border = border.join(F.broadcast(place), "part")
    ends = border.where("edge >= 2").select((F.col("nth") + 1).alias("nth"), F.col("border").alias("before"))
    starts = border.where("edge in (1, 3)").join(ends, "nth", "left").select("part", F.coalesce(F.col("border") == F.col("before"), F.lit(False)).alias("joined"))
    items = border.drop("border").join(starts, "part")
    # a last run that is not also the first never continues what is before it
    items = items.withColumn("cut", F.when((F.col("edge") == 2) | ~F.col("joined"), 1).otherwise(0))
    chain = F.sum("cut").over(Window.orderBy("part", "edge"))
    items = items.withColumn("chain", chain)
    whole = items.groupBy("chain").agg(F.min("keep_id").alias("all_keep"), F.sum("group_size").alias("all_size"))
    fix = items.join(whole, "chain").select("part", "edge", "all_keep", "all_size")

    rest = runs.drop("border")
    fixed = rest.where("edge > 0").join(F.broadcast(fix), ["part", "edge"]).withColumns({"keep_id": F.col("all_keep"), "group_size": F.col("all_size")})
    final = rest.where("edge = 0").select("doc_id", "keep_id", "group_size", "text_sha256").unionByName(fixed.select("doc_id", "keep_id", "group_size", "text_sha256"))
    return final.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
