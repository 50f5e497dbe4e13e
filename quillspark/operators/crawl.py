"""A crawl over stored pages: first come, first served, joined to the extraction of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import strings
from ..sources import pages as page_source
from .graph import _cut


def numbered(rows: DataFrame, *order: Column, start: int = 0) -> tuple[DataFrame, int]:
    """rows with a column `place` that counts from `start` in this order, and how many there are. Ranges of the order are counted apart, so no task sorts
    more than its range; rows that tie in all of `order` are in one range."""
    ranged = _cut(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    at = F.monotonically_increasing_id()
    ranged = ranged.select("*", F.shiftright(at, 33).cast("int").alias("range"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("inside"))
    sizes = sorted((r["range"], r["count"]) for r in ranged.groupBy("range").count().collect())  # one row a partition
    before, total = [], 0
    for part, n in sizes:
        before.append((part, start + total))
        total += n
    offsets = rows.sparkSession.createDataFrame(before, "range int, before long")
    return ranged.join(F.broadcast(offsets), "range").withColumn("place", F.col("before") + F.col("inside")).drop("range", "inside", "before"), total


def crawl(pages: DataFrame, seeds: DataFrame, cap: int | None = None) -> DataFrame:
    """(place, depth, and the columns of a paper record) of the pages (page_id, url, html) that are reached from seeds (position, url) by their references, in the order
    in which one queue would reach them: a page's references wait behind all that wait already. A crawl ends with `cap` papers, in the middle of a level too.

    An id that is asked for again is taken once. Ids without a page and pages that say 404 are passed over and do not count for the cap. Of several pages of one
    id the one with the smallest page_id is read, ties by url and html; pages and seeds without url are no pages. Without seeds the result is empty.

    Each page is read once, for its references; a level is a join of the waiting ids with the reference lists, and only papers that are taken are extracted in full."""
    own = pages.where("url IS NOT NULL").select(strings.id_from_url(F.col("url")).alias("id"), F.struct("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).alias("page"))
    first = own.groupBy("id").agg(F.min("page").alias("page")).select("page.*")
    links = _cut(page_source.paper_records(first).select("id", "references"))
    asked = seeds.where("url IS NOT NULL").select(strings.id_from_url(F.col("url")).alias("id"), "position").groupBy("id").agg(F.min("position").alias("came"))
    taken, total, depth = None, 0, 0
    waiting = asked
    while True:
        there = waiting.join(links.select("id"), "id", "left_semi")
        level, n = numbered(there, F.col("came"), F.col("id"), start=total)
        level = level.select("id", "place", F.lit(depth).alias("depth"))
        if cap is not None:
            level = level.where(F.col("place") < cap)
        level = _cut(level)
        taken = level if taken is None else _cut(taken.union(level))
        total, depth = total + n, depth + 1
        if not n or (cap is not None and total >= cap):
            break
        found = level.join(links, "id").select("place", F.posexplode("references").alias("pos", "to"))
        waiting = found.groupBy(F.col("to").alias("id")).agg(F.min(F.struct("place", "pos")).alias("came")).join(taken.select("id"), "id", "left_anti")
    # pages are met by id before they are extracted
    chosen = first.withColumn("id", strings.id_from_url(F.col("url"))).join(taken.select("id"), "id", "left_semi").drop("id")
    records = page_source.paper_records(chosen)
    return taken.join(records, "id").select("place", "depth", *records.columns)
