"""Rolling window features by a sliding two-pointer sweep.

Rows are first added up to weights: one for each partition key, time, value and label. A key's time axis is cut into chunks, and a weight goes to its
own chunk and to those later ones whose windows reach back to it, so a key with a third of all rows is many tasks' work. A task sweeps each chunk in order
of time. For each window a head pointer lets weights in and a tail pointer lets them out. Each quantile has two heaps, what lies up to its rank and what
lies above. A weight that has left stays in its heap as a tombstone until it comes to the top, where its sequence number, below the tail's, gives it away;
after each move the border is put where the changed number of rows asks for it. Labels are counted by reference.
"""

from __future__ import annotations

import heapq
from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, carry, tidy


class Quantile:
    """The value at rank ceil(percent * m / 100) of m weighted values. Elements are (value, sequence number), so no two are equal, and all in `low`
    are below all in `high`, tombstones too; which heap holds one shows by the top of `low`."""

    def __init__(self, percent: int):
        self.percent, self.low, self.high, self.n_low, self.n_all = percent, [], [], 0, 0

    def _below(self, value: int, seq: int) -> bool:
        return bool(self.low) and (value, seq) <= (-self.low[0][0], -self.low[0][1])

    def enter(self, value: int, seq: int, weight: int) -> None:
        self.n_all += weight
        if self._below(value, seq):
            heapq.heappush(self.low, (-value, -seq, weight))
            self.n_low += weight
        else:
            heapq.heappush(self.high, (value, seq, weight))

    def leave(self, value: int, seq: int, weight: int) -> None:
        self.n_all -= weight
        if self._below(value, seq):
            self.n_low -= weight

    def value(self, tail: int, live: int) -> int | None:
        """Numbers below `tail` have left; `live` elements have not."""
        low, high = self.low, self.high
        rank = -(-self.percent * self.n_all // 100)
        if len(low) + len(high) > 2 * live + 64:
            low[:], high[:] = [x for x in low if -x[1] >= tail], [x for x in high if x[1] >= tail]
            heapq.heapify(low)
            heapq.heapify(high)
        while True:
            while low and -low[0][1] < tail:
                heapq.heappop(low)
            if self.n_low < rank:
                while high[0][1] < tail:
                    heapq.heappop(high)
                v, s, w = heapq.heappop(high)
                heapq.heappush(low, (-v, -s, w))
                self.n_low += w
            elif low and self.n_low - low[0][2] >= rank:
                v, s, w = heapq.heappop(low)
                heapq.heappush(high, (-v, -s, w))
                self.n_low -= w
            else:
                return -low[0][0] if rank else None


class Window:
    """What lies less than `width` before the sweep's time, or exactly that, from its tail to the head that all windows share."""

    def __init__(self, width: int, percents: list[int]):
        self.width, self.quantiles = width, [Quantile(p) for p in percents]
        self.rows, self.tail, self.n, self.total, self.valued, self.labels = deque(), 0, 0, 0, 0, Counter()

    def enter(self, row: tuple) -> None:
        time, value, label, weight, seq = row
        self.rows.append(row)
        self.n += weight
        if label is not None:
            self.labels[label] += weight
        if value is not None:
            self.total += value * weight
            for q in self.quantiles:
                q.enter(value, seq, weight)

    def leave_before(self, time: int) -> None:
        rows = self.rows
        while rows and rows[0][0] < time:
            _, value, label, weight, seq = rows.popleft()
            self.tail = seq + 1
            self.n -= weight
            if label is not None:
                self.labels[label] -= weight
                if not self.labels[label]:
                    del self.labels[label]
            if value is not None:
                self.total -= value * weight
                for q in self.quantiles:
                    q.leave(value, seq, weight)

    def features(self) -> list:
        return [self.n, self.total, len(self.labels), *(q.value(self.tail, len(self.rows)) for q in self.quantiles)]


#: Fixed order of the columns that the sweep reads.
SWEPT = ("key", "chunk", "time", "own", "value", "label", "weight")


def _sweep(widths: list[int], percents: list[int], out_names: list[str]):
    """Rows of SWEPT, in order of their first three -> (key, time, window, features...) for each time that a chunk has weights of its own."""

    def run(batches):
        at, now, own, waiting, seq = None, None, False, [], 0
        windows: list[Window] = []

        def settle(out):
            """The rows of one time: their windows first, then they go in."""
            if own:
                for w in windows:
                    w.leave_before(now - w.width)
                    for column, x in zip(out, [at[0], now, w.width, *w.features()], strict=True):
                        column.append(x)
            for row in waiting:
                for w in windows:
                    w.enter(row)
            if not own:
                for w in windows:  # a halo's older weights need not be kept
                    w.leave_before(now - w.width)

        for batch in batches:
            out: list[list] = [[] for _ in out_names]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in SWEPT]
            key, chunk, time, is_own, value, label, weight = (c.to_pylist() for c in columns)
            for i in range(batch.num_rows):
                if at != (key[i], chunk[i]) or now != time[i]:
                    if at is not None:
                        settle(out)
                    if at != (key[i], chunk[i]):
                        at, windows, seq = (key[i], chunk[i]), [Window(w, percents) for w in widths], 0
                    now, own, waiting = time[i], False, []
                own = own or is_own[i]
                waiting.append((now, value[i], label[i], weight[i], seq))
                seq += 1
            yield _batch(out, out_names)
        if at is not None:
            out = [[] for _ in out_names]
            settle(out)
            yield _batch(out, out_names)

    return run


def _batch(columns: list[list], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "key" else pa.int64()) for c, n in zip(columns, names, strict=True)], names=names)


def features(rows: DataFrame, key: Column, time: Column, value: Column, label: Column, widths: list[int], percents: list[int], chunk: int | None = None) -> DataFrame:
    """For each row and each W of `widths`, the rows of its key (null is one key) with time - W <= their time < time: the columns of `rows`, then
    time, window, n_events, total, n_labels, and q<p> for each p of `percents`, all long.

    n_events counts all of them, total adds up their values (0 without any), n_labels counts distinct labels, q<p> is the value at rank ceil(p * m / 100) of the
    m rows that have one (null for m = 0). Nulls are no values and no labels. Rows of one time do not see each other. Rows without a time are in no window, and theirs
    are empty. Repeated rows count each; other columns, whatever their names, pass through, unless they are named as one of the result's. An empty table gives an empty
    result.

    `chunk` is the length of a chunk of time, half the widest window without it; the halo that a chunk reads is as wide as that window. Memory is that of the weights
    of one window of one key, and the results, one row for each key, time and window, go back to the rows by a join that can split a hot key and time.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "rolling")
    widest = max(widths)
    chunk = chunk or max(1, widest // 2)
    quantiles = [f"q{p}" for p in percents]
    own_names = ["time", "window", "n_events", "total", "n_labels", *quantiles]
    packed, cells, _ = carry(rows, own_names)
    # a key's bytes, with one in front that tells null from empty
    narrow = rows.select(packed, F.when(key.isNull(), F.unhex(F.lit("00"))).otherwise(F.concat(F.unhex(F.lit("01")), key.cast("string").cast("binary"))).alias("key"), time.cast("long").alias("time"), value.cast("long").alias("value"), label.cast("string").alias("label"))
    narrow = scratch.keep(narrow, "rows")
    weights = narrow.where("time is not null").groupBy("key", "time", "value", "label").agg(F.count("*").alias("weight"))
    # labels are only counted, so within a task any of their numbers will do; their hash is short
    weights = weights.select("key", "time", "value", F.when(F.col("label").isNotNull(), F.md5("label")).alias("label"), "weight")
    chunk_of = lambda t: F.expr(f"({t} - pmod({t}, {chunk}L)) div {chunk}L")
    spread = weights.withColumn("first", chunk_of("time")).withColumn("chunk", F.explode(F.sequence("first", chunk_of(f"(time + {widest}L)"))))
    spread = spread.select("key", "chunk", "time", (F.col("chunk") == F.col("first")).alias("own"), "value", "label", "weight")
    spread = scratch.keep(spread, "weights")
    names = ["key", *own_names]
    schema = ", ".join(f"`{n}` {'binary' if n == 'key' else 'long'}" for n in names)
    ordered = spread.repartitionByRange("key", "chunk").sortWithinPartitions("key", "chunk", "time")
    swept = ordered.mapInArrow(tidy(_sweep(sorted(widths), percents, names)), schema)
    timed = narrow.join(swept, ["key", "time"])
    empty = narrow.where("time is null").select("row", "time", F.explode(F.array(*(F.lit(w).cast("long") for w in sorted(widths)))).alias("window"), *(F.lit(0).cast("long").alias(c) for c in ("n_events", "total", "n_labels")), *(F.lit(None).cast("long").alias(q) for q in quantiles))
    return timed.select("row", *own_names).unionByName(empty).select(*cells, *own_names)


def document_time(doc_id: Column) -> Column:
    """60 * floor((doc_id + (h mod 10000)) / 6) in integers, h being the CRC-32 of the id in decimal digits; null for null."""
    x = doc_id.cast("long") + F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 10000
    return (x - F.pmod(x, F.lit(6))) * 10


def document_features(docs: DataFrame, widths: tuple[int, ...] = (600, 43200)) -> DataFrame:
    """doc_id, window_s, event_s, n_events, sum_chars, n_langs, median_chars, high_chars of each row of documents: `features` by source over the
    lengths of its texts in code points (null: no length; empty: 0) and their languages. Of other columns only source, text and lang are read."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), F.length("text").cast("long").alias("n"), F.col("lang").alias("l"))
    out = features(rows, F.col("source"), document_time(F.col("doc_id")), F.col("n"), F.col("l"), list(widths), [50, 90])
    return out.select("doc_id", F.col("window").alias("window_s"), F.col("time").alias("event_s"), "n_events", F.col("total").alias("sum_chars"), F.col("n_labels").alias("n_langs"), F.col("q50").alias("median_chars"), F.col("q90").alias("high_chars"))
