"""Exact top-k search by MaxScore over sharded postings.

A vector is a bag of terms: its places, with integer weights. The entries (distinct vectors) are dealt out over shards; a shard keeps, for each
term, its postings and their least and largest weight, which bound what the term can add to a score. Blocks of queries meet each shard. For a query the terms are
in order of their bounds; the smallest whose bounds together stay below the score to beat are non-essential: an entry that only they hold cannot win. The postings
of the essential terms are traversed and added up; then the others are probed, a few terms at a time, for the entries that are still competitive, which raises the
score to beat. Each shard's best are merged. The score to beat starts from a sample of entries, searched in full, so that a shard can rule out entries from the
first. All sums are exact, whatever the order of the terms, so the result is that of comparing all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, tidy

#: Entries of a shard: this many while there are few shards, and so many at most.
SHARD, LARGEST_SHARD, FEW_SHARDS = 2048, 65_536, 64
#: Entries whose scores give each query its first score to beat.
SAMPLE = 2048
#: Queries of a block, terms that are probed at once, and the share of a shard's entries from which a term's postings are a whole column.
BLOCK, PROBED, DENSE = 256, 8, 0.25
TOP = 2**63 - 1


def quantise(vector: list, scale: int) -> np.ndarray | None:
    """floor(scale * x) of each component, or None if one is null, not finite or too large for a long."""
    if vector is None or None in vector:
        return None
    x = np.floor(np.array(vector, np.float64) * scale)
    return x.astype("<i8") if np.isfinite(x).all() and (np.abs(x) < 2**63).all() else None


def _quantised(scale: int):
    def run(batches):
        for batch in batches:
            ids, vectors = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                q = None if i is None else quantise(v, scale)
                if q is not None:
                    ids.append(i)
                    vectors.append(np.trim_zeros(q, "b").tobytes())  # a missing term and a weight of 0 are the same
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.binary())], names=["id", "vector"])

    return run


def matrix(vectors: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors, strict=True):
        own = np.frombuffer(v, "<i8")[:width]
        row[: len(own)] = own
    return out


def arithmetic(bound: float):
    """The type in which sums of products up to `bound` are exact."""
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64 if bound < 2**62 else object


def largest(x: np.ndarray) -> float:
    return float(np.abs(x.astype(np.float64)).max(initial=0))


class Shard:
    """Entries' ids and vectors; for each term its postings, or a whole column where most entries have it, and the bounds of its weights."""

    def __init__(self, entry: np.ndarray, vid: np.ndarray, rows: np.ndarray):
        self.entry, self.vid, self.rows, self.n = entry, vid, rows, len(rows)
        self.least, self.most = np.minimum(rows.min(0, initial=0), 0), np.maximum(rows.max(0, initial=0), 0)
        self.size = largest(rows)
        self.forms: dict = {}

    def form(self, kind) -> tuple[np.ndarray, list]:
        """The forward rows, and the postings of each term, in a type of numbers."""
        if kind not in self.forms:
            rows = self.rows.astype(kind)
            columns = np.ascontiguousarray(rows.T)
            postings = []
            for c in columns:
                held = np.flatnonzero(c)
                postings.append(None if len(held) >= DENSE * self.n else (held, c[held]))
            self.forms[kind] = rows, columns, postings
        return self.forms[kind]

    def search(self, query: np.ndarray, keep: int, beat: float) -> tuple[np.ndarray, list]:
        """Places and scores of the `keep` best entries of at least `beat`, ties to the smaller vid and then the smaller entry."""
        kind = arithmetic(self.size * largest(query) * len(query))
        slack = 0 if kind in (np.float32, np.float64) else 1e-9  # where numbers are rounded for a comparison
        rows, columns, postings = self.form(kind)
        q = query.astype(kind)
        # what each term adds at most; it is exact, or rounded up
        bound = np.maximum(query.astype(np.float64) * self.least, query.astype(np.float64) * self.most) * (1 + slack)
        terms = np.flatnonzero(query)
        terms = terms[np.argsort(-bound[terms], kind="stable")]
        left = np.append(np.cumsum(bound[terms][::-1])[::-1], 0.0)  # of a term and all after it
        floor = lambda: min(beat, TOP) - slack * abs(beat) if beat > -np.inf else beat
        if left[0] < floor():
            return np.zeros(0, np.int64), []
        essential = int(np.searchsorted(-left, -floor(), side="right")) if floor() > 0 else len(terms)
        essential = min(essential, len(terms))
        acc = np.zeros(self.n, kind)
        dense = [t for t in terms[:essential] if postings[t] is None]
        touched = np.full(self.n, bool(dense) or floor() <= 0)  # a whole column has all entries
        if dense:
            acc = acc + q[dense] @ columns[dense]
        for t in terms[:essential]:
            if postings[t] is not None:
                held, weights = postings[t]
                acc[held] += q[t] * weights
                touched[held] = True
        alive = np.flatnonzero(touched)
        acc, done = acc[alive], essential
        if done < len(terms) and len(alive) > 4 * keep:
            # the most promising ones in full, for a higher score to beat
            best = np.argpartition(-acc.astype(np.float64), 2 * keep)[: 2 * keep]
            full = acc[best] + rows[alive[best]][:, terms[done:]] @ q[terms[done:]]
            beat = max(beat, float(np.partition(full.astype(np.float64), len(full) - keep)[len(full) - keep]))
        while True:
            ok = acc.astype(np.float64) + left[done] >= floor()
            alive, acc = alive[ok], acc[ok]
            if done == len(terms):
                break
            some = terms[done : done + PROBED]
            acc = acc + rows[np.ix_(alive, some)] @ q[some]
            done += len(some)
            if done == len(terms) and len(acc) > keep:
                beat = max(beat, float(np.partition(acc.astype(np.float64), len(acc) - keep)[len(acc) - keep]))
        if kind is object:
            order = sorted(range(len(alive)), key=lambda i: (-clip(acc[i]), self.vid[alive[i]], self.entry[alive[i]]))[:keep]
        else:
            order = np.lexsort((self.entry[alive], self.vid[alive], -acc))[:keep]
        return alive[order], [clip(int(acc[i])) for i in order]


def clip(score: int) -> int:
    return max(-TOP - 1, min(TOP, int(score)))


def _blocks(sample: np.ndarray, width: int, keep: int):
    """(entry, vector) of queries -> blocks of them (entries, vectors, beat), with the keep-th best score in the sample as the score to beat."""
    shard = Shard(np.arange(len(sample)), np.arange(len(sample)), sample)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                q = matrix(part.column(1).to_pylist(), width)
                beat = np.full(len(q), -np.inf)
                if len(sample) >= keep:
                    kind = arithmetic(shard.size * largest(q) * width)
                    if kind in (np.float32, np.float64):
                        scores = q.astype(kind) @ shard.rows.astype(kind).T
                        beat = np.partition(scores, len(sample) - keep, axis=1)[:, len(sample) - keep].astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (part.column(0).to_numpy().astype("<i8").tobytes(), q.tobytes(), beat.tobytes())], names=["entries", "vectors", "beats"])

    return run


SHARD_ROWS = ["shard", "kind", "entry", "vid", "vector", "entries", "beats"]


def _search(width: int, keep: int):
    """Shards one after another, each with its entries and then the blocks of queries -> (query, entry, vid, score)."""

    def run(batches):
        now, parts, shard = None, [], None
        for batch in batches:
            numbers, kinds, entries, vids = (batch.column(batch.schema.get_field_index(c)) for c in SHARD_ROWS[:4])
            vectors, asked, beats = (batch.column(batch.schema.get_field_index(c)) for c in SHARD_ROWS[4:])
            numbers, kinds = numbers.to_numpy(), kinds.to_numpy()
            edges = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(kinds) != 0)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(numbers)], strict=True):
                if lo == hi:
                    continue
                if numbers[lo] != now:
                    now, parts, shard = numbers[lo], [], None
                if kinds[lo] == 0:
                    cut = slice(lo, hi)
                    parts.append((entries.slice(lo, hi - lo).to_numpy(), vids.slice(lo, hi - lo).to_numpy(), matrix(vectors[cut].to_pylist(), width)))
                    continue
                if not parts:
                    continue
                shard = shard or Shard(*(np.concatenate([p[k] for p in parts]) for k in range(3)))
                for at in range(lo, hi):
                    ids, beat = np.frombuffer(asked[at].as_py(), "<i8"), np.frombuffer(beats[at].as_py(), np.float64)
                    queries = np.frombuffer(vectors[at].as_py(), "<i8").reshape(len(ids), -1)
                    out: list[list] = [[], [], [], []]
                    for i in range(len(ids)):
                        places, scores = shard.search(queries[i], keep, beat[i])
                        for column, values in zip(out, ([int(ids[i])] * len(places), shard.entry[places].tolist(), shard.vid[places].tolist(), scores), strict=True):
                            column += values
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["query", "entry", "vid", "score"])

    return run


def search(vectors: DataFrame, query_filter, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that `query_filter` (a condition) takes, the k other rows with the largest inner product
    of the vectors floor(scale * x), ties to the smaller id; all others, if there are fewer.

    Vectors that are null, hold a null or non-finite component or one whose floor(scale * x) is no long take no part, nor do null ids. Components that a shorter or empty
    vector lacks count as 0, and a zero vector takes part: its scores are 0. A score beyond a long becomes the nearest long. Equal vectors are one entry
    with its k + 1 smallest ids, so copies cost nothing more. Rows that repeat an id and a vector are one; rows that share an id only are queries and candidates each, and
    a query's own id is no candidate. Other columns are ignored; an
    empty table gives an empty result. The driver sees SAMPLE vectors, two counts and a length.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "maxscore")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(tidy(_quantised(scale)), "id long, vector binary")
    rows = scratch.keep(rows, "valid")
    nth = F.dense_rank().over(Window.partitionBy("vector").orderBy("id"))
    entries = rows.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("vector").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    entries = scratch.keep(entries.select(F.monotonically_increasing_id().alias("entry"), F.col("ids")[0].alias("vid"), "vector", "ids"), "entries")
    facts = entries.agg(F.count("*").alias("n"), F.max(F.length("vector")).alias("bytes")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, keep = max(1, facts["bytes"] // 8), k + 1
    n_shards = max(-(-facts["n"] // LARGEST_SHARD), min(-(-facts["n"] // SHARD), FEW_SHARDS))
    sample = entries.orderBy(F.xxhash64("vid"), "entry").limit(SAMPLE).select("vector").collect()

    own = scratch.keep(rows.where(query_filter(F.col("id"))).join(entries.select("vector", "entry"), "vector").select(F.col("id").alias("query_id"), "entry").distinct(), "queries")
    asked = entries.join(own.select("entry").distinct(), "entry", "left_semi").select("entry", "vector")
    blocks = asked.repartition(max(1, min(n_shards, FEW_SHARDS)), "entry").mapInArrow(tidy(_blocks(matrix([r["vector"] for r in sample], width), width, keep)), "entries binary, vectors binary, beats binary")
    nothing = lambda kind: F.lit(None).cast(kind)
    placed = entries.select(F.pmod(F.xxhash64("entry"), F.lit(n_shards)).alias("shard"), F.lit(0).alias("kind"), "entry", "vid", "vector", nothing("binary").alias("entries"), nothing("binary").alias("beats"))
    visits = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)).cast("array<long>")).alias("shard"), F.lit(1).alias("kind"), nothing("long").alias("entry"), nothing("long").alias("vid"), F.col("vectors").alias("vector"), "entries", "beats")
    ordered = placed.unionByName(visits).repartition(n_shards, "shard").sortWithinPartitions("shard", "kind")
    found = ordered.mapInArrow(tidy(_search(width, keep)), "query long, entry long, vid long, score long")
    found = found.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vid", "entry"))).where(F.col("nth") <= keep).drop("nth", "vid")
    found = scratch.keep(found, "found").join(entries.select("entry", F.explode("ids").alias("vec_id")), "entry").select(F.col("query").alias("entry"), "vec_id", "score")
    best = Window.partitionBy("entry").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= keep)
    out = own.join(found, "entry").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "entry").orderBy(F.desc("score"), "vec_id"))
    return out.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
