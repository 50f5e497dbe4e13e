"""Approximate nearest neighbours by an inverted multi-index.

Each half of the vectors has a codebook of its own; a pair of centroids is a cell. A query goes through the cells by the sum of its
halves' squared distances to their centroids, with a heap, until those cells hold enough vectors; the vectors in them are ranked by
their exact distance. How many are enough is measured: some vectors are searched in full, once, and the cells that hold most of
their neighbours set the number, so it is the smaller a share the more vectors there are and the better they cluster.

The index is cut into slabs of bounded size, entries of one first centroid in order of the second. A query goes to the slabs
that hold cells it visits, and is compared with the entries of these cells only. Equal vectors are one entry with its smallest ids, so a
vector that a third of all rows share costs no more than another.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, tidy

#: Vectors that the codebooks are fitted on, at most; chosen by a hash of the id.
SAMPLE = 20_000
CENTROIDS = 128
#: Vectors that are searched in full to find how many entries a query must visit, and the share of their neighbours to be found.
PROBES, RECALL = 64, 0.96
#: Entries of a slab, about, and bits of a slab's number within its centroid.
SLAB, CHUNK_BITS = 4096, 32


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        a = nearest(x, c)
        n = np.bincount(a, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, a, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1), 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def traverse(d1: np.ndarray, d2: np.ndarray, sizes: np.ndarray, enough: int) -> np.ndarray:
    """Cells (i * len(d2) + j) in ascending order of d1[i] + d2[j], until they hold `enough` entries."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    a, b, k = d1[o1].tolist(), d2[o2].tolist(), len(d2)
    first, second = (o1 * k).tolist(), o2.tolist()
    size = sizes.tolist()
    heap, out, held = [(a[0] + b[0], 0, 0)], [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = first[i] + second[j]
        held += size[cell]
        out.append(cell)
        if j + 1 < k:
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return np.array(out, np.int64)


def _valid(id_col: str, vector_col: str):
    def run(batches):
        for batch in batches:
            ids, vectors = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i is None or not v or None in v:
                    continue
                x = np.array(v, np.float64)
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    vectors.append((x + 0.0).tobytes())  # one zero
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.binary())], names=["id", "vector"])

    return run


def _nearest(rows: np.ndarray, cols: np.ndarray, queries: np.ndarray, x: np.ndarray, vid: np.ndarray, entry: np.ndarray, keep: int):
    """Of pairs (query, entry), rows ascending: (query, entry, score) of each query's `keep` nearest, ties to the smaller vid."""
    score = np.sqrt(((queries[rows] - x[cols]) ** 2).sum(1))
    order = np.lexsort((entry[cols], vid[cols], score, rows))
    rows, cols, score = rows[order], cols[order], score[order]
    nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
    top = nth < keep
    return rows[top], cols[top], score[top]


def _candidates(d: np.ndarray, keep: int, slack: np.ndarray):
    """Pairs that can be among each row's `keep` smallest, however the distances were rounded."""
    kth = np.partition(d, keep - 1, axis=1)[:, keep - 1] if d.shape[1] > keep else np.full(len(d), np.inf)
    return np.nonzero((d <= (kth + slack)[:, None]) & np.isfinite(d))


def _probe(probes: np.ndarray, own: np.ndarray, keep: int):
    """(entry, vid, cell, vector) -> each probe's nearest other entries of this task: (probe, cell, score, vid, entry)."""

    def run(batches):
        norm = (probes**2).sum(1)
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                entry, vid, cell = (part.column(k).to_numpy() for k in range(3))
                x = np.frombuffer(b"".join(part.column(3).to_pylist()), np.float64).reshape(len(vid), -1)
                size = (x**2).sum(1)
                d = norm[:, None] - 2 * probes @ x.T + size
                d[entry == own[:, None]] = np.inf
                rows, cols, score = _nearest(*_candidates(d, keep, 1e-9 * (1 + norm + size.max())), probes, x, vid, entry, keep)
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(cell[cols].astype(np.int64)), pa.array(score), pa.array(vid[cols]), pa.array(entry[cols])], names=["probe", "cell", "score", "vid", "entry"])

    return run


def _visits(books, sizes: np.ndarray, chunks: np.ndarray, enough: int):
    """(entry, vector) of queries -> a row for each slab that a query visits: (slab, kind, entry, vid, c2, vector, cells), cells having a bit
    for each cell of the slab's first centroid."""
    k = len(books[1])
    half = books[0].shape[1]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                vectors = part.column(1).to_pylist()
                q = np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)
                near = squared(q[:, :half], books[0]), squared(q[:, half:], books[1])
                slab, who, cells = [], [], []
                for i in range(len(q)):
                    seen = np.zeros(len(books[0]) * k, bool)
                    seen[traverse(near[0][i], near[1][i], sizes, enough)] = True
                    seen = (seen & (sizes > 0)).reshape(-1, k)
                    first = np.flatnonzero(seen.any(1))
                    bits = np.packbits(seen[first], axis=1)
                    each = chunks[first]
                    slab.append(np.repeat(first << CHUNK_BITS, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each))
                    who += [i] * int(each.sum())
                    cells += [bits[j].tobytes() for j in np.repeat(np.arange(len(first)), each)]
                take = pa.array(who, pa.int64())
                n = len(who)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(slab)), pa.array(np.ones(n, np.int32)), part.column(0).take(take), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), part.column(1).take(take), pa.array(cells, pa.binary())], names=SLAB_ROWS)

    return run


SLAB_ROWS = ["slab", "kind", "entry", "vid", "c2", "vector", "cells"]


def _rerank(keep: int, n_cells: int):
    """Slabs one after another, each with its entries in order of c2 and then the queries that visit it -> (query, entry, vid, score): each
    query's nearest entries among those whose cells it visits. No other distance is computed."""

    def run(batches):
        slab, parts, ready = None, [], None

        def load():
            entry, vid, c2 = (np.concatenate([p[k] for p in parts]) for k in range(3))
            x = np.concatenate([p[3] for p in parts])
            starts = np.flatnonzero(np.diff(c2, prepend=-1))
            return entry, vid, x, (x**2).sum(1), c2[starts], starts, np.append(starts[1:], len(c2))

        for batch in batches:
            slabs, kinds = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("slab", "kind"))
            edges = np.flatnonzero((np.diff(slabs) != 0) | (np.diff(kinds) != 0)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(slabs)], strict=True):
                if lo == hi:
                    continue
                if slabs[lo] != slab:
                    slab, parts, ready = slabs[lo], [], None
                col = lambda c, lo=lo, hi=hi: batch.column(batch.schema.get_field_index(c)).slice(lo, hi - lo)  # noqa: E731, B023
                vectors = np.frombuffer(b"".join(col("vector").to_pylist()), np.float64).reshape(hi - lo, -1)
                if kinds[lo] == 0:
                    parts.append((col("entry").to_numpy(), col("vid").to_numpy(), col("c2").to_numpy(), vectors))
                    continue
                if not parts:
                    continue
                ready = ready or load()
                entry, vid, x, size, runs, starts, stops = ready
                asked, cells = col("entry").to_numpy(), col("cells").to_pylist()
                for q in range(0, hi - lo, 512):
                    block = vectors[q : q + 512]
                    seen = np.unpackbits(np.frombuffer(b"".join(cells[q : q + 512]), np.uint8).reshape(len(block), -1), axis=1, count=n_cells).astype(bool)
                    norm = (block**2).sum(1)
                    d = np.full((len(block), len(vid)), np.inf)
                    for cell, a, b in zip(runs.tolist(), starts.tolist(), stops.tolist(), strict=True):
                        own = np.flatnonzero(seen[:, cell])
                        if len(own):
                            d[own, a:b] = norm[own, None] - 2 * block[own] @ x[a:b].T + size[a:b]
                    rows, cols, score = _nearest(*_candidates(d, keep, 1e-9 * (1 + norm + size.max())), block, x, vid, entry, keep)
                    yield pa.RecordBatch.from_arrays([pa.array(asked[q : q + 512][rows]), pa.array(entry[cols]), pa.array(vid[cols]), pa.array(score)], names=["query", "entry", "vid", "score"])

    return run


def search(vectors: DataFrame, query_filter, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", centroids: int = CENTROIDS, share: float | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that `query_filter` (a condition) takes, the k nearest other rows found by
    Euclidean distance in double precision, ties to the smaller id; all others, if there are fewer.

    Queries visit cells until those hold `share` of the distinct vectors; without it as many as PROBES vectors, searched in full,
    needed for RECALL of their neighbours. Vectors that are null, zero, empty or hold null or non-finite numbers take no part, nor do null
    ids or vectors of another length than most (ties: the longest). Rows that repeat an id count each; a query's own rows are no candidates.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "multi-index")
    schema = "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(tidy(_valid(id_col, vector_col)), "id long, vector binary")
    rows = scratch.keep(rows, "valid")
    length = rows.groupBy(F.length("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if length is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.length("vector") == length["n"])
    # a vector's smallest ids; each task passes on no more than these
    nth = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    entries = rows.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    entries = scratch.keep(entries.select(F.monotonically_increasing_id().alias("entry"), F.col("ids")[0].alias("vid"), "vector", "ids"), "entries")

    sample = entries.orderBy(F.xxhash64("vid"), "entry").limit(SAMPLE).select("vector").collect()
    x = np.frombuffer(b"".join(r["vector"] for r in sample), np.float64).reshape(len(sample), -1)
    half, n_centroids = x.shape[1] // 2, max(1, min(centroids, len(x) // 8))
    halves = slice(None, half), slice(half, None)
    books = [kmeans(x[:, h], n_centroids) for h in halves]

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                y = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float64).reshape(batch.num_rows, -1)
                c1, c2 = (nearest(y[:, h], b) for h, b in zip(halves, books, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((c1 * n_centroids + c2).astype(np.int64)), batch.column(2)], names=["entry", "vid", "cell", "vector"])

    index = scratch.keep(entries.select("entry", "vid", "vector").mapInArrow(tidy(assign), "entry long, vid long, cell long, vector binary"), "index")
    sizes = np.zeros(n_centroids**2, np.int64)
    for r in index.groupBy("cell").count().collect():  # a row for each pair of centroids at most
        sizes[r["cell"]] = r["count"]
    total = int(sizes.sum())
    enough = int(np.ceil(share * total)) if share is not None else _calibrated(index, books, halves, sizes, k)
    enough = max(enough, 4 * (k + 1))

    # Slabs: the entries of one first centroid, in as many parts as its number asks for.
    chunks = np.maximum(1, -(-sizes.reshape(n_centroids, -1).sum(1) // SLAB))
    c1 = F.floor(F.col("cell") / n_centroids)
    parts = F.element_at(F.array(*(F.lit(int(c)) for c in chunks)), (c1 + 1).cast("int"))
    slab = F.shiftleft(c1, CHUNK_BITS) + F.pmod(F.xxhash64("entry"), parts.cast("long"))
    types = "slab long, kind int, entry long, vid long, c2 int, vector binary, cells binary"
    placed = index.select(slab.alias("slab"), F.lit(0).alias("kind"), "entry", "vid", F.pmod("cell", F.lit(n_centroids)).cast("int").alias("c2"), "vector", F.lit(None).cast("binary").alias("cells"))

    # Queries with equal vectors are one search.
    own = scratch.keep(rows.where(query_filter(F.col("id"))).join(entries.select("vector", "entry"), "vector").select(F.col("id").alias("query_id"), "entry"), "queries")
    asked = index.join(own.select("entry").distinct(), "entry", "left_semi").select("entry", "vector")
    visits = asked.mapInArrow(tidy(_visits(books, sizes, chunks, enough)), types)
    ordered = placed.unionByName(visits).repartition("slab").sortWithinPartitions("slab", "kind", "c2")
    found = ordered.mapInArrow(tidy(_rerank(k + 1, n_centroids)), "query long, entry long, vid long, score double")
    order = Window.partitionBy("query").orderBy("score", "vid", "entry")
    found = scratch.keep(found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1).drop("nth", "vid"), "found")
    found = found.join(entries.select("entry", F.explode("ids").alias("vec_id")), "entry").select(F.col("query").alias("entry"), "vec_id", "score")
    found = found.withColumn("nth", F.row_number().over(Window.partitionBy("entry").orderBy("score", "vec_id"))).where(F.col("nth") <= k + 1)
    out = own.join(found, "entry").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return out.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _calibrated(index: DataFrame, books, halves, sizes: np.ndarray, k: int) -> int:
    """How many entries a query must visit so that RECALL of the neighbours of PROBES entries, found by a pass over the whole index, are in the
    cells visited."""
    probes = index.orderBy(F.xxhash64(F.lit(1), "vid"), "entry").limit(PROBES).select("entry", "vector").collect()
    q = np.frombuffer(b"".join(r["vector"] for r in probes), np.float64).reshape(len(probes), -1)
    near = index.select("entry", "vid", "cell", "vector").mapInArrow(tidy(_probe(q, np.array([r["entry"] for r in probes]), k)), "probe long, cell long, score double, vid long, entry long")
    order = Window.partitionBy("probe").orderBy("score", "vid", "entry")
    near = near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).select("probe", "cell").collect()  # k rows a probe
    if not near:
        return int(sizes.sum())
    sums = [(squared(q[:, halves[0]], books[0])[:, :, None] + squared(q[:, halves[1]], books[1])[:, None, :])[i].ravel() for i in range(len(q))]
    upto = []
    for s in sums:
        cells = np.argsort(s, kind="stable")
        held = np.empty(len(cells), np.int64)
        held[cells] = np.cumsum(sizes[cells])
        upto.append(held)
    need = np.sort([upto[r["probe"]][r["cell"]] for r in near])
    return int(need[min(len(need) - 1, int(np.ceil(RECALL * len(need))))])
