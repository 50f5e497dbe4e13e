"""Dense vectors: nearest documents, k-means, cluster quality, topics."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import l2_distance
from . import text


def similar(vectors: DataFrame, vec_id: int, n: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, distance): the n vectors nearest to that of vec_id, itself excepted; ties to the smaller id."""
    target = vectors.where(F.col(id_col) == vec_id).select(F.col(vector_col).alias("target")).limit(1)
    rows = vectors.where(F.col(id_col) != vec_id).join(F.broadcast(target))
    return rows.select(F.col(id_col).alias("vec_id"), l2_distance(F.col(vector_col), F.col("target")).alias("distance")).orderBy(F.round("distance", 9), "vec_id").limit(n)


def random_similar(vectors: DataFrame, n: int = 10, seed: int = 0, id_col: str = "vec_id") -> DataFrame:
    """`similar` to a document that is picked at random: the one whose id has the smallest hash under the seed."""
    picked = vectors.select(id_col).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), id_col).first()
    return similar(vectors, picked[0] if picked else -1, n, id_col)


def assign(vectors: DataFrame, centers: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance): the nearest of centers (cluster, center), ties to the smaller cluster. There are k centers, so they travel as
    one array and no pairs are made."""
    all_ = centers.agg(F.array_sort(F.collect_list(F.struct("cluster", "center"))).alias("centers"))
    v = F.col(vector_col).cast("array<double>")
    near = F.array_min(F.transform("centers", lambda c: F.struct(F.round(l2_distance(v, c["center"]), 12).alias("distance"), c["cluster"].alias("cluster"))))
    return vectors.join(F.broadcast(all_)).select(F.col(id_col).alias("vec_id"), near.alias("near")).select("vec_id", "near.cluster", "near.distance")


def centroids(vectors: DataFrame, assignment: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(cluster, center): means by dimension."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.posexplode(F.col(vector_col).cast("array<double>")).alias("dim", "x")).join(assignment.select("vec_id", "cluster"), "vec_id")
    means = rows.groupBy("cluster", "dim").agg(F.avg("x").alias("x"))
    return means.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("c")).select("cluster", F.col("c.x").alias("center"))


def kmeans_step(vectors: DataFrame, centers: DataFrame, **cols) -> DataFrame:
    """(cluster, center) after one round of Lloyd's algorithm; an empty cluster keeps its center."""
    new = centroids(vectors, assign(vectors, centers, **cols), **cols).withColumnRenamed("center", "new")
    return centers.join(new, "cluster", "left").select("cluster", F.coalesce("new", F.col("center").cast("array<double>")).alias("center"))


def _matrix(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow column of lists as rows of `width` values, and which of them are there. Null vectors have no row."""
    flat = column.flatten()
    if not column.null_count and not flat.null_count and all(np.diff(column.offsets.to_numpy()) == width):
        x = flat.to_numpy().reshape(-1, width)
        return x, np.ones(x.shape, bool)
    rows = [(r + [None] * width)[:width] for r in column.to_pylist() if r is not None]
    return np.array(rows, float).reshape(-1, width), np.array([[e is not None for e in r] for r in rows], bool).reshape(-1, width)


def _nearest(x: np.ndarray, squares: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The nearest center by the rule of `assign`. One product settles rows whose second best is clearly farther; the others are measured one by one."""
    far = (centers**2).sum(1)
    d = squares[:, None] + far - 2 * (x @ centers.T)
    near = d.argmin(1)
    if len(centers) > 1:
        two = np.partition(d, 1, 1)
        close = np.flatnonzero(~(two[:, 1] - two[:, 0] > 1e-9 * (1 + squares + far.max())))
        near[close] = np.round(np.stack([np.sqrt(((x[close] - c) ** 2).sum(1)) for c in centers], 1), 12).argmin(1)
    return near


def _cluster_sums(runs: list[np.ndarray]):
    """Vectors -> a task's sums and counts of each cluster's dimensions for each run's centers, by the rule of `assign`."""

    def run(batches):
        total, n = [np.zeros(c.shape) for c in runs], [np.zeros(c.shape, np.int64) for c in runs]
        for batch in batches:
            x, has = _matrix(batch.column(0), runs[0].shape[1])
            whole, squares = has.all(), (x**2).sum(1)
            full = x if whole else np.where(has, x, 0)
            for i, centers in enumerate(runs):
                near = _nearest(x, squares, centers)
                for k in range(len(centers)):
                    own = near == k
                    total[i][k] += full[own].sum(0)
                    n[i][k] += own.sum() if whole else has[own].sum(0)
        for i in range(len(runs)):
            k, dim = np.nonzero(n[i])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), i)), pa.array(k, pa.int64()), pa.array(dim, pa.int64()), pa.array(total[i][k, dim]), pa.array(n[i][k, dim])], names=["run", "k", "dim", "total", "n"])

    return run


def kmeans(vectors: DataFrame, centers: DataFrame, tol: float = 1e-8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rounds of Lloyd's algorithm, as many as it takes, until the k centers stand still. The centers (k rows) pass through the driver, the
    vectors do not: a round is that of `kmeans_step`, in one pass that sends a task's sums on."""
    return kmeans_runs(vectors, [centers], tol, id_col, vector_col)[0]


def kmeans_runs(vectors: DataFrame, starts: list[DataFrame], tol: float = 1e-8, id_col: str = "vec_id", vector_col: str = "embedding") -> list[DataFrame]:
    """`kmeans` from each of several tables of centers. A round is one pass for all runs that still move."""
    first = [c.select("cluster", F.col("center").cast("array<double>").alias("center")).orderBy("cluster").collect() for c in starts]
    now, moving = [np.array([r["center"] for r in f]) for f in first], [i for i, f in enumerate(first) if f]
    rows = vectors.select(F.col(vector_col).cast("array<double>").alias("v")).persist()
    while moving:
        sums = rows.mapInArrow(_cluster_sums([now[i] for i in moving]), "run long, k long, dim long, total double, n long").groupBy("run", "k", "dim").agg(F.sum("total") / F.sum("n"))
        new = {i: now[i].copy() for i in moving}
        for at, k, dim, x in sums.collect():
            new[moving[at]][k, dim] = x
        still = {i for i in moving if np.allclose(now[i], new[i], atol=tol, rtol=0, equal_nan=True)}
        for i in moving:
            now[i] = new[i]
        moving = [i for i in moving if i not in still]
    rows.unpersist()
    make = vectors.sparkSession.createDataFrame
    return [make([(int(r["cluster"]), c) for r, c in zip(f, end.tolist(), strict=True)], "cluster int, center array<double>") if f else start for f, end, start in zip(first, now, starts, strict=True)]


def purity(assignment: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the share of vectors that have their cluster's most frequent label. labels: (vec_id, label)."""
    cells = assignment.join(labels, "vec_id").groupBy("cluster", "label").agg(F.count("*").alias("n"))
    best = cells.groupBy("cluster").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    return best.agg((F.sum("most") / F.sum("all")).alias("purity"))


#: Vectors of one side of a cell of the grid of all pairs, and of a tile of distances within it.
CELL, TILE = 1 << 14, (512, 8192)


def _distance_sums(left: pa.Table, right: pa.Table) -> pa.Table:
    """For each vector of either side and each run its sums of distances to the other side's clusters, and their sizes there; each distance is taken once. In a cell of
    the diagonal (i, j) the left side meets itself."""
    same = left.num_rows > 0 and left.column("i")[0] == left.column("j")[0]
    right = left if same else right
    out = {name: [] for name in ("vec_id", "run", "own", "cluster", "total", "n")}
    if left.num_rows and right.num_rows:
        sides = [tuple(t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) for c in ("v", "clusters")) for t in (left, right)]
        names = [[np.unique(c[:, r]) for r in range(c.shape[1])] for _, c in sides]
        member = [np.concatenate([c[:, r, None] == n[r] for r in range(c.shape[1])], 1).astype(float) for (_, c), n in zip(sides, names, strict=True)]
        (x, _), (y, _) = sides
        total = [np.zeros((len(x), member[1].shape[1])), np.zeros((len(y), member[0].shape[1]))]
        # one product gives |a|^2 - 2ab + |b|^2
        a = np.concatenate([-2 * x, (x**2).sum(1)[:, None], np.ones((len(x), 1))], 1)
        b = np.concatenate([y, np.ones((len(y), 1)), (y**2).sum(1)[:, None]], 1).T
        for i in range(0, len(x), TILE[0]):
            for j in range(0, len(y), TILE[1]):
                if same and j + TILE[1] <= i:
                    continue  # met from the other side
                rows, cols = slice(i, i + TILE[0]), slice(j, j + TILE[1])
                d = a[rows] @ b[:, cols]
                np.sqrt(np.maximum(d, 0, out=d), out=d)
                if same and j < i + TILE[0]:  # on the diagonal: pairs beyond it only
                    d[np.arange(j, j + d.shape[1]) <= np.arange(i, i + d.shape[0])[:, None]] = 0
                total[0][rows] += d @ member[1][cols]
                total[1][cols] += d.T @ member[0][rows]
        if same:
            total = [total[0] + total[1], None]
        for side, (t, (_, mine)) in enumerate(zip((left, right), sides, strict=True)):
            if total[side] is None:
                continue
            ids, n = t.column("vec_id").to_numpy(), member[1 - side].sum(0).astype(np.int64)
            for at, (r, k) in enumerate((r, k) for r, found in enumerate(names[1 - side]) for k in found):
                for name, values in zip(out, (ids, np.full(len(ids), r), mine[:, r], np.full(len(ids), k), total[side][:, at], np.full(len(ids), n[at])), strict=True):
                    out[name].append(values)
    kinds = {"vec_id": pa.int64(), "run": pa.int32(), "own": pa.int32(), "cluster": pa.int32(), "total": pa.float64(), "n": pa.int64()}
    return pa.table({c: pa.array(np.concatenate(v) if v else np.array([], float), kinds[c]) for c, v in out.items()})


def silhouette(vectors: DataFrame, assignment: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, silhouette), exact and Euclidean, for an assignment (vec_id, cluster). A vector alone in its cluster has 0."""
    runs = assignment.select("vec_id", F.array(F.col("cluster").cast("int")).alias("clusters"))
    return silhouettes(vectors, runs, id_col, vector_col).drop("run")


def silhouettes(vectors: DataFrame, assignment: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, run, silhouette) for each of several clusterings (vec_id, clusters array<int>), from distances that are taken once for all of them and for both
    vectors. All pairs lie in the upper half of a grid of cells of at most about CELL by CELL vectors, one group each; a task holds a cell's vectors and a tile of its distances, and sums by cluster leave it, not
    pairs. The work is that of all pairs."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).join(assignment.select("vec_id", "clusters"), "vec_id")
    side = -(-vectors.count() // CELL) or 1
    rows = rows.withColumn("at", F.pmod(F.xxhash64("vec_id"), F.lit(side)))
    # pairs are alike both ways, so only cells on and above the diagonal are made
    left = rows.select(F.col("at").alias("i"), F.explode(F.sequence("at", F.lit(side - 1).cast("long"))).alias("j"), "vec_id", "clusters", "v")
    above = F.explode(F.when(F.col("at") > 0, F.sequence(F.lit(0).cast("long"), F.col("at") - 1)))
    right = rows.select(above.alias("to_i"), F.col("at").alias("to_j"), *(F.col(c).alias(c) for c in ("vec_id", "clusters", "v")))
    sums = left.groupBy("i", "j").cogroup(right.groupBy("to_i", "to_j")).applyInArrow(_distance_sums, "vec_id long, run int, own int, cluster int, total double, n long")
    by = sums.groupBy("vec_id", "run", "own", "cluster").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    own = F.col("own") == F.col("cluster")
    out = by.groupBy("vec_id", "run").agg(F.max(F.when(own, F.try_divide(F.col("total"), F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"), F.max(F.when(own, F.col("n"))).alias("size"))
    score = F.when(F.col("size") > 1, F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).otherwise(0.0)
    return out.select("vec_id", "run", score.alias("silhouette"))


#: Terms of a cluster up to which its runs are checked against them before they are counted.
FREQUENT = 1000


def topics(parts: DataFrame, stops: DataFrame | None, assignment: DataFrame, n: int = 5, upto: int = 3) -> DataFrame:
    """(cluster, topic): the n most frequent runs of one to three terms of a cluster's documents. assignment: (doc_id, cluster), of few clusters. A run is no more
    frequent than any of its terms, so terms are counted first, and only runs of terms that are no rarer than the cluster's n-th are made. Where that
    leaves more than FREQUENT terms (many ties), or a cluster has fewer than n, all runs are counted."""
    lists = text.term_lists(parts.join(assignment, "doc_id"), stops, ["cluster"])
    order = Window.partitionBy("cluster").orderBy(F.desc("n"), "gram")
    first = lists.select("cluster", F.explode("t").alias("gram")).groupBy("cluster", "gram").agg(F.count("*").alias("n"))
    first = first.withColumn("r", F.row_number().over(order)).where(F.col("r") <= FREQUENT + 1)
    first = first.groupBy("cluster").agg(F.max(F.when(F.col("r") == n, F.col("n"))).alias("least"), F.collect_list(F.struct("gram", "n")).alias("first"))
    few = F.transform(F.filter("first", lambda x: x["n"] >= F.col("least")), lambda x: x["gram"])
    few = first.select(F.col("cluster").alias("of"), F.col("least").isNotNull().alias("enough"), few.alias("few")).select("of", F.when(F.col("enough") & (F.size("few") <= FREQUENT), F.col("few")).alias("few"))
    rows = lists.join(F.broadcast(few), F.col("cluster").eqNullSafe(F.col("of")))
    counts = rows.select("cluster", text.runs(upto, F.col("few")).alias("gram")).groupBy("cluster", "gram").agg(F.count("*").alias("n"))
    top = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)
    return top.groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_list(F.struct("r", "gram")))["gram"], ", ").alias("topic"))


def ward(vectors: DataFrame, n: int = 1000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(step, a, b, height, size): Ward's linkage of at most n vectors, picked by a hash of the id. Clusters are numbered as they are made, after
    the n vectors in order of id. A sampling operator by nature: the full linkage needs all pairs."""
    sample = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).orderBy(F.xxhash64("vec_id"), "vec_id").limit(n)

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        x = np.array(pdf["v"].tolist())
        m = len(x)
        d = np.array([((x - row) ** 2).sum(1) for row in x])
        np.fill_diagonal(d, np.inf)
        size, name, alive, out = np.ones(m), np.arange(m), np.ones(m, bool), []
        for step in range(m - 1):
            i, j = divmod(int(np.argmin(np.where(alive[:, None] & alive[None, :], d, np.inf))), m)
            total = size[i] + size[j]
            out.append((step, int(min(name[i], name[j])), int(max(name[i], name[j])), float(np.sqrt(d[i, j])), int(total)))
            new = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * d[i, j]) / (total + size)
            d[i], d[:, i] = new, new
            d[i, i] = np.inf
            alive[j], size[i], name[i] = False, total, m + step
        return pd.DataFrame(out, columns=["step", "a", "b", "height", "size"])

    return sample.groupBy().applyInPandas(link, "step long, a long, b long, height double, size long")


def pca_2d(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x, y): the two principal components, the scalable stand-in for a neighbour embedding."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select(F.col(id_col).alias("vec_id"), array_to_vector(F.col(vector_col).cast("array<double>")).alias("v"))
    out = PCA(k=2, inputCol="v", outputCol="p").fit(rows).transform(rows).withColumn("p", vector_to_array("p"))
    return out.select("vec_id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
