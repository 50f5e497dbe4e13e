"""Link graphs: PageRank, HITS, breadth-first frontiers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segments import shared_folder


def _cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage of an iteration by a checkpoint in spark.checkpoint.dir, or, where that is unset and all runs on this machine, in a temporary folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = tempfile.mkdtemp(prefix="quillspark-")
        context.setCheckpointDir(path)
    return df.checkpoint()


def _delete(spark, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _drop(*tables: DataFrame) -> None:
    """Deletes what `_cut` wrote of tables that no later step reads, and lets go of the shuffle files of steps that are done."""
    for df in tables:
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            _delete(df.sparkSession, file.get())
    for df in tables[:1]:
        df.sparkSession._jvm.System.gc()  # shuffle files go once the driver has collected what refers to them


def weighted_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, w): an edge's multiplicity over its source's out-degree. The degree counts all references, repeated and unknown ones too."""
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    merged = edges.groupBy("src", "dst").agg(F.count("*").alias("m"))
    known = nodes.select(F.col("id").alias("dst"))
    return merged.join(known, "dst", "left_semi").join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(degree, "src").select("src", "dst", (F.col("m") / F.col("degree")).alias("w"))


def teleports(nodes: DataFrame, preferences: DataFrame | None, damping: float) -> DataFrame:
    """(id, base): the uniform share and, on top of it, the preferred one. Ids that are no nodes count in the sum only; a sum of 0 is ignored."""
    n = nodes.agg(F.count("*").alias("n"))
    rows = nodes.select("id").join(F.broadcast(n))
    base = F.lit(1 - damping) / F.col("n")
    if preferences is None:
        return rows.select("id", base.alias("base"), (1 / F.col("n")).alias("score"))
    prefs = preferences.groupBy("id").agg(F.sum("preference").alias("preference"))
    total = prefs.agg(F.sum("preference").alias("total"))
    rows = rows.join(prefs, "id", "left").join(F.broadcast(total))
    extra = F.coalesce(F.lit(1 - damping) * F.try_divide("preference", "total"), F.lit(0.0))
    return rows.select("id", (base + extra).alias("base"), (1 / F.col("n")).alias("score"))


def pagerank_step(scores: DataFrame, edges: DataFrame, damping: float = 0.85) -> DataFrame:
    """(id, base, score, was) after one update of (id, base, score)."""
    given = edges.join(scores.select(F.col("id").alias("src"), "score"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") * F.col("score")).alias("got"))
    return scores.join(given, "id", "left").select("id", "base", (F.col("base") + damping * F.coalesce("got", F.lit(0.0))).alias("score"), F.col("score").alias("was"))


def pagerank(nodes: DataFrame, edges: DataFrame, preferences: DataFrame | None = None, damping: float = 0.85, tol: float = 1e-4, max_iter: int = 100, updates: int | None = None) -> DataFrame:
    """(id, score). Stops when an update moves the scores by less than tol in sum and returns those before it. With `updates`, exactly that many
    are made. Mass at nodes without references is lost."""
    edges = _cut(weighted_edges(edges, nodes))
    scores = teleports(nodes, preferences, damping)
    if updates is not None:
        for i in range(updates):
            scores = pagerank_step(scores, edges, damping).drop("was")
            scores = _cut(scores) if i % 5 == 4 else scores
        return scores.select("id", "score")
    scores = _cut(scores)
    for _ in range(max_iter):
        new = _cut(pagerank_step(scores, edges, damping))
        moved = new.agg(F.sum(F.abs(F.col("score") - F.col("was")))).first()[0] or 0.0
        if moved < tol:
            break
        scores = new.drop("was")
    return scores.select("id", "score")


def preferences_of(seeds: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(id, preference) from seeds (professor, id) and a weight for each professor; an unknown professor is an error."""
    spark = seeds.sparkSession
    w = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "professor string, weight double")
    missing = w.join(seeds.select("professor").distinct(), "professor", "left_anti").limit(1).collect()
    if missing:
        raise KeyError(missing[0]["professor"])
    return seeds.join(F.broadcast(w), "professor").groupBy("id").agg(F.sum("weight").alias("preference"))


def important(nodes: DataFrame, edges: DataFrame, k: int = 10, **options) -> DataFrame:
    return pagerank(nodes, edges, **options).orderBy(F.desc(F.round("score", 12)), "id").limit(k)


#: Neighbours of a node in one list.
LIST = 1 << 16


def hits(edges: DataFrame, rounds: int | None = None, max_iter: int = 1000, tol: float = 1e-8) -> DataFrame:
    """(id, hub) on an undirected graph of edges (a, b), by power iteration with scores that sum to 1. Tables are kept packed and deleted, with the shuffle files that made
    them, as soon as the next one is there."""
    spark = edges.sparkSession
    slots, folder = int(spark.conf.get("spark.sql.shuffle.partitions")), shared_folder(spark, "hits")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        spark._jvm.System.gc()
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    edges = kept(edges.select("a", "b"), "edges")
    nodes = edges.select(F.col("a").alias("name")).union(edges.select(F.col("b").alias("name"))).where("name is not null").distinct()
    nodes = kept(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    half = kept(edges.join(nodes.select(F.col("name").alias("a"), F.col("id").alias("src")), "a").select("src", "b"), "half")
    pairs = kept(half.join(nodes.select(F.col("name").alias("b"), F.col("id").alias("dst")), "b").select("src", "dst"), "pairs")
    _delete(spark, f"{folder}/half")
    _delete(spark, f"{folder}/edges")
    both = pairs.select(F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))))
    # neighbours as lists of about LIST at most; they stay where they are dealt to, only scores move
    lists = both.groupBy("src").agg(F.ceil(F.count("*") / LIST).alias("lists"))
    near = both.join(lists, "src").groupBy("src", F.expr("pmod(dst, lists)").alias("list")).agg(F.collect_set("dst").alias("dsts")).select("src", "dsts")
    table = f"quill_{uuid.uuid4().hex[:16]}"
    near.repartition(slots, "src").write.option("compression", "zstd").bucketBy(slots, "src").option("path", f"{folder}/near").saveAsTable(table)
    near = spark.table(table)
    _delete(spark, f"{folder}/pairs")
    spark._jvm.System.gc()
    hub = nodes.select("id").join(F.broadcast(nodes.agg(F.count("*").alias("n")))).select("id", (1 / F.col("n")).alias("hub"))

    def step(of: DataFrame) -> DataFrame:
        given = near.join(of.withColumnRenamed("id", "src"), "src").select(F.explode("dsts").alias("id"), "hub")
        return _cut(given.groupBy("id").agg(F.sum("hub").alias("hub")))

    was = []
    for i in range(rounds or max_iter):
        # scaled once a round, on a table that is cut, so that no plan holds a step twice
        first = step(hub)
        spark._jvm.System.gc()
        last = step(first)
        new = last.join(F.broadcast(last.agg(F.max("hub").alias("top")))).select("id", (F.col("hub") / F.col("top")).alias("hub"))
        done = False
        if not rounds:
            moved = new.join(hub.withColumnRenamed("hub", "was"), "id").agg(F.sum(F.abs(F.col("hub") - F.col("was")))).first()[0] or 0.0
            done = bool(i) and moved < tol
        _drop(first, *was)
        hub, was = new, [last]
        if done:
            break
    spark.sql(f"DROP TABLE {table}")
    _delete(spark, f"{folder}/near")
    total = hub.agg(F.sum("hub").alias("total"))
    return hub.join(nodes, "id").join(F.broadcast(total)).select(F.col("name").alias("id"), (F.col("hub") / F.col("total")).alias("hub"))


def top_authors(edges: DataFrame, n: int = 10, rounds: int | None = None) -> DataFrame:
    """The n authors with the highest hub scores on the graph of edges (author, paper_id); ties by name."""
    named = edges.select(F.struct(F.lit(True).alias("is_author"), F.col("author").cast("string").alias("name")).alias("a"), F.struct(F.lit(False).alias("is_author"), F.col("paper_id").cast("string").alias("name")).alias("b"))
    scores = hits(named, rounds).where("id.is_author")
    return scores.select(F.col("id.name").alias("author"), "hub").orderBy(F.desc(F.round("hub", 9)), "author").limit(n)


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, cap: int | None = None) -> DataFrame:
    """(id, depth) of what is reachable from seeds (id), level by level, until nothing new, max_depth, or cap nodes (whole levels, then the
    smallest ids of the last)."""
    edges = _cut(edges.select("src", "dst").distinct())
    seen = _cut(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    front, depth = seen, 0
    while (max_depth is None or depth < max_depth) and (cap is None or seen.count() < cap):
        depth += 1
        front = edges.join(front.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        front = _cut(front.withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = _cut(seen.union(front))
    return seen.orderBy("depth", "id").limit(cap) if cap is not None else seen
