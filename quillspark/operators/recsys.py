"""Recommendation: collaborative filtering over field counts, and content-based profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import _cut


def user_fields(likes: DataFrame) -> DataFrame:
    """(user, field, n) of likes (user, fields array, nullable): how many of a user's papers have the field; a field counts once a paper."""
    empty = F.array().cast(likes.schema["fields"].dataType)
    return likes.select("user", F.explode(F.array_distinct(F.coalesce("fields", empty))).alias("field")).groupBy("user", "field").agg(F.count("*").alias("n"))


def fields(likes: DataFrame) -> DataFrame:
    return user_fields(likes).select("field").distinct().orderBy("field")


#: Profiles that all others are measured against, the width of a ring around one, and profiles nearest to the same one that give the first guess.
PIVOTS, RING, GUESSES = 16, 0.02, 512


def _dot(a: Column, b: Column) -> Column:
    """Of two maps from fields to weights."""
    return F.aggregate(F.map_entries(a), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0.0)))


def neighbours(matrix: DataFrame, n: int = 10, queries: DataFrame | None = None, among: DataFrame | None = None) -> DataFrame:
    """(user, neighbour, similarity, rank): the n users with the most similar field counts by cosine, for the users in `queries` (user) or all, out of
    those in `among` (user) or all; ties to the smaller user. Users without a common field are no neighbours.

    Users of equal counts are one profile with its n + 1 smallest users. Profiles lie in rings around the nearest of a few pivots. A sample of those with its own pivot gives each profile a
    distance within which its neighbours are; then it meets the rings that this distance reaches, and there the profiles that no pivot rules out by the triangle
    inequality. No join is on a field, so one that every user has costs nothing more. Nothing is lost whatever the sample; profiles that are all far from each
    other rule out little.
    """
    own = matrix.groupBy("user").agg(F.array_sort(F.collect_list(F.struct("field", "n"))).alias("profile"))
    listed = own if among is None else own.join(among.select("user").distinct(), "user", "left_semi")
    first = listed.withColumn("nth", F.row_number().over(Window.partitionBy("profile").orderBy("user"))).where(F.col("nth") <= n + 1)
    members = first.groupBy("profile").agg(F.array_sort(F.collect_list("user")).alias("users"))
    norm = F.sqrt(F.aggregate("profile", F.lit(0.0), lambda s, e: s + e["n"].cast("double") * e["n"].cast("double")))
    unit = F.map_from_entries(F.transform("profile", lambda e: F.struct(e["field"].alias("field"), (e["n"] / norm).alias("w"))))
    profiles = own.select("profile").distinct().join(members, "profile", "left").select(F.monotonically_increasing_id().alias("pid"), "profile", "users", unit.alias("v"))
    profiles = _cut(profiles)
    pivots = profiles.orderBy(F.xxhash64("profile"), "pid").limit(PIVOTS).agg(F.collect_list("v").alias("pivots"))
    distance = lambda dot: F.sqrt(F.greatest(2 - 2 * dot, F.lit(0.0)))
    away = F.transform("pivots", lambda p: distance(_dot(F.col("v"), p)))
    placed = profiles.join(F.broadcast(pivots)).withColumn("away", away).drop("pivots", "profile")
    placed = _cut(placed.withColumn("pivot", F.array_position("away", F.array_min("away")).cast("int") - 1).withColumn("ring", F.floor(F.array_min("away") / RING)))

    asked = own if queries is None else own.join(queries.select("user").distinct(), "user", "left_semi")
    asked = _cut(asked.join(profiles.select("profile", "pid"), "profile").select("user", "pid"))
    seekers = placed.join(asked.select("pid").distinct(), "pid", "left_semi")
    there = placed.where("users is not null").select("pivot", "ring", F.col("pid").alias("near"), F.col("v").alias("w"), F.col("away").alias("away2"), "users")
    nth = F.row_number().over(Window.partitionBy("pivot").orderBy(F.xxhash64("near"), "near"))
    guesses = there.withColumn("nth", nth).where((F.col("nth") <= GUESSES) & (F.size("w") <= 64)).select("pivot", "near", "w")  # GUESSES rows a pivot, none of them large
    guessed = seekers.select("pid", "v", "pivot").join(F.broadcast(guesses), "pivot").select("pid", _dot(F.col("v"), F.col("w")).alias("dot"))
    guessed = guessed.withColumn("nth", F.row_number().over(Window.partitionBy("pid").orderBy(F.desc("dot")))).where(F.col("nth") == n + 1)
    reach = guessed.select("pid", (distance(F.col("dot")) + 1e-4).alias("reach"))  # what is as near after rounding is within that
    seekers = seekers.select("pid", "v", "away").join(reach, "pid", "left").na.fill(2.0, ["reach"])
    reached = lambda d: F.sequence(F.floor(F.greatest(d - F.col("reach"), F.lit(0.0)) / RING), F.floor((d + F.col("reach")) / RING))
    visits = seekers.select("pid", "v", "away", "reach", F.posexplode("away").alias("pivot", "d")).withColumn("ring", F.explode(reached(F.col("d"))))
    close = F.lit(True)
    for j in range(PIVOTS):  # there may be fewer
        close = close & F.coalesce(F.abs(F.get("away", j) - F.get("away2", j)) <= F.col("reach"), F.lit(True))
    pairs = visits.join(there, ["pivot", "ring"]).where(close).select("pid", "near", "users", _dot(F.col("v"), F.col("w")).alias("similarity")).where("similarity > 0")
    order = Window.partitionBy("pid").orderBy(F.desc(F.round("similarity", 9)), F.col("users")[0])
    found = pairs.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n + 1).select("pid", "similarity", F.explode("users").alias("neighbour"))
    order = Window.partitionBy("pid").orderBy(F.desc(F.round("similarity", 9)), "neighbour")
    found = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n + 1).drop("nth")
    out = asked.join(found, "pid").where("user <> neighbour").drop("pid")
    order = Window.partitionBy("user").orderBy(F.desc(F.round("similarity", 9)), "neighbour")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("user", "neighbour", "similarity", "rank")


def collaborative(neighbours_: DataFrame, recommended: DataFrame) -> DataFrame:
    """(user, position, paper): the neighbours' lists one after another, in the neighbours' order, neither cut nor deduplicated. recommended: (user,
    papers array, nullable)."""
    lists = recommended.select(F.col("user").alias("neighbour"), F.posexplode("papers").alias("at", "paper"))
    rows = neighbours_.join(lists, "neighbour")
    position = F.row_number().over(Window.partitionBy("user").orderBy("rank", "at"))
    return rows.select("user", position.alias("position"), "paper")


def content_based(liked: DataFrame, papers: DataFrame, k: int = 10) -> DataFrame:
    """(user, rank, paper, score): each user's mean vector over liked titles, (user, title_id, term, w), against paper vectors (paper, term, w);
    the mean is not rescaled. Ties to the smaller paper."""
    n = liked.groupBy("user").agg(F.count_distinct("title_id").alias("n"))
    profile = liked.groupBy("user", "term").agg(F.sum("w").alias("w")).join(n, "user").select("user", "term", (F.col("w") / F.col("n")).alias("w"))
    scores = profile.join(papers.withColumnRenamed("w", "pw"), "term").groupBy("user", "paper").agg(F.sum(F.col("w") * F.col("pw")).alias("score"))
    order = Window.partitionBy("user").orderBy(F.desc(F.round("score", 9)), "paper")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("user", "rank", "paper", "score")
