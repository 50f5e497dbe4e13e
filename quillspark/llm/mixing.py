"""Mixing sources to target weights by temperature, on DataFrame functions only.

Source i with a share p_i of the tokens gets the weight p_i**a / sum_j p_j**a. The exponent a is found by bisection, so that the
weights have a target entropy, or so that no source is repeated more often than a limit. Each source's budget of tokens is then
dealt out as whole passes over its documents and one part of a pass. Every pass is another permutation (documents in order of a
hash of seed, pass and id), and the stream is cut into blocks over which every source is spread in proportion to its budget.

No source's rows meet in one task: totals are pre-aggregated, and the cut of the last pass is found in a histogram of the hash, in one of its 1024
cells' own histogram, and then among the rows of a cell there: a millionth of a source. What is kept of a source is one row, so each document
decides for itself.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, carry, sized

#: Cells of a histogram of the hash, and histograms one within the other.
CELLS, LEVELS = 1024, 2
#: Sections of the interval in one pass over the sources' totals; four bisections at once.
SECTIONS, PASSES = 16, 12


def tokens(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _key(source):
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), source.cast("string")))


def _measures(totals: DataFrame, grid: list[float], budget: float | None) -> list[tuple[float, float]]:
    """(entropy, largest repetition) of the weights at each exponent of the grid, from one aggregation over the totals."""
    top = F.first("ln_top")
    aggs = []
    for k, a in enumerate(grid):
        power = F.exp(F.lit(a) * F.col("ln_p"))
        aggs += [F.sum(power).alias(f"s{k}"), F.sum(power * F.lit(a) * F.col("ln_p")).alias(f"u{k}"), F.max(F.lit(a - 1.0) * F.col("ln_p")).alias(f"m{k}")]
    row = totals.agg(top.alias("ln_top"), F.first("total").alias("total"), *aggs).first()
    out = []
    for k, a in enumerate(grid):
        s = row[f"s{k}"]
        if budget is None:  # the budget that uses the most frequent source once
            repeats = math.exp(row[f"m{k}"] - (a - 1.0) * row["ln_top"])
        else:
            repeats = math.exp(row[f"m{k}"]) / s * budget / row["total"]
        out.append((math.log(s) - row[f"u{k}"] / s, repeats))
    return out


def find_exponent(totals: DataFrame, entropy: float | None, repetition: float | None, budget: float | None) -> float:
    """The exponent in [0, 1]: the largest whose entropy reaches the target, or the smallest that keeps the repetition limit. Where none
    does, the nearest end."""
    lo, hi = 0.0, 1.0
    for _ in range(PASSES):
        grid = [lo + (hi - lo) * k / SECTIONS for k in range(SECTIONS + 1)]
        measures = _measures(totals, grid, budget)
        # both measures fall with the exponent
        if entropy is not None:
            low = [a for a, (h, _) in zip(grid, measures, strict=True) if h >= entropy]
            lo, hi = (max(low), min([a for a in grid if a > max(low)], default=max(low))) if low else (0.0, 0.0)
        else:
            high = [a for a, (_, r) in zip(grid, measures, strict=True) if r <= repetition]
            lo, hi = (max([a for a in grid if a < min(high)], default=min(high)), min(high)) if high else (1.0, 1.0)
        if lo == hi:
            break
    return lo if entropy is not None else hi


def mix(docs: DataFrame, *, entropy: float | None = None, repetition: float | None = None, budget: int | None = None, block_tokens: int = 1 << 20, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, one for each time that a document is used, with n_tokens, epoch, block and slot added; the order of the mixture
    is that of (block, slot).

    Give `entropy` (in nats, of the sources' weights) or `repetition` (how often a source may be used). `budget` is the number of tokens
    of the mixture; without one it is the smallest that uses every document at least once. A source's last pass stops before the
    document that would exceed its budget. Tokens are runs of non-blank characters. A null source is a source; null and blank texts have no tokens,
    take no budget and are used like their neighbours in the permutation; a source without tokens is used once. A row without an id has its place by a hash of all
    of its columns. Rows that share a source and an id, or are alike in all columns, are used alike. An empty table gives an empty result; other columns pass through, those named like
    the added ones are replaced.
    """
    if (entropy is None) == (repetition is None):
        raise ValueError("give entropy or repetition")
    scratch = Scratch(docs.sparkSession, "mixing")
    # a row without an id goes by a hash of all of its columns
    quoted = ["`" + c.replace("`", "``") + "`" for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    id_of = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(*quoted))
    own = docs.select(_key(F.col(source_col)).alias("of_source"), id_of.alias("of_id"), tokens(F.col(text_col)).alias("n_tokens"))
    own = scratch.keep(own, "rows")
    totals = own.groupBy("of_source").agg(F.sum("n_tokens").alias("t"))
    every = totals.agg(F.sum("t").alias("total"), F.max("t").alias("most"))
    totals = scratch.keep(totals.crossJoin(F.broadcast(every)).select("of_source", "t", "total", F.ln(F.when(F.col("t") > 0, F.col("t") / F.col("total"))).alias("ln_p"), F.ln(F.when(F.col("most") > 0, F.col("most") / F.col("total"))).alias("ln_top")), "totals")
    real = totals.where("t > 0")
    a = 1.0 if real.isEmpty() else find_exponent(real, entropy, repetition, budget)

    # weights and budgets: full passes, and what is left for the last one
    power = F.exp(F.lit(a) * F.col("ln_p"))
    s = real.agg(F.sum(power).alias("s"))
    if budget is None:
        size = F.exp(F.lit(1.0 - a) * F.col("ln_top")) * F.col("total") * F.col("s")
    else:
        size = F.lit(float(budget))
    plan = totals.crossJoin(F.broadcast(s)).withColumn("size", size).withColumn("b", power / F.col("s") * F.col("size"))
    # a budget within a millionth of a token of whole passes is whole passes
    full = F.floor((F.col("b") + 1e-6 * F.greatest(F.lit(1.0), F.col("t") * 1e-6)) / F.col("t"))
    plan = plan.withColumn("full", F.when(F.col("t") > 0, full).otherwise(1)).withColumn("rest", F.greatest(F.lit(0), F.floor(F.col("b") - F.col("full") * F.col("t"))))
    plan = plan.select("of_source", "full", F.coalesce("rest", F.lit(0)).alias("rest"), F.when(F.col("t") > 0, F.col("t") / F.col("b")).otherwise(1.0).alias("rate"), F.ceil(F.coalesce("size", F.lit(0.0)) / block_tokens).alias("blocks"))
    plan = scratch.keep(plan, "plan")

    def place(epoch):
        """A place in [0, 2**62) in the permutation of a pass."""
        return F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), epoch.cast("long"), F.col("of_id")), 2)

    last = own.join(sized(plan.where("rest > 0").select("of_source", "full", "rest")), "of_source").withColumn("at", place(F.col("full")))
    # the cut of the last pass: the cell of the histogram in which it falls, the cell of that one's own histogram, and then the rows in there
    bits = int(math.log2(CELLS))
    inner, cut = last.withColumn("before", F.lit(0).cast("long")), None
    for level in range(1, LEVELS + 1):
        of_level = F.shiftright("at", 62 - level * bits)
        tally = inner.groupBy("of_source", of_level.alias("cell")).agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"), F.first("before").alias("start"))
        upto = F.sum("n").over(Window.partitionBy("of_source").orderBy("cell"))
        tally = tally.withColumn("before", F.col("start") + upto - F.col("n")).where(F.col("before") <= F.col("rest"))
        cut = tally.groupBy("of_source").agg(F.max(F.struct("cell", "before")).alias("c")).select("of_source", F.col("c.cell").alias("cell"), F.col("c.before").alias("before"))
        cut = scratch.keep(cut, f"cut-{level}")
        inner = last.withColumn("cell", of_level).join(sized(cut), ["of_source", "cell"]).drop("cell")
    # rows of equal places come in or stay out together, so they are added up before they meet
    inner = inner.groupBy("of_source", "at", "of_id").agg(F.sum("n_tokens").alias("n_tokens"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    order = Window.partitionBy("of_source").orderBy("at", "of_id")
    inner = inner.withColumn("upto", F.sum("n_tokens").over(order) + F.col("before")).where("upto <= rest")
    stop = inner.groupBy("of_source").agg(F.max(F.struct("at", F.col("of_id").alias("id"))).alias("stop"))
    # where not even the cell's first document fits, the pass stops at the cell's start
    edge = cut.select("of_source", F.struct(F.shiftleft(F.col("cell"), 62 - LEVELS * bits).alias("at"), F.lit(-(1 << 63)).cast("long").alias("id")).alias("edge"))
    plan = scratch.keep(plan.join(edge, "of_source", "left").join(stop, "of_source", "left").withColumn("stop", F.coalesce("stop", "edge")).drop("edge"), "final")

    row, cells, _ = carry(docs, ["n_tokens", "epoch", "block", "slot"])
    rows = docs.select(row, _key(F.col(source_col)).alias("of_source"), id_of.alias("of_id"), tokens(F.col(text_col)).alias("n_tokens")).join(sized(plan), "of_source")
    key = F.struct(place(F.col("full")).alias("at"), F.col("of_id").alias("id"))
    copies = F.col("full") + F.when(F.col("stop").isNotNull() & (key <= F.col("stop")), 1).otherwise(0)
    rows = rows.withColumn("copies", copies.cast("int")).where("copies > 0")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    at = place(F.col("epoch"))
    where = (F.col("epoch") + at.cast("double") / float(1 << 62)) * F.col("rate")
    block = F.least(F.floor(where * F.col("blocks")), F.greatest(F.col("blocks") - 1, F.lit(0))).cast("long")
    slot = F.xxhash64(F.lit(seed + 1).cast("long"), F.col("epoch").cast("long"), F.col("of_id"))
    return rows.select(*cells, "n_tokens", "epoch", block.alias("block"), slot.alias("slot"))
