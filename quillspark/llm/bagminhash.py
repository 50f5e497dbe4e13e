"""Near-duplicate documents by BagMinHash: signatures of multisets of word shingles, banding, and exact verification.

A shingle that a text has w times is the interval [0, w) of a weight axis, cut into the dyadic levels [0, 1), [1, 2), [2, 4), [4, 8)...
On each level of each shingle lies a Poisson process in time, of a rate that is the level's width; every point has a time, a place
on the level and a register. A text sees the points whose place is below w. A register's value is the earliest time seen in it, and
two texts agree in a register with a probability that is exactly their weighted Jaccard similarity. Points come in order of time,
and a process stops once it is later than all registers of its text, so a text costs about as many points as it has shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, sized, tidy
from .linking import buckets, link, to_blobs
from .textkern import U, chunks, mix, occurrences, shared_powers, signed, word_shingles

WORDS, THRESHOLD = 5, 0.8
#: 24 bands of 5 registers: a pair of similarity 0.8 is missed with a probability below 1e-4.
BANDS, ROWS = 24, 5
GOLD = U(0x9E3779B97F4A7C15)


def signatures(owner: np.ndarray, h: np.ndarray, count: np.ndarray, n: int, registers: int) -> np.ndarray:
    """float64 (n, registers): the earliest time in each register; infinite for texts without shingles."""
    sig = np.full(n * registers, np.inf)
    parts, level, at = [], 0, np.arange(len(h))
    while len(at):
        low, width = (0, 1) if level == 0 else (1 << level - 1, 1 << level - 1)
        parts.append((owner[at], mix(h[at] + mix(np.array([level + 1], U))), np.full(len(at), float(width)), (count[at] - low).astype(np.float64)))
        level += 1
        at = at[count[at] > (1 << level - 1)]
    if not parts:
        return sig.reshape(n, registers)
    own, seed, width, seen = (np.concatenate(x) for x in zip(*parts, strict=True))
    time, nth = np.zeros(len(own)), 1
    top = np.full(n, np.inf)
    while len(own):
        g = int(min(64, max(1, 65536 // len(own))))  # points a process makes at once, more as fewer processes are left
        state = mix(seed[:, None] + (U(nth) + np.arange(g, dtype=U)) * GOLD)
        gaps = -np.log(((state >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / width[:, None]
        gaps[:, 0] += time
        times = np.cumsum(gaps, axis=1)
        draw = mix(state ^ U(0xA0761D6478BD642F))
        register = ((draw >> U(40)) * U(registers) >> U(24)).astype(np.int64)
        place = (draw & U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * width[:, None]
        ok = (place < seen[:, None]) & (times < top[own][:, None])
        np.minimum.at(sig, (own[:, None] * registers + register)[ok], times[ok])
        mark = np.zeros(n, bool)
        mark[own] = True
        busy = np.flatnonzero(mark)
        top[busy] = sig.reshape(n, registers)[busy].max(1)
        time, nth = times[:, -1], nth + g
        on = time < top[own]
        own, seed, width, seen, time = own[on], seed[on], width[on], seen[on], time[on]
    return sig.reshape(n, registers)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """uint64 (n, bands): a key for each band, different from band to band."""
    bits = np.ascontiguousarray(sig).view(U).reshape(len(sig), bands, rows)
    keys = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U)), bits.shape[:2]).copy()
    for r in range(rows):
        keys = mix(keys * GOLD + bits[:, :, r])
    return keys


def _features(batches):
    powers = shared_powers()
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for lo, hi in chunks(texts):
            owner, h, w1, w2 = word_shingles(texts[lo:hi], WORDS, powers)
            size = np.bincount(owner, minlength=hi - lo)
            own, h, count = occurrences(owner, h)
            keys = signed(band_keys(signatures(own, h, count, hi - lo, BANDS * ROWS), BANDS, ROWS))
            cols = [ids.slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(size, pa.int64()), pa.array(signed(w1)), pa.array(signed(w2))]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(np.ascontiguousarray(keys[:, b])) for b in range(BANDS)], names=["doc_id", "tag", "size", "w1", "w2"] + [f"b{b}" for b in range(BANDS)])


def _payload(batches):
    """(id, w1, w2, text) -> (id, sorted hashes of (shingle, occurrence)), whose set Jaccard is the shingles' multiset Jaccard, of the texts
    whose word sequences have the digest w1, w2."""
    powers = shared_powers()
    for batch in batches:
        ids, w1, w2, texts = batch.column(0), *(signed(batch.column(k).to_numpy()) for k in (1, 2)), batch.column(3).to_pylist()
        for lo, hi in chunks(texts):
            owner, h, d1, d2 = word_shingles(texts[lo:hi], WORDS, powers)
            sought = (signed(d1) == w1[lo:hi]) & (signed(d2) == w2[lo:hi])
            own, h, count = occurrences(owner, h)
            total = int(count.sum())
            nth = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
            own, h = np.repeat(own, count), mix(np.repeat(h, count) + nth.astype(U) * GOLD)
            order = np.lexsort((h, own))
            out = pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(to_blobs(own[order], h[order], hi - lo), pa.binary())], names=["id", "payload"])
            yield out if sought.all() else out.filter(pa.array(sought))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tag: Column | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, class_id, n_shingles, kept, and with `tag`, a long that tells rows apart, that too.

    Two documents are linked if the multisets of their runs of five words have a weighted Jaccard similarity of 0.8 or more; a class is
    a connected component, class_id its smallest doc_id. Words are runs of letters, digits, underscores and characters beyond
    ASCII, in lower case; a text of one to four words has one shingle of them all. Null counts as the empty text; documents
    without words are classes of their own. A row without an id has a null class and is kept. Each row goes with its own words, whatever rows share its id; of each class one
    row is kept, one of those with its smallest id (a text without words is a class with the rows of its id that have none either). Other columns are ignored; an empty
    table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "bagminhash")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (F.lit(None) if tag is None else tag).cast("long").alias("tag"))
    keys = [f"b{b}" for b in range(BANDS)]
    features = scratch.keep(rows.mapInArrow(tidy(_features), "doc_id long, tag long, size long, w1 long, w2 long, " + ", ".join(f"{k} long" for k in keys)), "features")
    # equal word sequences are one item: copies, however many, meet in a count
    items = features.where("size > 0 and doc_id is not null").groupBy("w1", "w2").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"), *(F.first(k).alias(k) for k in keys))
    items = scratch.keep(items.withColumn("id", F.monotonically_increasing_id()), "items")
    members = items.select(F.explode(F.array(*keys)).alias("key"), "id")

    def payload_of(ids: DataFrame) -> DataFrame:
        sought = items.select("id", "w1", "w2", F.col("first_doc").alias("doc_id")).join(sized(ids), "id", "left_semi")
        sought = scratch.keep(sought, "sought")
        return rows.join(sized(sought), "doc_id").select("id", "w1", "w2", "text").mapInArrow(tidy(_payload), "id long, payload binary")

    comps = link(scratch, buckets(scratch, [members]), payload_of, THRESHOLD)
    # only items with copies or links need more than their own id
    linked = items.select("w1", "w2", "id", "first_doc", "copies").join(comps, "id", "left").where("copies > 1 or comp is not null")
    linked = scratch.keep(linked.drop("id"), "linked")
    first = scratch.keep(linked.where("comp is not null").groupBy("comp").agg(F.min("first_doc").alias("class")), "first")
    classes = scratch.keep(linked.join(sized(first), "comp", "left").select("w1", "w2", F.coalesce("class", "first_doc").alias("class")), "classes")
    scratch.drop("items", "sought", "linked", "first")
    out = features.select("doc_id", "tag", "size", "w1", "w2").join(sized(classes), ["w1", "w2"], "left")
    class_id = F.when((F.col("size") > 0) & F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id")).otherwise(F.col("doc_id"))
    # rows that share their class's smallest id: the first by words and tag stays, or, of those alike in both, the first of the table
    twice = features.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    twice = scratch.keep(twice, "twice")
    own = ["doc_id", class_id.alias("class_id"), F.col("size").alias("n_shingles"), F.coalesce(class_id == F.col("doc_id"), F.lit(True)).alias("kept"), "tag"]
    shown = ["doc_id", "class_id", "n_shingles", "kept"] + ["tag"] * (tag is not None)
    if twice.isEmpty():
        return out.select(*own).select(*shown)
    out = scratch.keep(out.select(*own, "w1", "w2", F.monotonically_increasing_id().alias("nth")), "rows")
    order = F.struct((F.col("n_shingles") > 0).alias("words"), "w1", "w2", "tag", "nth")
    heads = out.where("kept").join(sized(twice), "doc_id", "left_semi").groupBy("doc_id", (F.col("n_shingles") > 0).alias("words")).agg(F.min(order).alias("head"))
    heads = scratch.keep(heads.select(F.col("head.nth").alias("nth"), F.lit(True).alias("first")), "heads")
    out = out.join(sized(twice.withColumn("again", F.lit(True))), "doc_id", "left").join(sized(heads), "nth", "left")
    return out.withColumn("kept", F.col("kept") & (F.col("again").isNull() | F.col("first").isNotNull())).select(*shown)
