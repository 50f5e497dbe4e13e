"""From band keys to verified links and connected components, without listing the pairs of a bucket.

`members` has a row (key, id) for each band key of each distinct item; an item's payload unpacks to its set of 64-bit shingle hashes.
1. Every member of a bucket is compared with two of its members, picked by key and id: a number of pairs in proportion to rows.
   Each of an item's buckets picks others.
2. The verified links give components, by distributed union-find.
3. Items that share a bucket but not a component with another are compared too, so that no link between different components is lost.
   Long items meet by prefix filtering: with the hashes of all such items in one order, rare ones first, two sets of the wanted
   similarity must share one of the first few, and early enough that what follows it in both can still hold all that they must
   share. Short items meet in their buckets, unless bitmaps of their hashes prove them unlike: a bit that one of them alone has
   stands for a hash that they do not share.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, sized, tidy
from .textkern import distinct

def to_blobs(owner: np.ndarray, hashes: np.ndarray, n: int) -> list[bytes]:
    """Sorted hashes grouped by sorted owner -> a binary for each of n owners."""
    at = np.searchsorted(owner, np.arange(n + 1))
    return [hashes[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


#: 64-bit words of an item's bitmap, in which each of its hashes sets a bit.
WORDS = 16
#: Of these, words that are looked at first: with all of the rest shared, many pairs of a bucket are ruled out by them.
FIRST = 4


def _bits(sets: list[np.ndarray], words: int) -> tuple[np.ndarray, np.ndarray]:
    """A bitmap of each set, a byte a bit, and the number of hashes of each."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    bits = np.zeros((len(sets), words * 64), np.uint8)
    if len(sets):
        bits[np.repeat(np.arange(len(sets)), sizes), (np.concatenate(sets) >> np.uint64(32)).astype(np.int64) % (words * 64)] = 1
    return bits, sizes


#: Payload that is unpacked at once; items that several pairs share are unpacked once.
SLICE_BYTES = 2 << 20
#: Words of the bitmaps that are made of such a slice.
SLICE_WORDS = 16


def _similar(threshold: float, unpack):
    """(a, b, pa, pb) -> links whose sets have a Jaccard similarity of the threshold at least. Pairs that bitmaps prove unlike are not compared."""

    def run(batches):
        for batch in batches:
            step = max(500, int(SLICE_BYTES * batch.num_rows / max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                a, b, x, y = (part.column(part.schema.get_field_index(c)) for c in ("a", "b", "pa", "pb"))
                numbers: dict[bytes, int] = {}
                left = np.array([numbers.setdefault(p, len(numbers)) for p in x.to_pylist()], np.int64)
                right = np.array([numbers.setdefault(p, len(numbers)) for p in y.to_pylist()], np.int64)
                raw = unpack(list(numbers))
                bits, most = _bits(raw, SLICE_WORDS)
                maps = np.packbits(bits, axis=1).view(np.uint64)
                least = np.bitwise_count(maps).sum(1, dtype=np.int64)
                both = np.bitwise_count(maps[left] & maps[right]).sum(1, dtype=np.int64)
                may = both + np.minimum((most - least)[left], (most - least)[right]) >= threshold / (1 + threshold) * (least[left] + least[right]) - 1e-9
                sets: dict[int, np.ndarray] = {}
                keep = []
                for i in np.flatnonzero(may & (least[left] > 0) & (least[right] > 0)).tolist():
                    u, v = int(left[i]), int(right[i])
                    for k in (u, v):
                        if k not in sets:
                            sets[k] = distinct(raw[k])
                    small, large = (sets[u], sets[v]) if len(sets[u]) <= len(sets[v]) else (sets[v], sets[u])
                    if len(small) < threshold * len(large):
                        continue
                    place = np.searchsorted(large, small)
                    shared = np.count_nonzero(large.take(place, mode="clip") == small)
                    if shared / (len(small) + len(large) - shared) >= threshold:
                        keep.append(i)
                keep = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([a.take(keep), b.take(keep)], names=["a", "b"])

    return run


def as_sets(blobs: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in blobs]


#: Counters of the sketch that orders hashes by how often they occur. Any order gives the same result; a good one gives it sooner.
SKETCH_BITS = 20


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _sketch(unpack):
    """(payload) -> (cell, n): how many of this task's hashes are in each cell."""

    def run(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                sets = unpack(batch.column(0).slice(at, 1000).to_pylist())
                total += np.bincount(_cells(np.concatenate(sets)), minlength=len(total))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    return run


def _prefixes(sketch: np.ndarray, threshold: float, unpack):
    """(id, comp, few, payload) -> (token, id, comp, few, size, left): the first hashes of each set in the order of the sketch."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                token, n, sizes = [np.zeros(0, np.uint64)], [], []
                for s in unpack(part.column(part.schema.get_field_index("payload")).to_pylist()):
                    first = len(s) - int(np.ceil(threshold * len(s) - 1e-9)) + 1 if len(s) else 0
                    token.append(s[np.lexsort((s, sketch[_cells(s)]))[:first]])
                    n.append(first)
                    sizes.append(len(s))
                at_row = pa.array(np.repeat(np.arange(len(n)), n))
                cols = [part.column(part.schema.get_field_index(c)).take(at_row) for c in ("id", "comp", "few")]
                # what a set has from a hash on bounds what it can share with a set that it shares none before with
                left = np.repeat(np.array(sizes, np.int64), n) - (np.arange(sum(n)) - np.repeat(np.cumsum(n) - n, n))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64)), *cols, pa.array(np.repeat(np.array(sizes, np.int64), n)), pa.array(left.astype(np.int64))], names=["token", "id", "comp", "few", "size", "left"])

    return run


def _bitmaps(unpack):
    """(id, comp, few, payload) -> (id, comp, few, size, slack, rest, w0, w1, ...); slack is the size less the number of bits, rest the bits after the FIRST words."""
    names = ["id", "comp", "few", "size", "slack", "rest", *(f"w{k}" for k in range(WORDS))]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                bits, sizes = _bits([distinct(s) for s in unpack(part.column(part.schema.get_field_index("payload")).to_pylist())], WORDS)
                words = np.packbits(bits, axis=1).view(np.int64)
                cols = [part.column(part.schema.get_field_index(c)) for c in names[:3]] + [pa.array(sizes), pa.array(sizes - bits.sum(1, dtype=np.int64)), pa.array(bits[:, FIRST * 64 :].sum(1, dtype=np.int64))]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(np.ascontiguousarray(words[:, k])) for k in range(WORDS)], names=names)

    return run


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """(id, comp) of every id in links (a, b), comp being the smallest id that is reachable. In each round a node takes the smallest of itself and
    its neighbours, then what that one has taken; edges are rewritten to the new names and those that became loops or repeats go, so later
    rounds are small. Each round is written to the shared folder."""
    edges = scratch.keep(links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-edges-0")
    labels = None
    for i in range(1, 200):
        near = edges.select(F.col("u").alias("id"), F.col("v").alias("next")).union(edges.select(F.col("v").alias("id"), F.col("u").alias("next")))
        step = scratch.keep(near.groupBy("id").agg(F.min("next").alias("low")).select("id", F.least("id", "low").alias("mid")), f"{name}-step-{i}")
        up = step.select(F.col("id").alias("mid"), F.col("mid").alias("comp"))
        new = scratch.keep(step.join(up, "mid").select("id", "comp"), f"{name}-new-{i}")
        if labels is None:
            labels = new
        else:
            renamed = new.select(F.col("id").alias("comp"), F.col("comp").alias("to"))
            labels = scratch.keep(labels.join(renamed, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")), f"{name}-labels-{i}")
        left, right = new.select(F.col("id").alias("u"), F.col("comp").alias("cu")), new.select(F.col("id").alias("v"), F.col("comp").alias("cv"))
        moved = edges.join(left, "u").join(right, "v").where("cu <> cv").select(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).distinct()
        edges = scratch.keep(moved, f"{name}-edges-{i}")
        scratch.drop(f"{name}-edges-{i - 1}", f"{name}-step-{i}", f"{name}-labels-{i - 1}", *([f"{name}-new-{i}"] if i > 1 else []))
        if edges.isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def buckets(scratch: Scratch, turns: list[DataFrame], repeats: bool = False) -> list[DataFrame]:
    """A table for each turn: (key, id, low, high) of the members (key long, id long) of buckets of several ids, with the two members that all others are compared
    with. `turns`: tables of members that share no keys, taken one after the other; `repeats`: rows of one may be alike, they become one."""
    # the order of id xor key is another one in each bucket, and can be undone
    mixed = F.col("id").bitwiseXOR(F.col("key"))
    acts = []
    for k, members in enumerate(turns):
        picks = members.groupBy("key").agg(F.min(mixed).alias("low"), F.max(mixed).alias("high")).where("low <> high")
        picks = scratch.keep(picks.select("key", F.col("low").bitwiseXOR(F.col("key")).alias("low"), F.col("high").bitwiseXOR(F.col("key")).alias("high")), f"picks-{k}")
        scratch.drop()
        act = members.select("key", "id").join(sized(picks), "key")
        acts.append(scratch.keep(act.distinct() if repeats else act, f"act-{k}"))
        scratch.drop(f"picks-{k}")
    return acts


def link(scratch: Scratch, turns: list[DataFrame], payload_of: Callable[[DataFrame], DataFrame], threshold: float, unpack=as_sets, by_prefixes: bool = True) -> DataFrame:
    """(id, comp) of the ids that are linked to another. turns: what `buckets` returns; payload_of maps a kept table of ids to (id,
    payload binary); unpack turns a list of payloads into arrays of 64-bit hashes, sorted and distinct if `by_prefixes`."""
    act = reduce(DataFrame.union, turns)
    ids = scratch.keep(act.select("id").distinct(), "ids")
    payload = scratch.keep(payload_of(ids), "payload")
    if payload.count() > ids.count():  # rows that repeat an item
        payload = scratch.keep(payload.dropDuplicates(["id"]), "payload-once")

    def pairs(rows: DataFrame) -> DataFrame:
        return rows.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def verified(rows: DataFrame, name: str) -> DataFrame:
        left = payload.select(F.col("id").alias("a"), F.col("payload").alias("pa"))
        right = payload.select(F.col("id").alias("b"), F.col("payload").alias("pb"))
        found = rows.join(right, "b").join(left, "a").select("a", "b", "pa", "pb")
        return scratch.keep(found.mapInArrow(tidy(_similar(threshold, unpack)), "a long, b long"), name)

    reps = act.where("id <> low").select(F.col("low").alias("x"), F.col("id").alias("y")).union(act.where("id <> high").select(F.col("high").alias("x"), F.col("id").alias("y")))
    seen = scratch.keep(pairs(reps), "pairs")
    links = verified(seen, "links")
    scratch.drop()
    comps = components(scratch, links, "first")

    placed = scratch.keep(act.select("key", "id").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id")), "placed")
    scratch.drop(*(f"act-{k}" for k in range(len(turns))))
    # with up to three members all pairs have been compared
    # (what is joined by a bucket's key is written first, so that no join is tied to an aggregation's partitions and hot ones can be split)
    unlike = placed.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count("*").alias("n")).where("least <> most and n > 3").select("key")
    unlike = scratch.keep(unlike, "unlike")
    open_ = scratch.keep(placed.join(sized(unlike), "key"), "open")
    scratch.drop("placed", "unlike")
    # Members of a bucket's largest component need not look for others: the others look for them.
    sizes = open_.groupBy("key", "comp").agg(F.count("*").alias("n"))
    core = scratch.keep(sizes.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("c")).select("key", F.col("c.comp").alias("core")), "core")
    items = open_.join(sized(core), "key").groupBy("id", "comp").agg(F.max(F.col("comp") != F.col("core")).alias("few"))
    items = scratch.keep(items, "items-open")
    done = ("ids", "payload", "payload-once", "pairs", "links", "open", "core", "items-open")
    if items.isEmpty():
        scratch.drop(*done)
        return comps
    rows = items.join(payload, "id").select("id", "comp", "few", "payload")
    if by_prefixes:
        # a row for each cell at most
        cells = rows.select("payload").mapInArrow(tidy(_sketch(unpack)), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        sketch[cells["cell"].to_numpy()] = cells["n"].to_numpy()
        tokens = scratch.keep(rows.mapInArrow(tidy(_prefixes(sketch, threshold, unpack)), "token long, id long, comp long, few boolean, size long, left long"), "tokens")
        few = tokens.where("few").select("token", F.col("id").alias("x"), F.col("comp").alias("cx"), F.col("size").alias("sx"), F.col("left").alias("lx"))
        many = tokens.select("token", F.col("id").alias("y"), F.col("comp").alias("cy"), F.col("size").alias("sy"), F.col("left").alias("ly"))
        shared = threshold / (1 + threshold) * (F.col("sx") + F.col("sy")) - 1e-9
        near = (F.col("cx") != F.col("cy")) & (F.least("lx", "ly") >= shared) & (F.least("sx", "sy") >= shared)
        found = few.join(many, "token").where(near).select("x", "y")
    else:
        maps = ", ".join(f"w{k} long" for k in range(WORDS))
        maps = scratch.keep(rows.mapInArrow(tidy(_bitmaps(unpack)), f"id long, comp long, few boolean, size long, slack long, rest long, {maps}"), "bitmaps")
        sides = open_.select("key", "id").join(maps, "id")
        few = sides.where("few").select("key", *(F.col(c).alias(f"x_{c}") for c in maps.columns))
        many = sides.select("key", *(F.col(c).alias(f"y_{c}") for c in maps.columns))
        # a bit that one side alone has stands for a hash that the sides do not share: its size less those bits bounds what it shares
        both = [F.bit_count(F.col(f"x_w{k}").bitwiseAND(F.col(f"y_w{k}"))) for k in range(WORDS)]
        may_share = reduce(add, both[:FIRST]) + F.least("x_rest", "y_rest") + F.least("x_slack", "y_slack")
        can_share = reduce(add, both) + F.least("x_slack", "y_slack")
        shared = threshold / (1 + threshold) * (F.col("x_size") + F.col("y_size")) - 1e-9
        near = (F.col("x_comp") != F.col("y_comp")) & (F.least("x_size", "y_size") >= shared) & (may_share >= shared) & (can_share >= shared)
        found = few.join(many, "key").where(near).select(F.col("x_id").alias("x"), F.col("y_id").alias("y"))
    rest = scratch.keep(pairs(found).join(seen, ["a", "b"], "left_anti"), "rest")
    more = verified(rest, "more")
    if not more.isEmpty():
        comps = components(scratch, links.union(more), "all")
    scratch.drop(*done, "tokens", "bitmaps", "rest", "more")
    return comps
