"""Word vectors from character n-grams: skip-gram with negative sampling, trained in rounds over partitions whose models are averaged.

A word is the mean of the vectors of its n-grams, so words that training never met have vectors too. N-grams and context words share `buckets` rows each by
CRC-32, so a model has 2 * buckets * size numbers however large the corpus is; that is what the driver holds and each task gets."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import _cut

SENTENCE = 1000  # words; longer texts are trained in pieces of this length
SLICE = 256  # centre words of one step
SHARED = 32  # noise words of one step
AT_ONCE = 16  # gradients of one row that a step adds up in full
BLOCK = 64  # rows that are averaged together
WORDS = 1 << 20  # of a partition, at least, if texts are dealt to more of them
REMEMBERED = 100_000  # words whose n-grams a task keeps


def grams(word: str, buckets: int, shortest: int = 3, longest: int = 6) -> np.ndarray:
    """The rows of a word's n-grams, `<` and `>` being its ends, and of the whole word."""
    marked, crc = f"<{word}>", zlib.crc32
    raw = marked.encode()
    spans = [(i, i + n) for n in range(shortest, min(longest, len(marked) - 1) + 1) for i in range(len(marked) - n + 1)]
    if len(raw) == len(marked):
        parts = [crc(raw[i:j]) for i, j in spans]
    else:
        parts = [crc(marked[i:j].encode()) for i, j in spans]
    parts.append(crc(raw))
    return np.array(parts, np.int64) % buckets


def context(word: str, buckets: int) -> int:
    return zlib.crc32(word.encode()) % buckets


def pairs(sentence: np.ndarray, width: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(centre, other): places of words of one sentence that are at most the centre's width apart, by centre. `sentence` numbers the words' sentences."""
    at = np.arange(len(sentence))
    centres, others = [], []
    for d in range(1, window + 1):
        same = sentence[d:] == sentence[:-d]
        left, right = at[:-d][same], at[d:][same]
        for a, b in ((left, right), (right, left)):
            near = width[a] >= d
            centres.append(a[near])
            others.append(b[near])
    centre, other = np.concatenate(centres), np.concatenate(others)
    order = np.argsort(centre, kind="stable")
    return centre[order], other[order]


def _sums(values: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of values[rows] over segments of `rows` of so many (one at least) each: the first rows of all segments, then the second ones, and so on, which is several
    times faster on short segments than a reduction along the first axis."""
    by = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[by]
    more = len(sizes) - np.cumsum(np.bincount(sizes))  # segments of more than so many rows
    out = values[rows[starts]]
    for r in range(1, len(more) - 1):
        c = more[r]
        out[:c] += values[rows[starts[:c] + r]]
    back = np.empty_like(out)
    back[by] = out
    return back


def gradients(h: np.ndarray, centre: np.ndarray, positive: np.ndarray, noise: np.ndarray, negatives: int):
    """(loss, dh, dpositive, dnoise) of centre vectors h, pairs of a centre's place with its context's vector, and noise vectors that all pairs share; each
    pair meets `negatives` noise words in expectation."""
    met = (np.bincount(centre, minlength=len(h))[:, None] * (negatives / len(noise))).astype(h.dtype)
    good = np.einsum("pd,pd->p", h[centre], positive)
    bad = h @ noise.T
    loss = np.logaddexp(0, -good).sum() + (met * np.logaddexp(0, bad)).sum()
    slope = -np.exp(-np.logaddexp(0, good))
    push = met * np.exp(-np.logaddexp(0, -bad))
    dh = push @ noise
    at, n = np.unique(centre, return_counts=True)
    dh[at] += _sums(slope[:, None] * positive, np.argsort(centre, kind="stable"), n)
    return loss, dh, slope[:, None] * h[centre], push.T @ h


def _scatter(table: np.ndarray, times: np.ndarray, rows: np.ndarray, moves: np.ndarray, of: np.ndarray, weights: np.ndarray, rate: float) -> None:
    """Subtracts moves[of], each the sum of as many gradients as its weight says, from rows. All gradients of a step are taken at the same place, so a row
    moves by their sum, but by no more than AT_ONCE times their mean."""
    order = np.argsort(rows, kind="stable")
    ordered, of = rows[order], of[order]
    first = np.flatnonzero(np.diff(ordered, prepend=-1))
    own = ordered[first]
    n = np.add.reduceat(weights[of], first)
    step = _sums(moves, of, np.diff(first, append=len(rows)))
    step *= (rate / np.maximum(1, n / AT_ONCE))[:, None].astype(np.float32)
    table[own] -= step
    times[own] += np.ceil(n).astype(np.int64)


class _Trainer:
    def __init__(self, model, counts, window, negatives, rate, often, rng):
        self.model, self.window, self.negatives, self.rate, self.rng = model.copy(), window, negatives, rate, rng
        self.times = np.zeros(model.shape[:2], np.int64)
        self.buckets = model.shape[1]
        total = max(counts.sum(), 1)
        share = np.maximum(counts, 1) / total
        self.keep = np.minimum(1, np.sqrt(often / share) + often / share)
        self.noise = np.cumsum(counts**0.75) / max((counts**0.75).sum(), 1e-9)
        self.forget()

    def forget(self) -> None:
        """Words' numbers; by number the row as a context, and where the rows of the n-grams begin in `pool`."""
        self.number: dict[str, int] = {}
        self.context, self.begins, self.pool = [], [0], []

    def known(self, words: list[str]) -> np.ndarray:
        if len(self.number) >= REMEMBERED:
            self.forget()
        get, out = self.number.get, np.empty(len(words), np.int64)
        for place, word in enumerate(words):
            i = get(word)
            if i is None:
                i = self.number[word] = len(self.number)
                found = grams(word, self.buckets)
                self.context.append(context(word, self.buckets))
                self.begins.append(self.begins[-1] + len(found))
                self.pool.append(found)
            out[place] = i
        return out

    def learn(self, sentences) -> None:
        number = np.repeat(np.arange(len(sentences)), [len(s) for s in sentences])
        words = self.known([w for s in sentences for w in s])
        self.pool = [np.concatenate(self.pool)] if self.pool else []
        target = np.array(self.context, np.int64)[words]
        kept = np.flatnonzero(self.rng.random(len(words)) < self.keep[target])
        words, target, number = words[kept], target[kept], number[kept]
        if len(words) < 2:
            return
        begins, pool = np.array(self.begins), self.pool[0]
        begin, count = begins[words], (begins[1:] - begins[:-1])[words]
        centre, other = pairs(number, self.rng.integers(1, self.window + 1, len(words)), self.window)
        given, taken = self.model
        for start in range(0, len(words), SLICE):
            lo, hi = np.searchsorted(centre, [start, start + SLICE])
            if lo == hi:
                continue
            at, inside, n = np.unique(centre[lo:hi], return_inverse=True, return_counts=True)
            sizes = count[at]
            flat = pool[np.repeat(begin[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
            h = _sums(given, flat, sizes) / sizes[:, None].astype(np.float32)
            goal, noise = target[other[lo:hi]], np.searchsorted(self.noise, self.rng.random(SHARED)).clip(max=self.buckets - 1)
            _, dh, dgood, dbad = gradients(h, inside, taken[goal], taken[noise], self.negatives)
            weights = np.concatenate([np.ones(len(goal)), np.full(SHARED, len(goal) * self.negatives / SHARED)]).astype(np.float32)
            _scatter(taken, self.times[1], np.concatenate([goal, noise]), np.concatenate([dgood, dbad]), np.arange(len(goal) + SHARED), weights, self.rate)
            # each n-gram takes its word's whole step, or words of many n-grams would hardly move
            _scatter(given, self.times[0], flat, dh, np.repeat(np.arange(len(at)), sizes), n.astype(np.float32), self.rate)


@dataclass
class Subwords:
    """A trained model: n-gram vectors of shape (buckets, size)."""

    given: np.ndarray

    def vectors(self, words: DataFrame, word_col: str = "term") -> DataFrame:
        """words with a column `vector`, of known and unknown words alike; null for a null word."""
        shared = words.sparkSession.sparkContext.broadcast(self.given)

        @F.pandas_udf("array<double>")
        def of(column: pd.Series) -> pd.Series:
            table = shared.value
            return column.map(lambda w: None if w is None else table[grams(w, len(table))].mean(axis=0).astype(float))

        return words.withColumn("vector", of(word_col))

    def maker(self, spark):
        """For `learn.Pieces.embedded_by`: to be called in a task, it gives a function from terms to their vectors."""
        shared = spark.sparkContext.broadcast(self.given)

        def make():
            table = shared.value

            def of(terms: list[str]) -> np.ndarray:
                rows = [grams(t, len(table)) for t in terms]
                sizes = np.array([len(r) for r in rows])
                return _sums(table, np.concatenate(rows), sizes) / sizes[:, None].astype(np.float32)

            return of

        return make

    def neighbours(self, queries: DataFrame, words: DataFrame, k: int = 10) -> DataFrame:
        """(query, rank, term, similarity): for each of queries (query), a list that the caller bounds, the k words (term) of the largest cosine, other than
        itself; ties in alphabetical order. Each task keeps its k best for each query before the shuffle."""
        from pyspark.sql import Window

        asked = [r["query"] for r in queries.where("query IS NOT NULL").select("query").distinct().orderBy("query").collect()]
        shared = words.sparkSession.sparkContext.broadcast((self.given, asked))

        def best(batches):
            table, of = shared.value
            unit = lambda w: (lambda v: v / (np.linalg.norm(v) or 1))(table[grams(w, len(table))].astype(float).mean(axis=0))
            wanted = np.array([unit(q) for q in of]).reshape(len(of), table.shape[1])
            held = pd.DataFrame({"query": pd.Series(dtype=str), "term": pd.Series(dtype=str), "similarity": pd.Series(dtype=float)})
            for batch in batches:
                terms = batch["term"].to_numpy(object)
                if not len(terms) or not of:
                    continue
                near = np.round(wanted @ np.array([unit(t) for t in terms]).T, 9)
                pick = min(k + 1, len(terms))
                # all that reach the k-th value, so that ties are settled by name
                least = np.partition(near, len(terms) - pick, axis=1)[:, len(terms) - pick]
                q, t = np.nonzero(near >= least[:, None])
                new = pd.DataFrame({"query": np.array(of, object)[q], "term": terms[t], "similarity": near[q, t]})
                held = pd.concat([held, new[new["query"] != new["term"]]]).sort_values(["query", "similarity", "term"], ascending=[True, False, True]).groupby("query").head(k)
            yield held

        found = words.select("term").where("term IS NOT NULL").distinct().mapInPandas(best, "query string, term string, similarity double")
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "term"))
        return found.withColumn("rank", place).where(F.col("rank") <= k).select("query", "rank", "term", "similarity")

    def save(self, spark, path: str) -> None:
        rows = [(i, r.tolist()) for i, r in enumerate(self.given)]
        spark.createDataFrame(rows, "row int, vector array<float>").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> Subwords:
        rows = spark.read.parquet(path).orderBy("row").collect()
        return cls(np.array([r["vector"] for r in rows], np.float32))


def fit(texts: DataFrame, size: int = 100, rounds: int = 5, buckets: int = 1 << 16, window: int = 5, negatives: int = 5, rate: float = 0.05, often: float = 1e-3, seed: int = 1) -> Subwords:
    """A model of texts (terms array<string>). Each round every partition trains on a copy of the model, and each row becomes the mean of what the partitions made of
    it, by how often they touched it. Null and empty texts, null words and texts of one word teach nothing; without any text the model is where it started. A repeated
    run, or a task that runs again, gives the same model, as partitions are kept in spark.checkpoint.dir and seeds follow their numbers. A group of the averaging has
    one row a partition, of BLOCK * size numbers."""
    spark = texts.sparkSession
    words = F.filter("terms", lambda t: t.isNotNull())
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / SENTENCE).cast("int")), lambda i: F.slice(words, i * SENTENCE + 1, SENTENCE))
    kept = _cut(texts.where(F.size(words) > 0).select(F.explode(cut).alias("terms")))
    slots, found = spark.sparkContext.defaultParallelism, kept.rdd.getNumPartitions()
    tasks = min(slots, (kept.agg(F.sum(F.size("terms"))).first()[0] or 0) // WORDS)
    if tasks > found or tasks == slots and found % slots and found < 4 * slots:  # few large files, or a last turn that leaves many tasks idle
        kept = _cut(kept.repartition(tasks))
    counts = np.zeros(buckets)
    rows = kept.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).groupBy((F.crc32(F.col("t").cast("binary")) % buckets).alias("row")).agg(F.sum("n").alias("n"))
    for r in rows.collect():  # at most `buckets` rows
        counts[r["row"]] = r["n"]
    rng = np.random.default_rng(seed)
    model = np.stack([rng.uniform(-1 / size, 1 / size, (buckets, size)), np.zeros((buckets, size))]).astype(np.float32)
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((model, counts))
        step = rate * (1 - turn / rounds)

        def train(batches, shared=shared, step=step, turn=turn):
            task = TaskContext.get().partitionId()
            start, seen = shared.value
            own = _Trainer(start, seen, window, negatives, step, often, np.random.default_rng([seed, turn, task]))
            waiting, n = [], 0
            for batch in batches:
                for terms in batch["terms"]:
                    waiting.append(terms)
                    n += len(terms)
                    if n >= 16 * SLICE:
                        own.learn(waiting)
                        waiting, n = [], 0
            if waiting:
                own.learn(waiting)
            for side in range(2):
                for b in np.unique(np.flatnonzero(own.times[side]) // BLOCK):
                    part = slice(b * BLOCK, (b + 1) * BLOCK)
                    moved = (own.model[side, part].astype(float) - start[side, part]) * own.times[side, part][:, None]
                    yield pd.DataFrame({"side": [side], "block": [b], "task": [task], "n": [own.times[side, part].tobytes()], "moved": [moved.tobytes()]})

        def average(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("task")
            n = sum(np.frombuffer(x, np.int64) for x in rows["n"])
            moved = sum(np.frombuffer(x).reshape(-1, size) for x in rows["moved"]) / np.maximum(n, 1)[:, None]
            return pd.DataFrame({"side": rows["side"].iloc[:1], "block": rows["block"].iloc[:1], "moved": [moved.tobytes()]})

        moves = kept.mapInPandas(train, "side int, block int, task int, n binary, moved binary").groupBy("side", "block").applyInPandas(average, "side int, block int, moved binary")
        new = model.copy()
        for r in moves.collect():  # the model's own size
            new[r["side"], r["block"] * BLOCK : (r["block"] + 1) * BLOCK] += np.frombuffer(r["moved"]).reshape(-1, size)
        model = new
        shared.destroy()
    return Subwords(model[0])
