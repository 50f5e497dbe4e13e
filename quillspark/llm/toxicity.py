"""Toxicity by a classifier chain.

Categories are predicted one after another. Each has a logistic model over the presence of words and word beginnings, a few measures
of the text's form, and the log-odds of all categories before it. Later models are trained on out-of-fold predictions of the
earlier ones, so they learn how far those can be trusted. Presence, not frequency, counts: a long text does not dilute a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bagminhash import band_keys
from .common import Scratch, carry, row_type, tidy
from .fuzzy_lines import signatures as minima
from .textkern import Powers, U, WORD_BYTE, chunks, mix, shared_powers, word_shingles, words

#: Labelled rows that the chain is fitted on, at most, of each combination of labels; chosen by a hash of the id.
ROWS_PER_STRATUM = 2000
BITS, SELECTED, FOLDS = 20, 2048, 5
#: Beginnings of words, in bytes, that are features beside whole words.
PREFIXES = (4, 5, 6)
DENSE = 6
#: Standard errors by which a feature must differ between the classes.
MIN_Z = 2.0
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True


def features(texts: list[str], powers: Powers):
    """(document, feature) pairs, repeats included, and a dense (n, DENSE) block of measures of form."""
    n = len(texts)
    doc, start, end, runs = words(texts, powers)
    size = end - start
    whole = mix(runs.hashes(start, end) ^ mix(size.astype(U)))
    own, ids = [doc], [whole >> U(64 - BITS)]
    for k in PREFIXES:
        long = np.flatnonzero(size > k)
        own.append(doc[long])
        ids.append(mix(runs.hashes(start[long], start[long] + k) + U(k)) >> U(64 - BITS))
    data = np.frombuffer(("\n".join(texts) + "\n").encode("utf-8", "surrogatepass"), np.uint8)
    stops = np.cumsum([len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts])
    per = lambda flag: np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(flag)])[stops]]))
    length = np.maximum(np.diff(np.concatenate([[0], stops])), 1)
    count = np.maximum(np.bincount(doc, minlength=n), 1)
    same = np.zeros(len(whole), bool)
    same[1:] = (whole[1:] == whole[:-1]) & (doc[1:] == doc[:-1])
    dense = np.stack([np.log1p(count), per(~WORD_BYTE[data] & ~SPACE[data]) / length, per(DIGIT[data]) / length, np.bincount(doc, weights=size, minlength=n) / count, np.bincount(doc, weights=same, minlength=n) / count, per(data >= 128) / length], 1)
    return np.concatenate(own), np.concatenate(ids).astype(np.int64), dense


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Logistic:
    """A logistic model over the presence of selected features and dense columns, fitted by full-batch Adam with a ridge."""

    def __init__(self, row, col, dense, y, ridge=1e-4, steps=250):
        n, pos = len(y), max(int(y.sum()), 1)
        yes = np.bincount(col, weights=y[row], minlength=1 << BITS)
        all_ = np.bincount(col, minlength=1 << BITS)
        p1, p0, p = yes / pos, (all_ - yes) / max(n - pos, 1), np.clip(all_ / n, 1e-9, 1 - 1e-9)
        z = np.abs(p1 - p0) / np.sqrt(p * (1 - p) * (1 / pos + 1 / max(n - pos, 1)))
        z[all_ < 3] = 0
        top = np.argsort(-z, kind="stable")[:SELECTED]
        top = np.sort(top[z[top] > MIN_Z])
        self.slot = np.full(1 << BITS, -1, np.int32)
        self.slot[top] = np.arange(len(top))
        self.mean, self.scale = dense.mean(0), np.maximum(dense.std(0), 1e-9)
        x = (dense - self.mean) / self.scale
        s = self.slot[col]
        row, s = row[s >= 0], s[s >= 0]
        w, v, b = np.zeros(len(top)), np.zeros(x.shape[1]), np.log(pos / max(n - pos, 1))
        theta = np.concatenate([w, v, [b]])
        m = q = np.zeros_like(theta)
        k = len(w)
        for t in range(1, steps + 1):
            g = (_sigmoid(np.bincount(row, weights=theta[s], minlength=n) + x @ theta[k:-1] + theta[-1]) - y) / n
            grad = np.concatenate([np.bincount(s, weights=g[row], minlength=k), x.T @ g, [g.sum()]]) + ridge * np.concatenate([theta[:-1], [0]])
            m, q = 0.9 * m + 0.1 * grad, 0.999 * q + 0.001 * grad**2
            theta = theta - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(q / (1 - 0.999**t)) + 1e-8)
        self.w, self.v, self.b = theta[:k], theta[k:-1], theta[-1]

    def logit(self, row, col, dense):
        """row and col may repeat a pair; it counts once."""
        s = self.slot[col]
        hit = np.flatnonzero(s >= 0)
        pair = np.unique(row[hit].astype(np.int64) * len(self.w) + s[hit]) if len(hit) else np.zeros(0, np.int64)
        words = np.bincount(pair // max(len(self.w), 1), weights=self.w[pair % max(len(self.w), 1)], minlength=len(dense))
        return words + ((dense - self.mean) / self.scale) @ self.v + self.b


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which on a category is assigned: the best F0.5 on out-of-fold predictions (a false alarm costs more than a
    miss), in the middle of its gap."""
    if not y.any():
        return 1.1
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f = 1.25 * hits / (np.arange(1, len(y) + 1) + 0.25 * y.sum())
    k = int(np.argmax(f))
    below = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float((p[order[k]] + below) / 2)


#: Band keys of a text, of four minima of its runs of five words each, by which near copies are known.
LIKENESS = 6


def likeness(texts: list[str], powers: Powers) -> np.ndarray:
    """uint64 (n, LIKENESS): texts that are alike share a key. Texts without words share all of theirs."""
    owner, h, _, _ = word_shingles(texts, 5, powers)
    own, at = np.unique(owner, return_inverse=True)
    keys = np.zeros((len(texts), LIKENESS), U)
    if len(own):
        keys[own] = band_keys(minima(at, h, len(own), 4 * LIKENESS), LIKENESS, 4)
    return keys


def folds(keys: np.ndarray) -> np.ndarray:
    """A fold for each text. Texts that share a key, directly or through others, share one, so no model is judged by a copy of what it has seen.
    Groups are dealt out by size, so folds are as equal as the largest groups allow; groups of one size are in order of their texts' hashes."""
    n = len(keys)
    parent = np.arange(n)
    groups = [np.unique(keys[:, j], return_inverse=True)[1] for j in range(keys.shape[1])]
    while n:
        new = parent
        for group in groups:
            low = np.full(group.max() + 1, n)
            np.minimum.at(low, group, new)
            new = np.minimum(new, low[group])
        new = new[new]
        if (new == parent).all():
            break
        parent = new
    least = np.full(n, np.iinfo(np.uint64).max, U)
    np.minimum.at(least, parent, mix(keys[:, 0]))
    root, group, size = np.unique(parent, return_inverse=True, return_counts=True)
    filled, fold = [0] * FOLDS, np.zeros(len(root), np.int64)
    for g in np.lexsort((least[root], -size)).tolist():  # the largest first, each to the emptiest fold
        fold[g] = filled.index(min(filled))
        filled[fold[g]] += size[g]
    return fold[group] if n else np.zeros(0, np.int64)


class Chain:
    def __init__(self, row, col, dense, labels: np.ndarray, fold: np.ndarray):
        n, k = labels.shape
        extra = np.zeros((n, 0))
        self.models, self.thresholds = [], []
        for j in range(k):
            y = labels[:, j].astype(float)
            if y.min() == y.max():  # nothing to learn: its share is its prediction
                self.models.append(float(y[0]))
                self.thresholds.append(0.5)
                extra = np.hstack([extra, np.full((n, 1), 0.0)])
                continue
            x = np.hstack([dense, extra])
            out = np.zeros(n)
            for f in range(FOLDS):
                here, there = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                yes = y[here].sum()
                if not len(there) or not 0 < yes < len(here):  # nothing to learn from
                    out[there] = np.log((yes + 0.5) / (len(here) - yes + 0.5))
                    continue
                at = np.full(n, -1)
                at[here] = np.arange(len(here))
                use = at[row] >= 0
                model = Logistic(at[row[use]], col[use], x[here], y[here])
                at[:] = -1
                at[there] = np.arange(len(there))
                use = at[row] >= 0
                out[there] = model.logit(at[row[use]], col[use], x[there])
            self.thresholds.append(best_threshold(_sigmoid(out), y))
            self.models.append(Logistic(row, col, x, y))
            extra = np.hstack([extra, np.clip(out, -12, 12)[:, None]])

    def predict(self, row, col, dense) -> np.ndarray:
        extra, out = np.zeros((len(dense), 0)), []
        for model in self.models:
            if isinstance(model, float):
                out.append(np.full(len(dense), model))
                extra = np.hstack([extra, np.zeros((len(dense), 1))])
                continue
            logit = model.logit(row, col, np.hstack([dense, extra]))
            extra = np.hstack([extra, np.clip(logit, -12, 12)[:, None]])
            out.append(_sigmoid(logit))
        return np.stack(out, 1) if out else np.zeros((len(dense), 0))


def _training(batches):
    """(labels, text) -> (labels, distinct features, dense, keys of likeness) as binaries."""
    powers = shared_powers()
    for batch in batches:
        marks, texts = batch.column(0), batch.column(1).to_pylist()
        for lo, hi in chunks(texts):
            row, col, dense = features(texts[lo:hi], powers)
            pair = np.unique(row.astype(np.int64) << BITS | col)
            at = np.searchsorted(pair >> BITS, np.arange(hi - lo + 1))
            col = (pair & (1 << BITS) - 1).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([marks.slice(lo, hi - lo), pa.array([col[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()), pa.array([d.tobytes() for d in dense], pa.binary()), pa.array([k.tobytes() for k in likeness(texts[lo:hi], powers)], pa.binary())], names=["marks", "ids", "dense", "keys"])


def fit_chain(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", rows_per_stratum: int = ROWS_PER_STRATUM) -> Chain:
    """Fits the chain on at most rows_per_stratum rows of each combination of the 0/1 columns `categories` of `labels`. Rows whose id or
    label is null take no part; an id that is labelled several times has the highest label of each category; of rows that share an id the one with the
    smallest text counts; without labelled rows nothing is ever assigned. Of a text the distinct features are kept, 4 bytes each, so what the driver gets has a bound in rows, and in bytes
    that of so many of the longest texts."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "chain")
    marks = F.concat(*(F.when(F.col(c) > 0, "1").otherwise("0") for c in categories))
    known = labels.where(" and ".join(f"{c} is not null" for c in [id_col, *categories])).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(*(F.max(c).alias(c) for c in categories))
    known = known.select("doc_id", marks.alias("marks"))
    parts = []
    for combination in range(1 << len(categories)):
        want = format(combination, f"0{len(categories)}b")
        parts.append(known.where(F.col("marks") == want).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_stratum))
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.union(p)
    chosen = scratch.keep(chosen, "chosen")  # bounded by rows_per_stratum
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "marks").agg(F.min("text").alias("text"))  # rows of one id are one, so the bound holds
    got = rows.select("marks", "text", "doc_id").mapInArrow(tidy(_training), "marks string, ids binary, dense binary, keys binary")
    got = scratch.keep(got, "training").collect()
    got.sort(key=lambda r: (r["marks"], r["ids"]))  # the same model whatever the order of rows
    if not got:
        return Chain(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, DENSE)), np.zeros((0, 0)), np.zeros(0, np.int64))
    row = np.repeat(np.arange(len(got), dtype=np.int32), [len(r["ids"]) >> 2 for r in got])
    col = np.frombuffer(b"".join(r["ids"] for r in got), np.uint32).astype(np.int32)
    often = np.bincount(col, minlength=1 << BITS)[col] >= 3  # what is rarer is never selected
    row, col = row[often], col[often]
    dense = np.frombuffer(b"".join(r["dense"] for r in got), np.float64).reshape(-1, DENSE)
    y = np.array([[int(c) for c in r["marks"]] for r in got])
    fold = folds(np.frombuffer(b"".join(r["keys"] for r in got), U).reshape(-1, LIKENESS))
    del got, often
    return Chain(row, col, dense, y, fold)


def classify(docs: DataFrame, chain: Chain, categories: list[str], id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Every row of `docs`, without its text unless `keep_text`, with p_<category> (double) and is_<category> (boolean) for each category.

    Null counts as the empty text. Rows are independent: ties, repeated rows, null ids and other columns pass through, but columns that are
    named like the added ones are replaced; an empty table gives an empty result.
    """
    names = [f"p_{c}" for c in categories] + [f"is_{c}" for c in categories]
    row, cells, fields = carry(docs, names if keep_text else [text_col, *names])
    schema = T.StructType([T.StructField("row", row_type(fields))] + [T.StructField(c, T.DoubleType() if c[:2] == "p_" else T.BooleanType()) for c in names])

    def run(batches):
        powers = shared_powers()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in chunks(texts):
                p = chain.predict(*features(texts[lo:hi], powers))
                if not p.shape[1]:
                    p = np.zeros((hi - lo, len(categories)))
                marks = [pa.array(p[:, j] >= (chain.thresholds[j] if chain.thresholds else 1.1)) for j in range(len(categories))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo)] + [pa.array(np.round(p[:, j], 6)) for j in range(len(categories))] + marks, names=["row", *names])

    found = docs.select(row, F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(tidy(run), schema)
    return found.select(*cells, *names)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """`classify` with a chain low_quality -> toxic that is fitted on `labels` (doc_id, quality, toxic)."""
    marks = labels.select(F.col("doc_id").alias(id_col), (1 - F.col("quality")).alias("low_quality"), F.col("toxic").alias("toxic"))
    categories = ["low_quality", "toxic"]
    return classify(docs, fit_chain(docs, marks, categories, id_col, text_col), categories, id_col, text_col, keep_text)
