"""Text classification: multinomial naive Bayes in relational form, tf-idf features, and wrappers over MLlib."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text
from .graph import _cut, _delete, _drop
from .index import pieces_of
from .segments import _by_shard as copartitioned
from .segments import shared_folder


#: Words that one task of `word_vectors` trains on.
WORDS = 1 << 20


def split_by_id(df: DataFrame, id_col: str = "doc_id", parts: int = 10, test: int = 2) -> tuple[DataFrame, DataFrame]:
    """A repeatable split: ids whose remainder by `parts` is below `test` are the test rows."""
    held = F.pmod(F.col(id_col), F.lit(parts)) < test
    return df.where(~held), df.where(held)


def naive_bayes_fit(tokens_: DataFrame, labels: DataFrame, alpha: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(prior, likelihood, missing) of tokens (doc_id, term) and labels (doc_id, label): unsmoothed log priors, log likelihoods of the terms that a
    class has, and of those that it lacks."""
    return naive_bayes_of(tokens_.join(labels, "doc_id").groupBy("label", "term").agg(F.count("*").alias("c")), labels, alpha)


def naive_bayes_of(counts: DataFrame, labels: DataFrame, alpha: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`naive_bayes_fit` of counts (label, term, c), for tokens that carry their label and need no join."""
    prior = labels.groupBy("label").agg(F.count("*").alias("n"))
    total = labels.agg(F.count("*").alias("all"))
    prior = prior.join(F.broadcast(total)).select("label", F.ln(F.col("n") / F.col("all")).alias("log_prior"))
    size = counts.groupBy("label").agg(F.sum("c").alias("total"))
    vocab = counts.agg(F.count_distinct("term").alias("v"))
    size = size.join(F.broadcast(vocab)).select("label", (F.col("total") + alpha * F.col("v")).alias("denominator"))
    likelihood = counts.join(F.broadcast(size), "label").select("label", "term", F.ln((F.col("c") + alpha) / F.col("denominator")).alias("log_p"))
    return prior, likelihood, size.select("label", F.ln(F.lit(alpha) / F.col("denominator")).alias("log_missing"))


def naive_bayes_scores(model: tuple[DataFrame, DataFrame, DataFrame], tokens_: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, label, score): the joint log probability of each of docs (doc_id) with each class. Terms that no class has are ignored."""
    prior, likelihood, missing = model
    known = likelihood.select("term").distinct()
    tf = tokens_.join(docs, "doc_id", "left_semi").groupBy("doc_id", "term").agg(F.count("*").alias("tf")).join(known, "term", "left_semi")
    length = tf.groupBy("doc_id").agg(F.sum("tf").alias("length"))
    classes = F.broadcast(prior.join(missing, "label"))
    # the sum over terms that a class has, as a correction of the sum if it had none
    extra = tf.join(likelihood.join(F.broadcast(missing), "label"), "term").groupBy("doc_id", "label").agg(F.sum(F.col("tf") * (F.col("log_p") - F.col("log_missing"))).alias("extra"))
    rows = docs.select("doc_id").join(length, "doc_id", "left").join(classes).join(extra, ["doc_id", "label"], "left")
    score = F.col("log_prior") + F.coalesce("length", F.lit(0)) * F.col("log_missing") + F.coalesce("extra", F.lit(0.0))
    return rows.select("doc_id", "label", score.alias("score"))


def naive_bayes_predict(model: tuple[DataFrame, DataFrame, DataFrame], tokens_: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, prediction, score) of docs (doc_id); ties to the smaller label."""
    best = Window.partitionBy("doc_id").orderBy(F.desc(F.round("score", 6)), "label")
    rows = naive_bayes_scores(model, tokens_, docs).withColumn("r", F.row_number().over(best)).where("r = 1")
    return rows.select("doc_id", F.col("label").alias("prediction"), "score")


def log_odds(scores: DataFrame) -> DataFrame:
    """Joint log probabilities (doc_id, label, score) as log odds of each class against the mean of its document's, so that documents of different length
    can be compared."""
    mean = F.avg("score").over(Window.partitionBy("doc_id"))
    return scores.withColumn("score", F.col("score") - mean)


def label_index(labels: DataFrame) -> DataFrame:
    """(label, index): labels in alphabetical order, from 0."""
    return labels.select("label").distinct().select("label", (F.row_number().over(Window.orderBy("label")) - 1).cast("long").alias("index"))


def tf_idf_features(tokens_: DataFrame, docs: DataFrame, normalise: bool = True) -> DataFrame:
    """(doc_id, term, w): tf * (ln((1+N)/(1+df)) + 1), each document's weights scaled to unit length."""
    tf = tokens_.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    rows = tf.join(df, "term").join(F.broadcast(n)).select("doc_id", "term", (F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    if not normalise:
        return rows
    norm = rows.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return rows.join(norm, "doc_id").select("doc_id", "term", (F.col("w") / F.col("norm")).alias("w"))


#: Terms whose vectors are made together.
BATCH = 1 << 14


@dataclass
class Pieces:
    """`tf_idf_features` before they are scaled, as (piece, doc_id, term, w): texts are dealt into pieces by document once, and their counts kept in a table with a bucket for
    each piece; a piece is then sent the frequencies of its own terms, so counts never move again."""

    rows: DataFrame
    kept: DataFrame
    pieces: int
    name: str
    folder: str

    @staticmethod
    def build(parts: DataFrame, least: int = 1) -> Pieces:
        """Of a table with title and abstract, and its terms of `least` characters or more."""
        spark, pieces = parts.sparkSession, pieces_of(parts)
        # the numbers of pieces are such that each has a bucket to itself
        taken = spark.range(32 * pieces + 256).select("id", F.pmod(F.hash("id"), F.lit(pieces))).orderBy(F.desc("id")).collect()  # a few numbers a piece
        free = {bucket: i for i, bucket in taken}
        numbers = F.lit([free.get(i, i) for i in range(pieces)]).cast("array<long>")
        dealt = parts.withColumn("piece", F.get(numbers, F.pmod(F.xxhash64("doc_id"), F.lit(pieces)).cast("int"))).repartition(pieces, "piece")
        tf = text.tokens(dealt, "piece").where(F.length("term") >= least).groupBy("piece", "doc_id", "term").agg(F.count("*").alias("tf"))
        name, folder = f"quill_{uuid.uuid4().hex[:16]}", shared_folder(spark, "features")
        tf.write.option("compression", "zstd").bucketBy(pieces, "piece").option("path", folder).saveAsTable(name)
        kept = spark.table(name)
        words = kept.groupBy("piece", "term").agg(F.count("*").alias("n"))
        df = words.select("piece", "term", F.sum("n").over(Window.partitionBy("term")).alias("df"))  # a row a piece
        found = kept.join(df.hint("shuffle_hash"), ["piece", "term"]).join(F.broadcast(parts.agg(F.count("*").alias("n"))))
        rows = found.select("piece", "doc_id", "term", (F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
        return Pieces(rows, kept, pieces, name, folder)

    def added(self, sums: DataFrame) -> DataFrame:
        """What is made of the rows by piece and document, cut. As long as it is made there are as many partitions as pieces, so rows stay where they lie; then the counts go."""
        conf, spark = self.rows.sparkSession.conf, self.rows.sparkSession
        names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum")
        before = [conf.get(n, None) for n in names]
        with copartitioned(spark):
            try:
                for n in names:
                    conf.set(n, str(self.pieces))
                out = _cut(sums)
            finally:
                for n, was in zip(names, before, strict=True):
                    conf.unset(n) if was is None else conf.set(n, was)
        spark.sql(f"DROP TABLE {self.name}")
        _delete(spark, self.folder)
        spark._jvm.System.gc()  # and the shuffle files
        return out

    def embedded(self, vector: Column) -> DataFrame:
        """`weighted_embedding` with a vector that is made of the column `term`: (doc_id, dim, x). Scaled after it is added up."""
        w = F.col("w")
        each = self.rows.select("piece", "doc_id", "w", F.posexplode(F.concat(F.array(w), F.coalesce(vector, F.array().cast("array<double>")))).alias("at", "x"))
        sums = self.added(each.groupBy("piece", "doc_id", "at").agg(F.sum(w * F.col("x")).alias("x")))
        norm = F.sqrt(F.max(F.when(F.col("at") == 0, F.col("x"))).over(Window.partitionBy("doc_id")))
        return sums.withColumn("norm", norm).where("at > 0").select("doc_id", (F.col("at") - 1).alias("dim"), (F.col("x") / F.col("norm")).alias("x"))

    def embedded_by(self, vectors_of, width: int) -> DataFrame:
        """`embedded` with `width` numbers a term that are made where a piece lies: vectors_of() is called in a task and gives a function from an array of terms to a matrix."""

        def embed(piece: pa.Table) -> pa.Table:
            doc, term = (piece.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for c in ("doc_id", "term"))
            order = np.argsort(doc.indices.to_numpy(), kind="stable")
            at, w = term.indices.to_numpy()[order], piece.column("w").to_numpy()[order]
            ends = np.cumsum(np.bincount(doc.indices))
            table, of, out = vectors_of(), term.dictionary, np.empty((len(ends), width))
            table = np.concatenate([table(of[i : i + BATCH].to_pylist()).astype(np.float32) for i in range(0, len(of), BATCH)])
            for i, end in enumerate(ends):
                own = slice(ends[i - 1] if i else 0, end)
                out[i] = w[own] @ table[at[own]].astype(float) / np.sqrt(w[own] @ w[own])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, width, dtype=np.int32)), pa.array(out.ravel()))
            return pa.table([doc.dictionary, flat], names=["doc_id", "vector"])

        kind = self.kept.schema["doc_id"].dataType.simpleString()
        return self.added(self.rows.groupBy("piece").applyInArrow(embed, f"doc_id {kind}, vector array<double>")).select("doc_id", F.posexplode("vector").alias("dim", "x"))

    def slice(self, start: int, stop: int) -> DataFrame:
        """`feature_slice`: (doc_id, term, w)."""
        w = F.col("w")
        first = self.kept.select("term").distinct().orderBy("term").limit(stop).collect()  # `stop` rows
        mine = F.collect_list(F.when(F.col("term").isin([r["term"] for r in first][start:]), F.struct("term", "w")))
        sums = self.added(self.rows.groupBy("piece", "doc_id").agg(F.sqrt(F.sum(w * w)).alias("norm"), mine.alias("mine")).where(F.size("mine") > 0))
        return sums.select("doc_id", "norm", F.inline("mine")).select("doc_id", "term", (w / F.col("norm")).alias("w"))


def weighted_embedding(features: DataFrame, term_vectors: DataFrame) -> DataFrame:
    """(doc_id, dim, x): the sum of a document's term vectors (term, vector), each by its weight; unknown terms are skipped."""
    rows = features.join(term_vectors, "term").select("doc_id", "w", F.posexplode("vector").alias("dim", "x"))
    return rows.groupBy("doc_id", "dim").agg(F.sum(F.col("w") * F.col("x")).alias("x"))


#: Counts (a document's term each) of the documents that one task of `lda_topics` holds.
POSTINGS = 1 << 21


def _digamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers: raised to 6 at least, then the asymptotic series."""
    out, x = np.zeros_like(x), x.copy()
    for _ in range(6):
        low = x < 6
        out -= np.where(low, 1 / x, 0)
        x += low
    r = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


def _shares(sizes: np.ndarray, beta: np.ndarray, n: np.ndarray, most: int = 100, tol: float = 1e-3) -> np.ndarray:
    """exp E[log theta] (topics x documents), for counts n of documents of so many terms each, whose terms' exp E[log beta] are given (topics x counts):
    updates until a document's weights move by less than tol on average."""
    k = len(beta)
    weights, open_ = np.ones((k, len(sizes))), np.arange(len(sizes))

    def spread(w):
        return np.exp(_digamma(w) - _digamma(w.sum(0)))

    for _ in range(most):
        e = spread(weights[:, open_])
        part = n / ((np.repeat(e, sizes, 1) * beta).sum(0) + 1e-100)
        new = 1 / k + e * np.add.reduceat(beta * part, np.cumsum(sizes) - sizes, axis=1)
        moves = np.abs(new - weights[:, open_]).mean(0) >= tol
        weights[:, open_] = new
        if not moves.any():
            break
        if moves.mean() < 0.8:
            rest = np.repeat(moves, sizes)
            open_, sizes, beta, n = open_[moves], sizes[moves], beta[:, rest], n[rest]
    return spread(weights)


def _packed(block: pa.Table) -> pa.Table:
    """A block's counts (block, doc_id, term, n) as one row: its terms, and by document how many it has, their places in the list, and their counts."""
    doc, term = (block.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for c in ("doc_id", "term"))
    order = np.argsort(doc.indices.to_numpy(), kind="stable")
    binary = (np.bincount(doc.indices), term.indices.to_numpy()[order], block.column("n").to_numpy()[order])
    return pa.table([block.column("block")[:1], pa.array([term.dictionary.to_pylist()]), *(pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in binary)], names=["block", "terms", "sizes", "at", "n"])


def _topic_sums(sums: list[float]):
    """(a packed block, its terms with their topics' weights) -> what the block adds to the weights."""
    k = len(sums)

    def run(block: pa.Table, weights: pa.Table) -> pa.Table:
        sizes, at, n = (np.frombuffer(block.column(c)[0].as_py(), np.int32) for c in ("sizes", "at", "n"))
        weights = weights.sort_by("i").combine_chunks()
        own = np.stack([weights.column(f"w{j}").to_numpy() for j in range(k)])
        own = np.exp(_digamma(own) - _digamma(np.array(sums))[:, None])
        beta = own[:, at]
        share = np.repeat(_shares(sizes, beta, n), sizes, 1)
        part = n / ((share * beta).sum(0) + 1e-100)
        added = [np.bincount(at, part * share[j], own.shape[1]) * own[j] for j in range(k)]
        return pa.table([weights.column("term"), *map(pa.array, added)], names=["term", *(f"w{j}" for j in range(k))])

    return run


def lda_topics(tokens_: DataFrame, k: int = 3, words: int = 5, seed: int = 1, passes: int = 5) -> DataFrame:
    """(topic, rank, term, weight) of a latent Dirichlet allocation (variational Bayes, priors 1/k) over all documents and all terms: each pass goes over the whole
    corpus. Documents lie in blocks of about POSTINGS counts, one task each; a pass brings a block the weights of its own terms and adds up what the blocks
    return by term, so nothing that follows the vocabulary is on the driver or broadcast."""
    names = [f"w{j}" for j in range(k)]
    folder = shared_folder(tokens_.sparkSession, "topics")
    tokens_.groupBy("doc_id", "term").agg(F.count("*").alias("n")).write.option("compression", "zstd").parquet(folder)
    counts = tokens_.sparkSession.read.parquet(folder)
    blocks = -(-counts.count() // POSTINGS) or 1
    dealt = counts.select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block"), "doc_id", "term", "n")
    packed = _cut(dealt.groupBy("block").applyInArrow(_packed, "block long, terms array<string>, sizes binary, at binary, n binary"))
    # what is needed stays where it is dealt to, only weights move
    needed = packed.select(F.col("block").alias("of"), F.posexplode("terms").alias("i", "term"))
    needed = _cut(needed.repartition(int(tokens_.sparkSession.conf.get("spark.sql.shuffle.partitions")), "term"))
    held = packed.select("block", "sizes", "at", "n")
    part = lambda j, turn: (F.pmod(F.xxhash64("term", F.lit(seed), F.lit(j), F.lit(turn)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    start = [(1 + 0.1 * F.sqrt(-2 * F.ln(part(j, 0))) * F.cos(2 * math.pi * part(j, 1))).alias(w) for j, w in enumerate(names)]
    weights = _cut(needed.select("term").distinct().select("term", *start))
    for turn in range(passes + 1):
        sums = [float(x or 0) for x in weights.agg(*(F.sum(w) for w in names)).first()]
        if turn == passes:
            break
        added = held.groupBy("block").cogroup(needed.join(weights, "term").groupBy("of")).applyInArrow(_topic_sums(sums), ", ".join(["term string", *(f"{w} double" for w in names)]))
        was, weights = weights, _cut(added.groupBy("term").agg(*((F.sum(w) + 1 / k).alias(w) for w in names)))
        _drop(was)
    tops = [weights.select("term", (F.col(w) / (sums[j] or 1)).alias("weight")).orderBy(F.desc("weight"), "term").limit(words).collect() for j, w in enumerate(names)]
    found = [(j, r, t["term"], t["weight"]) for j, top in enumerate(tops) for r, t in enumerate(top)]  # k topics
    _drop(weights, needed, packed)
    _delete(tokens_.sparkSession, folder)
    return tokens_.sparkSession.createDataFrame(found, "topic int, rank int, term string, weight double")


def word_vectors(parts: DataFrame, size: int = 100, min_count: int = 5, seed: int = 1):
    """A Word2Vec model over sentences in a column `terms`; `findSynonyms` and `getVectors` are its queries. Trained by one task for each WORDS words, but by no more
    than run at once; their models are averaged."""
    from pyspark.ml.feature import Word2Vec

    words = parts.agg(F.sum(F.size("terms"))).first()[0] or 0
    tasks = min(parts.sparkSession.sparkContext.defaultParallelism, -(-words // WORDS) or 1)
    return Word2Vec(vectorSize=size, minCount=min_count, seed=seed, inputCol="terms", outputCol="vector", maxIter=1, numPartitions=tasks).fit(parts)


def feed_forward(rows: DataFrame, layers: list[int], seed: int = 1, max_iter: int = 50):
    """A multilayer perceptron on (features vector, label double)."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    return MultilayerPerceptronClassifier(layers=layers, seed=seed, maxIter=max_iter).fit(rows)


def batch_predict(make_predictor, return_type, batch_size: int = 1024):
    """A column function that loads a model once on each worker and runs it over batches: the interface for encoders and classifiers that are
    trained elsewhere. make_predictor() returns a function from arrays to arrays."""
    from pyspark.ml.functions import predict_batch_udf

    return predict_batch_udf(make_predictor, return_type=return_type, batch_size=batch_size)


def loss_by_epoch(model) -> list[float]:
    """The training loss before the first epoch and after each one, of a model of `feed_forward`."""
    return list(model.summary().objectiveHistory)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(kind, path: str):
    """A stored model of a class such as Word2VecModel or MultilayerPerceptronClassificationModel."""
    return kind.load(path)


def feature_slice(features: DataFrame, start: int, stop: int) -> DataFrame:
    """The rows of features (doc_id, term, w) whose terms are in places start to stop - 1 of the alphabetical vocabulary."""
    first = features.select("term").distinct().orderBy("term").limit(stop)
    wanted = first.withColumn("at", F.row_number().over(Window.orderBy("term")) - 1).where(F.col("at") >= start).select("term")  # `stop` rows
    return features.join(wanted, "term", "left_semi")


def hashing_encoder(width: int = 32):
    """make_predictor for `batch_predict`: an encoder that needs no trained weights. A text's vector has, in the place that a word's CRC-32 names, how often such
    words come, with the sign of its next bit, scaled to unit length."""

    def make():
        import re
        import zlib

        import numpy as np

        def predict(texts):
            out = np.zeros((len(texts), width), np.float64)
            for row, text in zip(out, texts, strict=True):
                for word in re.findall(r"\w+", text.lower()):
                    h = zlib.crc32(word.encode())
                    row[h % width] += 1 if h // width & 1 else -1
                row /= np.linalg.norm(row) or 1
            return out

        return predict

    return make
