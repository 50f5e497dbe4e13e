"""The queries that have no SQL, against plain versions of what they compute."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import learn, text
from quillspark.plans import mining, search

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def matrix(spark):
    rows = sorted((r["vec_id"], r["embedding"], r["label"]) for r in mining.vectors(spark, SF).collect())
    return [r[0] for r in rows], np.array([r[1] for r in rows], float), np.array([r[2] for r in rows])


def test_word2vec(spark):
    got = mining.word2vec_neighbors(spark, SF).collect()
    words = [r["word"] for r in got]
    near = [r["similarity"] for r in got]
    assert len(set(words)) == 5 and "the" not in words and near == sorted(near, reverse=True) and all(-1 <= x <= 1 + 1e-6 for x in near)


def test_lda(spark):
    known = {r["term"] for r in search.vocabulary(spark, SF).collect()}
    by = defaultdict(list)
    for r in mining.lda_topics(spark, SF).orderBy("topic", "rank").collect():
        assert r["term"] in known
        by[r["topic"]].append(r["weight"])
    assert len(by) == 3 and all(len(w) == 5 and w == sorted(w, reverse=True) and 0 < w[-1] for w in by.values())


def test_perceptron(spark, matrix):
    ids, _, _ = matrix
    got = {r["vec_id"]: r["prediction"] for r in mining.mlp_classifier(spark, SF).collect()}
    held = [i for i in ids if i % 10 < 2]
    assert sorted(got) == held
    assert set(got.values()) <= set(range(10))
    # the table's labels do not depend on its vectors, so what is learnt shows on other rows
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=4) + 4 * np.eye(4)[i % 3]).tolist(), float(i % 3)) for i in range(300)]
    made = spark.createDataFrame(rows, "vec_id long, v array<double>, label double").withColumn("features", array_to_vector("v"))
    train, test = learn.split_by_id(made, "vec_id")
    right = learn.feed_forward(train, [4, 8, 3]).transform(test).select(F.avg((F.col("label") == F.col("prediction")).cast("int"))).first()[0]
    assert right > 0.9
    losses = [r["loss"] for r in mining.mlp_loss(spark, SF).orderBy("epoch").collect()]
    assert len(losses) > 5 and losses[-1] < losses[0]


def test_models_are_stored(spark, tmp_path):
    from pyspark.ml.classification import MultilayerPerceptronClassificationModel

    train, test = mining._labelled_vectors(spark, SF)
    model = learn.feed_forward(train, [64, 10], max_iter=5)
    learn.save_model(model, f"file://{tmp_path}/m")
    back = learn.load_model(MultilayerPerceptronClassificationModel, f"file://{tmp_path}/m")
    same = [sorted((r["vec_id"], r["prediction"]) for r in m.transform(test).collect()) for m in (model, back)]
    assert same[0] == same[1]


def test_kmeans_of_the_library(spark, matrix):
    ids, x, _ = matrix
    got = {r["vec_id"]: r["cluster"] for r in mining.kmeans_mllib(spark, SF).collect()}
    c = np.array([got[i] for i in ids])
    centers = np.array([x[c == k].mean(0) for k in range(10)])
    d = ((x[:, None] - centers) ** 2).sum(-1)
    assert sorted(got) == ids and (d.argmin(1) == c).mean() > 0.95


def test_ward(spark, matrix):
    ids, x, _ = matrix
    got = sorted(tuple(r) for r in mining.ward_clusters(spark, SF).collect())
    assert len(got) == len(ids) - 1
    size, mean, last = {i: 1 for i in range(len(ids))}, dict(enumerate(x)), 0.0
    for step, a, b, height, n in got:
        names = np.array(sorted(size))
        m, s = np.array([mean[k] for k in names]), np.array([size[k] for k in names], float)
        cost = np.sqrt(2 * s[:, None] * s / (s[:, None] + s)) * np.sqrt(np.maximum((m**2).sum(1)[:, None] - 2 * m @ m.T + (m**2).sum(1), 0))
        np.fill_diagonal(cost, np.inf)
        own = np.sqrt(2 * size[a] * size[b] / (size[a] + size[b])) * np.linalg.norm(mean[a] - mean[b])
        assert height == pytest.approx(own) and height <= cost.min() + 1e-6 and height >= last - 1e-9 and n == size[a] + size[b]
        mean[len(ids) + step] = (mean[a] * size[a] + mean[b] * size[b]) / n
        size[len(ids) + step] = n
        for k in (a, b):
            del size[k], mean[k]
        last = height


def test_principal_components(spark, matrix):
    ids, x, _ = matrix
    got = {r["vec_id"]: (r["x"], r["y"]) for r in mining.pca_2d(spark, SF).collect()}
    _, _, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    want = x @ axes[:2].T
    have = np.array([got[i] for i in ids])
    for k in range(2):
        assert min(np.abs(have[:, k] - want[:, k]).max(), np.abs(have[:, k] + want[:, k]).max()) < 1e-6


def test_hits(spark):
    pairs = sorted((r["author"], r["paper_id"]) for r in mining.authors(spark, SF).collect())
    a, b = ({k: i for i, k in enumerate(sorted({p[j] for p in pairs}))} for j in (0, 1))
    m = np.zeros((len(a), len(b)))
    for x, y in pairs:
        m[a[x], b[y]] = 1
    both = np.block([[np.zeros((len(a), len(a))), m], [m.T, np.zeros((len(b), len(b)))]])
    h = np.full(len(both), 1.0)
    for _ in range(2000):
        h = both @ (both @ h)
        h /= h.sum()
    want = {str(k): h[i] for k, i in a.items()}
    got = {r["author"]: r["hub"] for r in mining.hits_converged(spark, SF).collect()}
    assert len(got) == 10 and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in got)
    assert min(got.values()) >= sorted(want.values())[-10] - 2e-6


def test_encoder(spark):
    titles = {r["doc_id"]: (r["text"] or "").split("\n")[0] for r in search.docs(spark, SF).collect()}
    got = {r["doc_id"]: r["vector"] for r in mining.sentence_vectors(spark, SF).collect()}
    assert sorted(got) == sorted(titles)
    for i, t in titles.items():
        v = np.zeros(32)
        for w in re.findall(r"\w+", t.lower()):
            h = zlib.crc32(w.encode())
            v[h % 32] += 1 if h // 32 & 1 else -1
        assert np.allclose(got[i], v / (np.linalg.norm(v) or 1), atol=1e-6)


def test_whole_passages(spark):
    """eval_by_query, eval_summary: the judgements are the documents that hold the passage, and a passage's best hit is one of them."""
    texts = {r["doc_id"]: r["text"] or "" for r in search.docs(spark, SF).collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    held = {i: [d for d, t in texts.items() if p in t] for i, p in items.items()}
    _, qrels = search.benchmark_runs(spark, SF)
    got = defaultdict(list)
    for r in qrels.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["doc_id"])
    assert dict(got) == {i: sorted(d) for i, d in held.items() if d}
    rows = search.eval_by_query(spark, SF).collect()
    assert {r["query_id"] for r in rows} == set(got) and all(r["mrr"] > 0 for r in rows)
    mean = search.eval_summary(spark, SF).first()
    assert mean["mrr"] == pytest.approx(np.mean([r["mrr"] for r in rows]), abs=2e-6)


def test_short_and_long_passages_meet(spark):
    texts = [(1, "one two three four five six seven eight"), (2, "x one two three four five six"), (3, ""), (4, None), (5, "two three")]
    passages = [(1, "two three four five six"), (2, "two three"), (3, "one two three four five six"), (4, "nothing of it here at all today")]
    docs, items = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(passages, "item_id long, passage string")
    want = sorted((d, i) for d, t in texts for i, p in passages if t and p in t)
    assert sorted(map(tuple, search.containing(docs, items).select("doc_id", "item_id").collect())) == want


def test_list_literals_and_missing_pages(spark):
    from quillspark.functions import strings
    from quillspark.sources import pages

    cases = {"['cs.CV', 'cs.LG']": "cs.CV", "[\"it's\", 'b']": "it's", "['it\\'s']": "it's", "['open": None, "['']": "", "['a']": "a", "[]": None, "": None, None: None, "['a, b', 'c']": "a, b"}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "literal string, want string")
    for r in rows.withColumn("got", strings.first_of_list_literal(F.col("literal"))).collect():
        assert r["got"] == r["want"], r
    html = ['<p>room 404 is here</p>', '<input id="error-status" value="404">', '<input value="404" id="error-status">', '<input id="error-status" value="200">']
    got = pages.paper_records(spark.createDataFrame([(i, f"u/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string"))
    assert sorted(r["id"] for r in got.collect()) == ["0", "3"]


def test_subword_queries(spark):
    near = mining.subword_neighbors(spark, SF).collect()
    by = defaultdict(list)
    for r in sorted(near, key=lambda r: r["rank"]):
        by[r["query"]].append(r["term"])
    assert by and all(len(v) == 5 for v in by.values())
    assert sum(q[:-1] in v for q, v in by.items()) > len(by) / 2
    rows = mining.subword_embedding(spark, SF)
    with_words = text.tokens(text.sections(search.docs(spark, SF))).select("doc_id").distinct().count()
    assert rows.count() == 100 * with_words and rows.where("x IS NULL OR isnan(x)").isEmpty()


def test_network_queries(spark, matrix):
    ids, _, labels = matrix
    losses = mining.network_losses(spark, SF).orderBy("epoch").collect()
    assert [r["epoch"] for r in losses] == list(range(5)) and losses[-1]["loss"] < losses[0]["loss"]
    assert all(0 <= r["valid_accuracy"] <= 1 and r["valid_loss"] > 0 for r in losses)
    got = mining.network_predictions(spark, SF).collect()
    assert {r["vec_id"]: r["label"] for r in got} == {i: n for i, n in zip(ids, labels, strict=True) if i % 10 == 0}
    assert all(0 <= r["prediction"] < 10 for r in got)
