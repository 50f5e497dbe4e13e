"""Steps whose size must not follow that of the tables."""

import math
import os
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.operators import graph, index, learn, rank, subwords, text, vector
from quillspark.operators.index import Index
from quillspark.plans import mining


def test_silhouettes_in_bounded_cells(spark, monkeypatch):
    """Two clusterings from one pass over the pairs, no task with more than a few cells' worth of vectors."""
    rng = np.random.default_rng(4)
    x, a, b = rng.normal(size=(300, 3)), rng.integers(0, 3, 300), np.r_[[9], rng.integers(0, 2, 299)]
    rows = [(i, x[i].tolist(), [int(a[i]), int(b[i])]) for i in range(300)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>, clusters array<int>")
    whole = vector._distance_sums

    def checked(left, right):
        assert max(left.num_rows, right.num_rows) <= 100, "a side of a cell follows the table"
        return whole(left, right)

    monkeypatch.setattr(vector, "CELL", 50)
    monkeypatch.setattr(vector, "TILE", (7, 11))
    monkeypatch.setattr(vector, "_distance_sums", checked)
    got = {(r["vec_id"], r["run"]): r["silhouette"] for r in vector.silhouettes(t, t).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for run, c in enumerate((a, b)):
        for i in range(300):
            own = (c == c[i]).sum()
            inner = d[i, c == c[i]].sum() / (own - 1) if own > 1 else 0
            outer = min(d[i, c == k].mean() for k in set(c) - {c[i]})
            assert got[i, run] == pytest.approx((outer - inner) / max(outer, inner) if own > 1 else 0, abs=1e-6)


def test_stored_index_is_counted_once_and_not_shuffled_by_document(spark, tmp_path):
    texts = [(i, f"graph{i % 3} net\n" + "deep graph net of words " * (i % 5)) for i in range(40)] + [(90, None), (91, "")]
    lazy = Index.build(spark.createDataFrame(texts, "doc_id long, text string"), 1)
    stored = lazy.stored(str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "graph dee"), (2, "net deep deep words"), (3, "nothing")], "query_id int, query string")
    for method in ("okapi25", "ltc-lnc"):
        for match in ("prefix", "exact"):
            got = rank.rank(stored, asked, method, 0.2, match)
            plan = got._jdf.queryExecution().toString()
            assert not re.search(r"hashpartitioning\([^)]*doc_id#", plan) and "posexplode" not in plan
            rows = [sorted((r["query_id"], r["doc_id"], round(r["score"], 9)) for r in x.collect()) for x in (got, rank.rank(lazy, asked, method, 0.2, match))]
            assert rows[0] == rows[1]
    assert sorted(map(tuple, stored.doc_lengths.collect())) == sorted(map(tuple, lazy.doc_lengths.collect()))


def test_topics_make_runs_of_frequent_terms_only(spark, monkeypatch):
    """All that is counted besides single terms are runs of a cluster's most frequent terms; ties, small clusters and a cluster of null as before."""
    rng = np.random.default_rng(8)
    texts = [(i, " ".join(f"w{min(int(x), 60)}" for x in rng.zipf(1.3, 30)) + "\na b c", [None, 1, 2][i % 3]) for i in range(60)] + [(99, "x y\nx y", 3)]
    t = spark.createDataFrame(texts, "doc_id long, text string, cluster int")
    parts, assigned = text.sections(t), t.select("doc_id", "cluster")
    grams = text.ngrams(parts).join(assigned, "doc_id").groupBy("cluster", "gram").count().collect()
    want = {}
    for c in (None, 1, 2, 3):
        best = sorted(((-r["count"], r["gram"]) for r in grams if r["cluster"] == c))[:4]
        want[c] = ", ".join(g for _, g in best)
    made = vector.topics(parts, None, assigned, 4)
    assert {r["cluster"]: r["topic"] for r in made.collect()} == want
    assert "array_contains(few" in made._jdf.queryExecution().toString()
    monkeypatch.setattr(vector, "FREQUENT", 1)
    assert {r["cluster"]: r["topic"] for r in vector.topics(parts, None, assigned, 4).collect()} == want


def test_bayes_counts_without_a_join_of_tokens(spark):
    plan = mining.nb_prior(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search(r"hashpartitioning\(doc_id#", plan)


def test_token_spans_leave_a_task_in_small_batches(spark, monkeypatch):
    """One text of more tokens than a batch has, and many texts in one batch."""
    monkeypatch.setattr(text, "SPANS", 7)
    texts = [(1, "Été un\n" + "a😀b " * 20), (2, None), *((i, f"t{i} x") for i in range(3, 30))]
    parts = text.sections(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1))
    spans = text.token_spans(parts)
    got = sorted(map(tuple, spans.select("doc_id", "section", "pos", "char_idx", "surface", "term").collect()))
    abstract = [(1, "abstract", 2 * i + j, 4 * i + 2 * j, "ab"[j], "ab"[j]) for i in range(20) for j in (0, 1)]
    assert got == sorted([(1, "title", 0, 0, "Été", "été"), (1, "title", 1, 4, "un", "un"), *abstract, *((i, "title", n, n * (len(str(i)) + 2), w, w) for i in range(3, 30) for n, w in enumerate((f"t{i}", "x")))])
    sizes = spans.mapInPandas(lambda batches: (b[["pos"]].iloc[:1].assign(pos=len(b)) for b in batches), "pos int")
    assert "MapInArrow" in spans._jdf.queryExecution().toString() and sizes.count() > 0


def test_word_vectors_are_trained_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(learn, "WORDS", 100)
    parts = spark.createDataFrame([(["deep", "graph", "net", "of"] * 20,)] * 8, "terms array<string>")
    model = learn.word_vectors(parts, size=4)
    assert model.getNumPartitions() == 4 and model.getVectors().count() == 4


def test_subwords_are_trained_by_all_tasks(spark, monkeypatch):
    """One file of many words is dealt to the tasks that run at once."""
    monkeypatch.setattr(subwords, "WORDS", 50)
    seen = []
    cut = subwords._cut
    monkeypatch.setattr(subwords, "_cut", lambda df: seen.append(cut(df)) or seen[-1])
    parts = spark.createDataFrame([(["deep", "graph", "net", "of"] * 20,)] * 8, "terms array<string>").coalesce(1)
    subwords.fit(parts, size=4, rounds=1, buckets=64)
    assert seen[-1].rdd.getNumPartitions() == 4


def test_topic_models_make_tokens_once(spark):
    """However many passes the models make."""
    made = spark.sparkContext.accumulator(0)
    tokens = spark.createDataFrame([(i % 4, w) for i, w in enumerate(["deep", "graph", "net", "of"] * 5)], "doc_id long, term string").coalesce(1)

    def count(batches):
        for b in batches:
            made.add(len(b))
            yield b

    assert learn.lda_topics(tokens.mapInPandas(count, tokens.schema), 2, 2).count() == 4
    assert made.value == 20


def test_topics_come_from_all_documents_and_terms(spark, monkeypatch):
    """Against a plain batch version of the same updates, in one block and in many; each document has a term of its own."""
    rng = np.random.default_rng(7)
    themes = ("harbour vessel sailor anchor", "kitchen pastry butter recipe", "planet comet telescope galaxy")
    rows = [(i, w) for i in range(90) for w in [*rng.choice(themes[i % 3].split(), 9 + i % 5).tolist(), f"own{i}"]]
    tokens = spark.createDataFrame([*rows, (None, "harbour"), (None, "vessel")], "doc_id long, term string")
    monkeypatch.setattr(learn, "POSTINGS", 1 << 20)
    one = [tuple(r) for r in learn.lda_topics(tokens, 3, 200).collect()]
    monkeypatch.setattr(learn, "POSTINGS", 40)
    many = {(r["topic"], r["term"]): r["weight"] for r in learn.lda_topics(tokens, 3, 200).collect()}
    assert len(one) == 3 * (12 + 90)
    assert {(t, w): pytest.approx(x, rel=1e-6) for t, _, w, x in one} == many
    assert {frozenset(w for t, r, w, _ in one if t == topic and r < 4) for topic in range(3)} == {frozenset(t.split()) for t in themes}
    assert [sum(x for t, _, _, x in one if t == topic) for topic in range(3)] == pytest.approx([1, 1, 1])


def test_shares_follow_a_plain_loop():
    rng = np.random.default_rng(9)
    sizes, n = np.array([3, 1, 6, 2]), rng.integers(1, 5, 12)
    beta = rng.random((3, 12))
    got = learn._shares(sizes, beta, n)
    x = np.linspace(0.3, 20, 50)
    h = 1e-5
    assert np.allclose(learn._digamma(x), [(math.lgamma(v + h) - math.lgamma(v - h)) / (2 * h) for v in x], atol=1e-7)
    for d, end in enumerate(np.cumsum(sizes)):
        b, c, g = beta[:, end - sizes[d] : end], n[end - sizes[d] : end], np.ones(3)
        for _ in range(100):
            e = np.exp(learn._digamma(g) - learn._digamma(g.sum(keepdims=True)))
            new = np.array([1 / 3 + e[j] * sum(c[i] * b[j, i] / (e @ b[:, i]) for i in range(len(c))) for j in range(3)])
            moved, g = np.abs(new - g).mean(), new
            if moved < 1e-3:
                break
        assert np.allclose(got[:, d], np.exp(learn._digamma(g) - learn._digamma(g.sum(keepdims=True))), rtol=2e-3)


def test_features_are_added_up_where_their_texts_were_dealt_to(spark, monkeypatch):
    """Against the features made by shuffled joins, with ids that repeat or are null, in many pieces; counts are not shuffled once they are made."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(40)] + ["x", "yy"]
    rows = [(i % 50, " ".join(rng.choice(words, 12)) + "\n" + " ".join(rng.choice(words, 9))) for i in range(70)] + [(200, None), (201, "")]
    parts = text.sections(spark.createDataFrame([*rows, (None, "w1 w2 x")], "doc_id long, text string"))
    some = text.sections(spark.createDataFrame(rows, "doc_id long, text string"))
    vector = F.when(F.length("term") > 1, F.array(F.length("term").cast("double"), F.ascii("term") / 7))
    monkeypatch.setattr(index, "BUCKET_CHARS", 300)
    plans, cut = [], learn._cut
    monkeypatch.setattr(learn, "_cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = learn.Pieces.build(some).embedded(vector).collect()
    old = learn.tf_idf_features(text.tokens(some), some)
    want = learn.weighted_embedding(old, text.tokens(some).select("term").distinct().select("term", vector.alias("vector"))).collect()
    by = {(r["doc_id"], r["dim"]): r["x"] for r in want}
    assert len(got) == len(by) and {(r["doc_id"], r["dim"]): pytest.approx(r["x"], rel=1e-9) for r in got} == by
    assert any(r["doc_id"] is None for r in learn.Pieces.build(parts).embedded(vector).collect())
    part = {(r["doc_id"], r["term"]): r["w"] for r in learn.Pieces.build(some, 2).slice(3, 7).collect()}
    long = text.tokens(some).where("length(term) > 1")
    by = {(r["doc_id"], r["term"]): r["w"] for r in learn.feature_slice(learn.tf_idf_features(long, some), 3, 7).collect()}
    assert by and {k: pytest.approx(w, rel=1e-9) for k, w in part.items()} == by
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert not any(re.search(r"hashpartitioning\([^)]*doc_id#", p) for p in plans) and not spark.catalog.listTables()


def test_sums_of_short_segments():
    rng = np.random.default_rng(3)
    for sizes in ([1], [3, 1, 7, 1, 2], rng.integers(1, 9, 50).tolist(), [40]):
        values, rows = rng.normal(size=(20, 4)), rng.integers(0, 20, sum(sizes))
        ends = np.cumsum(sizes)
        assert np.allclose(subwords._sums(values, rows, np.array(sizes)), [values[rows[e - n : e]].sum(0) for e, n in zip(ends, sizes, strict=True)])


def test_documents_are_embedded_without_a_row_for_each_number_of_a_term(spark):
    model = subwords.Subwords(np.random.default_rng(6).normal(size=(512, 8)).astype(np.float32))
    parts = text.sections(spark.createDataFrame([(1, "deep graph net\nnet of été"), (2, "graph"), (3, ""), (4, None), (2, "of net")], "doc_id long, text string"))
    made = learn.Pieces.build(parts).embedded_by(model.maker(spark), 8)
    old = learn.tf_idf_features(text.tokens(parts), parts)
    want = {(r["doc_id"], r["dim"]): r["x"] for r in learn.weighted_embedding(old, model.vectors(old.select("term").distinct())).collect()}
    assert len(want) == 16 and {(r["doc_id"], r["dim"]): pytest.approx(r["x"], abs=1e-5) for r in made.collect()} == want


def test_hits_leaves_nothing_behind(spark, tmp_path, monkeypatch):
    """Tables of rounds that are done are deleted, lists of neighbours are read where they lie, and the scores are those of a plain loop."""
    rng = np.random.default_rng(2)
    links = sorted({(int(a), int(b)) for a, b in rng.integers(0, 9, (25, 2))})
    made, cut = [], graph._cut
    monkeypatch.setattr(graph, "_cut", lambda df: made.append((df._jdf.queryExecution().executedPlan().toString(), cut(df))) or made[-1][1])
    monkeypatch.setattr(graph, "shared_folder", lambda spark, name: str(tmp_path / name))
    edges = spark.createDataFrame([(f"a{a}", f"b{b}") for a, b in links + links[:3]], "a string, b string")
    got = {r["id"]: r["hub"] for r in graph.hits(edges).collect()}
    names = sorted(got)
    m = np.array([[(int(x[1]), int(y[1])) in links and (x[0], y[0]) == ("a", "b") for y in names] for x in names], float)
    m, h = m + m.T, np.ones(len(names))
    for _ in range(300):
        h = m @ (m @ h)
        h /= h.max()
    assert [got[n] for n in names] == pytest.approx((h / h.sum()).tolist(), abs=1e-5)
    files = [c._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:") for _, c in made]
    assert len(files) > 6 and [os.path.exists(f) for f in files] == [False] * (len(files) - 1) + [True]
    assert sorted(os.listdir(tmp_path / "hits")) == ["nodes"] and not spark.catalog.listTables()
    assert not any(re.search(r"Exchange hashpartitioning\(src#\d+L?, \d+\)[^\n]*\n[^\n]*dsts", p) for p, _ in made)


def test_each_distance_is_taken_once(spark, monkeypatch):
    """Cells below the diagonal are not made, and a cell gives sums for both of its sides; the nearest center is that of the plain rule, ties and missing numbers included."""
    rng = np.random.default_rng(5)
    x, c = rng.normal(size=(40, 3)), rng.integers(0, 3, (40, 2))
    parts = [pa.table({"i": [0] * 20, "j": [j] * 20, "vec_id": list(range(20 * at, 20 * at + 20)), "clusters": c[20 * at : 20 * at + 20].tolist(), "v": x[20 * at : 20 * at + 20].tolist()}) for at, j in ((0, 0), (0, 1), (1, 1))]
    monkeypatch.setattr(vector, "TILE", (7, 5))
    made = [vector._distance_sums(parts[0], parts[0].slice(0, 0)), vector._distance_sums(parts[1], parts[2]), vector._distance_sums(parts[2].set_column(0, "i", [[1] * 20]), parts[2].slice(0, 0))]
    got = {}
    for r in pa.concat_tables(made).to_pylist():
        key = (r["vec_id"], r["run"], r["cluster"])
        got[key] = got.get(key, 0) + r["total"]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert got == {(i, r, k): pytest.approx(d[i, c[:, r] == k].sum(), abs=1e-6) for i in range(40) for r in (0, 1) for k in range(3)}
    assert made[1].num_rows == 40 * 6
    centers = np.array([[0, 0, 0], [2, 0, 0], [0, 2, 0], [0, 0, 0]], float)
    rows = np.concatenate([rng.integers(-2, 3, (200, 3)).astype(float), [[1, 1, 0], [1, 0, np.nan]]])
    plain = np.round(np.stack([np.sqrt(((rows - k) ** 2).sum(1)) for k in centers], 1), 12).argmin(1)
    assert (vector._nearest(rows, (rows**2).sum(1), centers) == plain).all()
