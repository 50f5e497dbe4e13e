"""Hand fixtures, round trips and edge cases."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.functions import codecs, strings
from quillspark.operators import graph, learn, metrics, profile, rank, recsys, spell, text, vector
from quillspark.operators import index as ix
from quillspark.plans import mining, search
from quillspark.sources import pages, tables
from quillspark.streaming import ingest

CORPUS = [("d1", "deep model\ndeep deeper graph"), ("d2", "graph\ndeep rank rank"), ("d3", "model\nrank model")]


@pytest.fixture(scope="module")
def small(spark):
    return ix.Index.build(spark.createDataFrame(CORPUS, "doc_id string, text string"), n_stops=0, id_col="doc_id")


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("n, code", [(0, "80"), (5, "85"), (127, "FF"), (128, "0180"), (824, "06B8"), (214577, "0D0CB1")])
def test_variable_byte(spark, n, code):
    assert value(spark, codecs.vb_hex(F.lit(n))) == code
    assert codecs.decode_vb(bytes.fromhex(code)) == [n]


@pytest.mark.parametrize("positions, bits", [([0], "0"), ([0, 1, 3], "00100"), ([9, 12], "1110010101")])
def test_gamma(spark, positions, bits):
    assert value(spark, codecs.gamma_bits(F.array(*map(F.lit, positions)))) == bits
    assert codecs.decode_gamma(bits) == positions


def test_strings(spark):
    assert value(spark, strings.word_bigrams(F.lit("deep"))) == ["¶d", "de", "ee", "ep", "p¶"]
    assert value(spark, F.levenshtein(F.lit("kitten"), F.lit("sitting"))) == 3
    assert value(spark, strings.first_of_list_literal(F.lit("['cs.CV', 'cs.LG']"))) == "cs.CV"
    assert value(spark, strings.id_from_url(F.lit("http://x/y/abc"))) == "abc"
    assert value(spark, strings.number_with_commas(F.lit("1,234"))) == 1234
    assert value(spark, strings.highlight(F.lit("a deep deep b"), F.array(F.lit(2), F.lit(7), F.lit(2)), F.array(F.lit(6), F.lit(11), F.lit(6)), "<", ">")) == "a <deep> <deep> b"
    kept = strings.preprocess(F.array(*map(F.lit, ["The", "Cat", "!", "x", "Dogs"])), ["the"], 1)
    assert value(spark, kept) == ["cat", "dogs"]


@pytest.mark.parametrize("a, b, occ, jaccard", [("deap", "deep", 3, 3 / 7), ("netwark", "network", 6, 6 / 10), ("aaa", "aaa", 6, 6 / 2), ("aaaa", "aaaa", 11, 11 / -1)])
def test_bigram_overlap(spark, a, b, occ, jaccard):
    index = spell.bigram_index(spark.createDataFrame([(b,)], "word string"))
    row = spell.candidates(index, spark.createDataFrame([(a,)], "query string")).first()
    assert (row["occ"], row["jaccard"]) == (occ, pytest.approx(jaccard))


def test_spelling(spark):
    index = spell.bigram_index(spark.createDataFrame([("network",), ("neural",), ("deep",)], "word string"))
    assert spell.correct_text(index, spark, "deap netwark!") == "deep network!"
    assert spell.correct_text(index, spark, "") == ""


@pytest.mark.parametrize("method, expected", [("okapi25", (0.437015, 0.214289, 0.104710)), ("ltn-lnn", (0.461675, 0.218395, 0.081093)), ("ltc-lnc", (0.286707, 0.078534, 0.057341))])
def test_ranking_fixture(spark, small, method, expected):
    queries = spark.createDataFrame([(1, "deep rank")], "query_id int, query string")
    got = {r["doc_id"]: r["score"] for r in rank.rank(small, queries, method, 0.2).collect()}
    assert [round(got[d], 6) for d in ("d1", "d2", "d3")] == list(expected)


def test_ranking_without_hits(spark, small):
    queries = spark.createDataFrame([(1, "nothing here")], "query_id int, query string")
    for method in ("okapi25", "ltc-lnc"):
        assert rank.rank(small, queries, method).count() == 0
    with pytest.raises(ValueError):
        rank.rank(small, queries, "xyz-lnn")
    with pytest.raises(ValueError):
        rank.rank(small, queries, match="fuzzy")


def test_repeated_query_terms_count_twice_in_bm25(spark, small):
    queries = spark.createDataFrame([(1, "rank"), (2, "rank rank")], "query_id int, query string")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in rank.rank(small, queries, "okapi25").collect()}
    assert got[2, "d2"] == pytest.approx(2 * got[1, "d2"])


def test_top_k_and_all(spark, small):
    queries = spark.createDataFrame([(1, "deep rank")], "query_id int, query string")
    scores = rank.rank(small, queries, "okapi25")
    assert rank.top_k(scores, 2).count() == 2 and rank.top_k(scores, -1).count() == 3


def test_prefix_and_exact(spark, small):
    prefix = {r["doc_id"]: (r["tf_title"], r["tf_abstract"]) for r in small.lookup("deep").collect()}
    assert prefix == {"d1": (1, 2), "d2": (0, 1)}
    assert small.lookup("deepe").count() == 0  # not a term itself


def test_add_then_remove_is_identity(spark, small):
    new = spark.createDataFrame([("d9", "zebra\ndeep zebra")], "doc_id string, text string")
    grown = small.add(new)
    assert grown.vocab.where("term = 'zebra'").count() == 1
    rows = lambda i: sorted(map(tuple, i.counts.collect()))
    assert rows(grown.remove(["d9"])) == rows(small)


@pytest.mark.parametrize("compression", ["gamma", "vb", "none"])
def test_store_and_load(spark, small, tmp_path, compression):
    size = ix.store(small.postings, f"file://{tmp_path}/i", compression)
    back = ix.load(spark, f"file://{tmp_path}/i", compression)
    key = lambda df: sorted((r["term"], r["doc_id"], r["title_pos"], r["abstract_pos"]) for r in df.collect())
    assert size > 0 and key(back) == key(small.postings)


def test_unknown_compression(small):
    with pytest.raises(ValueError):
        ix.encode(small.postings, "zip")


@pytest.mark.parametrize("compression", ["gamma", "vb"])
def test_framing(spark, small, compression):
    for term, record in ((r["term"], bytes(r["record"])) for r in ix.framed(small.postings, compression).collect()):
        word, docs = ix.unframe_term(record, compression)
        want = sorted((r["doc_id"], r["title_pos"], r["abstract_pos"]) for r in small.postings.where(F.col("term") == term).collect())
        assert word == term and [(d, t, a) for d, t, a in docs] == want


def test_metrics_fixture(spark):
    qrels = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id int, doc_id string, rank int")
    runs = spark.createDataFrame([(1, 1, "b"), (1, 2, "x"), (1, 3, "a")], "query_id int, rank int, doc_id string")
    r = metrics.retrieval(runs, qrels).first()
    assert [round(r[k], 6) for k in ("precision", "recall", "f1", "map", "ndcg", "mrr", "ndcg_at_k")] == [0.666667, 0.666667, 0.666667, 0.833333, 0.821238, 1.0, 0.330138]
    none = spark.createDataFrame([(1, 1, "x")], "query_id int, rank int, doc_id string")
    assert all(metrics.retrieval(none, qrels).first()[k] == 0 for k in ("precision", "f1", "map", "ndcg", "mrr"))


def test_class_report(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "label string, prediction string")
    r = {x["class"]: x for x in metrics.class_report(rows).collect()}
    assert (r["a"]["precision"], r["a"]["recall"], r["c"]["f1"]) == (0.5, 0.5, 0.0)
    assert metrics.summary_report(rows).first()["accuracy"] == 0.5


def test_auc_of_a_perfect_order(spark):
    rows = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.2), (0, 0.1)], "label int, score double")
    assert metrics.auc(metrics.roc_points(rows)).first()["auc"] == pytest.approx(1.0)


GRAPH = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "zz"), ("c", "a")]


@pytest.mark.parametrize("preferred, updates, expected", [(None, None, (0.100685, 0.080312, 0.148602, 0.0375)), ("b", None, (0.181993, 0.264832, 0.339906, 0.0375)), (None, 2, (0.188906, 0.098594, 0.220781, 0.0375))])
def test_pagerank_fixture(spark, preferred, updates, expected):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    edges = spark.createDataFrame(GRAPH, "src string, dst string")
    prefs = spark.createDataFrame([(preferred, 1.0)], "id string, preference double") if preferred else None
    got = {r["id"]: r["score"] for r in graph.pagerank(nodes, edges, prefs, updates=updates).collect()}
    assert [round(got[x], 6) for x in "abcd"] == list(expected)


def test_preferences(spark):
    seeds = spark.createDataFrame([("p", "x"), ("q", "x"), ("q", "y")], "professor string, id string")
    assert {r["id"]: r["preference"] for r in graph.preferences_of(seeds, {"p": 1, "q": 2}).collect()} == {"x": 3.0, "y": 2.0}
    with pytest.raises(KeyError):
        graph.preferences_of(seeds, {"z": 1})


@pytest.mark.parametrize("size", [2, 1 << 16])
def test_hits_in_lists_of_neighbours(spark, monkeypatch, size):
    monkeypatch.setattr(graph, "LIST", size)
    edges = [("a", "p"), ("a", "q"), ("b", "q"), ("q", "b"), ("c", "p"), ("c", "q"), ("c", "r"), ("c", "r"), (None, "r"), ("d", "d")]
    names = sorted({x for e in edges for x in e if x and None not in e})
    near = {n: {b for a, b in edges if a == n and b} | {a for a, b in edges if b == n and a} for n in names}
    hub = {n: 1.0 for n in names}
    for _ in range(4):
        hub = {n: sum(hub[m] for m in near[n]) for n in names}
    total = sum(hub.values())
    got = {r["id"]: round(r["hub"], 9) for r in graph.hits(spark.createDataFrame(edges, "a string, b string"), 2).collect()}
    assert got == {n: round(h / total, 9) for n, h in hub.items()}


def test_hits_and_bfs(spark):
    edges = spark.createDataFrame([("ann", 1), ("ann", 2), ("bob", 2)], "author string, paper_id int")
    top = graph.top_authors(edges, 2).collect()
    assert [r["author"] for r in top] == ["ann", "bob"] and top[0]["hub"] > top[1]["hub"]
    seeds = spark.createDataFrame([("b",)], "id string")
    reached = {r["id"]: r["depth"] for r in graph.bfs(spark.createDataFrame(GRAPH, "src string, dst string"), seeds).collect()}
    assert reached == {"b": 0, "c": 1, "zz": 2, "a": 2}
    assert graph.bfs(spark.createDataFrame(GRAPH, "src string, dst string"), seeds, cap=2).count() == 2


def test_kmeans_keeps_an_empty_cluster(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 1.0]), (3, [9.0, 9.0])], "vec_id long, embedding array<double>")
    c = spark.createDataFrame([(0, [0.0, 0.0]), (1, [10.0, 10.0]), (2, [99.0, 99.0])], "cluster int, center array<double>")
    got = {r["cluster"]: r["center"] for r in vector.kmeans(v, c).collect()}
    assert got == {0: [0.0, 0.5], 1: [9.0, 9.0], 2: [99.0, 99.0]}


def test_kmeans_goes_on_until_the_centers_stand_still(spark):
    rng = np.random.default_rng(0)
    x = np.sort(rng.random((400, 2)), 0)
    want, rounds = x[:4].copy(), 0
    while True:
        near = ((x[:, None] - want) ** 2).sum(2).argmin(1)
        new = np.array([x[near == k].mean(0) for k in range(4)])
        rounds += 1
        if np.allclose(want, new, atol=1e-12, rtol=0):
            break
        want = new
    assert rounds > 20
    v = spark.createDataFrame([*enumerate(x.tolist()), (400, None)], "vec_id long, embedding array<double>")
    c = v.where("vec_id < 4").select(F.col("vec_id").cast("int").alias("cluster"), F.col("embedding").alias("center"))
    got = vector.kmeans(v, c).orderBy("cluster").collect()
    assert np.allclose([r["center"] for r in got], want, atol=1e-9, rtol=0)
    step = vector.kmeans_step(v.where("vec_id < 400"), vector.kmeans(v, c)).orderBy("cluster").collect()
    assert np.allclose([r["center"] for r in step], want, atol=1e-9, rtol=0)


def test_ward_merges_the_nearest_first(spark):
    v = spark.createDataFrame([(1, [0.0]), (2, [0.1]), (3, [5.0])], "vec_id long, embedding array<double>")
    first = vector.ward(v).orderBy("step").first()
    assert (first["a"], first["b"], round(first["height"], 6)) == (0, 1, 0.1)


def test_ward_query_links_all_of_a_small_table(spark):
    d = "/root/testdata/sf0.001"
    rows = mining.vectors(spark, d).orderBy("vec_id").collect()
    got = mining.ward_clusters(spark, d).orderBy("step").collect()
    assert len(got) == len(rows) - 1 > 199 and got[-1]["size"] == len(rows)
    members = {i: [i] for i in range(len(rows))}
    x = np.array([r["embedding"] for r in rows], float)
    for r in got:  # a merge's height follows from the means of its two sides
        a, b = members.pop(r["a"]), members.pop(r["b"])
        want = math.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(x[a].mean(0) - x[b].mean(0))
        assert math.isclose(r["height"], want, rel_tol=1e-6, abs_tol=1e-9) and r["size"] == len(a) + len(b)
        members[len(rows) + r["step"]] = a + b
    assert all(p["height"] <= q["height"] + 1e-9 for p, q in zip(got, got[1:]))


def test_naive_bayes_prior_is_not_smoothed(spark):
    labels = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "y")], "doc_id int, label string")
    tokens = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "doc_id int, term string")
    prior, likelihood, missing = learn.naive_bayes_fit(tokens, labels)
    assert {r["label"]: round(math.exp(r["log_prior"]), 6) for r in prior.collect()} == {"x": 0.75, "y": 0.25}
    docs = spark.createDataFrame([(10,), (11,)], "doc_id int")
    new = spark.createDataFrame([(10, "c"), (10, "c")], "doc_id int, term string")
    got = {r["doc_id"]: r["prediction"] for r in learn.naive_bayes_predict((prior, likelihood, missing), new, docs).collect()}
    assert got == {10: "y", 11: "x"}


def test_collaborative_tolerates_missing_lists(spark):
    likes = spark.createDataFrame([(1, ["a"]), (2, ["a"]), (3, ["a", "b"]), (4, None)], "user int, fields array<string>")
    lists = spark.createDataFrame([(2, ["p", "q"]), (3, None)], "user int, papers array<string>")
    near = recsys.neighbours(recsys.user_fields(likes), 2)
    got = [(r["user"], r["paper"]) for r in recsys.collaborative(near, lists).orderBy("user", "position").collect()]
    assert got == [(1, "p"), (1, "q"), (3, "p"), (3, "q")]


def test_histogram_of_one_value(spark):
    assert profile.histogram(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x").count() == 1


def test_token_offsets(spark):
    parts = text.sections(spark.createDataFrame([(1, "Héllo, a1\nB"), (2, None)], "doc_id int, text string"))
    got = [(r["section"], r["char_idx"], r["surface"], r["term"]) for r in text.token_spans(parts).orderBy("section", "pos").collect()]
    assert got == [("abstract", 0, "B", "b"), ("title", 0, "Héllo", "héllo"), ("title", 7, "a1", "a1")]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('paperId,title,abstract,x\n1,"T, one",\n2,,"two\nlines"\n')
    rows = {r["doc_id"]: (r["title"], r["abstract"]) for r in tables.papers_csv(spark, f"{tmp_path}/a.csv").collect()}
    assert rows == {"1": ("T, one", ""), "2": ("", "two\nlines")}
    (tmp_path / "b.csv").write_text("titles,abstracts,terms\nA,x,\"['cs.CV', 'cs.LG']\"\nA,y,\"['q']\"\nB,x,\"['q']\"\n")
    assert [tuple(r)[1:] for r in tables.categorised_csv(spark, f"{tmp_path}/b.csv").collect()] == [("A", "x", "cs.CV")]
    (tmp_path / "v.json").write_text('{"q": ["b", "a"]}')
    assert [tuple(r) for r in tables.judgements_json(spark, f"{tmp_path}/v.json").collect()] == [("q", 1, "b"), ("q", 2, "a")]
    for name, title in (("1", "old"), ("2", "new")):
        (tmp_path / f"p{name}.json").write_text(f'[{{"id": "x", "title": "{title}"}}]')
    assert [r["title"] for r in tables.crawled_json(spark, [f"{tmp_path}/p1.json", f"{tmp_path}/p2.json"]).collect()] == ["new"]
    page = '<meta name="citation_title" content="T"><meta name="citation_author" content="A B">1,234 Citations'
    paper = pages.paper_records(spark.createDataFrame([("http://h/p/42", page)], "url string, html string")).first()
    assert (paper["id"], paper["title"], paper["authors"], paper["citation_count"], paper["reference_count"], paper["related_topics"]) == ("42", "T", ["A B"], 1234, -1, [])
    built = []
    for _ in range(2):
        tables.artefact(spark, f"file://{tmp_path}/art", "n", {"k": 1}, lambda: built.append(1) or spark.range(3))
    assert built == [1]


def test_streaming_append(spark, tmp_path):
    spark.createDataFrame([(1, "alpha beta"), (2, "beta")], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in")
    ingest.append_postings(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").where("term = 'beta'").count() == 2


def test_engine(spark):
    from quillspark.engine import Engine, NotReady

    docs = spark.createDataFrame([(1, "deep model\ndeep deeper graph"), (2, "graph\ndeep rank rank"), (3, "model\nrank model")], "doc_id long, text string")
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    engine = Engine(
        ix.Index.build(docs, n_stops=0),
        Engine.bigrams_of(docs),
        table([(1, "x"), (2, "y"), (3, "y")], "doc_id long, category string"),
        table([(1, 0), (2, 1), (3, 1)], "doc_id long, cluster int"),
        table([(0, "a"), (1, "b")], "cluster int, topic string"),
        table([(1,), (2,), (3,)], "id long"),
        table([(1, 2), (3, 2)], "src long, dst long"),
        table([("p", 3)], "professor string, id long"),
    )
    ids = lambda df: [r["doc_id"] for r in df.orderBy("rank").collect()]
    assert ids(engine.search("dep rnak", method="okapi25", correct=True, abstract_weight=0.2)) == [1, 2, 3]
    assert ids(engine.search("deep rank", category="y", method="okapi25")) == [2, 3]
    assert ids(engine.search("deep rank", method="okapi25", preferences={"p": 1.0}, personalization_weight=1.0))[0] == 2
    found = engine.search("deep", k=1, method="okapi25", highlight=True, clustered=True).first()
    assert "<mark" in found["abstract"] and found["topic"] in ("a", "b")
    with pytest.raises(NotReady):
        engine.similar(1)


def test_evaluation_ranks_by_whole_passages(spark, tmp_path):
    start = "common words that open each of these passages in the very same way"
    passages = [f"{start} own{i} part{i} end{i}" for i in range(4)]
    fill = [f"note{i}\nother{i} text{i} of{i}" for i in range(30)]
    docs = [(i, f"title{i}\nintro{i} {passages[3 - i % 4]} outro{i}") for i in range(8)] + [(100 + i, t) for i, t in enumerate(fill)]
    spark.createDataFrame([(*x, "en") for x in docs], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    runs, qrels = search.benchmark_runs(spark, str(tmp_path))
    held = {q: {i for i, t in docs if p in t} for q, p in enumerate(passages)}
    judged = qrels.collect()
    assert {q: {r["doc_id"] for r in judged if r["query_id"] == q} for q in held} == held
    first = runs.where("rank <= 2").collect()
    assert {q: {r["doc_id"] for r in first if r["query_id"] == q} for q in held} == held
    got = search.eval_by_query(spark, str(tmp_path)).collect()
    assert len(got) == 4 and all(r["recall"] == r["mrr"] == r["map"] == 1 for r in got)
    assert search.eval_summary(spark, str(tmp_path)).first()["mrr"] == 1


def test_passage_runs_match_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    sql = search._bm25_scores(match="exact", source="(SELECT item_id AS query_id, text AS query FROM benchmark) v")
    want = con.execute(f"{sql}{search._RANKED} SELECT query_id, rank, doc_id FROM best WHERE rank <= 10").fetchall()
    runs, _ = search.benchmark_runs(spark, d)
    assert sorted(tuple(r) for r in runs.collect()) == sorted(want)


def test_codes_of_a_column_are_decoded_together(spark):
    """Arrow decoders against the plain ones, with nulls, empty and long lists, and a number cut off; the round trip needs no join."""
    rng = np.random.default_rng(4)
    lists = [sorted({int(x) for x in rng.integers(0, [5, 300, 2**31 - 1][i % 3], i % 4)}) for i in range(200)] + [list(range(300))]
    rows = spark.createDataFrame([(f"t{i}", i if i else None, p, lists[-i]) for i, p in enumerate(lists)], "term string, doc_id long, title_pos array<int>, abstract_pos array<int>")
    codes = [r.asDict() for r in rows.select(codecs.gamma_bits(F.col("title_pos")).alias("gamma"), codecs.vb_bytes(F.col("title_pos")).alias("vb")).collect()]
    gamma, vb = [None, *(r["gamma"] for r in codes)], [None, *(bytes(r["vb"]) for r in codes), b"\x05", b"\x85"]
    assert codecs.gamma_lists(pa.array(gamma, pa.string())).to_pylist() == [None if c is None else codecs.decode_gamma(c) for c in gamma]
    assert codecs.vb_lists(pa.array(vb, pa.binary())).to_pylist() == [None if c is None else codecs.decode_vb(c) for c in vb]
    made = ix.roundtrip(rows)
    assert sorted(map(tuple, made.collect())) == [(c, 201, 201) for c in ("gamma", "none", "vb")]
    assert "Join" not in made._jdf.queryExecution().toString()
    assert sorted(map(tuple, ix.roundtrip(rows.limit(0)).collect())) == [(c, 0, 0) for c in ("gamma", "none", "vb")]
