"""The crawl against a plain queue, and the stream of requests against the batch ranking."""

import random
from collections import deque

import pytest

from quillspark.operators import crawl, rank
from quillspark.operators import index as ix
from quillspark.streaming import requests

PAGES = "page_id long, url string, html string"
SEEDS = "position int, url string"


def page(n, references, found=True, **fields):
    title, authors = fields.get("title", f"T{n}"), fields.get("authors", ["A B", "C D"])
    html = "" if found else '<div id="error-status" value="404"></div>'
    html += f'<meta name="citation_title" content="{title}"><meta name="description" content="about {n}"><meta name="citation_publication_date" content="2019/05">'
    html += "".join(f'<meta name="citation_author" content="{a}">' for a in authors)
    html += '<li data-topics="graphs, search"></li><span>1,234 Citations</span><span>56 References</span>'
    return (n, f"https://papers.example/{n}", html + "".join(f'<div data-reference="https://papers.example/{r}"></div>' for r in references))


def plain(pages, seeds, cap):
    """A queue, as one process would crawl."""
    links = {}
    for n, url, html, references, found in sorted(pages, key=lambda p: p[0]):
        links.setdefault(str(n), references if found else None)
    queue, out = deque((str(s), 0) for s in seeds), []
    seen = set()
    while queue and (cap is None or len(out) < cap):
        n, depth = queue.popleft()
        if n in seen or links.get(n) is None:
            continue
        seen.add(n)
        out.append((len(out), depth, n))
        queue.extend((str(r), depth + 1) for r in links[n])
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("cap", [None, 1, 23])
def test_crawl_is_that_of_a_queue(spark, seed, cap):
    rnd = random.Random(seed)
    made = [(n, [rnd.randrange(70) for _ in range(rnd.randrange(5))], rnd.random() > 0.15) for n in range(60)]
    rows = [page(n, r, f) for n, r, f in made]
    seeds = [3, 64, 3, 17, 5]
    got = crawl.crawl(spark.createDataFrame(rows, PAGES).repartition(3), spark.createDataFrame([(i, f"https://papers.example/{s}") for i, s in enumerate(seeds)], SEEDS), cap)
    assert [(r["place"], r["depth"], r["id"]) for r in got.orderBy("place").collect()] == plain([(n, "", "", r, f) for n, r, f in made], seeds, cap)


def test_records_of_a_crawl_hold_every_field(spark):
    rows = [page(1, [2, 2, 1], title="First"), page(2, [], authors=[]), (2, "https://papers.example/2", "<p>a later copy</p>"), (3, None, None), (4, "https://papers.example/4", None)]
    seeds = spark.createDataFrame([(0, "https://papers.example/1"), (1, None), (2, "https://papers.example/4")], SEEDS)
    first, bare, second = crawl.crawl(spark.createDataFrame([*rows[:2], (9, *rows[2][1:]), *rows[3:]], PAGES), seeds).orderBy("place").collect()
    assert first.asDict() == {"place": 0, "depth": 0, "id": "1", "title": "First", "abstract": "about 1", "publication_year": 2019, "authors": ["A B", "C D"], "related_topics": ["graphs", "search"], "citation_count": 1234, "reference_count": 56, "references": ["2", "2", "1"]}
    assert (bare["id"], bare["depth"], bare["title"], bare["citation_count"], bare["references"]) == ("4", 0, "", -1, [])
    assert (second["id"], second["depth"], second["authors"], second["abstract"]) == ("2", 1, [], "about 2")


def test_empty_crawls(spark):
    pages, seeds = spark.createDataFrame([page(1, [])], PAGES), spark.createDataFrame([(0, "https://papers.example/1")], SEEDS)
    assert crawl.crawl(pages, seeds.limit(0)).isEmpty() and crawl.crawl(pages.limit(0), seeds).isEmpty()


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame([(1, "deep model\ndeep deeper graph"), (2, "graph\ndeep rank rank"), (3, "model\nrank model")], "doc_id long, text string")
    return ix.Index.build(docs, n_stops=0).cached()


ASKED = [(1, "deep rank", "okapi25", 2), (2, "graph", "ltc-lnc", -1), (3, "rank model", "okapi25", 1), (4, "zebra", "okapi25", 5), (5, None, "okapi25", 5), (6, "deep", "fast", 5), (7, "deep", "okapi25", 0), (None, "deep", "okapi25", 1), (1, "deep rank", "okapi25", 2)]


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_answers_are_those_of_the_batch_ranking(spark, index):
    got = sorted_rows(requests.answer(index, spark.createDataFrame(ASKED, requests.REQUEST)))
    want = [(4, None, None, None, None), (5, None, None, None, "no query"), (6, None, None, None, "unknown method"), (7, None, None, None, "k must be positive or -1")]
    for i, q, m, k in ASKED[:3]:
        best = rank.top_k(rank.rank(index, spark.createDataFrame([(i, q)], "query_id long, query string"), m), k)
        want += [(r["query_id"], r["rank"], r["doc_id"], r["score"], None) for r in best.collect()]
    key = lambda r: (r[0], r[1] or 0, r[2] or 0, round(r[3] or 0, 9), r[4] or "")
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_limits_are_applied_before_scores_are_shuffled(spark, index):
    few = [(1, "graph network", "okapi25", 2), (2, "graph", "okapi25", 3)]
    plan = requests.answer(index, spark.createDataFrame(few, requests.REQUEST))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    got = sorted_rows(requests.answer(index, spark.createDataFrame([*few, (3, "graph network", "okapi25", -1)], requests.REQUEST)))
    one = sorted_rows(requests.answer(index, spark.createDataFrame(few, requests.REQUEST)))
    assert [r for r in got if r[0] < 3] == one and [r[2:] for r in got if r[0] == 3][:1] != []


def test_prefixes_of_a_large_vocabulary(spark, tmp_path, monkeypatch):
    docs = [(i, f"graph grapher w{i}\ngraphs net network w{i}x{i % 3} netting {'gra' * (i % 2)}") for i in range(40)]
    stored = ix.Index.build(spark.createDataFrame(docs, "doc_id long, text string"), 0).stored(str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, "graph net w1"), (2, "gra w1x1 none"), (3, "network")], "query_id int, query string")
    key = lambda df: sorted((r["query_id"], r["doc_id"], round(r["score"], 9)) for r in df.collect())
    before = key(rank.rank(stored, asked, "okapi25"))
    monkeypatch.setattr(rank, "BROADCAST_TERMS", 0)
    found = rank.rank(stored, asked, "okapi25")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert key(found) == before
    assert "hashpartitioning(qterm" not in "".join(line for line in plan.split("\n") if "doc_id" in line)


def test_a_restarted_stream_answers_each_request_once(spark, index, tmp_path, monkeypatch):
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    put = lambda rows: spark.createDataFrame(rows, requests.REQUEST).coalesce(1).write.mode("append").json(source)
    run = lambda: requests.serve(index, spark.readStream.schema(requests.REQUEST).json(source), out, state).awaitTermination(120)
    put(ASKED[:2])
    run()
    put(ASKED[2:4])
    whole = requests.answer

    def fails(*args):
        # the batch's files are there, but it is not committed
        df = whole(*args)
        df.write.mode("overwrite").parquet(f"{out}/batch=1")
        raise RuntimeError("executor lost")

    monkeypatch.setattr(requests, "answer", fails)
    with pytest.raises(Exception, match="executor lost"):
        run()
    monkeypatch.setattr(requests, "answer", whole)
    run()
    run()
    assert sorted_rows(requests.responses(spark, out)) == sorted_rows(requests.answer(index, spark.createDataFrame(ASKED[:4], requests.REQUEST)))
