"""The pipeline, stage by stage, on the smallest tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_columns(stages):
    for name, _ in pipeline.STAGES[:-1]:
        assert stages[name].columns == stages["documents"].columns
        assert [f.dataType for f in stages[name].schema] == [f.dataType for f in stages["documents"].schema]


def test_toxicity_keeps_texts(spark, stages):
    before, after = rows(stages["documents"]), rows(stages["toxicity"])
    assert set(after) < set(before) and all(before[i] == t for i, t in after.items())
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()
    assert sum(r["doc_id"] in after for r in labels) <= 0.2 * len(labels)


def test_line_dedup_only_drops_lines(stages):
    before, after = rows(stages["toxicity"]), rows(stages["line_dedup"])
    for i, t in after.items():
        lines = iter(before[i].split("\n"))
        assert all(any(x == y for y in lines) for x in t.split("\n"))


def test_near_dedup_keeps_one_of_each_class(stages):
    from test_llm_operators import brute_classes

    before, after = rows(stages["line_dedup"]), rows(stages["near_dedup"])
    assert set(after) == set(brute_classes(before).values())


def test_mixing_loses_nothing(stages):
    before, after = rows(stages["near_dedup"]), stages["mixing"].groupBy("doc_id").count().collect()
    assert {r["doc_id"] for r in after} == set(before) and max(r["count"] for r in after) <= 2


def test_encoding_round_trip(stages):
    texts = rows(stages["mixing"])
    for r in stages["bpe"].collect():
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() and len(r["ids"]) == r["n_tokens"]


def test_run(spark, stages):
    key = lambda df: sorted((r["doc_id"], r["ids_sha256"]) for r in df.collect())
    assert key(pipeline.run(spark, SF)) == key(stages["bpe"])


def test_line_dedup_keeps_one_line_of_each_component(stages):
    from test_llm_operators import brute_lines

    from quillspark.llm.fuzzy_lines import normalise

    before, after = rows(stages["toxicity"]), rows(stages["line_dedup"])
    _, lines, roots = brute_lines(before)
    of = {x: roots[n] for n, x in enumerate(lines)}  # a short line is its own component
    home = {}
    for i, t in sorted(before.items()):
        for x in filter(None, map(normalise, t.split("\n"))):
            home.setdefault(of.get(x, x), i)
    kept = [(of.get(x, x), i) for i, t in after.items() for x in filter(None, map(normalise, t.split("\n")))]
    assert len(kept) == len(home) and dict(kept) == home
    assert set(after) == set(home.values()) | {i for i, t in before.items() if not t.strip()}


def test_toxicity_keeps_clean_documents(spark, stages):
    before, after = rows(stages["documents"]), rows(stages["toxicity"])
    clean = [r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect() if r["doc_id"] in before]
    assert clean and sum(i not in after for i in clean) <= 0.1 * len(clean)


ODD = [
    (5, "alpha beta gamma delta epsilon zeta eta", "en", "s", 1),
    (5, "an other text that has its own id shared with another", "en", "s", 2),
    (3, "an other text that has its own id shared with another", "de", None, 3),
    (7, "alpha beta gamma delta epsilon zeta eta", None, "t", 4),
    (7, "alpha beta gamma delta epsilon zeta eta", None, "t", 4),
    (8, "rows that are alike in every single column they have", "en", "s", 5),
    (8, "rows that are alike in every single column they have", "en", "s", 5),
    (9, None, "en", "s", None),
    (10, "", "en", "s", 0),
    (None, "a text without any id at all is here", "en", "s", 6),
    (None, "another text without any id at all is there", "en", "s", 6),
    (11, "word " * 50_000, "en", "s", 7),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).withColumn("tag", F.lit("mine")).withColumn("nth", F.lit(0))


def test_near_dedup_of_shared_ids(spark, odd):
    left = pipeline.dedup_documents(spark, odd, SF)
    assert left.columns == odd.columns
    got = sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str)
    text = dict(enumerate(r[1] for r in ODD))
    assert got == sorted([(5, text[0]), (3, text[2]), (8, text[5]), (9, None), (10, ""), (None, text[9]), (None, text[10]), (11, text[11])], key=str)


def test_line_dedup_of_shared_ids(spark, odd):
    got = [(r["doc_id"], r["text"]) for r in pipeline.dedup_lines(spark, odd, SF).collect()]
    text = dict(enumerate(r[1] for r in ODD))
    assert sorted(got, key=str) == sorted([(5, text[0]), (3, text[2]), (8, text[5]), (9, ""), (10, ""), (None, text[9]), (None, text[10]), (11, text[11])], key=str)


def test_other_stages_of_odd_rows(spark, odd):
    assert pipeline.drop_toxic(spark, odd, SF).count() == len(ODD)
    mixed = pipeline.mix_sources(spark, odd, SF)
    assert mixed.columns == odd.columns and {(r["doc_id"], r["text"]) for r in mixed.collect()} == {r[:2] for r in ODD}
    assert pipeline.encode(spark, odd, SF).count() == len(ODD)


def test_stages_of_nothing(spark, odd):
    for _, stage in pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0
