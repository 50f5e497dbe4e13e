"""Subword vectors: gradients, averaging, neighbours against plain versions, and what training is to learn."""

import numpy as np
from pyspark.sql import functions as F

from quillspark.operators import subwords


def test_gradients_follow_finite_differences():
    rng = np.random.default_rng(3)
    h, positive, noise = rng.normal(size=(3, 4)), rng.normal(size=(5, 4)), rng.normal(size=(6, 4))
    centre = np.array([0, 0, 1, 2, 2])
    _, *slopes = subwords.gradients(h, centre, positive, noise, 5)
    for which, table in enumerate((h, positive, noise)):
        for place in np.ndindex(table.shape):
            was = table[place]
            values = []
            for side in (1e-6, -1e-6):
                table[place] = was + side
                values.append(subwords.gradients(h, centre, positive, noise, 5)[0])
            table[place] = was
            assert abs((values[0] - values[1]) / 2e-6 - slopes[which][place]) < 1e-5


def test_pairs_are_those_of_a_plain_loop():
    rng = np.random.default_rng(4)
    sentence, width = np.sort(rng.integers(0, 6, 40)), rng.integers(1, 6, 40)
    got = sorted(zip(*(x.tolist() for x in subwords.pairs(sentence, width, 5)), strict=True))
    assert got == [(i, j) for i in range(40) for j in range(40) if i != j and abs(i - j) <= width[i] and sentence[i] == sentence[j]]


def corpus(spark):
    rng = np.random.default_rng(5)
    themes = ("harbour vessel sailor anchor captain lighthouse", "kitchen pastry butter recipe flour cinnamon", "planet comet telescope galaxy asteroid nebula")
    rows = [(rng.choice(t.split(), 12).tolist(),) for t in themes for _ in range(250)]
    return spark.createDataFrame(rows, "terms array<string>").repartition(4)


def test_words_of_one_theme_and_misspelt_words_are_near(spark, tmp_path):
    texts = corpus(spark)
    model = subwords.fit(texts, size=24, rounds=5, buckets=4096, often=1.0)
    words = texts.select(F.explode("terms").alias("term")).distinct()
    asked = spark.createDataFrame([("lighthuose",), ("telescpoe",), ("captain",)], "query string")
    near = {}
    for r in model.neighbours(asked, words, 5).orderBy("query", "rank").collect():
        near.setdefault(r["query"], []).append(r["term"])
    assert "lighthouse" in near["lighthuose"] and "telescope" in near["telescpoe"]
    assert set(near["captain"]) == {"harbour", "vessel", "sailor", "anchor", "lighthouse"}
    model.save(spark, str(tmp_path / "model"))
    assert np.array_equal(subwords.Subwords.load(spark, str(tmp_path / "model")).given, model.given)


def test_neighbours_are_those_of_a_plain_search(spark):
    model = subwords.Subwords(np.random.default_rng(6).normal(size=(512, 8)).astype(np.float32))
    words = [f"w{i * i}" for i in range(200)]
    table = spark.createDataFrame([(w,) for w in [*words, words[0], None]], "term string").repartition(5)
    unit = {w: v / np.linalg.norm(v) for w in words for v in [model.given[subwords.grams(w, 512)].astype(float).mean(axis=0)]}
    got = {(r["query"], r["rank"]): r["term"] for r in model.neighbours(table.limit(0).union(table.where("term IN ('w4', 'w81')")).withColumnRenamed("term", "query"), table, 7).collect()}
    for q in ("w4", "w81"):
        best = sorted((w for w in words if w != q), key=lambda w: (-round(float(unit[q] @ unit[w]), 9), w))[:7]
        assert [got[q, i + 1] for i in range(7)] == best


def test_a_second_run_gives_the_same_model_and_odd_rows_teach_nothing(spark):
    rows = [(["alpha", "beta", "gamma"] * 700,), (None,), ([],), ([None, "alpha"],), (["lone"],)]
    texts = spark.createDataFrame(rows, "terms array<string>").coalesce(1)
    first, second = (subwords.fit(texts, size=8, rounds=2, buckets=256).given for _ in range(2))
    assert np.array_equal(first, second) and np.isfinite(first).all()
    empty = subwords.fit(texts.limit(0), size=8, rounds=2, buckets=256).given
    assert empty.shape == (256, 8) and np.isfinite(empty).all()
    odd = subwords.Subwords(first).vectors(spark.createDataFrame([("",), (None,), ("unseen",)], "term string")).collect()
    assert [r["vector"] is None for r in odd] == [False, True, False]
