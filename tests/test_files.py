"""Whole index files and matrices, written and read by many tasks."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import index as ix
from quillspark.operators.index import Index
from quillspark.sources import files, tables

TEXTS = [(1, "deep graph\nthe graph of the net"), (2, "net\ndeep net deep"), (10, "graph"), (11, None), (12, "été graph\ngraph " + "graph word " * 100)]


@pytest.fixture(scope="module")
def postings(spark):
    return Index.build(spark.createDataFrame(TEXTS, "doc_id long, text string"), 0).postings


def rows(df):
    return sorted((r["term"], int(r["doc_id"]), list(r["title_pos"]), list(r["abstract_pos"])) for r in df.collect())


def whole(path):
    return b"".join((path / p["file"]).read_bytes() for p in files.manifest_of(str(path))["parts"])


@pytest.mark.parametrize("compression", ["gamma", "vb", "none"])
@pytest.mark.parametrize("block", [1, 40, 1 << 20])
def test_index_files_round_trip(spark, postings, tmp_path, compression, block):
    path = tmp_path / "index"
    size = files.write_index(postings, str(path), compression, block)
    back = files.read_index(spark, f"file://{path}")
    assert rows(back) == rows(postings)
    data = whole(path)
    assert len(data) == size
    assert back.rdd.getNumPartitions() > 5 if block == 1 else True
    by_term = {}
    for term, doc, title, abstract in rows(postings):
        by_term.setdefault(term, []).append((str(doc), title, abstract))
    if compression == "none":
        assert json.loads(data) == [[t, {d: {"title": a, "abstract": b} for d, a, b in docs}] for t, docs in sorted(by_term.items())]
    else:
        assert data == b"".join(ix.frame_term(t, docs, compression) for t, docs in sorted(by_term.items()))
    (tmp_path / "plain").write_bytes(data)
    assert rows(files.read_index(spark, str(tmp_path / "plain"), compression)) == rows(postings)


def test_index_files_after_the_codecs_were_used(spark, postings, tmp_path):
    """Column functions that have been used hold a lock, and what ships a data source must not drag them along."""
    ix.decode(ix.encode(postings, "vb"), "vb").collect()
    ix.decode(ix.encode(postings, "gamma"), "gamma").collect()
    files.write_index(postings, str(tmp_path / "index"), "vb")
    assert rows(files.read_index(spark, str(tmp_path / "index"))) == rows(postings)


@pytest.mark.parametrize("compression", ["gamma", "vb", "none"])
def test_texts_dealt_by_ranges_give_the_same_file(spark, tmp_path, compression):
    """Postings that are cut from sorted tokens, and documents that travel together, give the bytes of postings one by one; rows that share an id are one document."""
    texts = TEXTS + [(i, f"graph net\nnet word{i % 7} " + "deep " * (i % 5)) for i in range(20, 400)] + [(2, "net\ndeep net deep"), (7, "")]
    texts += [(500, "graph\n" + "deep net " * 12000)]  # more tokens than a batch has rows
    index = Index.build(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), 1)
    if compression == "gamma":
        index = index.remove([500])
    dealt = index.by_ranges()
    made = ix.ordered_postings(dealt.kept)
    assert "hashpartitioning" not in made._jdf.queryExecution().executedPlan().toString()  # tokens stay where they are made
    assert rows(made) == rows(index.postings)
    size = files.write_index(index.postings, str(tmp_path / "a"), compression, 1000)
    assert files.write_index(made, str(tmp_path / "b"), compression, 1000, ranges=True) == size
    assert whole(tmp_path / "a") == whole(tmp_path / "b")
    assert rows(files.read_index(spark, str(tmp_path / "b"))) == rows(index.postings)
    assert not list((tmp_path / "b").glob("_chunks*"))


def test_json_file_with_odd_ids_and_spacing(spark, tmp_path):
    odd = spark.createDataFrame([("a", 'x"y\\z', [0], []), ("a", "é\n", [], [1, 2]), ("b", "}", [3], [])], "term string, doc_id string, title_pos array<int>, abstract_pos array<int>")
    files.write_index(odd, str(tmp_path / "i"), "none")
    data = json.loads(whole(tmp_path / "i"))
    assert data == [["a", {'x"y\\z': {"title": [0], "abstract": []}, "é\n": {"title": [], "abstract": [1, 2]}}], ["b", {"}": {"title": [3], "abstract": []}}]]
    (tmp_path / "spaced").write_bytes(whole(tmp_path / "i").replace(b": [", b":  ["))
    want = sorted((r["term"], r["doc_id"], r["title_pos"], r["abstract_pos"]) for r in odd.collect())
    for path in ("i", "spaced"):
        assert sorted((r["term"], r["doc_id"], r["title_pos"], r["abstract_pos"]) for r in files.read_index(spark, str(tmp_path / path), "none").collect()) == want


def test_index_file_bytes(spark, tmp_path):
    """A file made by hand: one term, two documents."""
    made = spark.createDataFrame([("ab", 7, [0], [0, 130]), ("ab", 8, [], [2])], "term string, doc_id long, title_pos array<int>, abstract_pos array<int>")
    files.write_index(made, str(tmp_path / "vb"), "vb")
    assert whole(tmp_path / "vb") == bytes.fromhex("02 6162 00000002 01 37 00000001 80 00000003 80 0182 01 38 00000000 00000001 82")
    files.write_index(made, str(tmp_path / "g"), "gamma")
    # 0 -> 1 -> "0"; 0, 130 -> 1, 130 -> "0" + "11111110" "0000010"; 2 -> 3 -> "101"
    assert whole(tmp_path / "g") == bytes.fromhex("02 6162 00000002 01 37 01 0001 00 03 0010 007f02 01 38 01 0000 00 01 0003 05")


def test_overwriting_and_empty_tables(spark, postings, tmp_path):
    path = str(tmp_path / "i")
    files.write_index(postings, path)
    files.write_index(postings.where("term = 'net'"), path)
    assert rows(files.read_index(spark, path)) == rows(postings.where("term = 'net'"))
    assert len(list((tmp_path / "i").glob("part-*"))) == len(files.manifest_of(path)["parts"])
    assert files.write_index(postings.limit(0), path) == 0
    assert files.read_index(spark, path).count() == 0
    with pytest.raises(ValueError):
        files.write_index(postings, path, "zip")


def test_values_beyond_the_layout_fail(spark, tmp_path):
    long_list = spark.createDataFrame([("a", 1, list(range(0, 400000, 100)), [])], "term string, doc_id long, title_pos array<int>, abstract_pos array<int>")
    with pytest.raises(Exception, match="length field"):
        files.write_index(long_list, str(tmp_path / "g"), "gamma")
    files.write_index(long_list, str(tmp_path / "v"), "vb")
    assert rows(files.read_index(spark, str(tmp_path / "v"))) == rows(long_list)


def test_matrices_both_ways(spark, tmp_path):
    m = np.random.default_rng(1).normal(size=(1000, 7))
    np.save(tmp_path / "m.npy", m)
    read = files.read_matrix(spark, str(tmp_path / "m.npy"), block=4096)
    assert read.rdd.getNumPartitions() > 10
    got = [r["embedding"] for r in read.orderBy("vec_id").collect()]
    assert np.array_equal(np.array(got), m)
    files.write_matrix(read.orderBy(F.rand(3)), str(tmp_path / "out"), block=8192)
    parts = files.manifest_of(str(tmp_path / "out"))["parts"]
    assert len(parts) > 3
    assert np.array_equal(np.concatenate([np.load(tmp_path / "out" / p["file"]) for p in parts]), m)
    again = tables.matrix_npy(spark, str(tmp_path / "out"))
    assert again.orderBy("vec_id").collect() == read.orderBy("vec_id").collect()
    np.save(tmp_path / "f.npy", m.astype("float32"))
    assert np.allclose([r["embedding"] for r in tables.matrix_npy(spark, str(tmp_path / "f.npy")).orderBy("vec_id").collect()], m, atol=1e-6)
    with pytest.raises(Exception, match="one length"):
        files.write_matrix(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>").coalesce(1), str(tmp_path / "bad"))
    np.save(tmp_path / "e.npy", np.zeros((0, 3)))
    assert tables.matrix_npy(spark, str(tmp_path / "e.npy")).count() == 0
