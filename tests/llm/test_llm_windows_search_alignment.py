"""Operators 11 to 13 against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as vocab
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import alignment, maxscore, rolling

SF = "/root/testdata/sf0.001"
WORDS = ["a", "the", "model", " ", "\n", "\t", "<|endoftext|>", "héllo", "深い", "foo\r\n", "x y", "don't", "１２", "<0x41>", "\x1c", "ﬁ", "it's  ", "  "]


# 11: rolling windows
def plain_windows(rows, widths, percents):
    """rows: (key, time, value, label)."""
    out = []
    for key, time, _, _ in rows:
        for w in widths:
            own = [] if time is None else [r for r in rows if r[0] == key and r[1] is not None and time - w <= r[1] < time]
            v = sorted(r[2] for r in own if r[2] is not None)
            out.append((key, time, w, len(own), sum(v), len({r[3] for r in own if r[3] is not None}), *(v[-(-p * len(v) // 100) - 1] if v else None for p in percents)))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [1, 7, 50, None])
def test_windows_are_those_of_a_plain_version(spark, chunk):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", "", None]), rng.choice([None, *range(-60, 200)]), rng.choice([None, 0, 1, 1, 2, 3, 50, 10**12]), rng.choice([None, "x", "y", "z", ""])) for _ in range(300)]
    rows += rows[:40] + [("a", 77, 5, "x")] * 30
    df = spark.createDataFrame(rows, "key string, time long, value long, label string")
    got = rolling.features(df.withColumn("window", F.lit("mine")).withColumn("weight", F.lit(1)), F.col("key"), F.col("time"), F.col("value"), F.col("label"), [5, 90], [50, 90, 1, 100], chunk)
    got = got.select("key", "time", "window", "n_events", "total", "n_labels", "q50", "q90", "q1", "q100")
    assert sorted(map(tuple, got.collect()), key=str) == plain_windows(rows, [5, 90], [50, 90, 1, 100])


def test_dual_heaps_keep_their_rank():
    rng = random.Random(1)
    for percent in (1, 50, 90, 100):
        q, live, tail = rolling.Quantile(percent), [], 0
        for seq in range(3000):
            row = (rng.randrange(20), seq, rng.randrange(1, 4))
            q.enter(*row)
            live.append(row)
            while live and rng.random() < (0.6 if seq // 500 % 2 else 0.3):
                gone = live.pop(0)
                tail = gone[1] + 1
                q.leave(*gone)
            if rng.random() < 0.5:
                v = sorted(x for x, _, w in live for _ in range(w))
                assert q.value(tail, len(live)) == (v[math.ceil(percent * len(v) / 100) - 1] if v else None)
        assert len(q.low) + len(q.high) <= 2 * len(live) + 600


def test_documents_without_ids_texts_sources(spark):
    rows = [(1, "ab", "en", "s"), (1, "ab", "en", "s"), (None, "x", "en", "s"), (2, None, None, None), (3, "", "de", None), (4, "äöü" * 40_000, "de", None), (-7, "q", "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("time", F.lit(0))
    time = lambda i: None if i is None else 60 * math.floor((i + zlib.crc32(str(i).encode()) % 10000) / 6)
    flat = [(s, time(i), None if t is None else len(t), lang) for i, t, lang, s in rows]
    got = rolling.document_features(df, (600, 10**6))
    want = [r[1:] for r in plain_windows(flat, [600, 10**6], [50, 90])]
    assert sorted((tuple(r) for r in got.select("event_s", "window_s", "n_events", "sum_chars", "n_langs", "median_chars", "high_chars").collect()), key=str) == sorted(want, key=str)
    assert rolling.document_features(df.limit(0)).count() == 0


# 12: exact top-k
def plain_top(rows, asked, k):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and all(abs(math.floor(256 * x)) < 2**63 for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if asked(i)}):
        (own,) = {tuple(v) for i, v in ok if i == q}
        scores = {(i, tuple(v)): max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(own, v, strict=False)))) for i, v in ok if i != q}
        best = sorted((-s, i) for (i, _), s in scores.items())[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("kind", ["dense", "sparse", "large", "huge"])
def test_top_k_is_that_of_all_pairs(spark, kind, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD", 64)
    monkeypatch.setattr(maxscore, "SAMPLE", 50)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 24)) * {"dense": 0.2, "sparse": 1.0, "large": 3e4, "huge": 2e13}[kind]
    if kind == "sparse":
        x[rng.random(x.shape) < 0.85] = 0
        x = np.abs(x) * np.where(np.arange(24) % 5 == 0, -1, 1)
    x[100:160] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(400, None), (401, [0.1, None]), (402, [float("nan")] * 24), (403, [float("inf")] * 24), (404, []), (405, [0.0] * 24), (406, [0.5]), (407, [1e30] * 24), (None, x[0].tolist()), (3, x[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = maxscore.search(df, lambda i: i % 7 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == plain_top(rows, lambda i: i % 7 == 0, 5)


def test_top_k_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert maxscore.search(spark.createDataFrame([], schema), lambda i: i >= 0).count() == 0
    assert maxscore.search(spark.createDataFrame([(0, [1.0])], schema), lambda i: i >= 0).count() == 0
    got = maxscore.search(spark.createDataFrame([(0, [1.0]), (1, [1.0]), (2, [-1.0])], schema), lambda i: i == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 65536), (0, 2, 2, -65536)]


def test_shards_skip_entries_that_cannot_win():
    rng = np.random.default_rng(0)
    rows = np.zeros((5000, 40), np.int64)
    for row in rows:
        row[rng.choice(40, 4, replace=False)] = rng.integers(1, 30, 4)
    shard = maxscore.Shard(np.arange(5000), np.arange(5000), rows)
    query = np.where(np.arange(40) < 6, 100, 1)
    scores = rows @ query
    best = np.lexsort((np.arange(5000), -scores))[:6]
    places, found = shard.search(query, 6, float(scores[best[-1]]))
    assert places.tolist() == best.tolist() and found == scores[best].tolist()
    assert len(shard.search(query, 6, float(scores.max() * 50))[0]) == 0


# 13: alignment
@pytest.fixture(scope="module")
def tokenizers():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocab.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=vocab.path("piece_bpe_32k.model"))


def plain_alignment(texts, tokenizers, relation="end"):
    """Whole texts through both libraries, byte by byte."""
    a_model, b_model = tokenizers
    letters = {}
    other = 256
    for b in range(256):
        plain = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255
        letters[chr(b) if plain else chr(other)] = b
        other += not plain
    rows, links = [], []
    for text in texts:
        ids_a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b_model.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in a_model.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            rows.append((0, 0, 0, ""))
            links.append([])
            continue
        spans = lambda parts: [(sum(map(len, parts[:i])), sum(map(len, parts[: i + 1]))) for i in range(len(parts))]
        span_a, span_b = spans(bytes_a), spans(bytes_b)
        ends = sorted({e for _, e in span_a} & {e for _, e in span_b})
        groups, own = [], []
        for lo, hi in zip([0, *ends], ends, strict=False):
            in_a, in_b = ([(i, s) for i, s in zip(ids, span, strict=True) if lo <= s[0] and s[1] <= hi] for ids, span in ((ids_a, span_a), (ids_b, span_b)))
            groups.append(",".join(str(i) for i, _ in in_a) + "|" + ",".join(str(i) for i, _ in in_b))
            for i, s in in_a:
                for j, t in in_b:
                    if relation == "group" or relation == "end" and s[1] == t[1] or relation == "overlap" and max(s[0], t[0]) < min(s[1], t[1]):
                        own.append((i, j))
        rows.append((len(ids_a), len(ids_b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append(own)
    count = Counter(x for own in links for x in own)
    best = defaultdict(int)
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    return [(n_a, n_b, g, len(own), sum(count[x] == best[x[1]] for x in own), sum(count[x] for x in own), sha) for (n_a, n_b, g, sha), own in zip(rows, links, strict=True)]


def odd_texts():
    rng = random.Random(2)
    texts = ["".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 30))) for _ in range(150)]
    texts += ["".join(chr(rng.choice([rng.randrange(1, 128), rng.randrange(128, 0x250), rng.randrange(0x3000, 0x3100), rng.randrange(0x1F300, 0x1F400), 0x2581 if rng.random() < 0.05 else 32])) for _ in range(60)) for _ in range(150)]
    return [*texts, None, "", " ", "\n", "   \n\n ", "▁", "a▁ b", "x" * 3000, "one two " * 500, "one two", "one two"]


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("relation", alignment.RELATIONS)
@pytest.mark.parametrize("sent", [alignment.SENT, 0])
def test_alignment_of_odd_texts_is_that_of_whole_texts(spark, tokenizers, relation, sent):
    texts = odd_texts()
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).withColumn("links", F.lit(0)).withColumn("nth", F.lit("x"))
    got = alignment.alignment(df, vocab.path("byte_bpe_50k.json"), vocab.path("piece_bpe_32k.model"), relation, sent=sent).orderBy("doc_id")
    assert [tuple(r) for r in got.select(*COLUMNS).collect()] == plain_alignment(texts, tokenizers, relation)


def test_alignment_of_the_table_is_that_of_whole_texts(spark, tokenizers):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    docs = [r for r in docs if len(r["text"]) < 4000]
    df = spark.createDataFrame(docs, SCHEMA)
    got = alignment.alignment(df, vocab.path("byte_bpe_50k.json"), vocab.path("piece_bpe_32k.model")).orderBy("doc_id")
    assert [tuple(r) for r in got.select(*COLUMNS).collect()] == plain_alignment([r["text"] for r in docs], tokenizers)


def test_alignment_of_nothing_and_repeated_ids(spark):
    paths = vocab.path("byte_bpe_50k.json"), vocab.path("piece_bpe_32k.model")
    assert alignment.alignment(spark.createDataFrame([], SCHEMA), *paths).count() == 0
    got = alignment.alignment(spark.createDataFrame([(1, "ab"), (1, "ab"), (None, None)], SCHEMA), *paths).collect()
    assert sorted((r["doc_id"] or 0, r["n_groups"] > 0, r["count_sum"] == 2 * r["n_links"]) for r in got) == [(0, False, True), (1, True, True), (1, True, True)]


def test_a_full_table_begins_anew(monkeypatch):
    table = alignment.Aligner(vocab.path("byte_bpe_50k.json"), vocab.path("piece_bpe_32k.model"), "end")
    texts = [f"word{i} other{i % 7} the end" for i in range(300)]
    want = [(c, g, k.tolist()) for c, g, k in table.texts_of(texts)]
    monkeypatch.setattr(alignment, "KEPT", 10)
    got = [(c, g, k.tolist()) for i in range(0, 300, 7) for c, g, k in table.texts_of(texts[i : i + 7])]
    assert got == want and table.rows <= 10 + 7 * 5


def test_products_pair_all_of_a_group():
    a, b, shared, group = alignment.align(np.array([2, 3, 6]), np.array([1, 3, 4, 5, 6]))
    assert list(zip(a.tolist(), b.tolist(), group.tolist(), strict=True)) == [(0, 0, 0), (0, 1, 0), (1, 1, 0), (2, 2, 1), (2, 3, 1), (2, 4, 1)]
    assert sorted(zip(*(x.tolist() for x in alignment.products(a, b, shared)), strict=True)) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 2), (2, 3), (2, 4)]
