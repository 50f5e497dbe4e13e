"""Each operator against a brute-force version, and its behaviour on odd inputs."""

import hashlib
import itertools
import math
import random
import time
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as vocab
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import bagminhash, bpe_tree, content_sort, fuzzy_lines, min_cut, mixing, multi_index, pii, textkern, token_files, toxicity

SF = "/root/testdata/sf0.001"
GPT = vocab.path("byte_bpe_50k.json")
MULTI = vocab.path("byte_bpe_multi_50k.tiktoken")
LONG = "word " * 40_000
ODD = [(1, None, "a"), (2, "", "a"), (3, "same text here for all of us", "b"), (4, "same text here for all of us", None), (4, "same text here for all of us", None), (5, LONG, "b"), (6, "  \t \n ", "a"), (7, "x" * 30_000, "a")]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    names = "doc_id long, text string, source string, n_tokens string, kept string, class_id string, spans string, clean_text string, p_toxic string, epoch string, size int, body int"
    return spark.createDataFrame([(*r, *[None] * 9) for r in ODD], names)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def union_find(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# 1
def shingles(text):
    w = re.findall(r"\w+", text.lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(texts):
    bags = {i: shingles(t) for i, t in texts.items()}
    where = defaultdict(set)
    for i, bag in bags.items():
        for s in bag:
            where[s].add(i)
    pairs = {(a, b) for ids in where.values() for a, b in itertools.combinations(sorted(ids), 2)}
    links = []
    for a, b in pairs:
        both = sum((bags[a] & bags[b]).values())
        if both >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - both):
            links.append((a, b))
    return union_find(texts, links)


def test_near_duplicates_match_brute_force(documents, texts):
    got = {r["doc_id"]: r["class_id"] for r in bagminhash.near_duplicates(documents).collect()}
    assert got == brute_classes(texts)


def test_near_duplicates_in_a_large_group_of_variants(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    made = {}
    for i in range(150):  # variants of very different distance, which share most bands
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10_000)}"
        made[i] = " ".join(w)
    got = bagminhash.near_duplicates(spark.createDataFrame(list(made.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == brute_classes(made)


def test_near_duplicates_go_by_words_not_by_ids_or_hashes(spark):
    a, b = (" ".join(f"{k}{i}" for i in range(40)) for k in "ab")
    # sequences of 4096 words that agree under every polynomial hash modulo 2**64
    thue = [" ".join("ab"[bin(i).count("1") + k & 1] for i in range(1 << 12)) for k in (0, 1)]
    rows = [(2, b), (3, a), (5, a), (5, b), (8, thue[0]), (9, thue[1]), (9, thue[1]), (None, a), (12, "x" * 1500 + " y"), (13, "x" * 1500 + " z")]
    want = {(2, 2, True): 1, (3, 3, True): 1, (5, 3, False): 1, (5, 2, False): 1, (8, 8, True): 1, (9, 9, True): 2, (None, None, True): 1, (12, 12, True): 1, (13, 13, True): 1}
    # both sequences have the same 32 runs of five words, but not equally often
    bags = [shingles(t) for t in thue]
    both = sum((bags[0] & bags[1]).values())
    if both >= 0.8 * (2 * sum(bags[0].values()) - both):
        want.pop((9, 9, True))
        want[9, 8, False] = 2
    got = bagminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["class_id"], r["kept"]) for r in got) == want


def test_signatures_estimate_the_weighted_jaccard():
    rng = np.random.default_rng(0)
    ids = rng.integers(1, 1 << 60, 300).astype(np.uint64)
    a, b = rng.integers(1, 12, 300), rng.integers(1, 12, 300)
    a[250:], b[:40] = 0, 0
    own = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
    sig = bagminhash.signatures(own, np.concatenate([ids[a > 0], ids[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 4096)
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - truth) < 4 * math.sqrt(truth * (1 - truth) / 4096)


def test_near_duplicates_on_odd_input(odd, none):
    got = sorted((r["doc_id"], r["class_id"], r["kept"]) for r in bagminhash.near_duplicates(odd).collect())
    assert got == [(1, 1, True), (2, 2, True), (3, 3, True), (4, 3, False), (4, 3, False), (5, 5, True), (6, 6, True), (7, 7, True)]
    assert bagminhash.near_duplicates(none).count() == 0


# 2
def test_toxicity_held_out(spark):
    rng = random.Random(2)
    clean, bad = [f"c{i:03d}o" for i in range(400)], ["idiotic", "scumbag", "moronic"]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(clean) for _ in range(rng.randrange(5, 200))]
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(bad) + rng.choice(["", "s"])
        rows.append((i, " ".join(words)))
        if i < 600:
            labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).where("doc_id >= 600").collect()
    wrong = sum(r["is_toxic"] != (r["doc_id"] % 4 == 0) for r in got)
    assert len(got) == 300 and wrong <= 6


def test_toxicity_on_odd_input(spark, odd, none):
    labels = spark.createDataFrame([(3, 1, 0), (5, 0, 1), (5, 0, 1), (None, 1, 1), (7, None, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(odd, labels)
    assert got.count() == len(ODD) and "source" in got.columns
    assert toxicity.toxicity(none, labels).count() == 0
    assert toxicity.toxicity(odd, labels.limit(0)).where("is_toxic").count() == 0


def test_later_models_see_earlier_predictions():
    rng = np.random.default_rng(0)
    dense = rng.normal(size=(400, toxicity.DENSE))
    first = (dense[:, 0] > 0).astype(int)
    chain = toxicity.Chain(np.zeros(0, np.int64), np.zeros(0, np.int64), dense, np.stack([first, first], 1), np.arange(400) % 3)
    assert chain.models[1].v[-1] > 0.5  # the weight of the first category's log-odds


def test_folds_keep_copies_together():
    rng = random.Random(3)
    powers, made, family = textkern.Powers(), [], []
    for f in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(150)]
        for _ in range(rng.randrange(1, 6)):
            words = list(base)
            words[rng.randrange(150)] = "changed"
            made.append(" ".join(words))
            family.append(f)
    made += ["", "!", "one word"]
    fold = toxicity.folds(toxicity.likeness(made, powers))
    assert all(len({x for x, g in zip(fold, family, strict=False) if g == f}) == 1 for f in range(60))
    assert min(Counter(fold.tolist()).values()) > len(made) / 8 and fold[-2] == fold[-3]
    order = rng.sample(range(len(made)), len(made))
    assert (toxicity.folds(toxicity.likeness([made[i] for i in order], powers)) == fold[order]).all()


def plain_chain(rows):
    """The contract of the chain, written again without its kernels: presence of hashed features, out-of-fold log-odds, F0.5."""
    powers = textkern.Powers()
    texts = [t for t, _ in rows]
    r, c, dense = toxicity.features(texts, powers)
    pairs = sorted(set(zip(r.tolist(), c.tolist(), strict=True)))
    often = Counter(c for _, c in pairs)
    pairs = [(r, c) for r, c in pairs if often[c] >= 3]
    y, fold = np.array([m for _, m in rows], float), toxicity.folds(toxicity.likeness(texts, powers))
    extra, out = np.zeros((len(rows), 0)), []
    for j in range(y.shape[1]):
        x, got = np.hstack([dense, extra]), np.zeros(len(rows))
        for f in range(toxicity.FOLDS):
            here, there = [i for i in range(len(rows)) if fold[i] != f], [i for i in range(len(rows)) if fold[i] == f]
            spot, away = {i: k for k, i in enumerate(here)}, {i: k for k, i in enumerate(there)}
            model = toxicity.Logistic(*(np.array(v, int) for v in zip(*[(spot[r], c) for r, c in pairs if r in spot], strict=True)), x[here], y[here, j])
            own = [(away[r], c) for r, c in pairs if r in away]
            got[there] = model.logit(*(np.array(v, int) for v in zip(*own, strict=True)), x[there])
        out.append((x, got))
        extra = np.hstack([extra, np.clip(got, -12, 12)[:, None]])
    return pairs, y, out


def test_chain_on_documents_is_the_plain_one(spark, documents, texts):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    marks = {r["doc_id"]: (1 - r["quality"], r["toxic"]) for r in labels.collect() if r["doc_id"] in texts}
    chain = toxicity.fit_chain(documents, labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic"), ["low_quality", "toxic"])
    pairs, y, out = plain_chain([(texts[i], marks[i]) for i in sorted(marks)])
    for j, (x, got) in enumerate(out):
        assert chain.thresholds[j] == pytest.approx(toxicity.best_threshold(toxicity._sigmoid(got), y[:, j]), abs=1e-6)
        whole = toxicity.Logistic(*(np.array(v, int) for v in zip(*pairs, strict=True)), x, y[:, j])
        assert np.allclose(whole.v, chain.models[j].v, atol=1e-6) and np.allclose(np.sort(whole.w), np.sort(chain.models[j].w), atol=1e-6)


# 3
def plain_spans(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, lo, hi in (("card", r"[0-9]([\x20-]?[0-9])+", 16, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 8, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if lo <= len(digits) <= hi and (kind == "phone" or pii.luhn(digits)):
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_match_the_plain_patterns(texts):
    rng = random.Random(0)
    pieces = [*"ab.@+- ()1234567890", "a@b.c", "1.2.3.4", "..", "4111111111111111", "+1 (346) 555-3462", "é", "²", "٣"]
    made = ["".join(rng.choice(pieces) for _ in range(rng.randrange(40))) for _ in range(5000)]
    for t in [*made, *texts.values()]:
        assert pii.base_spans(t) == plain_spans(t)


def test_pii_query(documents, texts):
    got = {r["doc_id"]: r for r in pii.find_pii(documents.select("doc_id", "text")).collect()}
    for i, t in texts.items():
        base = plain_spans(t)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(got[i]["spans"].split(",")) | {""}


def test_judge_adds_what_patterns_miss():
    judge = pii.Judge()
    found = lambda t: judge.spans(t, pii.base_spans(t))
    assert found("call me at (346) 555-3462 ok") == [("phone", 11, 25)]
    assert found("mail bob [at] example [dot] com now")[0][0] == "email"
    assert found("version 1.22.333 on 2020-10-11 of order 12345") == []
    x, y = pii.practice(2000, 77)
    p = judge.calibrated(x) >= np.array(judge.thresholds)[x[:, 0].astype(int)]
    assert y[p].mean() > 0.95 and p[y == 1].mean() > 0.9


def test_probabilities_are_calibrated():
    judge = pii.Judge()
    x, y = pii.practice(6000, 123)
    p = judge.calibrated(x)
    for lo in (0.0, 0.2, 0.5, 0.8):
        own = (p >= lo) & (p < lo + 0.3)
        if own.sum() > 200:
            assert abs(p[own].mean() - y[own].mean()) < 0.1
    score, share = pii.isotonic(np.array([0.1, 0.2, 0.3, 0.4, 0.5]), np.array([0, 1, 0, 1, 1]))
    assert (np.diff(score) > 0).all() and (np.diff(share) >= 0).all()


def plain_choice(judge, text):
    """The added spans, by comparing all candidates with all that is taken."""
    taken = [(a, b) for _, a, b in plain_spans(text)]
    ranked = []
    for n, (kind, a, b) in enumerate(pii.candidates(text)):
        x = np.array([pii.describe(text, kind, a, b)])
        if all(b <= c or a >= d for c, d in taken):
            ranked.append((-float(judge.calibrated(x)[0]), -float(judge.model.predict(x)[0]), n, (kind, a, b)))
    out = []
    for p, _, _, (kind, a, b) in sorted(ranked):
        if -p >= judge.thresholds[pii.KINDS.index(kind)] and all(b <= c or a >= d for c, d in taken):
            out.append((kind, a, b))
            taken.append((a, b))
    return out


def test_added_spans_match_the_plain_choice(texts):
    judge, rng = pii.Judge(), random.Random(8)
    pieces = ["call ", "card ", "(346) 555-3462", "4111 1111 1111 1111", "4111-1111 1111.1111", "0123 456 789", "jane at example dot com", "bob [at] x [dot] org", " ", ", ", "12.05.2024", "fe80::1ff:fe23:4567:890a", "1.2.3.4", "+1 (346) 555-3462", "order 12345", "a@b.co", "378282246310005", "-", "22"]
    made = ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(800)]
    added = 0
    for t in [*made, *texts.values()]:
        got = judge.spans(t, pii.base_spans(t))
        assert got == plain_choice(judge, t)
        added += len(got)
    assert added > 200


def test_generators_are_not_switched_off():
    for address in ("jane at example (dot) org", "jane at example [dot] com", "jane(at)example.org", "jane AT example DOT org"):
        assert any(k == "email" and address.startswith(f"write {address} today"[a:b]) for k, a, b in pii.candidates(f"write {address} today"))
    for address in ("fe80::1", "fe80::1ff:fe23:4567:890a", "2001::1", "::1", "abcd::beef", "2001:db8::", "1:2:3:4:5:6:7:8"):
        text = f"host {address} is up"
        assert address in [text[a:b] for k, a, b in pii.candidates(text) if k == "ip"]
    assert not [c for c in pii.candidates("std::cout :: Abc::new() a 12:30:x") if c[0] == "ip"]


def test_pii_on_odd_input(odd, none):
    assert pii.find_pii(odd, redact=True).count() == len(ODD) and pii.find_pii(none).count() == 0
    assert pii.redacted("a b@c.de f", [("email", 2, 8)]) == "a [EMAIL] f"
    for t in ("a" * 100_000 + "@", "1" * 100_000, "+1" * 50_000, "1." * 50_000):
        pii.base_spans(t)


# 4
def test_packing_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 1001):
        ranks = (2 ** rng.uniform(0, 31, n)).astype(np.uint32)
        control, data = token_files.pack(ranks)
        assert len(control) == -(-n // 4) and (token_files.unpack(control, data, n) == ranks).all()


def test_token_digest(documents, texts):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(GPT)
    want, start = {}, 0
    for i, t in sorted(texts.items()):
        ids = [*tk.encode(t, add_special_tokens=False).ids, 0]
        want[i] = start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        start += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.token_digest(documents, GPT).collect()}
    assert got == want


def test_units_are_the_librarys_tokens():
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(GPT)
    rng = random.Random(1)
    pieces = ["a", "the", " ", "  ", "\n", "\t", "'", "'s", "ll", "12", "é", "中", "!", "\x1c", "\xa0", "　", "<|endoftext|>", "\r\n", "\x85", " x", "foo ", "🙂", "ª", "²", " "]
    made = ["".join(rng.choice(pieces) for _ in range(rng.randrange(40))) for _ in range(3000)]
    # equal under any polynomial hash modulo 2**64
    made += ["".join("ab"[bin(i).count("1") + k & 1] for i in range(1 << 12)) for k in (0, 1)]
    made += ["x" * k + " y" for k in range(40)]
    want = [tk.encode(t, add_special_tokens=False).ids for t in made]
    for places, units in ((1 << 22, 1 << 20), (1 << 10, 700), (1 << 10, 0)):
        table = token_files.UnitTable(tk, places, units)
        for _ in range(2):
            for lo in range(0, len(made), 500):
                ids, n = table.encode_batch(pa.array(made[lo : lo + 500]).slice(0))
                assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want[lo : lo + 500]


def test_added_tokens_are_the_librarys(spark):
    from tokenizers import AddedToken, Tokenizer

    texts = {1: "a<|endoftext|>b", 2: "plain text", 3: "<|endoftext|>", 4: "", 5: "two <|endoftext|><|endoftext|> \n x", 6: "<|endoftext|", 7: " more plain  text"}
    tk = Tokenizer.from_file(GPT)
    assert tk.encode(texts[1], add_special_tokens=False).ids == [64, 50256, 65]
    want, start = {}, 0
    for i, t in texts.items():
        ids = [*tk.encode(t, add_special_tokens=False).ids, 0]
        want[i] = start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        start += len(ids)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.token_digest(docs, GPT).collect()} == want
    tk.add_tokens([AddedToken("<x>", lstrip=True, rstrip=True), AddedToken("word", single_word=True)])
    rng = random.Random(4)
    made = ["".join(rng.choice(["<x>", "word", "<|endoftext|>", " ", "a", "\n", "é", "s"]) for _ in range(rng.randrange(12))) for _ in range(500)]
    for tk.encode_special_tokens in (False, True):
        ids, n = token_files.UnitTable(tk).encode_batch(pa.array(made))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [tk.encode(t, add_special_tokens=False).ids for t in made]


def test_token_files_on_odd_input(spark, odd, none, tmp_path):
    assert token_files.token_digest(odd, GPT).where("n_tokens = 1").count() == 2
    assert token_files.token_digest(none, GPT).count() == 0
    token_files.write_tokens(odd, f"file://{tmp_path}/c", GPT)
    assert [r["ids"] for r in token_files.read_tokens(spark, f"file://{tmp_path}/c").where("doc_id = 1").collect()] == [[0]]


def test_token_files_without_ids_and_with_repeated_ids(spark):
    from tokenizers import Tokenizer

    rows = [(None, "no id"), (3, "three"), (None, "no id either"), (3, "three again, longer"), (3, "three"), (-1, None), (2, "two"), (3, None)] * 7
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(token_files.token_digest(docs.repartition(5), GPT).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids[:14] == [None] * 14 and ids[14:] == sorted(ids[14:]) and len(got) == len(rows)
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in got])[:-1]]).tolist()
    tk = Tokenizer.from_file(GPT)
    crc = lambda t: zlib.crc32(struct.pack(f"<{len(t) + 1}I", *t, 0))
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in got) == Counter((i, crc(tk.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    again = token_files.token_digest(docs.repartition(2), GPT).select("start", "ids_crc32").collect()
    assert sorted(map(tuple, again)) == sorted((r["start"], r["ids_crc32"]) for r in got)


# 5
@pytest.mark.parametrize("partitions", [1, 4, 23])
def test_exact_dedup_over_partition_borders(spark, partitions, monkeypatch):
    monkeypatch.setattr(content_sort, "LEAST_HOT", 2 if partitions == 4 else 30)
    rng = random.Random(partitions)
    rows = [(i, rng.choice(["hot  text", "hot text", "hot\ttext", f"u{rng.randrange(60)}", "", "x" * 70 + rng.choice("abc")])) for i in range(400)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = content_sort.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t)].append(i)
    want = {i: (min(g), len(g), i == min(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for i in g}
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want


def test_exact_dedup_on_odd_input(odd, none):
    got = sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in content_sort.exact_dedup(odd).collect())
    assert got == [(1, 1, 2), (2, 1, 2), (3, 3, 3), (4, 3, 3), (4, 3, 3), (5, 5, 1), (6, 6, 1), (7, 7, 1)]
    assert content_sort.exact_dedup(none).count() == 0


@pytest.mark.parametrize("partitions", [1, 7])
def test_exact_dedup_without_ids(spark, partitions):
    rows = [(None if i % 3 == 0 else i, f"t{i % 5}" if i % 7 else "alone") for i in range(60)] + [(None, "never an id")] * 5
    got = content_sort.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    least = {t: min((i for i in g if i is not None), default=None) for t, g in groups.items()}
    want = Counter((i, least[t], len(groups[t]), i == least[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    assert Counter(tuple(r) for r in got) == want


def test_helper_columns_clash_with_none_of_the_callers(spark):
    """Each operator gets each of its own helper names as an extra column, null ids, an empty table and a very long text."""
    names = "row text_ html d b body drop of_doc of_body of_source of_id full rest rate blocks stop at copies id key keys comp few size w1 w2 h1 h2 line marks part edge border norm sha head __text __id __body __s __html __drop clean_text n_lines n_kept epoch block slot n_tokens spans n_ip p_toxic is_toxic ids n_chars".split()
    data = [(1, "one line\nand another one\none line", "a"), (None, "one line", None), (2, "word " * 30_000, "a"), (None, None, "b"), (3, "", "b")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").select("*", *(F.lit(f"<{n}>").alias(n) for n in names))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    runs = {
        "near": (lambda d: bagminhash.near_duplicates(d), ()),
        "toxicity": (lambda d: toxicity.toxicity(d, labels), ("text", "p_toxic", "is_toxic")),
        "pii": (lambda d: pii.find_pii(d), ("text", "spans", "n_ip")),
        "tokens": (lambda d: token_files.token_digest(d, GPT), ()),
        "exact": (lambda d: content_sort.exact_dedup(d), ()),
        "bpe": (lambda d: bpe_tree.bpe_round_trip(d, MULTI, vocab.PATTERN, keep_ids=True), ("text", "n_tokens", "ids")),
        "pages": (lambda d: min_cut.extract(d.withColumn("html", F.col("text"))), ("html", "text", "n_chars")),
        "lines": (lambda d: fuzzy_lines.dedup_lines(d, short_lines=True), ("clean_text", "n_lines", "n_kept")),
        "mixing": (lambda d: mixing.mix(d, repetition=1.0), ("n_tokens", "epoch", "block", "slot")),
    }
    for name, (run, replaced) in runs.items():
        got = run(docs)
        kept = [n for n in names if n not in replaced]
        rows = got.collect()
        assert len(rows) == len(data), name
        if replaced:
            assert all(r[n] == f"<{n}>" for r in rows for n in kept), name
            assert Counter(r["doc_id"] for r in rows) == Counter(i for i, *_ in data), name
        assert len(set(got.columns)) == len(got.columns) and run(docs.limit(0)).count() == 0, name


# 6
def test_bpe_tree_is_tiktoken(monkeypatch):
    import tiktoken

    with open(MULTI, "rb") as f:
        ranks = bpe_tree.load_ranks(f.read())
    plain = tiktoken.Encoding("plain", pat_str=vocab.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tree = bpe_tree.TreeBPE(ranks, vocab.PATTERN)
    monkeypatch.setattr(bpe_tree, "LEAF_CHARS", 8)
    monkeypatch.setattr(bpe_tree, "LEAF_BYTES", 4)
    rng = random.Random(0)
    pieces = ["a", "b", "th", "e", " ", "  ", "\n", "'", "'s", "'ll", "l", "1", "22", "é", "中", "!", "-", " the", "\t", "ing"]
    made = ["".join(rng.choice(pieces) for _ in range(rng.randrange(120))) for _ in range(1500)]
    made += [rng.choice("aeth") * rng.randrange(50, 900) for _ in range(50)] + ["".join(rng.choice("theanding") for _ in range(1000)) for _ in range(30)]
    for t in made:
        ids = tree.encode(t)
        assert ids == plain.encode_ordinary(t) and tree.decode(ids) == t.encode()


def test_bpe_round_trip(documents, texts, odd, none):
    import tiktoken

    with open(MULTI, "rb") as f:
        plain = tiktoken.Encoding("plain", pat_str=vocab.PATTERN, mergeable_ranks=bpe_tree.load_ranks(f.read()), special_tokens={})
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe_tree.bpe_round_trip(documents.select("doc_id", "text"), MULTI, vocab.PATTERN).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for i, t in texts.items():
        ids = plain.encode_ordinary(t)
        assert got[i] == (len(ids), sha(",".join(map(str, ids)).encode()), sha(t.encode()))
    assert bpe_tree.bpe_round_trip(odd, MULTI, vocab.PATTERN, keep_ids=True).where("size(ids) = n_tokens").count() == len(ODD)
    assert bpe_tree.bpe_round_trip(none, MULTI, vocab.PATTERN).count() == 0


# 7
def prose(k=6):
    return " ".join([*["word"] * 9, "end."] * k)


def test_main_text_of_pages_without_semantic_tags():
    weights = min_cut.fit()
    plain = f"<body>{f'<div><p>{prose()}</p></div>' * 6}"
    assert min_cut.main_text(plain, weights) == " ".join([prose()] * 6)
    for n in (6, 1000):
        adverts = "<body>" + f"<div><p>{prose()}</p><div class='ad'>Buy now our shoes</div></div>" * n
        assert min_cut.main_text(adverts, weights) == " ".join([prose()] * n)


@pytest.mark.parametrize("name", ["read-more-content", "content-with-sidebar", "post has-ads", "no-comments"])
def test_names_are_evidence_only(name):
    page = f"<body><nav><a href=x>Home</a></nav><article><h1>Title</h1><div id='{name}'><p>{prose()}</p></div><p>{prose()}</p></article><footer>Imprint</footer>"
    assert min_cut.main_text(page, min_cut.fit()) == f"Title {prose()} {prose()}"


def test_links_in_an_article_stay():
    page = f"<body><nav><a href=x>Home</a></nav><article><h1>T</h1><p>{prose()}</p><ul><li><a href=a>One other</a><li><a href=b>Two other</a></ul><p>{prose()}</p></article>"
    assert min_cut.main_text(page, min_cut.fit()) == f"T {prose()} One other Two other {prose()}"


@pytest.mark.parametrize("size", [10, 3000, 6000, 100000])
def test_quoted_values_of_any_length(size):
    page = f"<body><article data-x='a > b {'z' * size}'><h1>T</h1><p>{prose()}</p></article>"
    assert min_cut.main_text(page, min_cut.fit()) == f"T {prose()}"


def test_cut_and_tags_do_not_grow_with_the_square():
    weights = min_cut.fit()
    started = time.monotonic()
    assert min_cut.main_text(f"<body><article>{f'<p>{prose()}</p>' * 8000}</article>", weights).count("end.") == 48000
    assert min_cut.main_text(f"<body><article>{f'<p>{prose()}</p><div class=ad>Buy it</div><p>ok</p>' * 8000}</article>", weights).count("end.") == 48000
    for odd_page in ("<a \"<a '" * 50000 + ">", "<a<a" * 50000 + '" >', "</script" * 50000, "<div class=x>" * 20000 + "hi"):
        min_cut.main_text(odd_page, weights)
    assert time.monotonic() - started < 30  # the square of 8000 blocks took 61 s


def test_min_cut_is_minimal():
    rng = random.Random(0)
    for _ in range(200):
        k = rng.randrange(1, 9)
        content, other = ([rng.random() * 3 for _ in range(k)] for _ in range(2))
        between = [(a, b, rng.random() * 2) for a in range(k) for b in range(a + 1, k) if rng.random() < 0.4]

        def cost(side, content=content, other=other, between=between):
            return sum(c if s else o for s, c, o in zip(side, content, other, strict=True)) + sum(w for a, b, w in between if side[a] != side[b])

        best = min(cost(s) for s in itertools.product([False, True], repeat=k))
        assert cost(min_cut.min_cut(content, other, between)) == pytest.approx(best)


def test_main_text():
    weights = min_cut.fit()
    page = """<html><head><title>no</title><style>p{}</style><script>var a="</p>";</script></head><body><header><p>Site name</p></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
    <div class="cookie-notice"><p>We use cookies. Accept them, please, to go on reading.</p></div><article><header><h1>A  title &amp; more</h1></header><p>First <b>bold</b>
    paragraph&nbsp;here, with a comma.<p>Second one.<br>Still second.<!-- gone --></p><div class="ad">Buy this now. It is cheap and good.</div><p>Last.</article>
    <aside><p>Other stories that you may like to read today.</p></aside><section id="comments"><p>I liked this article a lot, thank you.</p></section>
    <form><label>Search</label><input></form><footer>&copy; 2024 all rights reserved.</footer></body></html>"""
    assert min_cut.main_text(page, weights) == "A title & more First bold paragraph here, with a comma. Second one. Still second. Last."
    for odd_page in ("", "<", "<p", "<!--", "<script>", "</p></div>", "<p a='\">x", "<" * 2000, "<div>" * 3000):
        min_cut.main_text(odd_page, weights)


def test_main_text_keeps_what_is_not_listed():
    weights = min_cut.fit()
    page = "<body><nav><a href=/>Home</a></nav><article><h1>On sums and their proofs</h1><p>The sum <math><mi>a</mi><mo>+</mo><mi>b</mi></math> is known to us all.</p><p><object data=x>A picture of it, said here in words.</object> <noscript>And this is a plain line.</noscript></p><p>It ends here, as told.</p></article><form><button>Send</button><textarea>draft</textarea></form></body>"
    assert min_cut.main_text(page, weights) == "On sums and their proofs The sum a+b is known to us all. A picture of it, said here in words. And this is a plain line. It ends here, as told."


def test_pages_without_article_and_with_unknown_names():
    weights = min_cut.fit()
    prose = ["The river rises in the hills, and by noon it has come down to the old mill.", "Nobody had seen it so high in spring, the miller said, and she had lived there all her life.", "By evening the road was under water. The post came two days late."]
    menu = "<div class='zorp'><a href=/a>Start</a> <a href=/b>World</a> <a href=/c>Sports</a></div>"
    page = f"<html><body>{menu}<div class='qux7'><h1>High water at the mill</h1>{''.join(f'<p>{p}</p>' for p in prose)}</div><footer>Copyright by us</footer></body></html>"
    assert min_cut.main_text(page, weights) == " ".join(["High water at the mill", *prose])


def test_blocks_are_read_in_linear_time():
    import time

    k = 4000
    for make in (lambda n: "<div>x" * n, lambda n: '<a "' * n, lambda n: "<a '\">" * n, lambda n: "<b>" * n + "<h1>x</h1>" * n, lambda n: "</i><b>x" * n, lambda n: "<div>" * n + "</section>x" * n):
        took = []
        for n in (k, 8 * k):
            page, start = make(n), time.process_time()
            min_cut.blocks(page)
            took.append(time.process_time() - start)
        assert took[1] < 24 * took[0] + 0.5


def test_practice_pages_held_out():
    weights, right, total = min_cut.fit(), 0, 0
    for page, marks in min_cut.practice_pages(150, seed=99):
        found = min_cut.blocks(page)
        assert len(found) == len(marks)
        z = min_cut.features(found) @ weights[:-1] + weights[-1]
        side = min_cut.min_cut(np.logaddexp(0, -z).tolist(), np.logaddexp(0, z).tolist(), min_cut.edges(found))
        right += sum(a == bool(b) for a, b in zip(side, marks, strict=True))
        total += len(marks)
    assert right / total > 0.98


def test_extract(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    import html

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in pages.collect():
        inner = r["html"][r["html"].index("<article>") + 9 : r["html"].index("</article>")]
        want[r["page_id"]] = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
    got = {r["page_id"]: r["text"] for r in min_cut.extract(pages).collect()}
    assert got == want
    odd = spark.createDataFrame([(1, None, 5), (1, "", 5), (None, "<p>", 5)], "page_id long, html string, text int")
    assert [tuple(r) for r in min_cut.extract(odd).select("text", "n_chars").collect()] == [("", 0)] * 3
    assert min_cut.extract(odd.limit(0)).count() == 0


# 8
def exact_neighbours(rows, queries, k):
    valid = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, x in valid:
        if q in queries:
            out[q] = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in valid if i != q)[:k]
    return out


def test_search_recall(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = defaultdict(list)
    for r in multi_index.search(spark.read.parquet(f"{SF}/embeddings.parquet"), lambda i: i % 100 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    want = exact_neighbours(rows, set(got), 10)
    hit = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    truth = {q: dict((i, s) for s, i in exact_neighbours(rows, {q}, len(rows))[q]) for q in got}
    assert all(s == pytest.approx(truth[q][i], abs=1e-12) for q in got for s, i in got[q])


def test_search_recall_of_all_queries(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [r for r in table.collect() if r["embedding"] and None not in r["embedding"]]
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got = defaultdict(set)
    for r in multi_index.search(table, lambda i: i % 100 == 0).collect():
        got[r["query_id"]].add(r["vec_id"])
    hit = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hit += len(got[int(ids[q])] & set(ids[np.lexsort((ids, d))[:10]].tolist()))
        total += 10
    assert total >= 200 and hit >= 0.9 * total


def test_search_computes_visited_cells_only(spark, monkeypatch):
    """With ten well-apart clusters the measured number of entries is a fraction of the table, and the result is exact."""
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(10, 8)) * 50
    rows = [(i, (centers[i % 10] + rng.normal(size=8)).tolist()) for i in range(2000)] + [(7, centers[3].tolist()), (7, centers[4].tolist())]
    asked = []
    monkeypatch.setattr(multi_index, "_visits", lambda *a, plain=multi_index._visits: asked.append(a[3]) or plain(*a))
    got = defaultdict(list)
    for r in multi_index.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 100 == 0, centroids=16).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert asked[0] < 700
    want = exact_neighbours(rows, set(range(0, 2000, 100)), 10)
    hit = sum(len(set(got[q]) & {i for _, i in want[q]}) for q in want)
    assert hit >= 0.9 * 200


def test_search_over_all_cells_is_exact(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]  # one vector that many rows share
    rows += [(5000, None), (5001, [0.0] * 6), (5002, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (5003, [float("nan")] * 6), (5004, [1.0]), (None, [1.0] * 6), (5100, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = defaultdict(list)
    for r in multi_index.search(df, lambda i: i % 50 == 0, k=5, share=1.0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    want = exact_neighbours([r for r in rows if r[0] != 5004], {i for i, _ in rows if i is not None and i % 50 == 0}, 5)
    assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}


def test_search_with_few_or_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert multi_index.search(spark.createDataFrame([], schema), lambda i: i % 2 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], schema)
    assert [tuple(r)[:3] for r in multi_index.search(few, lambda i: i % 2 == 0).collect()] == [(0, 1, 1)]


def test_traversal_is_in_order():
    rng = np.random.default_rng(1)
    a, b = rng.random(7), rng.random(9)
    cells = multi_index.traverse(a, b, np.ones(63, np.int64), 63)
    sums = a[cells // 9] + b[cells % 9]
    assert len(set(cells.tolist())) == 63 and (np.diff(sums) >= 0).all()


# 9
def brute_lines(texts):
    """What each document keeps, from all pairs of lines that share a shingle."""
    first = {}
    for i, t in sorted(texts.items()):
        for line in t.split("\n"):
            first.setdefault(fuzzy_lines.normalise(line), i)
    lines = [x for x in first if len(x) >= 8]
    sets = [{x[j : j + 8] for j in range(len(x) - 7)} for x in lines]
    where = defaultdict(list)
    for n, s in enumerate(sets):
        for g in s:
            where[g].append(n)
    links = set()
    for n, s in enumerate(sets):
        shared = Counter(m for g in s for m in where[g] if m > n)
        links |= {(n, m) for m, c in shared.items() if c / (len(s) + len(sets[m]) - c) >= 0.8}
    return first, lines, union_find(range(len(lines)), links)


def test_dedup_lines_matches_brute_force(documents, texts):
    first, lines, roots = brute_lines(texts)
    got = {r["doc_id"]: r for r in fuzzy_lines.dedup_lines(documents).collect()}
    kept = Counter(root for i in texts for line in got[i]["clean_text"].split("\n") if len(norm := fuzzy_lines.normalise(line)) >= 8 for root in [roots[lines.index(norm)]])
    assert set(kept) == set(roots.values()) and set(kept.values()) == {1}  # one line of each component
    low = {}
    for n, x in enumerate(lines):
        low[roots[n]] = min(low.get(roots[n], 1 << 60), first[x])
    for i, t in texts.items():
        out = got[i]["clean_text"].split("\n")
        assert all(low[roots[lines.index(fuzzy_lines.normalise(x))]] == i for x in out if len(fuzzy_lines.normalise(x)) >= 8)
        short = lambda ls: [x for x in ls if len(fuzzy_lines.normalise(x)) < 8]
        assert out == [""] or short(out) == short(t.split("\n"))


def test_dedup_lines_on_odd_input(spark, odd, none):
    got = fuzzy_lines.dedup_lines(odd)
    assert got.count() == len(ODD)
    by = {r["doc_id"]: r["clean_text"] for r in got.collect()}
    assert by[3] == ODD[2][1] and by[4] == "" and by[1] == "" and by[6] == ODD[6][1]
    assert fuzzy_lines.dedup_lines(none).count() == 0
    rows = [(1, "A line that repeats\nshort\na  LINE that repeats\nshort"), (None, "A line that repeats\nown line here"), (2, "own line here\nA line that repeats!")]
    clean = {r["doc_id"]: r["clean_text"] for r in fuzzy_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean == {1: "A line that repeats\nshort\nshort", None: "A line that repeats\nown line here", 2: "own line here"}


def test_equal_short_lines_stay_once(spark, documents, texts):
    from quillspark.llm import queries

    rows = [(1, "A line that repeats\nshort\n\n é \nshort\n"), (None, "short\nshort"), (2, "Short \nown\n\nÉ\nshorts"), (3, "own")]
    clean = {r["doc_id"]: (r["clean_text"], r["n_lines"], r["n_kept"]) for r in fuzzy_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), short_lines=True).collect()}
    assert clean == {1: ("A line that repeats\nshort\n\n é \n", 4, 3), None: ("short", 2, 1), 2: ("own\n\nshorts", 4, 2), 3: ("", 1, 0)}
    seen, want = set(), {}
    for i, t in sorted(texts.items()):
        want[i] = []
        for x in map(fuzzy_lines.normalise, t.split("\n")):
            if 0 < len(x) < 8 and x not in seen:
                want[i].append(x)
                seen.add(x)
    long = {r["doc_id"]: r["clean_text"] for r in fuzzy_lines.dedup_lines(documents).collect()}
    got = {r["doc_id"]: [fuzzy_lines.normalise(x) for x in r["clean_text"].split("\n")] for r in queries.op9_fuzzy_lines(spark, SF).collect()}
    assert {i: [x for x in g if 0 < len(x) < 8] for i, g in got.items()} == want
    assert all([x for x in g if len(x) >= 8] == [y for y in map(fuzzy_lines.normalise, long[i].split("\n")) if len(y) >= 8] for i, g in got.items())


# 10
def spark_hash(*values):
    import xxhash

    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<q", v), seed=h)
    return h


def test_mixture_is_the_planned_one(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["hot"] * 8 + ["b", "c", None]), " ".join(["w"] * rng.randrange(1, 40))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(df, repetition=3.0).collect()
    total = defaultdict(int)
    for _, s, t in rows:
        total[s] += len(t.split())
    # the exponent at which the rarest source is used three times and the most frequent one once
    top, low = max(total.values()), min(total.values())
    a = 1 - math.log(3.0) / math.log(top / low)
    budget = {s: top * (t / top) ** a for s, t in total.items()}
    used = Counter((r["doc_id"], r["epoch"]) for r in got)
    assert set(used.values()) == {1}
    for s, t in total.items():
        full = math.floor(budget[s] / t + 1e-9)
        rest = budget[s] - full * t
        want = {(i, e) for i, x, _ in rows if x == s for e in range(full)}
        at = 0
        for _, i, n in sorted((spark_hash(0, full, i) >> 2, i, len(x.split())) for i, y, x in rows if y == s):
            at += n
            if at > rest + 1e-6:
                break
            want.add((i, full))
        own = {(r["doc_id"], r["epoch"]) for r in got if r["source"] == s}
        assert len(own ^ want) <= 1  # the bisection ends within 2**-48 of the exponent


def test_mixing_by_entropy_and_budget(spark):
    rows = [(i, "ab"[i % 10 == 0], "one two three") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(df, entropy=math.log(2) - 1e-9, budget=1200).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()
    assert all(abs(r["n"] - 600) <= 6 for r in got) and len(got) == 2
    with pytest.raises(ValueError):
        mixing.mix(df)


def test_mixing_on_odd_input(odd, none):
    got = mixing.mix(odd, repetition=2.0)
    assert {r["doc_id"] for r in got.collect()} == {r[0] for r in ODD}
    assert mixing.mix(none, repetition=2.0).count() == 0
    assert mixing.mix(odd.where("doc_id < 3"), repetition=2.0).count() == 2  # no tokens at all


def test_mixing_stays_native(documents):
    plan = mixing.mix(documents, repetition=2.0)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# kernels
def test_hashes_depend_on_the_run_alone():
    powers = textkern.Powers()
    texts = ["one two three four five six", "", "six", "zero one two three four five"]
    owner, h, whole, _ = textkern.word_shingles(texts, 5, powers)
    assert owner.tolist() == [0, 0, 2, 3, 3] and h[0] == h[4] and len(set(h.tolist())) == 4
    alone = textkern.word_shingles(texts[3:], 5, powers)
    assert (alone[1] == h[3:]).all() and alone[2][0] == whole[3]


def test_components_of_chains_and_stars(spark):
    from quillspark.llm.common import Scratch
    from quillspark.llm.linking import components

    rng = random.Random(5)
    ids = list(range(600))
    links = [(i, i + 1) for i in range(100)] + [(300 + i, 200) for i in range(50)] + [(rng.randrange(400, 600), rng.randrange(400, 600)) for _ in range(120)]
    rng.shuffle(links)
    got = {r["id"]: r["comp"] for r in components(Scratch(spark, "t"), spark.createDataFrame(links, "a long, b long"), "c").collect()}
    want = union_find(ids, links)
    assert got == {i: want[i] for pair in links if pair[0] != pair[1] for i in pair}
    assert components(Scratch(spark, "t"), spark.createDataFrame([], "a long, b long"), "c").count() == 0


def test_lines_of_rows_that_share_an_id_or_have_none(spark):
    line = "hello world this is a line"
    rows = [(1, line), (1, f"{line}\nand another one of them"), (2, f"{line}\nalone here in this text"), (None, f"{line}\nno id has this line of text"), (None, "no id has this line of text"), (4, "twin rows have this"), (4, "twin rows have this")]
    got = fuzzy_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").withColumn("every", F.lit(1)).repartition(3)).collect()
    kept = sorted(x for r in got for x in r["clean_text"].split("\n") if x and r["doc_id"])
    assert kept == sorted({x for i, t in rows for x in t.split("\n") if i}) and len(got) == len(rows)
    assert [r["doc_id"] for r in got if line in r["clean_text"] and r["doc_id"]] == [1]
    assert sorted(r["clean_text"] for r in got if not r["doc_id"]) == sorted(t for i, t in rows if not i)


def test_one_row_of_a_class_is_kept(spark):
    a, b = "one two three four five six seven", "quite another text with other words in it"
    rows = [(5, a), (5, a), (7, a), (5, b), (3, b), (6, ""), (6, None), (6, "..."), (None, a)]
    got = bagminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in got if r["kept"] and r["doc_id"]) == [(3, 3), (5, 5), (6, 6)] and sum(r["kept"] for r in got) == 4


def test_mixing_of_rows_without_ids(spark):
    rows = [(None, "s", f"{i} " * 10) for i in range(40)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), repetition=1.5, budget=600).collect()
    assert 580 <= sum(r["n_tokens"] for r in got) <= 600


def test_labelled_rows_that_share_an_id_are_one(spark):
    docs = spark.createDataFrame([(1, f"good words number {i}") for i in range(300)] + [(2, "bad bad bad"), (3, "fine text")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit_chain(docs, labels.select("doc_id", "toxic"), ["toxic"])
    assert len(chain.models) == 1 and toxicity.toxicity(docs, labels).count() == 302


def test_lines_are_normalised_as_by_splitting():
    """Lines whose only white space is single blanks take a shorter way to the same result."""
    odd = ["", " ", "  ", " a ", "a  b", "A\tb", "a\u00a0b", "a\u2003b", "\x1fa", "a\x85b", "ΑΣ ΣΑΣ", "İx", " Ab C", "a\u200bb", "\ud800 x", "a\r"]
    assert [fuzzy_lines.normalise(x) for x in odd] == [" ".join(x.split()).lower() for x in odd]


def test_shingles_of_long_texts_are_those_among_short_ones():
    texts = ["abcdefgh", "Δelta and a longer line", "x" * 600]
    owner, h = textkern.char_shingles(texts, 8, textkern.Powers())
    mixed_owner, mixed = textkern.char_shingles([*texts, "short"], 8, textkern.Powers())
    assert (mixed[: len(h)] == h).all() and (mixed_owner[: len(h)] == owner).all() and len(mixed) == len(h) + 1


def test_first_words_of_bitmaps_bound_what_is_shared():
    from quillspark.llm import linking

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: 300 - 20 * k], rng.integers(0, 1 << 63, 20 * k).astype(np.uint64)])) for k in range(12)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(12)), pa.array(range(12)), pa.array([True] * 12), pa.array([s.tobytes() for s in sets])], names=["id", "comp", "few", "payload"])
    (out,) = linking._bitmaps(linking.as_sets)([batch])
    got = out.to_pydict()
    bits = [[f"{got[f'w{k}'][i] & (1 << 64) - 1:064b}" for k in range(linking.WORDS)] for i in range(12)]
    for i in range(12):
        assert got["rest"][i] == sum(w.count("1") for w in bits[i][linking.FIRST :])
        for j in range(i):
            head = sum(a == b == "1" for u, v in zip(bits[i][: linking.FIRST], bits[j], strict=False) for a, b in zip(u, v, strict=True))
            bound = head + min(got["rest"][i], got["rest"][j]) + min(got["slack"][i], got["slack"][j])
            assert bound >= len(np.intersect1d(sets[i], sets[j]))


def test_band_keys_of_lines_are_written_once_and_shuffled_in_turns(spark, monkeypatch):
    """Before, they were shuffled and written again with the distinct lines, and all bands met at once."""
    from quillspark.llm.common import Scratch

    kept, keep = {}, Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name, *a: kept.setdefault(name, df.columns) and keep(self, df, name, *a))
    line = "a line of some length that comes again and again"
    rows = [(i, f"{line} {'!' * (i % 3)}\nthe {i}th document has this line alone {i * 7919}") for i in range(30)]
    got = {r["doc_id"]: r["clean_text"] for r in fuzzy_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i, t in got.items() if line in t] == [0] and all(f"the {i}th document" in t for i, t in got.items())
    assert [k for k, columns in kept.items() if "b0" in columns] == ["lines"]
    assert sum(k.startswith("picks") for k in kept) == fuzzy_lines.TURNS > 1


def test_members_that_repeat_are_one(spark):
    from quillspark.llm import linking
    from quillspark.llm.common import Scratch

    rows = [[(1, 5), (1, 5), (1, 6), (1, 6), (2, 5), (2, 5)], [(3, 7), (3, 8), (3, 8)]]
    acts = linking.buckets(Scratch(spark, "t"), [spark.createDataFrame(r, "key long, id long") for r in rows], repeats=True)
    assert [sorted((r["key"], r["id"], *sorted((r["low"], r["high"]))) for r in a.collect()) for a in acts] == [[(1, 5, 5, 6), (1, 6, 5, 6)], [(3, 7, 7, 8), (3, 8, 7, 8)]]


def test_bitmaps_rule_out_no_similar_pair():
    from quillspark.llm import linking

    rng = np.random.default_rng(5)
    a = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in rng.integers(1, 900, 400)]
    b = [np.concatenate([x[: max(1, int(len(x) * p))], rng.integers(0, 1 << 63, int(len(x) * q)).astype(np.uint64)]) for x, p, q in zip(a, rng.uniform(0.7, 1, 400), rng.uniform(0, 0.3, 400), strict=True)]
    a = [np.concatenate([x, x[: len(x) // 3]]) for x in a]  # hashes may repeat, in any order
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(range(400)), *(pa.array([x.tobytes() for x in side]) for side in (a, b))], names=["a", "b", "pa", "pb"])
    found = [i for out in linking._similar(0.8, linking.as_sets)([batch]) for i in out.column(0).to_pylist()]
    want = [i for i, (x, y) in enumerate(zip(map(set, map(np.ndarray.tolist, a)), map(set, map(np.ndarray.tolist, b)), strict=True)) if len(x & y) / len(x | y) >= 0.8]
    assert found == want and 50 < len(want) < 350


def test_lines_of_a_whole_text_are_normalised_as_one_by_one():
    for t in ["", "A b\n c D \n\nE", "A  b\nC", "a\tb\nC", "a\r\nB", "a\x1fb\nC\x0b", "É a\nΑΣ\nb", "\n", " a\n b "]:
        assert fuzzy_lines.normalised(t) == [fuzzy_lines.normalise(x) for x in t.split("\n")]


def test_short_texts_among_long_ones_have_one_shingle():
    texts = ["short", "", "abcdefghij", "x", "Δelta and a longer line", "", "seven77", "eight888"]
    owner, h = textkern.char_shingles(texts, 8, textkern.Powers())
    apart = [textkern.char_shingles([t], 8, textkern.Powers())[1] for t in texts]
    assert owner.tolist() == [i for i, t in enumerate(texts) if t for _ in range(max(1, len(t) - 7))]
    assert (h == np.concatenate(apart)).all()
