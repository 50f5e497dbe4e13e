"""Alignment of two tokenizers' tokens by elementary intervals of a text's bytes.

The ends of both token sequences cut the bytes into elementary intervals: the union of both arrays of ends, each interval owned by the first token of either
side that ends at it or behind it. Each interval is one overlap of two tokens; an end that both share closes a group, and a group's product pairs all of its tokens.

Neither tokenizer looks across a place where a blank or line break follows something visible, so texts are cut there into units, mostly a blank and a word, which
both encode and align alike wherever they stand. A worker does so once for each unit while a bounded table holds it; a text's tokens, groups and links are those
of its units one after another. Tokenizers for which this cannot be shown from their files get whole texts as units.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, sized, tidy, worker_cache
from .token_files import byte_letters

#: Units that a table holds, and characters in them, before it is begun anew.
KEPT, KEPT_CHARS = 250_000, 4_000_000
#: Characters of text that are aligned at once; a longer text goes alone.
SLICE_CHARS = 1_000_000
#: Kinds of links: pairs of tokens that end together, that overlap, or that share a group.
RELATIONS = ("end", "overlap", "group")


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The owners (a, b) of each elementary interval, whether both end with it, and each interval's group. Both arrays ascend and have the same last end."""
    ends = np.union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    shared = (ends_a[a] == ends) & (ends_b[b] == ends) if len(ends) else np.zeros(0, bool)
    return a, b, shared, np.cumsum(shared) - shared


def products(a: np.ndarray, b: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tokens of each group, group by group. A group has no more than the tokens between two shared ends."""
    last_a, last_b = a[shared], b[shared]
    first_a, first_b = np.append(0, last_a[:-1] + 1), np.append(0, last_b[:-1] + 1)
    size_a, size_b = last_a + 1 - first_a, last_b + 1 - first_b
    n = size_a * size_b
    nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    wide = np.repeat(size_b, n)
    return np.repeat(first_a, n) + nth // np.maximum(wide, 1), np.repeat(first_b, n) + nth % np.maximum(wide, 1)


class ByteLevel:
    """Side A: a tokenizers file with a byte-level alphabet. Strings of special tokens are plain text."""

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters = {c: b for b, c in byte_letters().items()}
        size = 1 + max(self.tokenizer.get_vocab().values())
        self.bytes_of = [b""] * size
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes_of[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, plain = spec.get("pre_tokenizer") or {}, [t for t in spec.get("added_tokens", []) if not t["special"]]
        self.apart = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and spec.get("normalizer") is None and not plain

    def encode(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]


class Pieces:
    """Side B: a sentencepiece model, which puts a blank before a text by itself. Units begin with that blank or the one of the text."""

    BLANK = "▁"

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(self.BLANK, " ").encode() for i, p in enumerate(pieces)]
        own = [p for i, p in enumerate(pieces) if not self.model.is_byte(i)]
        self.before = self.model.encode("\n")
        crossing = any("\n" in p or "\t" in p or any(x != self.BLANK and y == self.BLANK for x, y in zip(p, p[1:])) for p in own)
        as_is = all(self._bytes(self.model.encode(t)) == (" " + t).encode() for t in ("a  b ", " \n a\t\tb\r\n", "ﬁ①é"))
        self.apart = not crossing and as_is and self._bytes(self.before) == b" \n" and len(self.before) == 2

    def _bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def encode(self, units: list[str], apart: bool) -> list[list[int]]:
        """No piece holds a line break, so what follows one is encoded as it stands, without a further blank."""
        if apart:
            return [ids[2:] for ids in self.model.encode(["\n" + u for u in units], num_threads=1)]
        return self.model.encode([u[1:] for u in units], num_threads=1)


class Aligner(dict):
    """unit -> row of what is known of it: counts of tokens, groups and bytes that differ, the groups' text, and its links as a * n_b + b."""

    def __init__(self, path_a: str, path_b: str, relation: str):
        import re

        super().__init__()
        self.a, self.b, self.relation = ByteLevel(path_a), Pieces(path_b), relation
        self.apart = self.a.apart and self.b.apart
        self.find = re.compile(r"\s*\S+(?:[^\S \n\t]\s*\S*)*|\s+").findall
        self.n_b = len(self.b.bytes_of)
        self.size_a, self.size_b = (np.array([len(x) for x in side.bytes_of], np.int64) for side in (self.a, self.b))
        self.decimal = [str(i) for i in range(max(len(self.a.bytes_of), self.n_b))]
        self.begin()

    def begin(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.chars, self.rows, self.texts = 0, 0, []
        self.counts, self.first, self.flat, self.links = np.zeros((1 << 12, 4), np.int64), np.zeros(1 << 12, np.int64), 0, np.zeros(1 << 14, np.int64)

    def __missing__(self, unit: str) -> int:
        self[unit] = row = self.rows + len(self.new)
        self.new.append(unit)
        return row

    def fill(self) -> None:
        """Encodes and aligns the new units, all at once: their bytes one after another."""
        new, self.new = self.new, []
        ids_a, ids_b = self.a.encode(new), self.b.encode(new, self.apart)
        bytes_a, bytes_b = self.a.bytes_of, self.b.bytes_of
        same = [b"".join(map(bytes_a.__getitem__, x)) == b"".join(map(bytes_b.__getitem__, y)) == u.encode() for x, y, u in zip(ids_a, ids_b, new, strict=True)]
        n_a, n_b = (np.array([len(x) if ok else 0 for x, ok in zip(ids, same, strict=True)], np.int64) for ids in (ids_a, ids_b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(x for x, ok in zip(ids, same, strict=True) if ok), np.int64, int(n.sum())) for ids, n in ((ids_a, n_a), (ids_b, n_b)))
        a, b, shared, group = align(np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b]))
        if self.relation == "end":
            link_a, link_b = a[shared], b[shared]
        elif self.relation == "overlap":
            link_a, link_b = a, b
        else:
            link_a, link_b = products(a, b, shared)
        unit_of_a = np.repeat(np.arange(len(new)), n_a)
        groups = np.bincount(unit_of_a[a[shared]], minlength=len(new))
        links = np.bincount(unit_of_a[link_a], minlength=len(new))
        keys = flat_a[link_a] * self.n_b + flat_b[link_b]
        # the text of each group, then of each unit
        decimal, last_a, last_b = self.decimal, a[shared], b[shared]
        cut_a, cut_b = (np.append(0, last + 1).tolist() for last in (last_a, last_b))
        text_a, text_b = (list(map(decimal.__getitem__, flat.tolist())) for flat in (flat_a, flat_b))
        of_group = [",".join(text_a[cut_a[g] : cut_a[g + 1]]) + "|" + ",".join(text_b[cut_b[g] : cut_b[g + 1]]) for g in range(len(last_a))]
        at = 0
        for n in groups.tolist():
            self.texts.append(";".join(of_group[at : at + n]))
            at += n
        rows = self.rows + len(new)
        while rows + 1 > len(self.first):
            self.counts, self.first = (np.concatenate([x, np.zeros_like(x)]) for x in (self.counts, self.first))
        while self.flat + len(keys) > len(self.links):
            self.links = np.concatenate([self.links, np.zeros_like(self.links)])
        self.counts[self.rows : rows] = np.stack([n_a, n_b, groups, ~np.array(same, bool)], 1)
        self.first[self.rows + 1 : rows + 1] = self.flat + np.cumsum(links)
        self.links[self.flat : self.flat + len(keys)] = keys
        self.rows, self.flat, self.chars = rows, self.flat + len(keys), self.chars + sum(map(len, new))

    def texts_of(self, texts: list[str | None]):
        """For each text: counts (n_a, n_b, n_groups, n_links), its groups' text, and its links; all empty where bytes differ."""
        names = [[] if not t else self.find(" " + t) if self.apart else [" " + t] for t in texts]
        rows = [np.array(list(map(self.__getitem__, x)), np.int64) for x in names]
        if self.new:
            self.fill()
        out = []
        for own in rows:
            n_a, n_b, groups, differ = self.counts[own].sum(0).tolist()
            if differ or not len(own):
                out.append(((0, 0, 0, 0), "", np.zeros(0, np.int64)))
                continue
            lo = self.first[own]
            size = self.first[own + 1] - lo
            stop = np.cumsum(size)
            links = self.links[np.arange(int(stop[-1])) + np.repeat(lo - (stop - size), size)]
            out.append(((n_a, n_b, groups, len(links)), ";".join(map(self.texts.__getitem__, own.tolist())), links))
        if self.rows > KEPT or self.chars > KEPT_CHARS:
            self.begin()
        return out


def aligner(path_a: str, path_b: str, relation: str) -> Aligner:
    cache = worker_cache("alignment")
    key = path_a, path_b, relation
    if key not in cache:
        cache[key] = Aligner(*key)
    return cache[key]


def _slices(texts: list[str | None]):
    """(from, to) of about SLICE_CHARS."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t or "") > SLICE_CHARS:
            yield lo, i
            lo, size = i, 0
        size += len(t or "")
    if lo < len(texts):
        yield lo, len(texts)


ROWS = "nth long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, times binary"


def _align_rows(path_a: str, path_b: str, relation: str):
    """(nth, doc_id, text) -> ROWS; links are a text's distinct ones, as differences of ascending numbers, and times how often each comes."""

    def run(batches):
        for batch in batches:
            nth, doc, text = (batch.column(k) for k in range(3))
            texts = text.to_pylist()
            for lo, hi in _slices(texts):
                found = aligner(path_a, path_b, relation).texts_of(texts[lo:hi])
                counts, shas, links, times = [x[0] for x in found], [], [], []
                for _, groups, keys in found:
                    shas.append(hashlib.sha256(groups.encode()).hexdigest() if groups else "")
                    keys, n = np.unique(keys, return_counts=True)
                    links.append(np.diff(keys, prepend=0).astype("<i8").tobytes())
                    times.append(n.astype("<i4").tobytes())
                out = [nth.slice(lo, hi - lo), doc.slice(lo, hi - lo), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4)), pa.array(shas), pa.array(links, pa.binary()), pa.array(times, pa.binary())]
                yield pa.RecordBatch.from_arrays(out, names=[f.split()[0] for f in ROWS.split(", ")])

    return run


def _unpacked(links: list[bytes], times: list[bytes]):
    """Keys, how often each comes, and how many each text has."""
    n = np.array([len(x) // 8 for x in links], np.int64)
    delta = np.frombuffer(b"".join(links), "<i8")
    upto = np.cumsum(delta)
    start = np.cumsum(n) - n
    base = np.where(start > 0, upto[np.maximum(start, 1) - 1], 0) if len(upto) else np.zeros(len(n), np.int64)
    return upto - np.repeat(base, n), np.frombuffer(b"".join(times), "<i4").astype(np.int64), n


def _count(batches):
    """(links, times) -> (link, n) of this task, added up as it goes."""
    keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            more, times, _ = _unpacked(part.column(0).to_pylist(), part.column(1).to_pylist())
            keys, place = np.unique(np.concatenate([keys, more]), return_inverse=True)
            n = np.bincount(place, np.concatenate([n, times]), len(keys)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["link", "n"])


def _packed(batches):
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(k).to_numpy().astype("<i8").tobytes()], pa.binary()) for k in range(2)], names=["links", "n"])


def most_links(path_a: str, path_b: str) -> int:
    """How many pairs can end together at all: the bytes of one are the last bytes of the other, so a pair is a token and how many of its bytes the other has."""
    return sum(len(x) for side in (ByteLevel(path_a), Pieces(path_b)) for x in side.bytes_of)


#: Distinct links up to which their counts are sent to all tasks, 17 bytes each; the pairs of two vocabularies that can end together are fewer as a rule.
SENT = 2_000_000


def alignment(docs: DataFrame, path_a: str, path_b: str, relation: str = "end", id_col: str = "doc_id", text_col: str = "text", sent: int = SENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row, whose text side A encodes behind a blank and side B by itself.

    Groups are cut by the byte offsets where tokens of both end. Links are, by `relation`, the pairs of tokens that end together, that overlap, or that share a
    group, one for each elementary interval in the first two cases. An id pair's count is how many links of all rows hold it; n_best counts the links whose count is the
    highest of their B id's, ties included, and count_sum adds up the counts of all. groups_sha256 is that of the groups' ids, `a1,a2|b1;a3|b2,b3`.
    A text that is null or empty, or whose tokens' bytes differ from a blank and the text on either side, has no tokens: zeros, and an empty groups_sha256.

    Rows are independent but for the counts; repeated rows and ids count each, other columns are ignored, and an empty table gives an empty result. Both files
    must be readable on every executor. Pairs that end together are no more than both vocabularies have bytes (`most_links`); if that is more than `sent`, or for the
    other relations, links meet their counts in joins.
    """
    if relation not in RELATIONS:
        raise ValueError(f"relation must be one of {RELATIONS}, not {relation!r}")
    spark = docs.sparkSession
    scratch = Scratch(spark, "alignment")
    rows = docs.select(F.monotonically_increasing_id().alias("nth"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    aligned = scratch.keep(rows.mapInArrow(tidy(_align_rows(path_a, path_b, relation)), ROWS), "aligned")
    counts = aligned.select("links", "times").mapInArrow(tidy(_count), "link long, n long").groupBy("link").agg(F.sum("n").alias("n"))
    counts = scratch.keep(counts, "counts")
    n_b = len(Pieces(path_b).bytes_of)
    shown = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if relation == "end" and most_links(path_a, path_b) <= sent:
        got = counts.mapInArrow(tidy(_packed), "links binary, n binary").collect()
        links, n = (np.frombuffer(b"".join(r[c] for r in got), "<i8") for c in ("links", "n"))
        order = np.argsort(links)
        table = spark.sparkContext.broadcast((links[order], n[order], n_b))
        return aligned.mapInArrow(tidy(_score(table)), ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in shown))

    best = counts.groupBy(F.pmod("link", F.lit(n_b)).alias("b")).agg(F.max("n").alias("most"))
    known = scratch.keep(counts.join(sized(scratch.keep(best, "best")), F.pmod("link", F.lit(n_b)) == F.col("b")).select("link", "n", (F.col("n") == F.col("most")).cast("long").alias("best")), "known")
    pairs = aligned.select("nth", "links", "times").mapInArrow(tidy(_exploded), "nth long, link long, times long").join(sized(known), "link")
    sums = pairs.groupBy("nth").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return aligned.drop("links", "times").join(sums, "nth", "left").na.fill(0, ["n_best", "count_sum"]).select(*shown)


def _score(table):
    def run(batches):
        worker_cache("alignment").clear()  # what the first step has kept
        links, n, n_b = table.value
        most = np.zeros(n_b, np.int64)
        np.maximum.at(most, links % n_b, n)
        best = n == most[links % n_b]
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                column = lambda c, part=part: part.column(part.schema.get_field_index(c))
                keys, times, size = _unpacked(column("links").to_pylist(), column("times").to_pylist())
                at = np.searchsorted(links, keys)
                stop = np.append(0, np.cumsum(size))
                n_best, total = (np.diff(np.append(0, np.cumsum(times * x))[stop]) for x in ((best[at], n[at]) if len(keys) else (0, 0)))
                out = {"n_best": pa.array(n_best.astype(np.int64)), "count_sum": pa.array(total.astype(np.int64))}
                names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
                yield pa.RecordBatch.from_arrays([out[c] if c in out else column(c) for c in names], names=names)

    return run


def _exploded(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            keys, times, size = _unpacked(part.column(1).to_pylist(), part.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), size)), pa.array(keys), pa.array(times)], names=["nth", "link", "times"])
