"""The sectioned inverted index: postings, lookups, changes, codecs and storage."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs
from . import text


#: Characters of the texts of one bucket of a stored index.
BUCKET_CHARS = 16 << 20


def pieces_of(parts: DataFrame) -> int:
    """How many pieces of about BUCKET_CHARS characters a table with title and abstract has, at least as many as tasks run at once."""
    chars = parts.agg(F.sum(F.length("title") + F.length("abstract"))).first()[0] or 0
    return max(parts.sparkSession.sparkContext.defaultParallelism, -(-chars // BUCKET_CHARS))


def postings(tokens_: DataFrame) -> DataFrame:
    """(term, doc_id, title_pos, abstract_pos, tf_title, tf_abstract): sorted positions of each term in each section of a document."""
    by = [F.array_sort(F.collect_set(F.when(F.col("section") == s, F.col("pos")))).alias(f"{s}_pos") for s in text.SECTIONS]
    return tokens_.groupBy("term", "doc_id").agg(*by).withColumns({f"tf_{s}": F.size(f"{s}_pos") for s in text.SECTIONS})


def counts(tokens_: DataFrame) -> DataFrame:
    """Postings without positions: (term, doc_id, tf_title, tf_abstract). All that ranking needs, aggregated before the shuffle."""
    return tokens_.groupBy("term", "doc_id").agg(*(F.count(F.when(F.col("section") == s, 1)).alias(f"tf_{s}") for s in text.SECTIONS))


def _cut_lists(batches):
    """(term, doc_id, place) in this order -> (term, doc_id, title_pos, abstract_pos); the last posting of a batch waits for the next."""
    names = ["term", "doc_id", "title_pos", "abstract_pos"]

    def other(column) -> np.ndarray:
        return pc.fill_null(pc.not_equal(column[1:], column[:-1]), True).to_numpy(zero_copy_only=False)

    def made(term, doc, place, opens):
        place, second = place & 0xFFFFFFFF, place >> 32 == 1
        at, lists = np.flatnonzero(opens), []
        for own in (~second, second):
            ends = np.concatenate([[0], np.cumsum(own)])[np.append(at, len(place))]
            lists.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(place[own].astype(np.int32))))
        return pa.RecordBatch.from_arrays([term.take(pa.array(at)), doc.take(pa.array(at)), *lists], names=names)

    held = None
    for batch in batches:
        columns = batch.columns if held is None else [pa.concat_arrays(c) for c in zip(held, batch.columns, strict=True)]
        if not len(columns[0]):
            continue
        term, doc, place = *columns[:2], columns[2].to_numpy()
        opens = np.concatenate([[True], other(term) | other(doc)])
        fresh = np.flatnonzero(opens | (np.diff(place, prepend=-1) != 0))  # rows that share an id share places
        last = int(np.flatnonzero(opens)[-1])
        held = [c[last:] for c in columns]
        fresh = fresh[fresh < last]
        if len(fresh):
            rows = pa.array(fresh)
            yield made(term.take(rows), doc.take(rows), place[fresh], opens[fresh])
    if held is not None:
        fresh = np.unique(held[2].to_numpy())
        yield made(held[0][: len(fresh)], held[1][: len(fresh)], fresh, np.arange(len(fresh)) == 0)


def ordered_postings(tokens_: DataFrame) -> DataFrame:
    """(term, doc_id, title_pos, abstract_pos) of tokens whose partitions have whole documents, each in the order of term and doc_id: tokens are sorted where
    they lie and lists are cut from batches of them, so none is collected by an aggregation."""
    place = F.col("pos") + F.when(F.col("section") == text.SECTIONS[1], F.lit(1 << 32)).otherwise(F.lit(0).cast("long"))
    rows = tokens_.select("term", "doc_id", place.alias("place")).sortWithinPartitions("term", "doc_id", "place")
    return rows.mapInArrow(_cut_lists, f"term string, doc_id {tokens_.schema['doc_id'].dataType.simpleString()}, title_pos array<int>, abstract_pos array<int>")


@dataclass
class Index:
    """Lazy tables; `add` and `remove` give a new index. Statistics all come from one table of counts, which is much smaller than the tokens; with
    `cached` it is computed once for all requests."""

    parts: DataFrame
    tokens: DataFrame
    n_stops: int = 20
    fixed_stops: DataFrame | None = None
    all_counts: DataFrame | None = None
    stop_list: list[str] | None = None
    terms: DataFrame | None = None
    lengths: DataFrame | None = None

    def __post_init__(self):
        self.uncounted = self.all_counts is None
        if self.uncounted:
            self.all_counts = counts(self.tokens)

    @staticmethod
    def build(docs: DataFrame, n_stops: int = 20, id_col: str = "doc_id", text_col: str = "text") -> Index:
        parts = text.sections(docs, id_col, text_col)
        return Index(parts, text.tokens(parts), n_stops)

    def cached(self) -> Index:
        """The same index with its counts kept in the executors' memory or on their disks, and its few stop words in the plan."""
        kept = Index(self.parts, self.tokens, self.n_stops, self.fixed_stops, self.all_counts.persist(), self.stop_list)
        if kept.stop_list is None:
            kept.stop_list = [r["term"] for r in kept.stops.collect()]  # n_stops rows
        return kept

    def stored(self, path: str) -> Index:
        """The same index with its counts, lengths and terms (term, df) as tables under `path`. Texts are cut into tokens once, after they were dealt by id, so
        counts are made where they lie; counts and lengths are bucketed by document, so what is summed up by document is not shuffled again."""
        spark, name = self.parts.sparkSession, f"quill_{uuid.uuid4().hex[:16]}"
        buckets = self._pieces()

        def kept(df: DataFrame, table: str) -> DataFrame:
            df.write.bucketBy(buckets, "doc_id").option("path", f"{path}/{table}").saveAsTable(f"{name}_{table}")
            return spark.table(f"{name}_{table}")

        parts = self.parts.repartition(buckets, "doc_id")
        every = kept(counts(text.tokens(parts)), "counts")
        totals = every.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.col("tf_title") + F.col("tf_abstract")).alias("n"))
        totals.write.parquet(f"{path}/terms")
        totals = spark.read.parquet(f"{path}/terms")
        found = Index(self.parts, self.tokens, self.n_stops, self.fixed_stops, every, self.stop_list)
        if found.stop_list is None:
            first = self.fixed_stops if self.fixed_stops is not None else totals.orderBy(F.desc("n"), "term").limit(self.n_stops)
            found.stop_list = [r["term"] for r in first.collect()]  # n_stops rows
        found.terms = found.without_stops(totals).select("term", "df")
        found.lengths = kept(found.doc_lengths, "lengths")
        return found

    def _pieces(self) -> int:
        return pieces_of(self.parts)

    def by_ranges(self) -> Index:
        """The same index with its texts dealt by ranges of ids before they are cut into tokens, so postings are made where they lie, and with its few stop words in the plan."""
        stops = self.stop_list if self.stop_list is not None else [r["term"] for r in self.stops.collect()]  # n_stops rows
        parts = self.parts.repartitionByRange(self._pieces(), "doc_id")
        return Index(parts, text.tokens(parts), self.n_stops, self.fixed_stops, None, stops)

    def without_stops(self, terms: DataFrame) -> DataFrame:
        if self.stop_list is not None:
            return terms.where(~F.col("term").isin(self.stop_list)) if self.stop_list else terms
        return text.non_stop(terms, self.stops) if self.n_stops else terms

    @property
    def stops(self) -> DataFrame:
        if self.fixed_stops is not None:
            return self.fixed_stops
        if self.uncounted:
            return text.stop_words(self.tokens, self.n_stops)
        n = self.all_counts.groupBy("term").agg(F.sum(F.col("tf_title") + F.col("tf_abstract")).alias("n"))
        return n.orderBy(F.desc("n"), "term").limit(self.n_stops)

    @property
    def kept(self) -> DataFrame:
        return self.without_stops(self.tokens)

    @property
    def postings(self) -> DataFrame:
        return postings(self.kept)

    @property
    def counts(self) -> DataFrame:
        return self.without_stops(self.all_counts)

    @property
    def doc_lengths(self) -> DataFrame:
        if self.lengths is not None:
            return self.lengths
        sums = self.counts.groupBy("doc_id").agg(*(F.sum(f"tf_{s}").alias(f"dl_{s}") for s in text.SECTIONS))
        return self.parts.select("doc_id").join(sums, "doc_id", "left").na.fill(0)

    @property
    def vocab(self) -> DataFrame:
        return self.terms.select("term") if self.terms is not None else self.counts.select("term").distinct()

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
        """The same stop words hold for the new documents; corpus and index grow together."""
        parts = text.sections(docs, id_col, text_col)
        return Index(self.parts.unionByName(parts), self.tokens.unionByName(text.tokens(parts)), self.n_stops, self.stops, None, self.stop_list)

    def remove(self, ids: list[int]) -> Index:
        gone = ~F.col("doc_id").isin(ids)
        return Index(self.parts.where(gone), self.tokens.where(gone), self.n_stops, self.stops, None, self.stop_list)

    def lookup(self, word: str) -> DataFrame:
        """Postings of a word, if it is a term, and of all terms that begin with it, as one list for each document."""
        word = word.lower()
        hits = self.kept.where(F.col("term").startswith(word))
        known = self.vocab.where(F.col("term") == word)
        return postings(hits.join(F.broadcast(known.select(F.lit(True).alias("known")).limit(1))).drop("known").withColumn("term", F.lit(word)))


#: What encodes and what decodes a list of positions.
CODES = {
    "gamma": (codecs.gamma_bits, codecs.gamma_positions),
    "vb": (codecs.vb_bytes, codecs.vb_positions),
    "none": (F.to_json, lambda c: F.from_json(c, "array<int>")),
}


def encode(postings_: DataFrame, compression: str = "none") -> DataFrame:
    """(term, doc_id, title_code, abstract_code): gamma bit strings, variable-byte binaries, or JSON texts."""
    if compression not in CODES:
        raise ValueError(f"compression must be one of {sorted(CODES)}, not {compression!r}")
    return postings_.select("term", "doc_id", *(CODES[compression][0](F.col(f"{s}_pos")).alias(f"{s}_code") for s in text.SECTIONS))


def decode(encoded: DataFrame, compression: str = "none") -> DataFrame:
    """Inverse of `encode`."""
    if compression not in CODES:
        raise ValueError(f"compression must be one of {sorted(CODES)}, not {compression!r}")
    out = encoded.select("term", "doc_id", *(CODES[compression][1](F.col(f"{s}_code")).alias(f"{s}_pos") for s in text.SECTIONS))
    return out.withColumns({f"tf_{s}": F.size(f"{s}_pos") for s in text.SECTIONS})


def roundtrip(postings_: DataFrame) -> DataFrame:
    """(compression, n, same): how many postings there are, and of how many both lists come back from each code, encoded and decoded where they lie."""
    coded = postings_.withColumns({f"{c}_{s}": to(F.col(f"{s}_pos")) for c, (to, _) in CODES.items() for s in text.SECTIONS})
    alike = {c: reduce(and_, (back(F.col(f"{c}_{s}")) == F.col(f"{s}_pos") for s in text.SECTIONS)) for c, (_, back) in CODES.items()}
    row = coded.agg(F.count("*").alias("n"), *(F.count_if(same).alias(c) for c, same in alike.items()))
    return row.select(F.inline(F.array(*(F.struct(F.lit(c).alias("compression"), F.col("n"), F.col(c).alias("same")) for c in CODES))))


def sizes(postings_: DataFrame) -> DataFrame:
    """Bytes of all position lists in each form: (compression, bytes)."""
    both = [F.col(f"{s}_pos") for s in text.SECTIONS]
    measure = {
        "gamma": sum((F.ceil(F.length(codecs.gamma_bits(p)) / 8) for p in both), F.lit(0)),
        "none": sum((F.length(F.to_json(p)) for p in both), F.lit(0)),
        "vb": sum((F.length(codecs.vb_bytes(p)) for p in both), F.lit(0)),
    }
    row = postings_.agg(*(F.sum(m).cast("long").alias(k) for k, m in measure.items()))
    return row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("compression"), F.col(k).alias("bytes")) for k in measure))).alias("r")).select("r.*")


def store(postings_: DataFrame, path: str, compression: str = "none") -> int:
    """Writes the encoded index, sorted by term so that lookups skip row groups; returns its payload's bytes."""
    encode(postings_, compression).repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(path)
    written = postings_.sparkSession.read.parquet(path)
    size = F.ceil(F.length("title_code") / 8) + F.ceil(F.length("abstract_code") / 8) if compression == "gamma" else F.length("title_code") + F.length("abstract_code")
    return written.agg(F.sum(size)).first()[0] or 0


def load(spark: SparkSession, path: str, compression: str = "none") -> DataFrame:
    return decode(spark.read.parquet(path), compression)


# the byte layout of whole terms: u8 word length, word, u32 documents, then for each document u8 id length, id and two lists
def frame_term(word: str, docs: list[tuple[str, list[int], list[int]]], compression: str) -> bytes:
    """One term's record. gamma lists: u8 bytes, u16 bits, payload padded on the left; vb lists: u32 bytes, payload. Big-endian."""
    raw = word.encode()
    out = [len(raw).to_bytes(1, "big"), raw, len(docs).to_bytes(4, "big")]
    for doc, *lists in docs:
        key = doc.encode()
        out += [len(key).to_bytes(1, "big"), key]
        for positions in lists:
            if compression == "gamma":
                last, bits = 0, ""
                for p in sorted(positions):
                    gap, last = p + 1 - last, p + 1
                    low = bin(gap)[3:]
                    bits += "1" * len(low) + "0" + low
                size = len(bits) // 8 + 1
                out += [size.to_bytes(1, "big"), len(bits).to_bytes(2, "big"), int("0" + bits, 2).to_bytes(size, "big")]
            else:
                code = b"".join(_vb(p) for p in positions)
                out += [len(code).to_bytes(4, "big"), code]
    return b"".join(out)


def _vb(n: int) -> bytes:
    out = [n & 127 | 128]
    while n := n >> 7:
        out.append(n & 127)
    return bytes(out[::-1])


def unframe_term(data: bytes, compression: str) -> tuple[str, list[tuple[str, list[int], list[int]]]]:
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        at += n
        return data[at - n : at]

    word = take(take(1)[0]).decode()
    docs = []
    for _ in range(int.from_bytes(take(4), "big")):
        key, lists = take(take(1)[0]).decode(), []
        for _ in range(2):
            if compression == "gamma":
                size, bits = take(1)[0], int.from_bytes(take(2), "big")
                payload = int.from_bytes(take(size), "big")
                lists.append(codecs.decode_gamma(format(payload, f"0{bits}b") if bits else ""))
            else:
                lists.append(codecs.decode_vb(take(int.from_bytes(take(4), "big"))))
        docs.append((key, *lists))
    return word, docs


def framed(postings_: DataFrame, compression: str) -> DataFrame:
    """(term, record binary): each term's whole record. A list of one term's documents must fit a task, as in the layout itself."""
    @F.pandas_udf("binary")
    def build(term: pd.Series, docs: pd.Series) -> pd.Series:
        return pd.Series([frame_term(t, [(str(d["doc_id"]), list(d["title_pos"]), list(d["abstract_pos"])) for d in ds], compression) for t, ds in zip(term, docs, strict=True)])

    lists = postings_.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("doc_id", "title_pos", "abstract_pos"))).alias("docs"))
    return lists.select("term", build("term", "docs").alias("record"))
