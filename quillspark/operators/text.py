"""Sections, tokens, stop words and counts over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import strings

SECTIONS = ("title", "abstract")


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, title, abstract): a text's first line and the rest. Null counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.substring_index(text, "\n", 1).alias("title"), F.when(text.contains("\n"), F.substr(text, F.locate("\n", text) + 1)).otherwise("").alias("abstract"))


def tokens(parts: DataFrame, *also: str) -> DataFrame:
    """(doc_id, *also, section, pos, term) of a table with title and abstract; no shuffle, no Python."""
    both = F.array(*(F.struct(F.lit(s).alias("section"), strings.terms(F.col(s)).alias("terms")) for s in SECTIONS))
    return parts.select("doc_id", *also, F.explode(both).alias("s")).select("doc_id", *also, "s.section", F.posexplode("s.terms").alias("pos", "term"))


#: Tokens of a batch that `token_spans` sends back to Spark.
SPANS = 1 << 15


def token_spans(parts: DataFrame, normalizer=None) -> DataFrame:
    """(doc_id, section, pos, char_idx, surface, term): tokens with their offsets in code points. `normalizer` maps a surface form to its
    term (a lemmatiser, say); lower case without one. Arrow batches, no shuffle; a task holds one batch of texts and SPANS tokens."""
    both = F.array(*(F.struct(F.lit(s).alias("section"), F.col(s).alias("body")) for s in SECTIONS))
    rows = parts.select("doc_id", F.explode(both).alias("s")).select("doc_id", "s.section", "s.body")
    most, lower = SPANS, normalizer or str.lower

    def spans(batches):
        import pyarrow as pa
        import regex

        find = regex.compile(strings.TERM).finditer
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.string())
        for batch in batches:
            ids, sections_, bodies = batch.columns
            at, found = [], []

            def made(at, found, ids=ids, sections_=sections_):
                columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
                return pa.RecordBatch.from_arrays([ids.take(pa.array(at)), sections_.take(pa.array(at)), *columns], names=["doc_id", "section", "pos", "char_idx", "surface", "term"])

            for row, body in enumerate(bodies):
                for pos, m in enumerate(find(body.as_py() or "")):
                    at.append(row)
                    found.append((pos, m.start(), m[0], lower(m[0])))
                    if len(at) == most:
                        yield made(at, found)
                        at, found = [], []
            if at:
                yield made(at, found)

    return rows.mapInArrow(spans, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, section string, pos int, char_idx int, surface string, term string")


def term_frequency(tokens_: DataFrame) -> DataFrame:
    return tokens_.groupBy("term").agg(F.count("*").alias("n"))


def stop_words(tokens_: DataFrame, n: int = 20) -> DataFrame:
    """The n most frequent terms, ties in alphabetical order."""
    return term_frequency(tokens_).orderBy(F.desc("n"), "term").limit(n)


def non_stop(tokens_: DataFrame, stops: DataFrame) -> DataFrame:
    """Anti join; the stop list has a fixed number of rows."""
    return tokens_.join(F.broadcast(stops.select("term")), "term", "left_anti")


def doc_lengths(tokens_: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, dl_title, dl_abstract) of every document, empty ones included."""
    count = tokens_.groupBy("doc_id").agg(*(F.count(F.when(F.col("section") == s, 1)).alias(f"dl_{s}") for s in SECTIONS))
    return parts.select("doc_id").join(count, "doc_id", "left").na.fill(0)


def term_lists(parts: DataFrame, stops: DataFrame | None, keep: list[str]) -> DataFrame:
    """(*keep, t): the terms of each section of a table with title and abstract, without stop words (term, a list of bounded length)."""
    lists = parts.select(*keep, F.explode(F.array(*(strings.terms(F.col(s)) for s in SECTIONS))).alias("t"))
    if stops is None:
        return lists
    gone = stops.agg(F.collect_list("term").alias("gone"))
    return lists.join(F.broadcast(gone)).select(*keep, F.filter("t", lambda x: ~F.array_contains(F.col("gone"), x)).alias("t"))


def runs(upto: int, within=None):
    """All runs of 1 to `upto` terms of the array `t`, a row each, made where it lies; of terms of the array `within` only, if that is given and not null."""

    def of(n: int):
        at = F.sequence(F.lit(1), F.size("t") - (n - 1))
        if within is not None:
            at = F.filter(at, lambda i: within.isNull() | F.forall(F.slice("t", i, F.lit(n)), lambda x: F.array_contains(within, x)))
        return F.when(F.size("t") >= n, F.transform(at, lambda i: F.array_join(F.slice("t", i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))

    return F.explode(F.concat(*(of(n) for n in range(1, upto + 1))))


def ngrams(parts: DataFrame, stops: DataFrame | None = None, upto: int = 3) -> DataFrame:
    """(doc_id, gram) for runs of 1 to `upto` terms in a section of a table with title and abstract, after stop words (term, a list of bounded
    length) are taken out."""
    return term_lists(parts, stops, ["doc_id"]).select("doc_id", runs(upto).alias("gram"))


def text_lengths(parts: DataFrame) -> DataFrame:
    return parts.select("doc_id", (F.size(strings.terms(F.col("title"))) + F.size(strings.terms(F.col("abstract")))).cast("long").alias("n_tokens"))


def distinct_documents(parts: DataFrame) -> DataFrame:
    """One document for each title, then one for each abstract, the smallest id each time."""
    by_title = parts.groupBy("title").agg(F.min(F.struct("doc_id", "abstract")).alias("d")).select("d.doc_id", "title", "d.abstract")
    return by_title.groupBy("abstract").agg(F.min(F.struct("doc_id", "title")).alias("d")).select("d.doc_id", "d.title", "abstract")
