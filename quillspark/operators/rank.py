"""Ranked search: SMART tf-idf variants and BM25 over two sections, for a batch of queries in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strings
from ..functions.vectors import log_tf
from .index import Index
from .text import SECTIONS

DOC_SCHEMES, QUERY_SCHEMES = ("ltn", "ltc"), ("nnn", "nnc", "lnn", "lnc")


def query_terms(queries: DataFrame, index: Index) -> DataFrame:
    """(query_id, qterm, qtf) of (query_id, query): the query's terms without stop words."""
    words = queries.select("query_id", F.explode(strings.terms(F.col("query"))).alias("term"))
    return index.without_stops(words).groupBy("query_id", F.col("term").alias("qterm")).agg(F.count("*").alias("qtf"))


#: Terms that queries match by prefix up to which they are broadcast to the counts' tasks.
BROADCAST_TERMS = 100_000
#: Characters of a batch of queries up to which its terms are broadcast to the vocabulary's tasks.
BROADCAST_CHARS = 4 << 20


def is_small(queries: DataFrame) -> bool:
    """Whether a batch of queries is small enough for its terms to be broadcast. The batch is read, not the corpus."""
    return (queries.agg(F.sum(F.length("query"))).first()[0] or 0) <= BROADCAST_CHARS


def matches(q: DataFrame, index: Index, match: str = "prefix", category: DataFrame | None = None, small: bool = True) -> DataFrame:
    """(query_id, qterm, qtf, doc_id, tf_title, tf_abstract, df). With match='prefix' a query term that is a term also matches all terms that
    begin with it. `category` (query_id, doc_id) or (doc_id) restricts documents before df is counted. `small`: the batch's terms may be broadcast."""
    if match not in ("prefix", "exact"):
        raise ValueError(f"match must be 'prefix' or 'exact', not {match!r}")
    hint = F.broadcast if small else lambda df: df
    asked = hint(q.select("qterm").distinct())
    if match == "prefix":
        # one pass over the vocabulary: each term has few prefixes, and they meet the query terms by equality
        starts = index.vocab.select("term", F.explode(F.transform(F.sequence(F.lit(1), F.length("term")), lambda n: F.left("term", n))).alias("qterm"))
        known = starts.join(asked, "qterm").withColumn("known", F.max(F.col("term") == F.col("qterm")).over(Window.partitionBy("qterm"))).where("known").drop("known")
    else:
        known = index.vocab.select("term", F.col("term").alias("qterm")).join(asked, "qterm", "left_semi")
    if match == "exact":  # one term each, so counts are the hits
        hits = index.counts.join(hint(known), "term").select("qterm", "doc_id", "tf_title", "tf_abstract")
    else:
        # a short prefix matches much of the vocabulary; what it matches is counted where that is cheap
        few = index.terms is not None and known.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
        if small and not few:  # terms meet the batch's terms where they lie, by those of their prefixes that are as long as one of them
            sizes = [r[0] for r in q.select(F.length("qterm")).distinct().collect()]  # as many as lengths of words
            starts = F.array(F.lit(None).cast("string"), *(F.when(F.length("term") >= n, F.left("term", F.lit(n))) for n in sizes))
            met = index.counts.withColumn("qterm", F.explode(starts)).where("qterm IS NOT NULL").join(F.broadcast(known.select("qterm").distinct()), "qterm")
        else:
            met = index.counts.join(F.broadcast(known) if few else known, "term")
        hits = met.groupBy("qterm", "doc_id").agg(F.sum("tf_title").alias("tf_title"), F.sum("tf_abstract").alias("tf_abstract"))
    if category is None:
        df = index.terms.select(F.col("term").alias("qterm"), "df").join(asked, "qterm", "left_semi") if match == "exact" and index.terms is not None else hits.groupBy("qterm").agg(F.count("*").alias("df"))
        return hits.join(hint(q.join(df, "qterm")), "qterm")
    hits = hits.join(hint(q), "qterm").join(category, [c for c in ("query_id", "doc_id") if c in category.columns], "left_semi")
    df = hits.groupBy("query_id", "qterm").agg(F.count("*").alias("df"))
    return hits.join(hint(df), ["query_id", "qterm"])


def bm25(hits: DataFrame, doc_lengths: DataFrame, k1: float = 1.2, b: float = 0.75, small: bool = True) -> DataFrame:
    """(query_id, doc_id, s_title, s_abstract). The number of documents and their mean lengths are those of the query's candidates."""
    cand = hits.select("query_id", "doc_id").distinct().join(doc_lengths, "doc_id")
    stats = cand.groupBy("query_id").agg(F.count("*").alias("n"), *(F.avg(f"dl_{s}").alias(f"avg_{s}") for s in SECTIONS))
    rows = hits.join(doc_lengths, "doc_id").join(F.broadcast(stats) if small else stats, "query_id")
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)

    def part(s: str):
        tf = F.col(f"tf_{s}")
        norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.try_divide(F.col(f"dl_{s}"), F.col(f"avg_{s}")))
        return F.sum(F.coalesce(F.when(tf > 0, F.col("qtf") * idf * tf * (k1 + 1) / (tf + norm)), F.lit(0.0))).alias(f"s_{s}")

    return rows.groupBy("query_id", "doc_id").agg(*(part(s) for s in SECTIONS))


def tf_idf(hits: DataFrame, corpus_size: DataFrame, scheme: str = "ltn-lnn", small: bool = True) -> DataFrame:
    """(query_id, doc_id, s_title, s_abstract) for a document scheme and a query scheme joined by '-'. corpus_size: one row with column n. The
    cosine norm of a document is over the query's terms' log frequencies in the section, before idf."""
    doc, _, query = scheme.partition("-")
    if doc not in DOC_SCHEMES or query not in QUERY_SCHEMES:
        raise ValueError(f"no such scheme: {scheme!r}")
    weight = log_tf(F.col("qtf")) if query[0] == "l" else F.col("qtf").cast("double")
    own = hits.select("query_id", "qterm", "qtf").distinct().withColumn("qw", weight)
    if query[2] == "c":
        norm = own.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
        own = own.join(norm, "query_id").withColumn("qw", F.try_divide("qw", "qn"))
    own = own.select("query_id", "qterm", "qw")
    rows = hits.join(F.broadcast(own) if small else own, ["query_id", "qterm"]).join(F.broadcast(corpus_size.select("n")))
    idf = F.ln(F.col("n") / F.col("df"))
    aggs = []
    for s in SECTIONS:
        tf = log_tf(F.col(f"tf_{s}"))
        aggs += [F.sum(F.col("qw") * tf * idf).alias(f"s_{s}"), F.sqrt(F.sum(tf * tf)).alias(f"norm_{s}")]
    out = rows.groupBy("query_id", "doc_id").agg(*aggs)
    if doc[2] == "c":
        out = out.withColumns({f"s_{s}": F.coalesce(F.try_divide(F.col(f"s_{s}"), F.col(f"norm_{s}")), F.lit(0.0)) for s in SECTIONS})
    return out.select("query_id", "doc_id", "s_title", "s_abstract")


def blend(scores: DataFrame, abstract_weight: float = 0.5) -> DataFrame:
    return scores.select("query_id", "doc_id", (F.col("s_title") * (1 - abstract_weight) + F.col("s_abstract") * abstract_weight).alias("score"))


def rank(index: Index, queries: DataFrame, method: str = "ltn-lnn", abstract_weight: float = 0.5, match: str = "prefix", category: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score) of every document that matches a query of (query_id, query). method: 'okapi25' or a tf-idf scheme."""
    small = is_small(queries)
    hits = matches(query_terms(queries, index), index, match, category, small)
    if method == "okapi25":
        scores = bm25(hits, index.doc_lengths, small=small)
    else:
        scores = tf_idf(hits, index.parts.agg(F.count("*").alias("n")), method, small)
    return blend(scores, abstract_weight)


def top_k(scores: DataFrame, k: int = 10) -> DataFrame:
    """Each query's k best documents with their rank; all of them for k = -1. Ties go to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    ranked = scores.withColumn("rank", F.row_number().over(order))
    return ranked if k < 0 else ranked.where(F.col("rank") <= k)


def with_text(hits: DataFrame, index: Index) -> DataFrame:
    """Titles and abstracts of ranked documents, fetched after the cut."""
    return index.parts.join(hits, "doc_id")


def with_highlights(hits: DataFrame, index: Index, queries: DataFrame) -> DataFrame:
    """`with_text` with the query's terms marked in both sections."""
    from .text import token_spans

    rows = with_text(hits, index)
    q = query_terms(queries, index).groupBy("query_id").agg(F.collect_list("qterm").alias("qterms"))
    spans = token_spans(rows.select("doc_id", "title", "abstract").distinct())
    marked = spans.join(rows.select("query_id", "doc_id").join(q, "query_id"), "doc_id").where(F.exists("qterms", lambda t: F.startswith(F.col("term"), t)))
    by = marked.groupBy("query_id", "doc_id").agg(*(F.collect_list(F.when(F.col("section") == s, F.struct(F.col("char_idx").alias("s"), (F.col("char_idx") + F.length("surface")).alias("e")))).alias(f"m_{s}") for s in SECTIONS))
    rows = rows.join(by, ["query_id", "doc_id"], "left")
    empty = F.array().cast("array<int>")
    return rows.withColumns({s: strings.highlight(F.col(s), F.coalesce(F.col(f"m_{s}.s"), empty), F.coalesce(F.col(f"m_{s}.e"), empty)) for s in SECTIONS}).drop("m_title", "m_abstract")


def personalised(scores: DataFrame, importance: DataFrame, weight: float = 0.5) -> DataFrame:
    """Blends scores and importance (doc_id, importance), each divided by its maximum; documents without importance are left out."""
    top = scores.groupBy("query_id").agg(F.max("score").alias("top_s"))
    top_p = importance.agg(F.max("importance").alias("top_p"))
    rows = scores.join(importance, "doc_id").join(top, "query_id").join(F.broadcast(top_p))
    text_part, rank_part = (F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)) for a, b in (("score", "top_s"), ("importance", "top_p")))
    return rows.select("query_id", "doc_id", (text_part * (1 - weight) + rank_part * weight).alias("score"), F.col("score").alias("search_score"), "importance")


def with_clusters(hits: DataFrame, assignment: DataFrame, topics: DataFrame) -> DataFrame:
    """Adds each document's cluster and its topic."""
    return hits.join(assignment, "doc_id").join(topics, "cluster")
