"""One call for a whole search request, as a service would make it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import strings
from .operators import graph, rank, spell, vector
from .operators.index import Index


class NotReady(RuntimeError):
    """A request that needs a table which the engine was not given."""


@dataclass
class Engine:
    """An index with what the kinds of search need: categories (doc_id, category), clusters (doc_id, cluster) with topics (cluster, topic), a link graph of
    nodes (id) and edges (src, dst), seeds (professor, id), vectors (vec_id, embedding), and a bigram index of surface words."""

    index: Index
    bigrams: DataFrame | None = None
    categories: DataFrame | None = None
    clusters: DataFrame | None = None
    topics: DataFrame | None = None
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    seeds: DataFrame | None = None
    vectors: DataFrame | None = None

    def _need(self, *names: str) -> None:
        missing = [n for n in names if getattr(self, n) is None]
        if missing:
            raise NotReady(f"not loaded: {', '.join(missing)}")

    def correct(self, query: str, similar_words_limit: int = 20) -> str:
        self._need("bigrams")
        return spell.correct_text(self.bigrams, self.index.parts.sparkSession, query, similar_words_limit)

    def search(self, query: str, k: int = 10, method: str = "ltn-lnn", abstract_weight: float = 0.5, category: str = "all", match: str = "prefix", highlight: bool = False, clustered: bool = False, preferences: dict[str, float] | None = None, personalization_weight: float = 0.5, correct: bool = False) -> DataFrame:
        """(query_id, rank, doc_id, score, title, abstract, ...) of the k best documents, all of them for k = -1. A category restricts the candidates before their
        statistics are taken. With preferences the score blends in a PageRank that is personalised to them."""
        if correct:
            query = self.correct(query)
        asked = self.index.parts.sparkSession.createDataFrame([(0, query)], "query_id int, query string")
        within = None
        if category != "all":
            self._need("categories")
            within = self.categories.where(F.col("category") == category).select("doc_id")
        scores = rank.rank(self.index, asked, method, abstract_weight, match, within)
        if preferences is not None:
            self._need("nodes", "edges", "seeds")
            prefs = graph.preferences_of(self.seeds, preferences) if preferences else None
            importance = graph.pagerank(self.nodes, self.edges, prefs).select(F.col("id").alias("doc_id"), F.col("score").alias("importance"))
            scores = rank.personalised(scores, importance, personalization_weight)
        best = rank.top_k(scores, k)
        if clustered:
            self._need("clusters", "topics")
            best = rank.with_clusters(best, self.clusters, self.topics)
        return rank.with_highlights(best, self.index, asked) if highlight else rank.with_text(best, self.index)

    def similar(self, doc_id: int, n: int = 10) -> DataFrame:
        """The n documents whose vectors are nearest, with their text."""
        self._need("vectors")
        near = vector.similar(self.vectors, doc_id, n).withColumnRenamed("vec_id", "doc_id")
        return self.index.parts.join(F.broadcast(near), "doc_id")

    @staticmethod
    def bigrams_of(docs: DataFrame, text_col: str = "text") -> DataFrame:
        return spell.bigram_index(docs.select(F.explode(F.regexp_extract_all(text_col, F.lit(strings.TERM), F.lit(0))).alias("word")))
