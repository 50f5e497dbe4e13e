"""Queries over the inverted index, with their SQL oracles."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codecs, strings
from ..operators import index as ix
from ..operators import graph, metrics, rank, segments, spell, text
from ..sources import files, quoted
from ..streaming import requests

SEARCHES = [(1, "tion thand eron"), (2, "ou tion tion"), (3, "der ation que")]
MISSPELLED = ["thad", "onenn", "tiom", "erten", "wiht"]
TYPED = [(1, "thad tiom"), (2, "erten wiht onenn")]
NEW_DOCUMENT = (10_000_001, "tion zebra\nzebra stripes tion zebra")
SECOND_WEIGHT = 0.2


def docs(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang")


def index(spark, d) -> ix.Index:
    """Lazy: nothing is read before a query's result is. A service that answers many requests keeps `Index.cached` in an `Engine`."""
    return ix.Index.build(docs(spark, d))


def counted(spark, d) -> ix.Index:
    """The index for ranked search: counted once, in a folder that driver and executors share."""
    return index(spark, d).stored(segments.shared_folder(spark, "counted"))


def searches(spark) -> DataFrame:
    return spark.createDataFrame(SEARCHES, "query_id int, query string")


def joined(array):
    return F.array_join(F.transform(array, lambda x: x.cast("string")), ",")


# tokens
def tokenize(spark, d):
    return index(spark, d).tokens.select("doc_id", "section", F.col("pos").cast("long").alias("pos"), "term")


def token_offsets(spark, d):
    return text.token_spans(text.sections(docs(spark, d))).select("doc_id", "section", F.col("pos").cast("long").alias("pos"), F.col("char_idx").cast("long").alias("char_idx"), "surface")


def term_freq(spark, d):
    return text.term_frequency(index(spark, d).tokens)


def stop_words_top20(spark, d):
    return index(spark, d).stops


def nonstop_tokens(spark, d):
    return index(spark, d).kept.select("doc_id", "section", F.col("pos").cast("long").alias("pos"), "term")


def doc_lengths(spark, d):
    return index(spark, d).doc_lengths


def preprocess_text(spark, d):
    words = strings.preprocess(F.split("text", " "), ["the", "of", "and", "der", "la"], 1)
    return docs(spark, d).select("doc_id", F.array_join(words, " ").alias("clean"))


def text_length(spark, d):
    return text.text_lengths(text.sections(docs(spark, d)))


def dedupe_title_abstract(spark, d):
    return text.distinct_documents(text.sections(docs(spark, d))).select("doc_id")


# postings
def postings(spark, d):
    return index(spark, d).postings.select("term", "doc_id", joined(F.col("title_pos")).alias("title_pos"), joined(F.col("abstract_pos")).alias("abstract_pos"))


def index_file(kind):
    """The whole index written as one file of this layout by many tasks, and read back from its blocks."""

    def run(spark, d):
        path = segments.shared_folder(spark, f"index-{kind}")
        files.write_index(ix.ordered_postings(index(spark, d).by_ranges().kept), path, kind, ranges=True)
        return files.read_index(spark, path).select("term", F.col("doc_id").cast("long").alias("doc_id"), joined(F.col("title_pos")).alias("title_pos"), joined(F.col("abstract_pos")).alias("abstract_pos"))

    return run


def csv_documents(spark, d):
    """All documents written as CSV, line breaks and quotes inside values, and read back in blocks of 1 MB."""
    path = segments.shared_folder(spark, "csv")
    docs(spark, d).write.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return quoted.read_csv(spark, path, ["doc_id", "text"], block=1 << 20).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def posting_lookup(spark, d):
    found = index(spark, d).postings.where(F.col("term") == "tion")
    return found.select("term", "doc_id", joined(F.col("title_pos")).alias("title_pos"), joined(F.col("abstract_pos")).alias("abstract_pos"))


def prefix_lookup(spark, d):
    found = index(spark, d).lookup("tion")
    return found.select("term", "doc_id", F.col("tf_title").cast("long").alias("tf_title"), F.col("tf_abstract").cast("long").alias("tf_abstract"))


def vocabulary(spark, d):
    return index(spark, d).vocab


def add_document(spark, d):
    new = spark.createDataFrame([NEW_DOCUMENT], "doc_id long, text string")
    grown = index(spark, d).add(new)
    return grown.counts.where(F.col("doc_id") >= 10_000_000).select("term", "doc_id", "tf_title", "tf_abstract")


def remove_document(spark, d):
    less = index(spark, d).remove([0, 1, 2])
    return less.counts.groupBy("term").agg(F.count("*").alias("df"))


def posting_gaps(spark, d):
    return index(spark, d).postings.select("term", "doc_id", joined(codecs.gaps(F.col("abstract_pos"))).alias("gaps"))


def gap_decode_cumsum(spark, d):
    found = index(spark, d).postings.select("term", "doc_id", F.posexplode(codecs.gaps(F.col("abstract_pos"))).alias("at", "gap"))
    order = Window.partitionBy("term", "doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return found.select("term", "doc_id", F.col("at").cast("long").alias("at"), F.sum("gap").over(order).cast("long").alias("pos"))


def gamma_bits(spark, d):
    return index(spark, d).postings.select("term", "doc_id", codecs.gamma_bits(F.col("abstract_pos")).alias("bits"))


def vb_bytes(spark, d):
    return index(spark, d).postings.select("term", "doc_id", F.hex(codecs.vb_bytes(F.col("abstract_pos"))).alias("bytes"))


def index_sizes(spark, d):
    return ix.sizes(index(spark, d).postings)


def codec_roundtrip(spark, d):
    return ix.roundtrip(ix.ordered_postings(index(spark, d).by_ranges().kept))


# spelling
def surface_words(spark, d) -> DataFrame:
    return docs(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit(strings.TERM), F.lit(0))).alias("word"))


def misspelled(spark) -> DataFrame:
    return spark.createDataFrame([(w,) for w in MISSPELLED], "query string")


def bigram_index(spark, d):
    return spell.bigram_index(surface_words(spark, d)).select("bigram", "word", "cnt")


def spell_candidates(spark, d):
    return spell.candidates(spell.bigram_index(surface_words(spark, d)), misspelled(spark)).select("query", "word", "occ", F.round("jaccard", 6).alias("jaccard"))


def spell_correct(spark, d):
    return spell.correct(spell.bigram_index(surface_words(spark, d)), misspelled(spark))


# ranking
def _rounded(df: DataFrame) -> DataFrame:
    return df.select("query_id", "doc_id", F.round("score", 6).alias("score"))


def _search(method: str, **options):
    def run(spark, d):
        return _rounded(rank.rank(counted(spark, d), searches(spark), method, SECOND_WEIGHT, **options))

    return run


def bm25_category(spark, d):
    english = docs(spark, d).where("lang = 'en'").select("doc_id")
    return _rounded(rank.rank(counted(spark, d), searches(spark), "okapi25", SECOND_WEIGHT, category=english))


def search_top10(spark, d):
    i = counted(spark, d)
    best = rank.top_k(rank.rank(i, searches(spark), "okapi25", SECOND_WEIGHT), 10)
    return rank.with_text(F.broadcast(best), i).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"), "title", F.length("abstract").cast("long").alias("abstract_chars"))


def search_all(spark, d):
    best = rank.top_k(rank.rank(counted(spark, d), searches(spark), "ltn-lnn", SECOND_WEIGHT), -1)
    return best.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id")


def search_highlight(spark, d):
    i = counted(spark, d)
    best = F.broadcast(graph._cut(rank.top_k(rank.rank(i, searches(spark), "okapi25", SECOND_WEIGHT), 3)))  # three for each of three searches
    return rank.with_highlights(best, i, searches(spark)).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "title", "abstract")


def benchmark_runs(spark, d, method: str = "okapi25") -> tuple[DataFrame, DataFrame]:
    """Each benchmark passage, whole, is a query; the documents that hold the passage are its judgements, in order of id."""
    (runs,), qrels = benchmark_all(spark, d, (method,))
    return runs, qrels


def benchmark_all(spark, d, methods: tuple[str, ...]) -> tuple[list[DataFrame], DataFrame]:
    """`benchmark_runs` of several methods over one index and one set of judgements."""
    items = spark.read.parquet(f"{d}/benchmark.parquet")
    queries = items.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    i = counted(spark, d)
    best = [rank.top_k(rank.rank(i, queries, m, SECOND_WEIGHT, match="exact"), 10).select("query_id", "rank", "doc_id") for m in methods]
    found = graph._cut(containing(docs(spark, d), items.select("item_id", F.col("text").alias("passage"))))
    order = Window.partitionBy("item_id").orderBy("doc_id")
    qrels = found.select(F.col("item_id").alias("query_id"), "doc_id", F.row_number().over(order).alias("rank"))
    return [graph._cut(b) for b in best], qrels


def containing(texts: DataFrame, passages: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, item_id) of documents (doc_id, text) and the passages (item_id, passage) that they contain. A text with a passage has the passage's first run of `words`
    whole words behind its first blank, so both sides meet by the hash of such runs, and `contains` decides. Passages without such a run meet all texts. Passages are
    broadcast if they are few characters; otherwise pairs of ids are found first and texts join them."""
    run = rf"(?<=\s)\S+(?:\s+\S+){{{words - 1}}}(?=\s)"
    first = passages.withColumn("run", F.regexp_extract("passage", run, 0))
    few = (passages.agg(F.sum(F.length("passage"))).first()[0] or 0) <= rank.BROADCAST_CHARS
    keyed = first.where("run <> ''").select("item_id", "passage", F.xxhash64(F.split("run", r"\s+")).alias("run"))
    # the words are bound by an outer lambda, so a text is split once
    hashes = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (words - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, F.lit(words))))
    runs = F.explode(F.array_distinct(F.transform(F.array(F.split("text", r"\s+")), hashes)[0])).alias("run")
    if few:
        near = texts.select("doc_id", "text", runs).join(F.broadcast(keyed), "run")
    else:
        near = texts.select("doc_id", runs).join(keyed, "run").join(texts.select("doc_id", "text"), "doc_id")
    short = first.where("run = ''").select("item_id", "passage")
    rest = texts.join(F.broadcast(short) if few else short, F.contains("text", "passage"))
    return near.where(F.contains("text", "passage")).select("doc_id", "item_id").unionByName(rest.select("doc_id", "item_id"))


METRICS = ("precision", "recall", "f1", "map", "ndcg", "mrr", "ndcg_at_k")


def _by_query(runs: DataFrame, qrels: DataFrame) -> DataFrame:
    return metrics.retrieval_by_query(runs, qrels).select("query_id", *(F.round(m, 6).alias(m) for m in METRICS))


def _summary(runs: DataFrame, qrels: DataFrame) -> DataFrame:
    return metrics.retrieval(runs, qrels).select(*(F.round(m, 6).alias(m) for m in METRICS))


def eval_by_query(spark, d):
    return _by_query(*benchmark_runs(spark, d))


def eval_summary(spark, d):
    return _summary(*benchmark_runs(spark, d))


METHODS = ("okapi25", "ltn-lnn", "ltc-lnc")


def eval_methods(spark, d):
    """The three ranking methods, each against the same judgements."""
    out, (every, qrels) = None, benchmark_all(spark, d, METHODS)
    for method, runs in zip(METHODS, every, strict=True):
        one = _summary(runs, qrels).select(F.lit(method).alias("method"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def served_requests(spark, d):
    """The benchmark's whole passages as a stream of requests for ten documents by BM25, and all answers."""
    # a stream of files takes one file by a pattern only
    source = spark.readStream.schema("item_id long, text string").parquet(f"{d}/benchmark.parque[t]")
    asked = source.select(F.col("item_id").alias("request_id"), F.col("text").alias("query"), F.lit("okapi25").alias("method"), F.lit(10).alias("k"))
    path, state = (segments.shared_folder(spark, n) for n in ("answers", "requests"))
    requests.serve(counted(spark, d), asked, path, state, SECOND_WEIGHT).awaitTermination()
    return requests.responses(spark, path).where("error IS NULL AND doc_id IS NOT NULL").select("request_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"))


def search_corrected(spark, d):
    """The whole request: spelling corrected, ranked, cut, marked."""
    i = counted(spark, d)
    asked = graph._cut(spell.correct_queries(spell.bigram_index(surface_words(spark, d)), spark.createDataFrame(TYPED, "query_id int, query string")))
    best = F.broadcast(graph._cut(rank.top_k(rank.rank(i, asked, "okapi25", SECOND_WEIGHT), 2)))  # two for each of two searches
    return rank.with_highlights(best, i, asked).join(asked, "query_id").select("query_id", "query", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"), F.md5(F.concat_ws("\n", "title", "abstract")).alias("marked"))


# the stored index
def stored(spark, d) -> segments.Segments:
    return segments.Segments.create(spark, segments.shared_folder(spark, "index"), docs(spark, d))


def passages(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _early(method: str, match: str):
    """The ten best by a search that stops early: whole benchmark passages, or the fixed searches by prefix."""

    def run(spark, d):
        asked = passages(spark, d) if match == "exact" else searches(spark)
        best, _ = stored(spark, d).search(asked, 10, method, SECOND_WEIGHT, match)
        return best.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"))

    return run


def index_changes(spark, d):
    """Terms and their document frequencies after documents of one source were taken out, then put in again with one more word under the ids that follow the largest, and
    segments merged."""
    index_ = stored(spark, d)
    table = spark.read.parquet(f"{d}/documents.parquet")
    moved = table.where("source = 'src3'")
    index_.remove(moved.select("doc_id"))
    after = table.agg((F.max("doc_id") + 1).alias("after"))
    index_.add(moved.crossJoin(F.broadcast(after)).select((F.col("doc_id") + F.col("after")).alias("doc_id"), F.concat_ws(" ", "text", F.lit("zebra")).alias("text")))
    index_.merge(everything=True)
    return index_.terms.select("term", "df", "cf_title", "cf_abstract")


def traverse_words(spark, d):
    """The terms that begin with a prefix, in order."""
    return stored(spark, d).traverse("th").select("term", "df")


SCHEMES = [f"{doc}-{query}" for doc in rank.DOC_SCHEMES for query in rank.QUERY_SCHEMES]
QUERIES = {
    f.__name__: f
    for f in (tokenize, token_offsets, term_freq, stop_words_top20, nonstop_tokens, doc_lengths, preprocess_text, text_length, dedupe_title_abstract, postings, posting_lookup, prefix_lookup, vocabulary, add_document, remove_document, posting_gaps, gap_decode_cumsum, gamma_bits, vb_bytes, index_sizes, codec_roundtrip, bigram_index, spell_candidates, spell_correct, bm25_category, search_top10, search_all, search_highlight, eval_by_query, eval_summary, eval_methods, search_corrected, served_requests)
}
QUERIES |= {"tfidf_" + s.replace("-", "_"): _search(s) for s in SCHEMES}
EARLY = {f"early_{m.replace('-', '_')}_{match}": (m, match) for m in ("okapi25", "ltn-lnn", "ltc-lnc") for match in ("exact", "prefix")}
QUERIES |= {name: _early(*how) for name, how in EARLY.items()} | {f.__name__: f for f in (index_changes, traverse_words)}
QUERIES |= {"csv_documents": csv_documents, "index_file_vb": index_file("vb"), "index_file_json": index_file("none")}
QUERIES |= {"bm25": _search("okapi25"), "bm25_exact": _search("okapi25", match="exact")}

# oracles
TOKENS = r"""
sec AS (SELECT doc_id, 'title' AS section, split_part(coalesce(text, ''), chr(10), 1) AS body FROM documents
        UNION ALL SELECT doc_id, 'abstract', CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END FROM documents),
lst AS (SELECT doc_id, section, regexp_extract_all(lower(body), '[\p{L}\p{N}]+') AS l FROM sec),
tok AS (SELECT doc_id, section, unnest(l) AS term, unnest(range(len(l))) AS pos FROM lst),
stops AS (SELECT term, count(*) AS n FROM tok GROUP BY term ORDER BY count(*) DESC, term LIMIT 20),
ns AS (SELECT * FROM tok WHERE term NOT IN (SELECT term FROM stops))
"""
COUNTS = """
cnt AS (SELECT term, doc_id, count(*) FILTER (section = 'title') AS tf_title, count(*) FILTER (section = 'abstract') AS tf_abstract FROM ns GROUP BY ALL),
dl AS (SELECT d.doc_id, count(n.term) FILTER (n.section = 'title') AS dl_title, count(n.term) FILTER (n.section = 'abstract') AS dl_abstract
       FROM documents d LEFT JOIN ns n ON n.doc_id = d.doc_id GROUP BY d.doc_id)
"""
LISTS = """
post AS (SELECT term, doc_id, coalesce(list_sort(list(DISTINCT pos) FILTER (section = 'title')), []) AS tp,
                coalesce(list_sort(list(DISTINCT pos) FILTER (section = 'abstract')), []) AS ap FROM ns GROUP BY ALL)
"""
_VALUES = ", ".join(f"({i}, '{q}')" for i, q in SEARCHES)


def _hits(match: str = "prefix", category: bool = False, source: str = f"(VALUES {_VALUES}) v(query_id, query)") -> str:
    on = "starts_with(c.term, q.qterm)" if match == "prefix" else "c.term = q.qterm"
    where = "WHERE c.doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')" if category else ""
    return f"""
WITH {TOKENS}, {COUNTS},
qt AS (SELECT query_id, term AS qterm, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+')) AS term FROM {source})
       WHERE term NOT IN (SELECT term FROM stops) GROUP BY ALL),
hit AS (SELECT q.query_id, q.qterm, q.qtf, c.doc_id, sum(c.tf_title) AS tf_title, sum(c.tf_abstract) AS tf_abstract
        FROM qt q JOIN (SELECT DISTINCT term FROM ns) v ON v.term = q.qterm JOIN cnt c ON {on} {where} GROUP BY ALL),
df AS (SELECT query_id, qterm, count(*) AS df FROM hit GROUP BY ALL),
full_hit AS (SELECT hit.*, df.df FROM hit JOIN df USING (query_id, qterm))
"""


def _bm25_scores(**options) -> str:
    def part(s: str) -> str:
        return f"sum(CASE WHEN tf_{s} > 0 THEN coalesce(qtf * ln((n - df + 0.5e0) / (df + 0.5e0) + 1) * tf_{s} * 2.2e0 / (tf_{s} + 1.2e0 * (0.25e0 + 0.75e0 * dl_{s} / nullif(avg_{s}, 0))), 0) ELSE 0 END) AS s_{s}"

    return f"""{_hits(**options)},
st AS (SELECT query_id, count(*) AS n, avg(dl_title) AS avg_title, avg(dl_abstract) AS avg_abstract FROM (SELECT DISTINCT query_id, doc_id FROM hit) JOIN dl USING (doc_id) GROUP BY query_id),
sc AS (SELECT query_id, doc_id, 0.8e0 * s_title + 0.2e0 * s_abstract AS score FROM
       (SELECT query_id, doc_id, {part('title')}, {part('abstract')} FROM full_hit JOIN dl USING (doc_id) JOIN st USING (query_id) GROUP BY ALL))
"""


def _tfidf(scheme: str, **options) -> str:
    doc, _, query = scheme.partition("-")
    weight = "1 + ln(qtf)" if query[0] == "l" else "qtf"
    norm = "sqrt(sum(w * w) OVER (PARTITION BY query_id))" if query[2] == "c" else "1e0"

    def part(s: str) -> str:
        tf = f"CASE WHEN tf_{s} > 0 THEN 1 + ln(tf_{s}) ELSE 0 END"
        score = f"sum(qw * ({tf}) * ln((SELECT count(*) FROM documents)::DOUBLE / df))"
        return f"coalesce({score} / nullif(sqrt(sum(({tf}) * ({tf}))), 0), 0)" if doc[2] == "c" else score

    return f"""{_hits(**options)},
qw AS (SELECT query_id, qterm, w / {norm} AS qw FROM (SELECT DISTINCT query_id, qterm, {weight} AS w FROM hit)),
sc AS (SELECT query_id, doc_id, 0.8e0 * {part('title')} + 0.2e0 * {part('abstract')} AS score FROM full_hit JOIN qw USING (query_id, qterm) GROUP BY ALL)
"""


_ROWS = " SELECT query_id, doc_id, round(score, 6) AS score FROM sc"
_RANKED = ", best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc)"
_BIGRAMS = r"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS word FROM documents),
bg AS (SELECT bigram, word, count(*) AS cnt FROM (SELECT word, unnest(list_transform(range(1, length(word) + 2), lambda i: substr('¶' || word || '¶', i, 2))) AS bigram FROM w) GROUP BY ALL)
"""
_CANDIDATES = f"""{_BIGRAMS},
q AS (SELECT query, unnest(list_transform(range(1, length(query) + 2), lambda i: substr('¶' || query || '¶', i, 2))) AS bigram FROM (VALUES {", ".join(f"('{w}')" for w in MISSPELLED)}) v(query)),
cand AS (SELECT query, word, sum(cnt)::BIGINT AS occ, sum(cnt)::DOUBLE / nullif(length(query) + 1 + length(word) + 1 - sum(cnt), 0) AS jaccard FROM q JOIN bg USING (bigram) GROUP BY query, word)
"""


def _eval(scores=_bm25_scores) -> str:
    source = "(SELECT item_id AS query_id, text AS query FROM benchmark) v"
    ideal = " + ".join(f"1 / log2({i + 2})" for i in range(10))
    return f"""{scores(match="exact", source=source)}{_RANKED},
runs AS (SELECT query_id, rank, doc_id FROM best WHERE rank <= 10),
qrels AS (SELECT item_id AS query_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rank FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
na AS (SELECT query_id, count(*) AS n_actual FROM qrels GROUP BY 1), np AS (SELECT query_id, count(*) AS n_predicted FROM runs GROUP BY 1),
j AS (SELECT r.*, n_actual, n_predicted, coalesce(n_actual - q.rank + 1, 0) AS gain, coalesce(q.rank, 0) AS place FROM runs r JOIN na USING (query_id) JOIN np USING (query_id) LEFT JOIN qrels q ON q.query_id = r.query_id AND q.doc_id = r.doc_id),
w AS (SELECT *, sum((gain > 0)::INT) OVER (PARTITION BY query_id ORDER BY rank) AS hits, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, rank) AS ideal FROM j),
e AS (SELECT query_id, sum((gain > 0)::INT) AS h, any_value(n_actual) AS a, any_value(n_predicted) AS p, sum(CASE WHEN gain > 0 THEN hits::DOUBLE / rank ELSE 0 END) AS ap,
      sum(gain / log2(rank + 1)) AS dcg, sum(gain / log2(ideal + 1)) AS best, min(CASE WHEN gain > 0 THEN rank END) AS f, sum(CASE WHEN gain > 0 AND place <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dk FROM w GROUP BY query_id),
m AS (SELECT query_id, h::DOUBLE / p AS precision, h::DOUBLE / a AS recall, coalesce(2 * (h::DOUBLE / p) * (h::DOUBLE / a) / nullif(h::DOUBLE / p + h::DOUBLE / a, 0), 0) AS f1, coalesce(ap / nullif(h, 0), 0) AS map,
      coalesce(dcg / nullif(best, 0), 0) AS ndcg, coalesce(1e0 / f, 0) AS mrr, dk / ({ideal}) AS ndcg_at_k FROM e)
"""

def _marked(queries: str, k: int) -> str:
    """The text of the k best documents of `best`, with each token that begins with a term of its query marked."""
    before, after = '<mark style="background-color: #FFFF00">', "</mark>"
    return f"""
wt AS (SELECT query_id, list(term) AS terms FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+')) AS term FROM {queries}) WHERE term NOT IN (SELECT term FROM stops) GROUP BY 1),
pc AS (SELECT query_id, rank, doc_id, score, section, terms, body, regexp_extract_all(body, '[\\p{{L}}\\p{{N}}]+') AS l, regexp_split_to_array(body, '[\\p{{L}}\\p{{N}}]+') AS g
       FROM best JOIN wt USING (query_id) JOIN sec USING (doc_id) WHERE rank <= {k}),
mk AS (SELECT query_id, rank, doc_id, score, section, array_to_string(list_transform(range(1, len(l) + 1), lambda i: g[i] || CASE WHEN len(list_filter(terms, lambda t: starts_with(lower(l[i]), t))) > 0
       THEN '{before}' || l[i] || '{after}' ELSE l[i] END), '') || CASE WHEN len(l) = 0 THEN body ELSE g[len(l) + 1] END AS body FROM pc),
hl AS (SELECT query_id, rank, doc_id, score, max(CASE WHEN section = 'title' THEN body END) AS title, max(CASE WHEN section = 'abstract' THEN body END) AS abstract FROM mk GROUP BY ALL)"""


def _corrected() -> str:
    words = ", ".join(f"({i}, {n}, '{w}')" for i, q in TYPED for n, w in enumerate(q.split()))
    values = ", ".join(f"('{w}')" for w in dict.fromkeys(w for _, q in TYPED for w in q.split()))
    grams = _CANDIDATES.replace(", ".join(f"('{w}')" for w in MISSPELLED), values).strip().removeprefix("WITH ")
    source = "cq"
    return f"""WITH {grams}, top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(jaccard, 9) DESC NULLS LAST, word) AS r FROM cand),
bw AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY levenshtein(query, word), r) AS b FROM top WHERE r <= 20),
cq AS (SELECT query_id, string_agg(coalesce(word, w), ' ' ORDER BY n) AS query FROM (VALUES {words}) v(query_id, n, w) LEFT JOIN (SELECT query AS w, word FROM bw WHERE b = 1) USING (w) GROUP BY query_id),
{_bm25_scores(source=source).strip().removeprefix("WITH ")}{_RANKED}, {_marked(source, 2)}
SELECT query_id, query, rank, doc_id, round(score, 6) AS score, md5(title || chr(10) || abstract) AS marked FROM hl JOIN cq USING (query_id)"""


ORACLES = {
    "tokenize": f"WITH {TOKENS} SELECT doc_id, section, pos, term FROM tok",
    "token_offsets": f"""WITH {TOKENS},
        s AS (SELECT doc_id, section, regexp_extract_all(body, '[\\p{{L}}\\p{{N}}]+') AS l, regexp_split_to_array(body, '[\\p{{L}}\\p{{N}}]+') AS g FROM sec),
        u AS (SELECT doc_id, section, unnest(l) AS surface, unnest(range(len(l))) AS pos, unnest(g[1:len(l)]) AS gap FROM s)
        SELECT doc_id, section, pos, (sum(length(gap)) OVER o + sum(length(surface)) OVER o - length(surface))::BIGINT AS char_idx, surface FROM u
        WINDOW o AS (PARTITION BY doc_id, section ORDER BY pos ROWS UNBOUNDED PRECEDING)""",
    "term_freq": f"WITH {TOKENS} SELECT term, count(*) AS n FROM tok GROUP BY term",
    "stop_words_top20": f"WITH {TOKENS} SELECT term, n FROM stops",
    "nonstop_tokens": f"WITH {TOKENS} SELECT doc_id, section, pos, term FROM ns",
    "doc_lengths": f"WITH {TOKENS}, {COUNTS} SELECT * FROM dl",
    "preprocess_text": """SELECT doc_id, array_to_string(list_transform(list_filter(string_split(text, ' '), lambda w: lower(w) NOT IN ('the', 'of', 'and', 'der', 'la')
        AND NOT contains('!"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', w) AND length(w) > 1), lambda w: lower(w)), ' ') AS clean FROM documents""".replace("\\\\", "\\"),
    "text_length": f"WITH {TOKENS} SELECT doc_id, sum(len(l))::BIGINT AS n_tokens FROM lst GROUP BY doc_id",
    "dedupe_title_abstract": f"""WITH {TOKENS}, p AS (SELECT a.doc_id, a.body AS t, b.body AS a FROM sec a JOIN sec b ON a.doc_id = b.doc_id AND a.section = 'title' AND b.section = 'abstract'),
        x AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1) SELECT min(doc_id) AS doc_id FROM x GROUP BY a""",
    "postings": f"WITH {TOKENS}, {LISTS} SELECT term, doc_id, array_to_string(tp, ',') AS title_pos, array_to_string(ap, ',') AS abstract_pos FROM post",
    "posting_lookup": f"WITH {TOKENS}, {LISTS} SELECT term, doc_id, array_to_string(tp, ',') AS title_pos, array_to_string(ap, ',') AS abstract_pos FROM post WHERE term = 'tion'",
    "prefix_lookup": f"""WITH {TOKENS} SELECT 'tion' AS term, doc_id, count(*) FILTER (section = 'title') AS tf_title, count(*) FILTER (section = 'abstract') AS tf_abstract
        FROM (SELECT DISTINCT doc_id, section, pos FROM ns WHERE starts_with(term, 'tion')) WHERE 'tion' IN (SELECT term FROM ns) GROUP BY doc_id""",
    "vocabulary": f"WITH {TOKENS} SELECT DISTINCT term FROM ns",
    "add_document": f"""WITH {TOKENS}, n AS (SELECT 'title' AS section, unnest(['tion', 'zebra']) AS term UNION ALL SELECT 'abstract', unnest(['zebra', 'stripes', 'tion', 'zebra']))
        SELECT term, {NEW_DOCUMENT[0]}::BIGINT AS doc_id, count(*) FILTER (section = 'title') AS tf_title, count(*) FILTER (section = 'abstract') AS tf_abstract FROM n WHERE term NOT IN (SELECT term FROM stops) GROUP BY term""",
    "remove_document": f"WITH {TOKENS} SELECT term, count(DISTINCT doc_id) AS df FROM ns WHERE doc_id NOT IN (0, 1, 2) GROUP BY term",
    "posting_gaps": f"WITH {TOKENS}, {LISTS} SELECT term, doc_id, array_to_string(list_transform(ap, lambda p, i: p - CASE WHEN i > 1 THEN ap[i - 1] ELSE 0 END), ',') AS gaps FROM post",
    "gap_decode_cumsum": f"WITH {TOKENS}, {LISTS} SELECT term, doc_id, unnest(range(len(ap))) AS at, unnest(ap) AS pos FROM post",
    "gamma_bits": f"""WITH {TOKENS}, {LISTS}, g AS (SELECT term, doc_id, list_transform(ap, lambda p, i: p + 1 - CASE WHEN i > 1 THEN ap[i - 1] + 1 ELSE 0 END) AS gaps FROM post)
        SELECT term, doc_id, array_to_string(list_transform(gaps, lambda x: repeat('1', length(bin(x)) - 1) || '0' || substr(bin(x), 2)), '') AS bits FROM g""",
    "vb_bytes": f"""WITH {TOKENS}, {LISTS} SELECT term, doc_id, array_to_string(list_transform(ap, lambda p:
        CASE WHEN p >= 2097152 THEN lpad(hex((p >> 21) & 127), 2, '0') ELSE '' END || CASE WHEN p >= 16384 THEN lpad(hex((p >> 14) & 127), 2, '0') ELSE '' END ||
        CASE WHEN p >= 128 THEN lpad(hex((p >> 7) & 127), 2, '0') ELSE '' END || hex((p & 127) + 128)), '') AS bytes FROM post""",
    "index_sizes": f"""WITH {TOKENS}, {LISTS}, e AS (SELECT tp AS l FROM post UNION ALL SELECT ap FROM post),
        m AS (SELECT ceil(coalesce(list_sum(list_transform(l, lambda p, i: 2 * (length(bin(p + 1 - CASE WHEN i > 1 THEN l[i - 1] + 1 ELSE 0 END)) - 1) + 1)), 0) / 8e0)::BIGINT AS gamma,
              (length(array_to_string(l, ',')) + 2)::BIGINT AS none, coalesce(list_sum(list_transform(l, lambda p: CASE WHEN p >= 2097152 THEN 4 WHEN p >= 16384 THEN 3 WHEN p >= 128 THEN 2 ELSE 1 END)), 0)::BIGINT AS vb FROM e)
        SELECT 'gamma' AS compression, sum(gamma)::BIGINT AS bytes FROM m UNION ALL SELECT 'none', sum(none)::BIGINT FROM m UNION ALL SELECT 'vb', sum(vb)::BIGINT FROM m""",
    "codec_roundtrip": f"WITH {TOKENS}, {LISTS} SELECT unnest(['gamma', 'vb', 'none']) AS compression, count(*) AS n, count(*) AS same FROM post",
    "bigram_index": f"{_BIGRAMS} SELECT bigram, word, cnt FROM bg",
    "spell_candidates": f"{_CANDIDATES} SELECT query, word, occ, round(jaccard, 6) AS jaccard FROM cand",
    "spell_correct": f"""{_CANDIDATES}, top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(jaccard, 9) DESC NULLS LAST, word) AS r FROM cand),
        best AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY levenshtein(query, word), r) AS b FROM top WHERE r <= 20)
        SELECT query, word AS corrected, levenshtein(query, word)::BIGINT AS distance FROM best WHERE b = 1""",
    "bm25": _bm25_scores() + _ROWS,
    "bm25_exact": _bm25_scores(match="exact") + _ROWS,
    "bm25_category": _bm25_scores(category=True) + _ROWS,
    "search_top10": f"""{_bm25_scores()}{_RANKED} SELECT query_id, rank, best.doc_id, round(score, 6) AS score, t.body AS title, length(a.body)::BIGINT AS abstract_chars
        FROM best JOIN sec t ON t.doc_id = best.doc_id AND t.section = 'title' JOIN sec a ON a.doc_id = best.doc_id AND a.section = 'abstract' WHERE rank <= 10""",
    "search_all": f"{_tfidf('ltn-lnn')}{_RANKED} SELECT query_id, rank, doc_id FROM best",
    "search_highlight": f"""{_bm25_scores()}{_RANKED}, {_marked(f"(VALUES {_VALUES}) v(query_id, query)", 3)}
        SELECT query_id, rank, doc_id, title, abstract FROM hl""",
    "search_corrected": _corrected(),
    "served_requests": f"{_bm25_scores(source='(SELECT item_id AS query_id, text AS query FROM benchmark) v')}{_RANKED} SELECT query_id AS request_id, rank, doc_id, round(score, 6) AS score FROM best WHERE rank <= 10",
    "eval_methods": " UNION ALL ".join(f"SELECT * FROM ({_eval(f)} SELECT '{m}' AS method, {', '.join(f'round(avg({x}), 6) AS {x}' for x in METRICS)} FROM m)" for m, f in zip(METHODS, (_bm25_scores, *(partial(_tfidf, m) for m in METHODS[1:])), strict=True)),
    "eval_by_query": f"{_eval()} SELECT query_id, {', '.join(f'round({m}, 6) AS {m}' for m in METRICS)} FROM m",
    "eval_summary": f"{_eval()} SELECT {', '.join(f'round(avg({m}), 6) AS {m}' for m in METRICS)} FROM m",
}
ORACLES |= {"tfidf_" + s.replace("-", "_"): _tfidf(s) + _ROWS for s in SCHEMES}
_PASSAGES = "(SELECT item_id AS query_id, text AS query FROM benchmark) v"
ORACLES |= {
    name: f"{(_bm25_scores if m == 'okapi25' else partial(_tfidf, m))(**({'match': 'exact', 'source': _PASSAGES} if match == 'exact' else {}))}{_RANKED} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM best WHERE rank <= 10"
    for name, (m, match) in EARLY.items()
}
_FROM = TOKENS.replace("FROM documents", "FROM moved").replace("stops AS (SELECT term, count(*) AS n FROM tok", "stops AS (SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')) AS term FROM documents)")
ORACLES |= {
    "index_changes": f"""WITH moved AS (SELECT doc_id, text FROM documents WHERE source IS DISTINCT FROM 'src3'
            UNION ALL SELECT doc_id + (SELECT max(doc_id) + 1 FROM documents), concat_ws(' ', text, 'zebra') FROM documents WHERE source = 'src3'), {_FROM}
        SELECT term, count(DISTINCT doc_id) AS df, count(*) FILTER (section = 'title') AS cf_title, count(*) FILTER (section = 'abstract') AS cf_abstract FROM ns GROUP BY term""",
    "traverse_words": f"WITH {TOKENS} SELECT term, count(DISTINCT doc_id) AS df FROM ns WHERE starts_with(term, 'th') GROUP BY term",
}
ORACLES |= {f"index_file_{k}": ORACLES["postings"] for k in ("vb", "json")}
ORACLES |= {"csv_documents": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
