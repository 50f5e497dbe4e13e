"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers as vocab

from . import alignment, bagminhash, bpe_tree, content_sort, fuzzy_lines, maxscore, min_cut, mixing, multi_index, pii, rolling, token_files, toxicity
from .common import table


def op1_bagminhash(spark, sf_dir):
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.toxicity(docs, table(spark, sf_dir, "labels"))


def op3_pii(spark, sf_dir):
    return pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_token_files(spark, sf_dir):
    return token_files.token_digest(table(spark, sf_dir, "documents"), vocab.path("byte_bpe_50k.json"))


def op5_exact_dedup(spark, sf_dir):
    return content_sort.exact_dedup(table(spark, sf_dir, "documents"))


def op6_bpe_tree(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_tree.bpe_round_trip(docs, vocab.path("byte_bpe_multi_50k.tiktoken"), vocab.PATTERN)


def op9_fuzzy_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fuzzy_lines.dedup_lines(docs, short_lines=True).select("doc_id", "clean_text", "n_lines", "n_kept")


def op10_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, repetition=2.0).select("doc_id", "source", "n_tokens", "epoch", "block", "slot")


def op7_min_cut(spark, sf_dir):
    return min_cut.extract(table(spark, sf_dir, "pages"))


def op8_multi_index(spark, sf_dir):
    return multi_index.search(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


def op11_rolling(spark, sf_dir):
    return rolling.document_features(table(spark, sf_dir, "documents"))


def op12_maxscore(spark, sf_dir):
    return maxscore.search(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op13_alignment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.alignment(docs, vocab.path("byte_bpe_50k.json"), vocab.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_bagminhash, op2_toxicity, op3_pii, op4_token_files, op5_exact_dedup, op6_bpe_tree, op7_min_cut, op8_multi_index, op9_fuzzy_lines, op10_mixing, op11_rolling, op12_maxscore, op13_alignment)}

ORACLES = {
    "op5_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
             g AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
    """,
    # CRC-32 by its table of 256 rows, then windows by range of whole seconds
    "op11_rolling": """
        WITH crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
             h AS (SELECT doc_id, source, lang, length(text) AS n, xor(list_reduce(range(1, length(doc_id::VARCHAR) + 1), lambda c, k: xor(c >> 8, t[1 + (xor(c, ascii(substr(doc_id::VARCHAR, k, 1))) & 255)]), 4294967295::BIGINT), 4294967295) AS h
                   FROM documents, crc),
             e AS (SELECT *, (60 * floor((doc_id + h % 10000) / 6.0))::BIGINT AS event_s FROM h),
             w AS (SELECT doc_id, 600 AS window_s, event_s, count(*) OVER x AS n_events, list(n) OVER x AS l, list(lang) OVER x AS g FROM e
                   WINDOW x AS (PARTITION BY source ORDER BY event_s RANGE BETWEEN 600 PRECEDING AND 1 PRECEDING)
                   UNION ALL SELECT doc_id, 43200, event_s, count(*) OVER x, list(n) OVER x, list(lang) OVER x FROM e
                   WINDOW x AS (PARTITION BY source ORDER BY event_s RANGE BETWEEN 43200 PRECEDING AND 1 PRECEDING)),
             s AS (SELECT * EXCLUDE (l, g), list_sort(list_filter(l, lambda x: x IS NOT NULL)) AS l, len(list_distinct(g)) AS n_langs FROM w)
        SELECT doc_id, window_s::BIGINT AS window_s, event_s, n_events, coalesce(list_sum(l), 0)::BIGINT AS sum_chars, coalesce(n_langs, 0)::BIGINT AS n_langs, l[(len(l) + 1) // 2] AS median_chars, l[(90 * len(l) + 99) // 100] AS high_chars FROM s
    """,
    "op12_maxscore": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM p QUALIFY rank <= 5
    """,
}
