"""The queries of this subpackage, each an operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravela.llm.bpe import bpe_round_trip, digests
from terravela.llm.decontaminate import contaminated
from terravela.llm.exact_dedup import exact_dedup
from terravela.llm.hard_negatives import hard_negatives
from terravela.llm.language_id import fit_language_model, label_languages
from terravela.llm.license_scan import scan_licenses, summarise
from terravela.llm.line_dedup import line_classes
from terravela.llm.ngram_join import jaccard_components
from terravela.llm.pii import find_pii
from terravela.llm.pii import summarise as summarise_pii
from terravela.llm.prefix_trie import conversation_trie
from terravela.llm.token_files import token_round_trip
from terravela.llm.toxicity import fit_lexicon, score_toxicity
from terravela.llm.warc import round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"), keep="max")


def _held_out(parts: int, part: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == part, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(~_held_out(3, 1)).select("doc_id", "toxic")
    lexicon = fit_lexicon(docs, labels)
    return score_toxicity(docs, lexicon).select("doc_id", _held_out(3, 1).alias("held_out"), "score", "predicted", "n_matches")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_classes(_table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise(scan_licenses(_table(spark, sf_dir, "documents")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit_language_model(docs.where(~_held_out(5, 0)))
    return label_languages(docs, model).select("doc_id", _held_out(5, 0).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise_pii(find_pii(_table(spark, sf_dir, "documents")))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return digests(bpe_round_trip(_table(spark, sf_dir, "documents"), path, pattern))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(_table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_warc": op6_warc,
    "op7_language_id": op7_language_id,
    "op8_pii": op8_pii,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_byte_level_bpe": op10_byte_level_bpe,
    "op11_token_files": op11_token_files,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_prefix_trie": op13_prefix_trie,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op2_ngram_jaccard_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
             s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w)),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
             shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
             links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
             reach(doc_id, other) AS (SELECT a, b FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce((SELECT min(other) FROM reach r WHERE r.doc_id = d.doc_id), d.doc_id)) AS component_id
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op6_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS lead FROM pages)
        SELECT page_id, octet_length(b) AS payload_bytes,
            array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(CAST('0x' || h[(i // 4) * 5 + 1:(i // 4) * 5 + 5] AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) % 32 + 1]), '') AS payload_digest,
            CASE WHEN page_id < lead THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < lead THEN lead END AS refers_to
        FROM p""",
    "op3_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
             g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t""",
    "op12_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
                WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON b.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0),
            p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
            n AS (SELECT p.*, s.other AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other) AS INTEGER) AS rank
                FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
    "op13_prefix_trie": """
        WITH c AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
            h AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT))),
                lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 AS h FROM c),
            r AS (SELECT h.conv_id, list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1:]) AS turns FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 5),
            n AS (SELECT d, turns[1:d] AS path, min(conv_id) AS conv_id, count(*) AS n_convs, list(conv_id ORDER BY conv_id) FILTER (WHERE len(turns) = d) AS ends FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM r) GROUP BY 1, 2),
            k AS (SELECT n.*, p.conv_id AS parent_conv_id, (n.n_convs - 1) * CASE WHEN n.d = 0 THEN 0 ELSE octet_length(encode(n.path[n.d].t)) END AS cost FROM n LEFT JOIN n p ON p.d = n.d - 1 AND p.path = n.path[1:n.d - 1]),
            m AS (SELECT k.conv_id, k.d, count(x.d) AS n_children FROM k LEFT JOIN k x ON x.d = k.d + 1 AND x.parent_conv_id = k.conv_id AND x.path[1:k.d] = k.path GROUP BY 1, 2),
            w AS (SELECT path[1:a] AS path, a, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(cost) AS saved FROM (SELECT k.path, k.cost, m.n_children, unnest(range(k.d + 1)) AS a FROM k JOIN m USING (conv_id, d)) GROUP BY 1, 2)
        SELECT k.conv_id, k.d AS depth, k.parent_conv_id, k.n_convs, m.n_children, CAST(w.n_leaves AS BIGINT) AS n_leaves, CAST(w.saved AS BIGINT) AS saved_tokens, sha256(coalesce(array_to_string(k.ends, ','), '')) AS ends_sha256
        FROM k JOIN m ON m.conv_id = k.conv_id AND m.d = k.d JOIN w ON w.a = k.d AND w.path = k.path""",
}
