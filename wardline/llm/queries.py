"""The queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import chat, codes, exact, iblt, licenses, mixing, negatives, outliers, packing, ppm, simhash, substring, toxicity
from .common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.matches(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprints(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.clusters(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.scores(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repaired(table(spark, sf_dir, "conversations"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judged(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_mixing": op2_mixing,
        "op3_fingerprints": op3_fingerprints,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_simhash": op5_simhash,
        "op6_toxicity": op6_toxicity,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_packing": op8_packing,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_chat_format": op10_chat_format,
        "op11_vector_codes": op11_vector_codes,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_quality_outliers": op13_quality_outliers,
        "pipeline": corpus_pipeline.run,
    }


OP4_SQL = r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k FROM documents),
r AS (SELECT doc_id, sha256(k) AS text_sha256, count(*) OVER (PARTITION BY k) AS group_size,
  first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS nth FROM n WINDOW w AS (PARTITION BY k ORDER BY length(t) DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, text_sha256 FROM r"""

OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
k AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 18), lambda i: md5(array_to_string(ws[i:i + 19], ' ')))) AS k, unnest(range(1, len(ws) - 18)) AS i FROM d),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM k) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM dup, range(20) r(j)),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
cut AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(cut.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN cut USING (doc_id)"""


def _op11_sql(rounds: int = 4) -> str:
    """Each round: distances of all parts to all entries, then floors of the means; products of whole doubles are exact."""
    fine = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    assign = "SELECT p.vec_id, p.label, p.part, p.v, arg_min(c.entry, (list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, c.v) + list_inner_product(c.v, c.v)) * 256 + c.entry) AS entry FROM parts p JOIN {c} c USING (part) GROUP BY ALL"
    means = "SELECT part, entry, list(m ORDER BY pos) AS v FROM (SELECT part, entry, pos, floor(sum(x) / count(*)) AS m FROM (SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS pos FROM {a}) GROUP BY ALL) GROUP BY ALL"
    steps = [
        f"kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND {fine})",
        "parts AS MATERIALIZED (SELECT vec_id, label, part, v[part * len(v) // 4 + 1:(part + 1) * len(v) // 4] AS v FROM kept, range(4) r(part))",
        "c0 AS MATERIALIZED (SELECT part, nth - 1 AS entry, v FROM (SELECT part, v, row_number() OVER (PARTITION BY part ORDER BY vec_id) AS nth FROM parts) WHERE nth <= 256)",
    ]
    for i in range(rounds):
        steps += [f"a{i} AS MATERIALIZED ({assign.format(c=f'c{i}')})", f"m{i} AS ({means.format(a=f'a{i}')})"]
        steps += [f"c{i + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (part, entry))"]
    steps += [
        f"last AS ({assign.format(c=f'c{rounds}')})",
        f"far AS (SELECT l.*, list_inner_product(l.v, l.v) - 2 * list_inner_product(l.v, c.v) + list_inner_product(c.v, c.v) AS d FROM last l JOIN c{rounds} c USING (part, entry))",
        "rows AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM far GROUP BY ALL)",
        f"book AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS pos FROM c{rounds}))",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM rows, book"


OP12_SQL = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT * FROM v WHERE vec_id % 100 = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS alike, list_inner_product(a.v, v.v)::BIGINT AS score FROM a JOIN v ON a.vec_id <> v.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT s.alike AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""


def oracle_sql() -> dict:
    """SQL of the queries that it can express; the others are held against brute force in the tests."""
    return {"op4_exact_dedup": OP4_SQL, "op7_substring_dedup": OP7_SQL, "op11_vector_codes": _op11_sql(), "op12_hard_negatives": OP12_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
