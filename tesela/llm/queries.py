"""The queries opN_<name>: each applies its operator to the whole of its table with the parameters for production."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import secret_spans

    return secret_spans(table(spark, sf_dir, "documents"))


def op2_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archived

    return archived(table(spark, sf_dir, "pages"))


def op3_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .gam import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lambda key: fold(key, 3) == 1)


def op4_log_frequency_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bloom_lm import corpus_scores

    return corpus_scores(table(spark, sf_dir, "documents"))


def op5_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .multiset_hash import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_content import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op7_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spaced_seed import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .byte_cnn import predict, train

    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 3) == 1
    network = train(docs, held_out)
    return predict(docs.withColumn("held_out", held_out), network, keep=["doc_id", "held_out"])


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_groups

    found = jaccard_groups(table(spark, sf_dir, "documents"), k=3, num=90, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import bpe_digests

    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


#: Rows of an Arrow batch, where the session leaves Spark's default: whole texts are long, and workers have little memory.
ARROW_ROWS = "2000"


def prepared(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if spark.conf.get(name, "10000") in (None, "10000"):
            spark.conf.set(name, ARROW_ROWS)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: prepared(f) for name, f in globals().items() if name.startswith("op")}


_PAGES = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
     q AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS first_id FROM p)
SELECT page_id, payload_bytes, sha256(t) AS payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM q
"""

#: Texts of equal sets are one class (its smallest doc_id), so that pairs are between classes; links are then followed from every class.
_GROUPS = """
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
    SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s FROM w),
c AS (SELECT doc_id, s, len(s) AS n, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS cid FROM s),
k AS (SELECT doc_id AS cid, n, unnest(s) AS g FROM c WHERE doc_id = cid),
pairs AS (
    SELECT x.cid AS a, y.cid AS b, x.n AS n, y.n AS m, count(*) AS common FROM k x JOIN k y ON x.g = y.g AND x.cid <> y.cid
    AND 10 * least(x.n, y.n) >= 9 * greatest(x.n, y.n) GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * common >= 90 * (n + m - common)),
reached AS (SELECT DISTINCT cid AS a, cid AS b FROM c UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id FROM c JOIN least ON a = cid
"""


def oracle_sql() -> dict[str, str]:
    """SQL has no answer for the others: their models, fingerprints and likelihood ratios are held against plain versions in tests."""
    return {"op2_warc_segments": _PAGES, "op9_ngram_jaccard_join": _GROUPS}
