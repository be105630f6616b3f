"""The opN_ queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, clustering, exact_dedup, html_extraction, mixing, packing, quality_classifier, quality_rules, simhash, toxicity, warc
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_words(mixing.mix(table(spark, sf_dir, "documents")))


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_records(table(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.conversation_digests(turns.unionByName(planted))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.main_text(table(spark, sf_dir, "pages"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op10_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clustered(table(spark, sf_dir, "embeddings"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_pieces(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_mixing": op2_mixing,
    "op3_warc_revisits": op3_warc_revisits,
    "op4_quality_rules": op4_quality_rules,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_html_extraction": op8_html_extraction,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_byte_level_bpe": op10_byte_level_bpe,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_best_fit_packing": op12_best_fit_packing,
}


def _clustering_sql(k: int = 8, rounds: int = 10, seed: int = 3) -> str:
    """Lloyd's rounds written out: centroids c0, c1, ..., and the assignments a0, a1, ... to them."""
    nearest = "SELECT rid, cluster, distance FROM (SELECT l.rid, c.cluster, CAST(sum((l.x - c.x) * (l.x - c.x)) AS BIGINT) AS distance FROM long l JOIN c{0} c USING (dim) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, cluster) = 1"
    moved = "SELECT c.cluster, c.dim, coalesce(m.x, c.x) AS x FROM c{0} c LEFT JOIN (SELECT cluster, dim, CAST((s - (s % n + n) % n) // n AS BIGINT) AS x FROM (SELECT a.cluster, l.dim, sum(l.x) AS s, count(*) AS n FROM a{0} a JOIN long l USING (rid) GROUP BY 1, 2)) m USING (cluster, dim)"
    steps = "".join(f", a{t} AS MATERIALIZED ({nearest.format(t)}), c{t + 1} AS MATERIALIZED ({moved.format(t)})" for t in range(rounds))
    return f"""
        WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        long AS MATERIALIZED (SELECT rid, CAST(i AS INTEGER) AS dim, v[i] AS x FROM kept CROSS JOIN range(1, 65) r(i)),
        f AS (SELECT rid, CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, v) - 1 AS INTEGER) AS cluster FROM kept),
        c0 AS MATERIALIZED (SELECT cluster, dim, x FROM f JOIN long USING (rid) WHERE cluster < {k}){steps},
        a AS MATERIALIZED ({nearest.format(rounds)}),
        h AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY dim)) AS centroid_sha256 FROM c{rounds} GROUP BY 1)
        SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM a JOIN kept USING (rid) JOIN h USING (cluster)"""


ORACLE_SQL: dict[str, str] = {
    "op11_centroid_clustering": _clustering_sql(),
    "op3_warc_revisits": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        s AS (SELECT page_id, h, strlen(h) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first_id FROM p),
        b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', substr(x, CAST(i AS INTEGER), 1))]), '') AS bits FROM s)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
                   16 * CAST(substr(bits, CAST(5 * i + 1 AS INTEGER), 1) AS INTEGER) + 8 * CAST(substr(bits, CAST(5 * i + 2 AS INTEGER), 1) AS INTEGER)
                   + 4 * CAST(substr(bits, CAST(5 * i + 3 AS INTEGER), 1) AS INTEGER) + 2 * CAST(substr(bits, CAST(5 * i + 4 AS INTEGER), 1) AS INTEGER)
                   + CAST(substr(bits, CAST(5 * i + 5 AS INTEGER), 1) AS INTEGER) AS INTEGER), 1)), '') AS payload_digest,
               CASE WHEN page_id IS NOT DISTINCT FROM first_id OR first_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
        FROM b""",
    "op6_chat_formatting": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, v.turn, v.role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
        e AS (SELECT *, length(regexp_replace(role, '(\\|\n|</?turn>|### )', '\\\1', 'g')) + length(regexp_replace(text, '(\\|</?turn>|### )', '\\\1', 'g')) + 15 AS n FROM c)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
               CAST(sum(n) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op9_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t""",
}
