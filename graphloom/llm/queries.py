"""The registered queries of the training-data operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import conversation_trie, exact_dedup, html_extract, license_scan, lm_scoring, minhash_dedup, mixing, quality, sentencepiece_codec, source_audit, suffix_dedup, topk_search, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), length=400).withColumnRenamed("id", "doc_id")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_dedup.find_near(_table(spark, sf_dir, "documents"), words=3, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept", "class_id")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(_table(spark, sf_dir, "documents"), dropout=0.1, seed=5).withColumnRenamed("id", "doc_id")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    model = lm_scoring.train(docs.filter(~held_out))
    return lm_scoring.score(docs, model, held_out=held_out).withColumnRenamed("id", "doc_id")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.withColumnRenamed("id", "doc_id")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0)
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "copies")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.find_copies(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=10)


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(_table(spark, sf_dir, "documents"), least=10, top=10)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(_table(spark, sf_dir, "conversations"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(_table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    every = [op1_suffix_array_dedup, op2_minhash_near_dedup, op3_sentencepiece, op4_url_filter, op5_lm_scoring, op6_quality_classifier, op7_source_mixing, op8_exact_dedup, op9_html_extraction, op10_topk_search, op11_source_audit, op12_conversation_trie, op13_license_scan]
    return {f.__name__: f for f in every} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {
        "op8_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
                   sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
        "op10_topk_search": """
            WITH vectors AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
            pairs AS (
                SELECT q.vec_id AS query_id, n.vec_id AS neighbor_id,
                       list_sum(list_transform(range(1, 1 + (SELECT max(len(embedding)) FROM vectors)), lambda i: (coalesce(q.embedding[i] > 0, false) <> coalesce(n.embedding[i] > 0, false))::INT))::INT AS distance
                FROM vectors q JOIN vectors n ON q.vec_id % 50 = 0 AND q.vec_id <> n.vec_id)
            SELECT query_id, rank::INT AS rank, neighbor_id, distance
            FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM pairs) WHERE rank <= 10""",
        "op11_source_audit": r"""
            WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id,
                              regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
            t AS (SELECT lang, source, id, unnest(w) AS term FROM d),
            k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
            v AS (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY lang),
            g AS (SELECT DISTINCT lang, source FROM d),
            c AS (SELECT g.lang, g.source, k.term, coalesce(x.n, 0)::HUGEINT AS n FROM g JOIN k USING (lang) LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL) x USING (lang, source, term)),
            p AS (SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM c JOIN v USING (lang)),
            q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) JOIN v USING (lang)),
            found AS (
                SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL
                UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b USING (lang) WHERE a.source <> b.source AND a.lang NOT IN (SELECT lang FROM v)
                UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
            SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found) WHERE part = 'pair' OR rank <= 10""",
        "op12_conversation_trie": """
            WITH own AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
            crc AS (SELECT c, c - c % 100 AS opener,
                           xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                                           lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 6 AS h FROM (SELECT DISTINCT c FROM own)),
            turns AS (SELECT crc.c, i, role, text, 0 AS later FROM crc JOIN own ON own.c = crc.opener AND i <= h UNION ALL SELECT own.c, i, role, text, 1 FROM own JOIN crc USING (c) WHERE i > h),
            placed AS (SELECT c, text, role, row_number() OVER (PARTITION BY c ORDER BY later, i) AS depth FROM turns),
            keyed AS (SELECT c, depth, length(text) AS n, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY c ORDER BY depth) AS key, depth = max(depth) OVER (PARTITION BY c) AS last FROM placed
                      UNION ALL SELECT c, 0, 0, '', c NOT IN (SELECT c FROM placed) FROM crc),
            hashed AS (SELECT c, depth, n, md5(key) AS key, last FROM keyed),
            nodes AS (SELECT key, depth, min(c) AS conv_id, count(*) AS n_convs, any_value(n) AS n, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE last), '')) AS ends FROM hashed GROUP BY key, depth),
            parents AS (SELECT DISTINCT a.key, a.depth, b.key AS p, b.depth AS p_depth FROM hashed a JOIN hashed b ON a.c = b.c AND b.depth = a.depth - 1),
            above AS (SELECT DISTINCT a.key AS k, a.depth AS k_depth, b.key, b.depth FROM hashed a JOIN hashed b ON a.c = b.c AND a.depth <= b.depth),
            totals AS (SELECT k, k_depth, count(*) FILTER (WHERE nodes.key || nodes.depth NOT IN (SELECT p || p_depth FROM parents)) AS n_leaves, sum((n_convs - 1) * n)::BIGINT AS saved FROM above JOIN nodes USING (key, depth) GROUP BY k, k_depth)
            SELECT nodes.conv_id, nodes.depth, up.conv_id AS parent_conv_id, nodes.n_convs, (SELECT count(*) FROM parents x WHERE x.p = nodes.key AND x.p_depth = nodes.depth) AS n_children, n_leaves, saved AS saved_tokens, nodes.ends AS ends_sha256
            FROM nodes JOIN totals ON k = nodes.key AND k_depth = nodes.depth LEFT JOIN parents ON parents.key = nodes.key AND parents.depth = nodes.depth LEFT JOIN nodes up ON up.key = parents.p AND up.depth = parents.p_depth""",
    }
