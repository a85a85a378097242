"""The queries of the corpus operators: thin callers of the operators, in the shape their contracts ask for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexispark.llm.common import load


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.rollups import maintained

    return maintained(load(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.bpe import encode_decode

    return encode_decode(load(spark, sf_dir, "documents"), with_ids=False)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.sharding import balanced_shards

    return balanced_shards(load(spark, sf_dir, "documents"), shards=40)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.toxicity import score, train

    docs = load(spark, sf_dir, "documents")
    return score(docs, train(docs, load(spark, sf_dir, "labels")))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.topk import exact_topk

    return exact_topk(load(spark, sf_dir, "embeddings"), k=10, every=100)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.mixing import mix_sources

    return mix_sources(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.exact_dedup import exact_dedup

    return exact_dedup(load(spark, sf_dir, "documents"), keep="max")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.licenses import license_scan

    return license_scan(load(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.minhash import near_dedup

    return near_dedup(load(spark, sf_dir, "documents"))


def op10_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.lm import lm_scores

    return lm_scores(load(spark, sf_dir, "documents"))


def op11_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.centroids import clustered

    return clustered(load(spark, sf_dir, "embeddings"))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.infill import digests, fill_in_middle

    return digests(fill_in_middle(load(spark, sf_dir, "documents")))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.secrets import digests, secret_scan

    return digests(secret_scan(load(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_toxicity, op3_token_counts, op4_bpe, op5_topk, op6_mixing, op7_exact_dedup, op8_licenses, op9_minhash, op10_brown_lm, op11_balls, op12_infill, op13_secrets)}


ORACLE = {
    "op3_token_counts": """
        WITH t AS (
            SELECT source, lang,
                   CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS blank,
                   CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS BIGINT) AS runs
            FROM documents)
        SELECT source, lang, 'blank-1' AS tokenizer, count(*) AS n_docs, CAST(sum(blank + 1) AS BIGINT) AS n_tokens FROM t GROUP BY ALL
        UNION ALL
        SELECT source, lang, 'runs-1', count(*), CAST(sum(runs) AS BIGINT) FROM t GROUP BY ALL
    """,
    "op5_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
    """,
    "op9_minhash": """
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS t FROM documents),
             u AS (SELECT doc_id, unnest(t) AS x, generate_subscripts(t, 1) AS i FROM w WHERE len(t) >= 5),
             g AS (SELECT doc_id, concat_ws(' ', x, lead(x, 1) OVER v, lead(x, 2) OVER v, lead(x, 3) OVER v, lead(x, 4) OVER v) AS x, lead(x, 4) OVER v AS last FROM u WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
             f AS (SELECT DISTINCT doc_id, x FROM g WHERE last IS NOT NULL UNION ALL SELECT doc_id, array_to_string(t, ' ') FROM w WHERE len(t) BETWEEN 1 AND 4),
             n AS (SELECT doc_id, count(*) AS n FROM f GROUP BY doc_id),
             c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM f a JOIN f b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
             l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
             r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
             m AS (SELECT a AS doc_id, min(b) AS low FROM r GROUP BY a)
        SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, least(doc_id, coalesce(low, doc_id)) = doc_id AS kept
        FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
    """,
    "op7_exact_dedup": """
        WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               coalesce(doc_id = max(doc_id) OVER w, false) AS kept, h AS text_sha256
        FROM t WINDOW w AS (PARTITION BY h)
    """,
}

ORACLE["op12_infill"] = """
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
         u AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS t, [CAST('0x' || substr(h, 8 * i - 7, 8) AS BIGINT) for i in [1, 2, 3, 4]] AS d FROM t),
         f AS (SELECT doc_id, text, t, CAST(len(t) AS BIGINT) AS n, least(d[1] % (len(t) + 1), d[2] % (len(t) + 1)) AS lo, greatest(d[1] % (len(t) + 1), d[2] % (len(t) + 1)) AS hi,
                      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] IS NULL OR d[3] % 100 >= 90 THEN 'plain' WHEN d[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
         p AS (SELECT doc_id, text, n, form, array_to_string(t[1:lo], '') AS a, array_to_string(t[lo + 1:hi], '') AS m, array_to_string(t[hi + 1:], '') AS z FROM f)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || a || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
    FROM p
"""


def _lloyd(rounds: int) -> str:
    """Centroid clustering as a chain of common tables: cN the centroids, aN the assignment of round N."""
    nearest = "SELECT id, vec_id, e, c, d FROM (SELECT v.*, c, list_sum(list_transform(list_zip(e, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, {0}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, c) = 1"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"a{i} AS ({nearest.format(f'c{i}')})")
        steps.append(
            f"c{i + 1} AS (SELECT c{i}.c, coalesce(n.m, c{i}.m) AS m FROM c{i} LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS m FROM "
            f"(SELECT c, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(e) AS x, generate_subscripts(e, 1) AS j FROM a{i}) GROUP BY c, j) GROUP BY c) n ON n.c = c{i}.c)"
        )
    return f"""
    WITH v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
         c0 AS (SELECT CAST(row_number() OVER o - 1 AS INTEGER) AS c, e AS m FROM v WINDOW o AS (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) NULLS LAST, e) QUALIFY row_number() OVER o <= 16),
         {', '.join(x.replace(' AS (', ' AS MATERIALIZED (', 1) for x in steps[:-1])}
    SELECT vec_id, a{rounds}.c AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a{rounds}.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
           sha256(array_to_string(m, ',')) AS centroid_sha256
    FROM a{rounds} JOIN c{rounds} ON c{rounds}.c = a{rounds}.c
    """


ORACLE["op11_balls"] = _lloyd(3)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
