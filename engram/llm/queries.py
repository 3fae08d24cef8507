"""The registered queries of this subpackage: op1 to op13 over their whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import alignment, centroids, chat_format, decontamination, jaccard_groups, language_id, license_scans, quality_classifier, quality_rules, secret_scans, sentencepiece_arrays, token_counts, topk_join
from engram.llm.tables import documents


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scans.license_scans(documents(spark, sf_dir))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scans.secret_scans(documents(spark, sf_dir))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_rules.quality_rules(docs, quality_rules.fit_references(docs))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups.jaccard_components(documents(spark, sf_dir), jaccard_groups.Threshold(k=4, of=85))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_arrays.encode_pieces(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"), keep_ids=False)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    tricky = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    return chat_format.chat_digests(chat_format.format_chats(turns.unionByName(tricky)))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = language_id.held_out(F.col("doc_id"))
    model = language_id.fit_language_model(docs.where(~out), key=F.col("doc_id"))
    return language_id.identify_language(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_classifier.quality_scores(docs, quality_classifier.fit_quality_model(docs, key=F.col("doc_id")))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return centroids.assign_centroids(vectors, centroids.fit_centroids(vectors))


def op12_topk_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk_join.topk_join(vectors.where(F.col("vec_id") % 50 == 0), vectors)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_license_scans, op3_secret_scans, op4_decontamination, op5_quality_rules, op6_ngram_jaccard, op7_sentencepiece, op8_chat_format, op9_language_id, op10_quality_classifier, op11_centroids, op12_topk_join, op13_alignment)}

def _centroid_sql(rounds: int = 10) -> str:
    """Rounds of assignment and floored means, one table each, over components in long form."""
    out = [
        """kept AS (SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS v, row_number() OVER () AS r FROM embeddings
            WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NOT NULL AND isfinite(x::DOUBLE)]) = 64)""",
        "parts AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept)",
        """c0 AS MATERIALIZED (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM (
            SELECT v, row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS cluster FROM kept WHERE vec_id IS NOT NULL) WHERE cluster < 8)""",
    ]
    for t in range(rounds + 1):
        out.append(f"d{t} AS MATERIALIZED (SELECT r, cluster, sum((p.x - c.x) * (p.x - c.x))::BIGINT AS distance FROM parts p JOIN c{t} c USING (i) GROUP BY r, cluster)")
        out.append(f"a{t} AS MATERIALIZED (SELECT r, cluster, distance FROM d{t} QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1)")
        if t < rounds:
            out.append(f"""c{t + 1} AS MATERIALIZED (SELECT c.cluster, c.i, coalesce(m.x, c.x) AS x FROM c{t} c LEFT JOIN (
                SELECT cluster, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS x FROM (
                    SELECT cluster, i, sum(x)::BIGINT AS s, count(*) AS n FROM a{t} JOIN parts USING (r) GROUP BY cluster, i)) m USING (cluster, i))""")
    return f"""WITH {", ".join(out)},
        told AS (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
        SELECT vec_id, cluster::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
               sum(distance) OVER ()::BIGINT AS inertia, centroid_sha256
        FROM a{rounds} JOIN kept USING (r) JOIN told USING (cluster)"""


#: DuckDB SQL where it can express a query.
ORACLES: dict[str, str] = {
    "op8_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        e AS (
            SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS escaped,
                   lag(role) OVER w AS before, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n
            FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length('### ' || role || ': ' || escaped) + 9)::BIGINT AS formatted_chars,
               bool_and(CASE WHEN i = 1 THEN role IN ('system', 'user')
                             WHEN role = 'user' THEN before IN ('system', 'assistant')
                             WHEN role = 'assistant' THEN before = 'user' ELSE false END
                        AND (i < n OR role = 'assistant')) AS valid
        FROM e GROUP BY conv_id""",
    "op11_centroids": _centroid_sql(),
    "op12_topk_join": """
        WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::DOUBLE for x in embedding] AS v FROM embeddings
                   WHERE len([x for x in embedding if x IS NOT NULL AND isfinite(x::DOUBLE)]) = len(embedding)),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
        FROM s QUALIFY rank <= 5""",
}
