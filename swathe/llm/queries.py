"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swathe.llm import (
    balltree, bpe, chat, codes, decontaminate, licenses, maxent, neardup, quality, toxicity, urls, whitening, windows)
from swathe.llm.common import table

TOKENIZER = "word_bpe_49k.json"
# The conversation that the contract adds: its texts hold control strings.
PROBE = [(-1, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.filter_urls(table(spark, folder, "pages"))


def op2_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op3_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return maxent.score_documents(table(spark, folder, "documents"))


def op4_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents")).drop("spans")


def op5_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"))


def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encoding_digests(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents"))


def op9_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    events = rows.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text",
                         F.monotonically_increasing_id().alias("message_id"))
    return chat.conversation_digests(chat.read_back(chat.render(chat.fold_events(events))))


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return windows.repeat_digests(table(spark, folder, "documents"))


def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


def op12_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return balltree.top_k(table(spark, folder, "embeddings"), every=100, k=10)


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return codes.compress(table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_url_filter, op2_benchmark_decontamination, op3_lm_scoring, op4_license_scans,
    op5_minhash_near_dedup, op6_bpe, op7_toxicity, op8_quality_rules, op9_chat_formatting,
    op10_substring_dedup, op11_embedding_whitening, op12_exact_top_k, op13_vector_codes)}

# Embeddings that take part, scaled to integers.
WHOLE = """
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: coalesce(abs(x) <= 4096, false))) = len(embedding)"""


def _codes_sql(rounds: int = codes.ROUNDS) -> str:
    """The rounds of the codebooks, one after another."""
    nearest = """
        a{i} AS MATERIALIZED (
            SELECT r, part, p, min(struct_pack(d, entry)) AS best FROM (
                SELECT r, part, p, entry, CAST(list_sum(list_transform(list_zip(p, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))
                    AS BIGINT) AS d FROM parts JOIN b{i} USING (part)) GROUP BY r, part, p),"""
    refined = """
        b{j} AS MATERIALIZED (
            SELECT part, entry, coalesce(m.e, b{i}.e) AS e FROM b{i} LEFT JOIN (
                SELECT part, entry, list(floor_mean ORDER BY k) AS e FROM (
                    SELECT part, best.entry AS entry, k,
                        CAST(sum(p[k]) - ((sum(p[k]) % count(*)) + count(*)) % count(*) AS BIGINT) // count(*) AS floor_mean
                    FROM a{i}, unnest(range(1, len(p) + 1)) AS t(k) GROUP BY part, best.entry, k)
                GROUP BY part, entry) m USING (part, entry)),"""
    steps = "".join(nearest.format(i=i) + refined.format(i=i, j=i + 1) for i in range(rounds)) + nearest.format(i=rounds)
    return f"""
        WITH whole AS (
            SELECT row_number() OVER (ORDER BY vec_id, v) AS r, vec_id, label, v FROM ({WHOLE.format(scale=codes.SCALE)})),
        parts AS MATERIALIZED (
            SELECT r, CAST(part AS INTEGER) AS part, v[part * (len(v) // 8) + 1:(part + 1) * (len(v) // 8)] AS p
            FROM whole, unnest(range(0, 8)) AS t(part)),
        b0 AS MATERIALIZED (SELECT part, CAST(r - 1 AS INTEGER) AS entry, p AS e FROM parts WHERE r <= 16),{steps}
        coded AS (
            SELECT r, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code,
                CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
        books AS (
            SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM whole JOIN coded USING (r), books"""


ORACLES: dict[str, str] = {
    "op9_chat_formatting": """
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        sized AS (
            SELECT *, length(role) + length(text)
                + 4 * length(regexp_replace(role || text, '[^&\\[\\]]', '', 'g'))
                + 3 * length(regexp_replace(role || text, '[^<]', '', 'g'))
                + length('<s>[') + length('] ') + length('</s>') AS chars FROM rows)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
                AS loss_sha256,
            CAST(sum(chars) AS BIGINT) AS formatted_chars
        FROM sized GROUP BY conv_id""",
    "op10_substring_dedup": """
        WITH docs AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'),
                                       lambda w: w <> '') AS words FROM documents),
        starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM docs),
        grams AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS gram FROM starts),
        late AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY gram) AS first_id FROM grams)
            WHERE doc_id > first_id),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM late),
        placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM docs),
        kept AS (
            SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.i) AS text, count(*) AS n
            FROM placed p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id)
        SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words,
            CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
        FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id""",
    "op12_exact_top_k": f"""
        WITH whole AS (SELECT vec_id, CAST(v AS DOUBLE[]) AS v FROM ({WHOLE.format(scale=balltree.SCALE)})),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
            FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
            vec_id, score FROM scored
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""",
    "op13_vector_codes": _codes_sql(),
}
