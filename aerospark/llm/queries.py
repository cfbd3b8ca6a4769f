"""One query for each operator over its whole table, with the columns its contract names."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerospark.llm import (
    decontam, divergence, langid, line_dedup, maxent, minhash, near_vectors, packing, quality, spelling, token_files, toxicity,
    warc,
)
from aerospark.llm.base import held_out, small_batches
from aerospark.scale import work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels")
    margins = quality.fit(docs, labels, "quality", ~held_out("doc_id", 3, 1))
    return quality.score(docs, margins, "score").select(
        "doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@_query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs, counts=True).select(
        "doc_id", "n_lines", "n_dropped", F.md5("text").alias("text_md5")
    )


ORACLES["op8_line_dedup"] = """
WITH lines AS (
    SELECT doc_id, coalesce(source, '') AS host, generate_subscripts(parts, 1) AS place, unnest(parts) AS line
    FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)
), keyed AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS key FROM lines),
totals AS (SELECT coalesce(source, '') AS host, count(*) AS total FROM documents GROUP BY 1),
boilerplate AS (
    SELECT host, key FROM (SELECT DISTINCT doc_id, host, key FROM keyed WHERE key <> '')
    JOIN totals USING (host) GROUP BY host, key, total HAVING count(*) >= 5 AND count(*) / total > 0.02
), marked AS (
    SELECT k.*, b.key IS NOT NULL AS gone FROM keyed k LEFT JOIN boilerplate b ON k.host = b.host AND k.key = b.key
), folded AS (
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           md5(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS text_md5
    FROM marked GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS INT) AS n_lines, CAST(coalesce(n_dropped, 0) AS INT) AS n_dropped,
       text_md5
FROM documents LEFT JOIN folded USING (doc_id)
"""


@_query
def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, length=3, threshold=0.85)


@_query
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontam.mark_contamination(docs, _table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id", F.col("hits.n_words").alias("n_words"), decontam.hit_words().alias("n_hit"),
        F.size("hits.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        decontam.contaminated().alias("contaminated"),
    )


@_query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("length"),
        F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
    )


@_query
def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


@_query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, ~held_out("doc_id", 5, 0))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"),
        F.coalesce("language.lang", F.lit("und")).alias("lang_pred"), F.col("language.cosine").alias("score"),
        F.col("language.rejected").alias("rejected"),
    )


@_query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), "toxic", ~held_out("doc_id", 3, 1))
    return toxicity.score(docs, model, "score").select(
        "doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


@_query
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return maxent.score_texts(docs, ~held_out("doc_id", 5, 1)).select(
        "doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@_query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = work_path(spark, "archives")
    warc.write_archives(_table(spark, sf_dir, "pages"), archives)
    records = warc.read_archives(spark, archives)
    page = lambda name: F.regexp_extract(name, "<urn:page:(-?[0-9]+)>", 1).try_cast("bigint")
    response = F.col("record_type") == "response"
    return records.select(
        page("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("bigint")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.regexp_extract("declared_digest", "sha256:(.*)", 1))
        .alias("payload_digest"),
        "record_type", page("refers_to").alias("refers_to"),
    )


ORACLES["op3_warc"] = """
WITH rows AS (
    SELECT page_id, coalesce(html, '') AS body FROM pages
), sized AS (
    SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM rows
), firsts AS (
    SELECT payload_digest, min(page_id) AS first_id FROM sized WHERE payload_bytes >= 100 GROUP BY payload_digest
), marked AS (
    SELECT s.*, first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id AS again, first_id
    FROM sized s LEFT JOIN firsts f USING (payload_digest)
    WHERE payload_bytes >= 100
    UNION ALL SELECT *, false, NULL FROM sized WHERE payload_bytes < 100
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first_id END AS refers_to
FROM marked
"""


@_query
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = work_path(spark, "tokens")
    docs = _table(spark, sf_dir, "documents")
    token_files.write_tokens(docs, files, public_tokenizers.path("word_bpe_49k.json"), 2)
    return token_files.read_tokens(spark, files).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


@_query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


ORACLES["op13_source_divergence"] = r"""
WITH docs AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
    FROM documents
), occurring AS (
    SELECT doc, lang, source, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
    SELECT lang, term FROM occurring GROUP BY lang, term HAVING count(DISTINCT doc) >= 3
), counts AS (
    SELECT lang, source, term, count(*) AS n FROM occurring JOIN kept USING (lang, term) GROUP BY lang, source, term
), groups AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (
    SELECT g.lang, g.source, coalesce(total, 0) AS total, coalesce(v, 0) AS v FROM groups g
    LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source) USING (lang, source)
    LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY lang) USING (lang)
), shares AS (
    SELECT lang, source, term, coalesce(n, 0) AS n,
           1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (total + v)::HUGEINT AS p
    FROM sizes JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every_pair AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
), language AS (
    SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (any_value(whole) + any_value(v))::HUGEINT AS q
    FROM counts JOIN (SELECT lang, sum(total) AS whole, max(v) AS v FROM sizes GROUP BY lang) USING (lang)
    GROUP BY lang, term
), terms AS (
    SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value
    FROM shares JOIN language USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
    SELECT lang, source, 'pair' AS part, item, value,
           row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS place FROM every_pair
    UNION ALL
    SELECT lang, source, 'term', item, value,
           row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms
    QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= 200
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(place AS INT) AS rank FROM ranked
"""


@_query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(_table(spark, sf_dir, "documents"))
