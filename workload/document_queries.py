"""Queries over descriptions, URLs, names, frame documents and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerospark.functions import text
from aerospark.operators import documents, search, vector_index
from aerospark.scale import work_path
from workload import views
from workload.registry import query
from workload.views import with_views

DIMS = 16

WORDS = r"""
    words AS (
        SELECT *, list_filter(regexp_split_to_array(replace(text, ',', ' '), '\s+'), lambda x: x <> '')[1:8] AS tags
        FROM documents)"""
CAPTIONED = WORDS + r""",
    captioned AS (
        SELECT *, substr('[echo] ' || list_filter(list_transform(
                   string_split('Caption this aerial drone frame: ' || text, chr(10)),
                   lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')[1], 1, 280) AS caption
        FROM words)"""


def _fraction(i: int, source: str = "words") -> str:
    digest = f"sha256({source} || ':{i // 8}')"
    at = i % 8 * 8
    pairs = " || ".join(f"substr({digest}, {at + k}, 2)" for k in (7, 5, 3, 1))
    return f"CAST('0x' || {pairs} AS BIGINT) / 4294967295.0"


def described_frames(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").selectExpr(
        "source AS session", "lang AS user", "doc_id AS frame_id", "text AS description",
        "concat('/frames/', doc_id, '.jpg') AS path",
    )


@query(
    "p22_annotation_words",
    f"""WITH {WORDS} SELECT doc_id, array_to_string(tags, '|') AS tags,
               array_to_string(tags[1:5], '|') AS labels FROM words""",
)
def annotation_words(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").withColumn("tags", text.tags(F.col("text")))
    return docs.select(
        "doc_id", F.array_join("tags", "|").alias("tags"),
        F.array_join(text.labels(F.col("tags")), "|").alias("labels"),
    )


@query(
    "p23_text_embedding",
    "SELECT doc_id, " + ", ".join(f"{_fraction(i, 'text')} AS e{i}" for i in range(DIMS)) + " FROM documents",
)
def text_embedding(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select(
        "doc_id", text.embedding(F.col("text"), DIMS).alias("v")
    )
    return docs.select("doc_id", *[F.col("v")[i].alias(f"e{i}") for i in range(DIMS)])


@query(
    "p24_vector_fit",
    """SELECT vec_id, 80 AS padded, 10 AS cut, embedding[10]::DOUBLE AS last_kept, 0.0::DOUBLE AS last_padded,
              round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings""",
)
def vector_fit(spark, sf_dir):
    fitted = views.table(spark, sf_dir, "embeddings").select(
        "vec_id", text.fit_vector(F.col("embedding"), 80).alias("long"),
        text.fit_vector(F.col("embedding"), 10).alias("short"),
    )
    total = F.aggregate("long", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return fitted.select(
        "vec_id", F.size("long").alias("padded"), F.size("short").alias("cut"),
        F.col("short")[9].cast("double").alias("last_kept"),
        F.col("long")[79].cast("double").alias("last_padded"), F.round(total, 6).alias("total"),
    )


@query(
    "p21_build_documents",
    """SELECT source || '-' || lpad(CAST(doc_id AS VARCHAR), greatest(4, length(CAST(doc_id AS VARCHAR)))::INT, '0') AS id,
              source AS account_id, doc_id AS frame_number, substr(text, 1, 280) AS caption, text AS description,
              '0,0,1280,720' AS boundingbox, 0 AS n_labels, '' AS geotags, '' AS "user" FROM documents""",
)
def build_documents(spark, sf_dir):
    frames = views.table(spark, sf_dir, "documents").selectExpr(
        "source AS account_id", "doc_id AS frame_number", "cast(array() AS array<float>) AS vector",
        "text AS description", "concat('/', doc_id) AS path",
    )
    made = documents.build_documents(frames)
    return made.select(
        "id", "account_id", "frame_number", "caption", "description", "boundingbox",
        F.size("labels").alias("n_labels"), "geotags", "user",
    )


@query(
    "m9_index_frames",
    f"""WITH {CAPTIONED},
        prompts AS (SELECT *, caption || ' ' || text AS words FROM captioned)
        SELECT source || '-' || doc_id AS id, caption, array_to_string(tags, '|') AS tags,
               array_to_string(tags[1:5], '|') AS labels, lang AS "user", source AS session,
               'sessions/' || source || '/frames/' || doc_id || '.jpg' AS path,
               {_fraction(0)} AS first_value, {_fraction(DIMS - 1)} AS last_value FROM prompts""",
)
def index_frames(spark, sf_dir):
    made = documents.index_frames(described_frames(spark, sf_dir), DIMS)
    return made.select(
        "id", "caption", F.array_join("tags", "|").alias("tags"), F.array_join("labels", "|").alias("labels"),
        "user", "session", "path", F.col("vector")[0].alias("first_value"),
        F.col("vector")[DIMS - 1].alias("last_value"),
    )


@query(
    "m9_index_counts",
    """SELECT source AS session, count(*) AS frames, count_if(lang <> 'de')::BIGINT AS indexed
       FROM documents GROUP BY 1""",
)
def index_counts(spark, sf_dir):
    frames = described_frames(spark, sf_dir).withColumn(
        "description", F.when(F.col("user") != "de", F.col("description"))
    )
    return documents.index_counts(frames)


@query(
    "m10_session_documents",
    "SELECT source || '-' || doc_id AS id, lang AS \"user\", 'src3' AS session FROM documents WHERE source = 'src3'",
)
def session_documents(spark, sf_dir):
    path = work_path(spark, "frame-documents")
    made = documents.index_frames(described_frames(spark, sf_dir), 8)
    documents.store_documents(made.drop("vector"), path)
    return documents.session_documents(spark, path, "src3").select("id", "user", "session")


@query(
    "a17_facet_counts",
    f"""WITH {WORDS}
        SELECT facet, value, count(*) AS documents FROM (
            SELECT 'user' AS facet, lang AS value FROM words
            UNION ALL SELECT 'session', source FROM words
            UNION ALL SELECT 'tags', unnest(tags) FROM words
            UNION ALL SELECT 'labels', unnest(tags[1:5]) FROM words) GROUP BY ALL""",
)
def facet_counts(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").withColumn("tags", text.tags(F.col("text")))
    faceted = docs.select(
        F.col("lang").alias("user"), F.col("source").alias("session"), "tags",
        text.labels(F.col("tags")).alias("labels"),
    )
    return documents.facet_counts(faceted)


@query(
    "j12_nearest_frames",
    with_views("docs", """
        WITH asked AS (
            SELECT account_id, min(frame_number) AS query_id, arg_min(vector, frame_number) AS probe
            FROM docs GROUP BY account_id),
        scored AS (
            SELECT query_id, id, list_cosine_similarity(vector::DOUBLE[], probe::DOUBLE[]) AS score
            FROM docs JOIN asked USING (account_id)),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored)
        SELECT query_id, id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM ranked WHERE rank <= 3"""),
)
def nearest_frames(spark, sf_dir):
    docs = views.embeddings(spark, sf_dir)
    asked = docs.groupBy("account_id").agg(
        F.min("frame_number").alias("query_id"), F.min_by("vector", "frame_number").alias("vector")
    )
    return search.search_frames(docs, asked).withColumn("score", F.round("score", 6))


def fiftieth_frames(docs):
    return docs.filter(F.col("frame_number") % 50 == 0).selectExpr("frame_number AS query_id", "account_id", "vector")


@query("j12_indexed_frames")
def indexed_frames(spark, sf_dir):
    """The frames nearest to every fiftieth one, from the nearest cells of an index over all."""
    docs = views.embeddings(spark, sf_dir)
    index = vector_index.build_index(docs, work_path(spark, "index"))
    return vector_index.search_index(index, fiftieth_frames(docs)).withColumn("score", F.round("score", 6))


@query(
    "j12_index_recall",
    with_views("docs", """
        WITH sizes AS (SELECT account_id, count(*) AS n FROM docs GROUP BY 1)
        SELECT CAST(count(*) AS BIGINT) AS queries, CAST(sum(least(n, 3)) AS BIGINT) AS results, true AS recalled_enough
        FROM docs JOIN sizes USING (account_id) WHERE frame_number % 50 = 0"""),
)
def index_recall(spark, sf_dir):
    """The answers of the index beside those of the exact search: at least nine in ten are the same."""
    docs = views.embeddings(spark, sf_dir)
    exact = search.search_frames(docs, fiftieth_frames(docs)).select("query_id", "id", F.lit(1).alias("exact"))
    found = indexed_frames(spark, sf_dir).select("query_id", "id", F.lit(1).alias("found"))
    both = F.sum(F.col("exact") * F.col("found"))
    return exact.join(found, ["query_id", "id"], "full").agg(
        F.count_distinct("query_id").alias("queries"), F.count("found").alias("results"),
        F.coalesce(both >= 0.9 * F.sum("exact"), F.lit(True)).alias("recalled_enough"),
    )


@query(
    "p25_description_json",
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang FROM documents""",
)
def description_json(spark, sf_dir):
    raw = "CASE WHEN doc_id % 2 = 0 THEN concat('{\"lang\":\"', lang, '\"}') ELSE text END"
    docs = views.table(spark, sf_dir, "documents").withColumn("parsed", F.try_parse_json(F.expr(raw)))
    return docs.select("doc_id", F.try_variant_get("parsed", "$.lang", "string").alias("lang"))


@query(
    "p26_box_in_text",
    with_views("detections", """
        SELECT video_id, frame_index, det_seq, CASE WHEN video_id % 3 < 2 THEN x END::BIGINT AS x,
               CASE WHEN video_id % 3 < 2 THEN y END::BIGINT AS y, CASE WHEN video_id % 3 < 2 THEN w END::BIGINT AS w,
               CASE WHEN video_id % 3 < 2 THEN h END::BIGINT AS h FROM detections"""),
)
def box_in_text(spark, sf_dir):
    written = (
        "CASE video_id % 3 WHEN 0 THEN concat('seen (x: 1, y: 2, width: 3, height: 4) {x: ', x, ', y:', y, ', w: ', w, ',h: ', h, '}') "
        "WHEN 1 THEN concat('at (x:', x, ', y: ', y, ', width: ', w, ', height: ', h, ')') ELSE 'nothing {x: a}' END"
    )
    found = views.detections(spark, sf_dir).withColumn("b", text.box_in_text(F.expr(written)))
    return found.select("video_id", "frame_index", "det_seq", "b.x", "b.y", "b.w", "b.h")


URLS = r"""
    urls AS (
        SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS scheme,
               regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
               regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
               regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages)"""


@query(
    "p27_frame_urls",
    f"""WITH {URLS}
        SELECT page_id, scheme || '://' || host || '/' || split_part(path, '/', 2) || '/'
                   || coalesce(nullif(regexp_extract(path, '^/[^/]*/(.*)/[^/]*$', 1), ''), 'output') || '/images/frame'
                   || page_id || '.jpg' || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS plain,
               scheme || '://' || host || '/input/videos/' || page_id % 5 || '/images/7/frameclip' || page_id
                   || '0.jpg?sig=a' AS named,
               host || '/frame' || page_id || '.jpg' AS from_template FROM urls""",
)
def frame_urls(spark, sf_dir):
    pages = views.table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    scheme = F.regexp_extract("url", "^([a-z]+)://", 1)
    page = F.col("page_id").cast("string")
    deep = F.concat(
        scheme, F.lit("://"), host, F.lit("/input/videos/"), (F.col("page_id") % 5).cast("string"),
        F.lit("/clip"), page, F.lit(".mp4?sig=a"),
    )
    return pages.select(
        "page_id", text.frame_url(F.col("url"), F.col("page_id")).alias("plain"),
        text.frame_url(deep, F.lit(0), include_name=True, video_id=F.lit(7)).alias("named"),
        text.frame_from_template(F.concat(host, F.lit("/frame(number).jpg")), F.col("page_id")).alias("from_template"),
    )


@query(
    "p28_file_names",
    rf"""WITH {URLS}
        SELECT page_id, split_part(path, '/', -1) AS name,
               replace(url, split_part(split_part(path, '/', -1), '.', 1),
                       split_part(split_part(path, '/', -1), '.', 1) || '_indexed') AS indexed,
               repeat('n', 296 - length(CAST(page_id AS VARCHAR)))[1:251] || '.mp4' AS trimmed FROM urls""",
)
def file_names(spark, sf_dir):
    long_name = F.concat(F.expr("repeat('n', 296 - length(cast(page_id AS string)))"), F.lit(".mp4"))
    return views.table(spark, sf_dir, "pages").select(
        "page_id", text.file_name(F.col("url")).alias("name"),
        text.indexed_url(F.col("url")).alias("indexed"),
        text.trim_file_name(long_name).alias("trimmed"),
    )


@query(
    "p29_session_names",
    r"""WITH slugs AS (
            SELECT page_id, coalesce(nullif(substr(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'),
                       '^-+|-+$', '', 'g'), 1, 40), ''), 'session') AS slug FROM pages)
        SELECT page_id, slug, 'frames-s-' || slug AS own_index, 'frames' AS shared_index,
               'sessions/' || slug || '/' AS prefix, 'sessions/' || slug || '/a/b.jpg' AS path FROM slugs""",
)
def session_names(spark, sf_dir):
    url = F.col("url")
    return views.table(spark, sf_dir, "pages").select(
        "page_id", text.slug(url).alias("slug"), text.index_name("frames", url, "index").alias("own_index"),
        text.index_name("frames", url, "filter").alias("shared_index"), text.blob_prefix(url).alias("prefix"),
        text.blob_path(url, F.lit("/a/b.jpg")).alias("path"),
    )


@query(
    "p30_model_formats",
    """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'yolo' WHEN p_partkey % 5 IN (0, 4) THEN 'onnx'
              ELSE 'torch' END AS format FROM part""",
)
def model_formats(spark, sf_dir):
    path = (
        "concat('/models/', replace(p_name, ' ', '_'), if(p_partkey % 7 = 0, '-YOLO', ''), '.v2', "
        "element_at(array('.onnx', '.pt', '.PTH', '.torchscript', '.engine'), cast(p_partkey % 5 AS int) + 1))"
    )
    return views.table(spark, sf_dir, "part").select(
        "p_partkey", text.model_format(F.expr(path)).alias("format")
    )


@query(
    "p31_sizes",
    """SELECT p_partkey, CAST(p_size * 32 AS INT) AS w, CAST(p_size * 16 AS INT) AS h FROM part""",
)
def sizes(spark, sf_dir):
    size = text.parse_size(F.expr("concat(p_size * 32, if(p_partkey % 2 = 0, 'x', 'X'), p_size * 16)"))
    return views.table(spark, sf_dir, "part").select("p_partkey", size.alias("s")).select(
        "p_partkey", F.col("s")[0].alias("w"), F.col("s")[1].alias("h")
    )
