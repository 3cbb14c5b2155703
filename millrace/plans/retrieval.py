"""Search by vector, words and flags. Chunks are rows of ``embeddings`` (five to a resource), resources are ``documents``."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import numbers, text
from millrace.operators import retrieval
from millrace.plans.registry import query
from millrace.session import table

REQUEST = "the and of that dataset api"
_TYPES = "['TITLE_SUMMARY','DESCRIPTION','TAGS','SCHEMA','ACCESS']"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, retrieval.DATASETS.chunk_types)), (F.col("vec_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.floor(F.col("vec_id") / 5).alias("resource_id"), kind.alias("chunk_type"), "embedding")


def request_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of the request: one row, by its id."""
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first().embedding


def resources(spark: SparkSession, sf_dir: str, wanted: DataFrame) -> DataFrame:
    """The resources of a few candidates, with presence flags and restrictions; candidates are at most as many as chunks were taken."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("resource_id"), F.col("text").alias("content"), "source", "lang")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("resource_id"), (F.col("toxic") == 1).alias("restricted"), (F.col("quality") == 0).alias("approval"))
    filled = lambda c: F.when(F.coalesce(F.char_length(c), F.lit(0)) > 0, 1).otherwise(0)
    quality = (filled(F.regexp_extract("content", r"^[^\r\n]*", 0)) + filled(F.col("content")) + filled(F.col("source")) + filled(F.col("lang"))) / 4
    few = F.broadcast(wanted)
    return docs.join(few, "resource_id").join(labels, "resource_id", "left").withColumn("quality", quality).withColumn("payment", F.lit(None).cast("boolean"))


def _sql(k: int, coverage: int, stop: tuple[str, ...], penalty: str) -> str:
    words = [w for w in ("the", "and", "of", "that", "dataset", "api") if w not in stop]
    return f"""
WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0),
c AS (SELECT vec_id AS chunk_id, vec_id // 5 AS resource_id, ({_TYPES})[vec_id % 5 + 1] AS chunk_type,
             round(greatest(0, least(1, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])))), 9) AS similarity
      FROM embeddings, q ORDER BY similarity DESC, chunk_id LIMIT {k}),
g AS (SELECT resource_id, max(similarity) AS similarity, least(1.0, count(DISTINCT chunk_type) / {coverage}.0) AS coverage,
             arg_min(chunk_type, (-similarity, chunk_id)) AS best_chunk_type FROM c GROUP BY resource_id),
r AS (SELECT g.*, d.text AS content, l.toxic = 1 AS restricted, l.quality = 0 AS approval,
             ((CASE WHEN length(regexp_extract(d.text, '^[^\\r\\n]*')) > 0 THEN 1 ELSE 0 END) + (CASE WHEN length(d.text) > 0 THEN 1 ELSE 0 END)
              + (CASE WHEN length(d.source) > 0 THEN 1 ELSE 0 END) + (CASE WHEN length(d.lang) > 0 THEN 1 ELSE 0 END)) / 4.0 AS quality
      FROM g JOIN documents d ON d.doc_id = g.resource_id LEFT JOIN labels l ON l.doc_id = g.resource_id),
s AS (SELECT *, len(list_intersect(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(content), '[^0-9a-z가-힣 \\t\\r\\n]', ' ', 'g'), '[ \\t\\r\\n]+'), lambda w: length(w) >= 2)), {words!r})) / {float(len(words))} AS lexical,
             {penalty} AS penalty FROM r),
p AS (SELECT *, round(0.60 * similarity + 0.12 * coverage + 0.05 * quality - penalty, 6) AS pre_score FROM s),
o AS (SELECT resource_id, best_chunk_type, pre_score, round(similarity, 4) AS similarity, round(coverage, 4) AS coverage, round(quality, 4) AS quality, round(lexical, 4) AS lexical, penalty FROM p),
f AS (SELECT *, round(least(1.0, greatest(0.0, round(0.60 * similarity + 0.12 * coverage + 0.05 * quality + 0.23 * lexical - penalty, 6))) * 100, 3) AS score FROM o),
t AS (SELECT * FROM f WHERE score >= 40 ORDER BY score DESC, pre_score DESC, similarity DESC, resource_id LIMIT 25)
SELECT CAST(row_number() OVER (ORDER BY score DESC, pre_score DESC, similarity DESC, resource_id) AS INTEGER) AS rank, resource_id, best_chunk_type, similarity, coverage, quality, lexical, pre_score, score FROM t"""


def _hybrid(spark: SparkSession, sf_dir: str, preset: retrieval.Preset) -> DataFrame:
    near = retrieval.top_chunks(chunks(spark, sf_dir), request_vector(spark, sf_dir), preset.chunks)
    found = resources(spark, sf_dir, retrieval.grouped(near, preset))
    found = found.withColumns({"auth": F.col("restricted"), "paid": F.col("payment")})
    best = retrieval.ranked(retrieval.scored(found, REQUEST, preset))
    return best.select("rank", "resource_id", "best_chunk_type", "similarity", "coverage", "quality", "lexical", "pre_score", "score")


@query(_sql(50, 5, text.DATASET_STOP, "(CASE WHEN restricted THEN 0.035 ELSE 0 END) + (CASE WHEN approval THEN 0.02 ELSE 0 END)"))
def hybrid_retrieval_topn(spark, sf_dir):
    """Request to ranked data sets: nearest chunks, groups, scores, cut, rank."""
    return _hybrid(spark, sf_dir, retrieval.DATASETS)


@query(_sql(200, 6, text.API_STOP, "(CASE WHEN restricted THEN 0.035 ELSE 0 END)"))
def hybrid_retrieval_api_preset(spark, sf_dir):
    """The same over the other catalogue's parameters."""
    return _hybrid(spark, sf_dir, retrieval.APIS)


@query("""
SELECT vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS similarity
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) DESC, vec_id LIMIT 50""")
def vector_topk_cosine(spark, sf_dir):
    """The 50 nearest vectors."""
    q = F.array(*(F.lit(float(x)) for x in request_vector(spark, sf_dir)))
    near = table(spark, sf_dir, "embeddings").select("vec_id", F.round(numbers.cosine(F.col("embedding"), q), 6).alias("similarity"))
    return near.orderBy(F.desc("similarity"), "vec_id").limit(50)


@query("""
WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS norm FROM embeddings)
SELECT vec_id, round(norm, 6) AS norm, CASE WHEN norm > 0 THEN round(v[1] / norm, 6) ELSE round(v[1], 6) END AS first_part, CAST(len(v) AS INTEGER) AS dimensions FROM n""")
def vector_l2_normalize(spark, sf_dir):
    """Unit vectors; shown by norm and first part."""
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(numbers.dot(v, v)), 6).alias("norm"), F.round(numbers.l2_normalized(v)[0], 6).alias("first_part"), F.size(v).alias("dimensions"))


@query(f"""
WITH c AS (SELECT vec_id // 5 AS resource_id, ({_TYPES})[vec_id % 5 + 1] AS chunk_type FROM embeddings)
SELECT resource_id, count(*) AS n_chunks, least(1.0, count(DISTINCT chunk_type) / 5.0) AS coverage FROM c GROUP BY resource_id""")
def chunk_group_coverage(spark, sf_dir):
    """Share of chunk types that each resource has."""
    return chunks(spark, sf_dir).groupBy("resource_id").agg(F.count("*").alias("n_chunks"), F.least(F.lit(1.0), F.size(F.collect_set("chunk_type")) / 5).alias("coverage"))


_TOKENS = r"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^0-9a-z가-힣 \t\r\n]', ' ', 'g'), '[ \t\r\n]+'), lambda w: length(w) >= 2))"


@query(f"SELECT doc_id, round(len(list_intersect({_TOKENS}, ['the','and','of','that','dataset'])) / 5.0, 6) AS lexical FROM documents")
def lexical_overlap_score(spark, sf_dir):
    """Share of the request's words that each document has."""
    words = text.query_terms(text.tokens(F.lit(REQUEST)), text.DATASET_STOP)
    score = F.size(F.array_intersect(words, text.tokens(F.col("text")))) / F.greatest(F.size(words), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(score, 6).alias("lexical"))


@query("""
WITH p AS (SELECT p_partkey AS id, 'DATASET' AS kind, round(p_retailprice / 2200, 4) AS score FROM part WHERE p_size > 45
           UNION ALL SELECT s_suppkey, 'OPEN_API', CASE WHEN s_acctbal > 0 THEN round(s_acctbal / 10000, 4) END FROM supplier)
SELECT id, kind, score, CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, kind, id) AS INTEGER) AS rank FROM p ORDER BY rank LIMIT 40""")
def merge_rank_two_lists(spark, sf_dir):
    """Two lists of candidates in one ranking; the top is cut before the window numbers it."""
    from pyspark.sql import Window

    a = table(spark, sf_dir, "part").where("p_size > 45").select(F.col("p_partkey").alias("id"), F.lit("DATASET").alias("kind"), F.round(F.col("p_retailprice") / 2200, 4).alias("score"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("OPEN_API").alias("kind"), F.when(F.col("s_acctbal") > 0, F.round(F.col("s_acctbal") / 10000, 4)).alias("score"))
    order = [F.col("score").desc_nulls_last(), F.col("kind"), F.col("id")]
    return a.unionByName(b).orderBy(*order).limit(40).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
