"""Hybrid retrieval: vector top-k, grouping of chunks to resources, scoring, cuts and ranks; one operator with two presets."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import numbers, text


@dataclass(frozen=True)
class Preset:
    """What differs between the catalogues."""

    chunk_types: tuple[str, ...]
    coverage_of: int
    stop: tuple[str, ...]
    penalties: tuple[tuple[str, float], ...]
    chunks: int
    api_words: bool = False


DATASETS = Preset(("TITLE_SUMMARY", "DESCRIPTION", "TAGS", "SCHEMA", "ACCESS"), 5, text.DATASET_STOP, (("restricted", 0.035), ("approval", 0.02), ("payment", 0.035)), 50, api_words=True)
APIS = Preset(("TITLE_SUMMARY", "DESCRIPTION", "TAGS", "SCHEMA", "RESOURCE", "ACCESS"), 6, text.API_STOP, (("auth", 0.035), ("paid", 0.045)), 200)

#: Weights of the score, the cut on the 0 to 100 scale, and the most candidates.
WEIGHTS = {"similarity": 0.60, "coverage": 0.12, "quality": 0.05, "lexical": 0.23}
LEAST_SCORE = 40.0
CANDIDATES = 25


def top_chunks(chunks: DataFrame, query: list[float], k: int, key: str = "chunk_id") -> DataFrame:
    """The k chunks nearest to ``query``, with ``similarity`` in 0..1; ties by key. A partial top-k in every task, no full sort."""
    vector = F.array(*(F.lit(float(x)) for x in query))
    near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), numbers.cosine(F.col("embedding"), vector)))
    return chunks.withColumn("similarity", F.round(near, 9)).drop("embedding").orderBy(F.col("similarity").desc_nulls_last(), F.col(key).asc_nulls_last()).limit(k)


def grouped(chunks: DataFrame, preset: Preset) -> DataFrame:
    """Per resource: best similarity, covered chunk types, text of the best chunk. At most k rows come in."""
    covered = F.array_intersect(F.collect_set("chunk_type"), F.array(*map(F.lit, preset.chunk_types)))
    return chunks.groupBy("resource_id").agg(
        F.max("similarity").alias("similarity"),
        F.least(F.lit(1.0), F.size(covered) / preset.coverage_of).alias("coverage"),
        F.min_by("chunk_type", F.struct(-F.col("similarity"), F.col("chunk_id"))).alias("best_chunk_type"),
    )


def scored(resources: DataFrame, query_text: str, preset: Preset) -> DataFrame:
    """The score of each resource; ``content`` is compared with the words of the request. Components are rounded before they are weighed again."""
    words = text.query_terms(text.tokens(F.lit(query_text)), preset.stop, preset.api_words)
    lexical = F.size(F.array_intersect(words, text.tokens(F.col("content")))) / F.greatest(F.size(words), F.lit(1))
    penalty = F.lit(0.0)
    for flag, cost in preset.penalties:
        penalty = penalty + F.when(F.coalesce(F.col(flag), F.lit(False)), F.lit(cost)).otherwise(F.lit(0.0))
    parts = resources.withColumns({"lexical": lexical, "penalty": penalty})
    pre = WEIGHTS["similarity"] * F.col("similarity") + WEIGHTS["coverage"] * F.col("coverage") + WEIGHTS["quality"] * F.col("quality") - F.col("penalty")
    parts = parts.withColumn("pre_score", F.round(pre, 6))
    rounded = parts.withColumns({c: F.round(c, 4) for c in ("similarity", "coverage", "quality", "lexical")})
    final = sum((F.lit(w) * F.col(c) for c, w in WEIGHTS.items()), F.lit(0.0)) - F.col("penalty")
    return rounded.withColumn("score", numbers.percent_score(F.round(final, 6)))


def ranked(resources: DataFrame, n: int = CANDIDATES, least: float = LEAST_SCORE) -> DataFrame:
    """The best n of at least ``least``, ranked; few rows come in, so one window over all is no bottleneck."""
    order = [F.col("score").desc(), F.col("pre_score").desc(), F.col("similarity").desc(), F.col("resource_id").asc()]
    best = resources.where(F.col("score") >= least).orderBy(*order).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def active(rows: DataFrame, status: str = "status", embedding: str | None = None) -> DataFrame:
    """Rows in use: of status ACTIVE and, where a vector is asked for, with one."""
    found = rows.where(F.col(status) == "ACTIVE")
    return found if embedding is None else found.where(F.col(embedding).isNotNull())


def group_texts(chunks: DataFrame, description: str = "DESCRIPTION") -> DataFrame:
    """Per resource: best similarity, the text of the nearest chunk, and the first text of its ``description`` chunks (nearest first)."""
    order = F.struct(-F.col("similarity"), F.col("chunk_id"))
    told = F.when(F.col("chunk_type") == description, F.struct((-F.col("similarity")).alias("s"), "chunk_id", "chunk_text"))
    return chunks.groupBy("resource_id").agg(F.max("similarity").alias("similarity"), F.min_by("chunk_text", order).alias("best_text"), F.min(told)["chunk_text"].alias("description"))
