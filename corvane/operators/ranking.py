"""Blending semantic and lexical scores, and ranking by mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.config import ALPHA, MIN_POOL, MODES, POOL_FACTOR, TOP_K
from corvane.functions import text as T
from corvane.operators import lexical, vectors
from corvane.storage import stored


def blend(semantic: DataFrame, lexical_: DataFrame, alpha: float) -> DataFrame:
    """alpha * semantic + (1 - alpha) * lexical over the union of both; what is missing counts 0."""
    both = semantic.select("query_id", "id", F.col("score").alias("s")).join(lexical_.select("query_id", "id", F.col("score").alias("l")), ["query_id", "id"], "full_outer")
    s, l_ = F.coalesce("s", F.lit(0.0)), F.coalesce("l", F.lit(0.0))
    return both.select("query_id", "id", F.round(alpha * s + (1 - alpha) * l_, 6).alias("score"), s.alias("semantic_score"), l_.alias("lexical_score"))


def surfaces(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, surface) for embedding and for the lexical index."""
    return chunks.select("id", T.embed_surface(F.col("heading"), F.col("text")).alias("surface")), chunks.select("id", T.lexical_surface(F.col("note_title"), F.col("heading"), F.col("text")).alias("surface"))


def pool(chunks: DataFrame, queries: DataFrame, k: int, embedder=None, embedded: DataFrame | None = None, threshold: int | None = None, rows: int | None = None) -> DataFrame:
    """(query_id, id, score, rank): the nearest chunks of each query that a ranking of ``k`` looks at."""
    embedder = embedder or vectors.HashingEmbedder()
    q = embedder.embed(queries.select(F.col("query_id").alias("id"), F.concat(F.lit(embedder.query_instruction), F.coalesce("query", F.lit(""))).alias("surface"))).withColumnRenamed("id", "query_id")
    size = max(POOL_FACTOR * k, MIN_POOL)
    if threshold is None:
        return vectors.knn_exact(q, vectors.Texts(surfaces(chunks)[0], embedder) if embedded is None else embedded, size)
    return vectors.knn(q, embedder.embed(surfaces(chunks)[0]) if embedded is None else embedded, size, threshold, rows)


def rank(chunks: DataFrame, queries: DataFrame, mode: str = "hybrid", k: int = TOP_K, alpha: float = ALPHA, embedder=None, index: lexical.Searchable | None = None, embedded: DataFrame | None = None, threshold: int | None = None, rows: int | None = None, nearest: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, id, score, semantic_score, lexical_score): the k best chunks of each query.

    A mode builds only the side that it needs, and only what ``index``,
    ``embedded`` and ``nearest`` (a stored ``pool`` for the same k) do not give. Above ``threshold`` vectors (None: never) the
    semantic side is approximate; ``rows`` is their number, if known. Text joins
    after the cut, see ``with_chunks``.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    none = queries.sparkSession.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, id string, score double")
    semantic, lex, weight = none, none, {"semantic": 1.0, "lexical": 0.0, "hybrid": alpha}[mode]
    if mode != "lexical":
        semantic = pool(chunks, queries, k, embedder, embedded, threshold, rows) if nearest is None else nearest
    if mode == "hybrid" and nearest is None:
        # a bounded number of rows a query, read by both sides of the blend
        semantic = stored(semantic, "pool")
    if mode != "semantic":
        lex = lexical.best_scaled(index or lexical.LexicalIndex.build(surfaces(chunks)[1]), queries, k, semantic if mode == "hybrid" else None, 1 - weight)
    return lexical.top(blend(semantic, lex, weight), k)


def with_chunks(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds the chunk's note, heading and snippet; ids without a chunk are dropped."""
    return ranked.join(chunks, "id").select("query_id", "rank", "id", "score", "semantic_score", "lexical_score", "note_path", "note_title", "heading", "text", T.snippet(F.col("text")).alias("snippet"))
