"""Rank metrics, all queries in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.config import METRIC_CUTOFF


def note_ranking(ranked: DataFrame) -> DataFrame:
    """(query_id, note, rank): chunk hits collapsed to the first of each note."""
    first = ranked.groupBy("query_id", "note").agg(F.min("rank").alias("first"))
    return first.select("query_id", "note", F.row_number().over(W.partitionBy("query_id").orderBy("first", "note")).alias("rank"))


def ndcg_recall(notes: DataFrame, qrels: DataFrame, k: int = METRIC_CUTOFF) -> DataFrame:
    """(query_id, ndcg, recall) at k for each query of qrels (query_id, note); queries without a hit count 0."""
    wanted = qrels.groupBy("query_id").agg(F.count_distinct("note").alias("relevant"))
    hits = notes.where(F.col("rank") <= k).join(qrels.select("query_id", "note").distinct(), ["query_id", "note"])
    gains = hits.groupBy("query_id").agg(F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.count("*").alias("hit"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("relevant", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    rows = wanted.join(gains, "query_id", "left")
    return rows.select("query_id", F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 6).alias("ndcg"), F.round(F.coalesce("hit", F.lit(0)) / F.col("relevant"), 6).alias("recall"))


def mean_metrics(each: DataFrame) -> DataFrame:
    return each.agg(F.count("*").alias("queries"), F.round(F.coalesce(F.avg("ndcg"), F.lit(0.0)), 6).alias("ndcg"), F.round(F.coalesce(F.avg("recall"), F.lit(0.0)), 6).alias("recall"))


def grounding_check(scored: DataFrame) -> DataFrame:
    """One row (questions, accuracy_at_1, mrr) of (question, candidate, score, positive)."""
    # the best positive and what stands before it, so that no question's candidates are sorted or kept
    falling = F.coalesce(F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(-F.col("score")), F.lit(float("inf")))
    placed = scored.select("question", "positive", F.struct(falling.alias("falling"), "candidate").alias("place"))
    best = placed.groupBy("question").agg(F.min(F.when(F.col("positive"), F.col("place"))).alias("best"))
    first = placed.join(best, "question").groupBy("question").agg(F.when(F.max("best").isNotNull(), 1 + F.count_if(F.col("place") < F.col("best"))).alias("first"))
    return first_places(first)


def first_places(first: DataFrame) -> DataFrame:
    """One row (questions, accuracy_at_1, mrr) of the place ``first`` of each question's best positive, null where it has none."""
    return first.agg(F.count("*").alias("questions"), F.round(F.coalesce(F.avg((F.coalesce("first", F.lit(0)) == 1).cast("double")), F.lit(0.0)), 6).alias("accuracy_at_1"), F.round(F.coalesce(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), F.lit(0.0)), 6).alias("mrr"))
