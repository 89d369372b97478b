"""Retrieval quality of a folder of notes, by judgements and by questions with candidate answers.

    python -m corvane.tools.evaluate NOTES QRELS.jsonl OUT [QUESTIONS.jsonl]

prints a summary and writes OUT/metrics_<time>.json.
"""

from __future__ import annotations

import json
import sys
from datetime import UTC, datetime
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.config import ALPHA, METRIC_CUTOFF, MODES
from corvane.operators import evaluation, lexical, ranking, vectors
from corvane.operators.chunking import chunk_notes
from corvane.sources import notes as source
from corvane.storage import create, stored

POOL = 50


def fixed(value: float, places: int = 4) -> str:
    """So many decimals of the exact value, halves away from zero."""
    return str(Decimal(value).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))


def modes(chunks: DataFrame, qrels: DataFrame, alpha: float = ALPHA, embedder: vectors.Embedder | None = None, k: int = POOL) -> DataFrame:
    """(mode, queries, ndcg, recall) of qrels (query_id, query, relevant); all modes use one index."""
    embedder = embedder or vectors.HashingEmbedder()
    surface = ranking.surfaces(chunks)
    known = {"index": lexical.LexicalIndex.build(surface[1]), "embedded": stored(embedder.embed(surface[0]), "embedded")}
    relevant = qrels.select("query_id", F.explode("relevant").alias("note"))
    paths = chunks.select("id", F.col("note_path").alias("note"))
    out: DataFrame | None = None
    for mode in MODES:
        hits = ranking.rank(chunks, qrels.select("query_id", "query"), mode, k, alpha, embedder, **known).join(paths, "id")
        each = evaluation.ndcg_recall(evaluation.note_ranking(hits), relevant)
        row = evaluation.mean_metrics(each).select(F.lit(mode).alias("mode"), "queries", "ndcg", "recall")
        out = row if out is None else out.unionByName(row)
    return out


def grounding(questions: DataFrame, embedder: vectors.Embedder | None = None) -> DataFrame:
    """(questions, accuracy_at_1, mrr) of (id, question, answers, candidates): each question's candidates by their cosine."""
    embedder = embedder or vectors.HashingEmbedder()
    asked = embedder.embed(questions.select("id", F.concat(F.lit(embedder.query_instruction), F.col("question")).alias("surface"))).select(F.col("id").alias("question"), F.col("embedding").alias("q"))
    rows = questions.select(F.col("id").alias("question"), "answers", F.posexplode("candidates").alias("candidate", "text"))
    # a candidate text that several questions share is embedded once
    texts = stored(embedder.embed(rows.select(F.col("text").alias("id"), F.col("text").alias("surface")).distinct()), "candidates")
    scored = rows.join(texts.withColumnRenamed("id", "text"), "text").join(asked, "question")
    return evaluation.grounding_check(scored.select("question", "candidate", F.round(vectors.cosine(F.col("q"), F.col("embedding")), 6).alias("score"), F.array_contains("answers", F.col("text")).alias("positive")))


def summary(metrics: dict) -> str:
    lines = ["=== Retrieval quality (SciFact, @10) ===", "mode      nDCG@10   recall@10"]
    lines += [f"{mode:<9} {fixed(row['ndcg'])}    {fixed(row['recall'])}" for mode, row in metrics["ranking"].items()]
    if found := metrics.get("grounding"):
        lines += ["", "=== Answer grounding (WikiQA) ===", f"questions={found['questions']}  accuracy@1={fixed(found['accuracyAt1'])}  MRR={fixed(found['mrr'])}"]
    return "\n".join(lines)


def evaluate(spark: SparkSession, folder: str, judged: str, out: str, asked: str | None = None, embedder: vectors.Embedder | None = None) -> dict:
    """Metrics, also written to ``out``; titles are the first quoted ones, as in the corpus that ``tools.corpus`` writes."""
    embedder = embedder or vectors.HashingEmbedder()
    found = stored(source.read_notes(spark, folder, recursive=False, first_title=True), "notes")
    chunks = stored(chunk_notes(found), "chunks")
    qrels = stored(source.read_jsonl(spark, judged, source.QRELS), "qrels")
    metrics = {"generatedAt": datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z"), "model": embedder.model_id, "corpus": {"notes": found.count(), "chunks": chunks.count()}, "queries": qrels.count(), "cutoff": METRIC_CUTOFF, "alpha": ALPHA}
    # three rows, and one
    metrics["ranking"] = {r["mode"]: {"ndcg": r["ndcg"], "recall": r["recall"]} for r in modes(chunks, qrels, embedder=embedder).collect()}
    if asked:
        row = grounding(source.read_jsonl(spark, asked, source.GROUNDING), embedder).head()
        metrics["grounding"] = {"questions": row["questions"], "accuracyAt1": row["accuracy_at_1"], "mrr": row["mrr"]}
    stamp = metrics["generatedAt"].replace(":", "-").replace(".", "-")
    create(spark, f"{out}/metrics_{stamp}.json", json.dumps(metrics, indent=2))
    return metrics


def main() -> None:
    if len(sys.argv) not in (4, 5):
        sys.exit(__doc__)
    print(summary(evaluate(SparkSession.builder.getOrCreate(), *sys.argv[1:])))


if __name__ == "__main__":
    main()
