"""A corpus of notes with judgements, and a set of questions with candidate answers.

    python -m corvane.tools.corpus CORPUS.jsonl QUERIES.jsonl JUDGEMENTS.tsv OUT [QUESTIONS.json]

writes notes to OUT/notes, OUT/qrels and OUT/questions (JSON lines).
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.sources import notes as source

#: Notes of a corpus, candidates of a question at least, questions at most.
TARGET_NOTES = 1000
MIN_CANDIDATES = 4
MAX_QUESTIONS = 150
SOURCE = "BeIR/SciFact"


def selected(corpus: DataFrame, relevant: DataFrame, target: int = TARGET_NOTES) -> DataFrame:
    """Ids (_id) of all relevant documents and of the lowest-numbered others, ``target`` in all if there are as many.

    Relevant documents that the corpus lacks count towards the target, as no note is written for them.
    """
    wanted = relevant.select(F.col("corpus_id").alias("_id")).distinct()
    room = max(0, target - wanted.count())
    others = corpus.select("_id").join(wanted, "_id", "left_anti").orderBy(F.expr("try_cast(_id AS double)"), "_id").limit(room)
    return wanted.unionByName(others)


def rendered(corpus: DataFrame, name: str = SOURCE) -> DataFrame:
    """(_id, file, content) of (_id, title, text): Markdown with frontmatter."""
    title, body, slug = F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")), T.slug(F.coalesce("title", F.lit("")))
    head = F.concat(F.lit("---\nid: "), T.yaml_string(F.col("_id")), F.lit("\ntitle: "), T.yaml_string(title), F.lit("\nsource: "), T.yaml_string(F.lit(name)), F.lit("\n---\n"))
    file = F.concat(F.when(slug != "", slug).otherwise("note"), F.lit("-"), F.col("_id"), F.lit(".md"))
    return corpus.select("_id", file.alias("file"), F.concat(head, F.lit("# "), title, F.lit("\n\n"), body, F.lit("\n")).alias("content"))


def judgements(files: DataFrame, relevant: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, query, relevant): the files of each query's relevant documents, in the order ``pos`` of their judgements; queries without any are left out."""
    known = relevant.join(files.select(F.col("_id").alias("corpus_id"), "file"), "corpus_id")
    rel = known.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "file"))), lambda x: x["file"]).alias("relevant"))
    return rel.join(queries.select(F.col("_id").alias("query_id"), F.col("text").alias("query")), "query_id", "left").select("query_id", F.coalesce("query", F.lit("")).alias("query"), "relevant")


def questions(rows: DataFrame, least: int = MIN_CANDIDATES, most: int = MAX_QUESTIONS) -> DataFrame:
    """(id, question, document_title, answer, answers, candidates) of rows (question_id, question, document_title, answer, label, pos).

    Questions with fewer than ``least`` candidates or without a right one are left
    out; of the others the first ``most``, in the order in which they first occur.
    A question's candidates are one row: their number is bounded by who wrote them.
    """
    row = F.struct("pos", "answer", "question", "document_title", "label")
    groups = rows.groupBy("question_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    right = F.transform(F.filter("rows", lambda r: r["label"] == 1), lambda r: r["answer"])
    kept = groups.where((F.size("rows") >= least) & (F.size(right) > 0)).orderBy(F.col("rows")[0]["pos"]).limit(most)
    first = F.col("rows")[0]
    return kept.select(F.col("question_id").alias("id"), first["question"].alias("question"), first["document_title"].alias("document_title"), right[0].alias("answer"), right.alias("answers"), F.transform("rows", lambda r: r["answer"]).alias("candidates"))


def build(spark: SparkSession, corpus: str, queries: str, judged: str, out: str, asked: str | None = None) -> None:
    docs = source.read_jsonl(spark, corpus, source.CORPUS)
    # a scan numbers the lines of a file in their order
    relevant = source.read_judgements(spark, judged).withColumn("pos", F.monotonically_increasing_id())
    files = rendered(docs.join(selected(docs, relevant), "_id", "left_semi"))
    source.write_notes(files, f"{out}/notes")
    source.write_jsonl(judgements(files, relevant, source.read_jsonl(spark, queries, source.CORPUS)), f"{out}/qrels")
    if asked:
        rows = source.read_json_array(spark, asked, source.QA).withColumn("pos", F.monotonically_increasing_id())
        source.write_jsonl(questions(rows), f"{out}/questions")


def main() -> None:
    if len(sys.argv) not in (5, 6):
        sys.exit(__doc__)
    build(SparkSession.builder.getOrCreate(), *sys.argv[1:])


if __name__ == "__main__":
    main()
