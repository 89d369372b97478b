"""The driver's tables as notes, queries, vectors, turns and change logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators.chat import ordered
from corvane.operators.chunking import chunk_notes
from corvane.operators.passages import containing
from corvane.storage import stored, table

FIELDS = ("path", "title", "content")


def _path():
    return F.concat(F.coalesce("source", F.lit("")), F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a note: doc_id, path, title, content."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", _path().alias("path"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.coalesce("text", F.lit("")).alias("content"))


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a Markdown file: doc_id, file, path, title, content."""
    docs = table(spark, sf_dir, "documents")
    title = F.concat(F.lit("Document "), F.col("doc_id").cast("string"))
    head = F.concat(F.lit("---\nid: "), T.yaml_string(F.col("doc_id").cast("string")), F.lit("\ntitle: "), T.yaml_string(title), F.lit("\nsource: "), T.yaml_string(F.coalesce("source", F.lit(""))), F.lit("\n---\n"))
    slug = T.slug(title)
    file = F.concat(F.when(slug != "", slug).otherwise("note"), F.lit("-"), F.col("doc_id").cast("string"), F.lit(".md"))
    return docs.select("doc_id", file.alias("file"), _path().alias("path"), title.alias("title"), F.concat(head, F.lit("# "), title, F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n")).alias("content"))


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with a title in one of the ways that people write them: doc_id, path, content."""
    docs = table(spark, sf_dir, "documents")
    n = F.col("doc_id").cast("string")
    ways = [F.concat(F.lit('"Say \\"doc '), n, F.lit('\\" \\\\ \\u00e9\\t."  # note')), F.concat(F.lit("'It''s doc "), n, F.lit("'")), F.concat(F.lit("Doc "), n, F.lit(" # a comment")), n, F.concat(F.lit("[doc, "), n, F.lit("]")), F.lit("true"), F.lit(""), F.concat(F.lit("Doc#"), n, F.lit(",:no"))]
    value = F.lit("")
    for k, way in enumerate(ways):
        value = F.when(F.col("doc_id") % len(ways) == k, way).otherwise(value)
    return docs.select("doc_id", _path().alias("path"), F.concat(F.lit("---\ntags: x\ntitle: "), value, F.lit("\n---\n"), F.coalesce("text", F.lit(""))).alias("content"))


def conversation_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a note with a section for each turn."""
    turns = table(spark, sf_dir, "conversations")
    part = F.concat(F.lit("## "), F.col("role"), F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), F.col("text"))
    body = turns.groupBy("conv_id").agg(ordered(part, F.col("turn"), "\n").alias("content"))
    return body.select(F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("title"), "content")


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(spark, sf_dir).select(*FIELDS).unionByName(conversation_notes(spark, sf_dir))


def markdown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_notes(markdown(spark, sf_dir))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_notes(notes(spark, sf_dir))


def kept_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks written once, for plans that read them several times."""
    return stored(chunks(spark, sf_dir), "chunks")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: ids divisible by 50."""
    return vectors(spark, sf_dir).where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding", F.col("label").alias("query_label"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat turns; the engine knows users and assistants only."""
    return table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, note, doc_id): documents that hold a benchmark passage, whole and in any case. A stated query set against all rows."""
    q = queries(spark, sf_dir).where("query <> ''").select("query_id", F.lower("query").alias("passage"))
    found = containing(notes(spark, sf_dir).select("doc_id", "path", F.lower("content").alias("low")), "low", q, "passage")
    return found.select("query_id", F.col("path").alias("note"), "doc_id")


def edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later state of the notes: every tenth edited, every 25th deleted, some added."""
    base = notes(spark, sf_dir)
    edit = base.where("doc_id % 25 <> 0").withColumn("content", F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("edited "), F.col("content"))).otherwise(F.col("content")))
    added = base.where("doc_id % 40 = 1").withColumn("path", F.concat(F.lit("new/"), F.col("path")))
    return edit.unionByName(added)


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as note changes: seq, ts, op, path, old_path."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "purchase", "rename").when(F.col("event_type") == "signup", "create").otherwise("modify")
    name = lambda n: F.concat(F.lit("users/user-"), n.cast("string"), F.lit(".md"))
    return e.select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), op.alias("op"), name(F.col("user_id")).alias("path"), F.when(op == "rename", name(F.col("user_id") + 1)).alias("old_path"))
