"""Readers of note folders and of the files that corpora and judgements come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.sources.sink import NotesSink
from corvane.storage import qualified, small_bytes

QRELS = "query_id string, query string, relevant array<string>"
GROUNDING = "id string, question string, document_title string, answer string, answers array<string>, candidates array<string>"
CORPUS = "_id string, title string, text string"
JUDGEMENTS = "query_id string, corpus_id string, score int"
QA = "question_id string, question string, document_title string, answer string, label int"


def listing(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, file, length, mtime) of the Markdown files; no file is opened. Paths are relative to the folder."""
    return _files(spark, folder, recursive).select(_relative(spark, folder).alias("path"), F.col("path").alias("file"), "length", F.col("modificationTime").alias("mtime"))


def _files(spark: SparkSession, folder: str | list[str], recursive: bool = True) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", str(recursive).lower()).load(folder)


def _relative(spark: SparkSession, folder: str):
    """What follows the folder in the full path of a file."""
    return F.substring(F.col("path"), len(qualified(spark, folder)) + 2, 1 << 30)


def read_notes(spark: SparkSession, folder: str, excluded: tuple[str, ...] = (), recursive: bool = True, first_title: bool = False, only: list[str] | None = None) -> DataFrame:
    """Markdown files as (path, title, content, mtime); paths are relative to the folder.

    ``first_title`` takes the first quoted title anywhere in the text, as the
    evaluation does, instead of the frontmatter's; ``only`` names the files
    (``file`` of ``listing``) to be opened. Files are packed into tasks by
    their sizes. Many small files: snapshot the result to Parquet before querying it.
    """
    files = _files(spark, folder if only is None else only, recursive)
    rows = files.select(_relative(spark, folder).alias("path"), F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("mtime"))
    title = T.eval_title(F.col("content"), F.element_at(F.split("path", "/"), -1)) if first_title else T.frontmatter_title(F.col("content"), F.col("path"))
    return rows.where(~T.excluded(F.col("path"), excluded)).select("path", title.alias("title"), "content", "mtime")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; blank lines are skipped, a broken one raises when it is read."""
    lines = spark.read.text(path).where(T.trimmed(F.col("value")) != "")
    return lines.select(F.from_json(T.trimmed(F.col("value")), schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_judgements(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated judgements below a header; quotes are characters like others, a score that is no number raises."""
    rows = spark.read.csv(path, schema="query_id string, corpus_id string, score string", sep="\t", header=True, quote="", mode="FAILFAST")
    return rows.where("trim(query_id) <> ''").select("query_id", "corpus_id", F.trim("score").cast("int").alias("score"))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON array; read whole by one task."""
    return spark.read.schema(schema).json(path, multiLine=True)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object a line, a file for each task; what was there goes."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def model_file(spark: SparkSession, folder: str, relative: str) -> bytes | None:
    """A file of a locally stored model, None where it is not there; see ``text.model_file_path``."""
    if not folder or relative.startswith("/") or ".." in relative.split("/"):
        return None
    return small_bytes(spark, f"{folder.rstrip('/')}/{relative}")


def write_notes(notes: DataFrame, folder: str) -> None:
    """(file, content) as one Markdown file each, all or none; see ``sink.NotesSink``."""
    spark = notes.sparkSession
    if ":/" not in folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("executors of several machines need a folder with a scheme, in a store that they share")
    spark.dataSource.register(NotesSink)
    notes.select("file", "content").write.format(NotesSink.name()).option("path", folder).mode("append").save()
