"""Notes to chunks: frontmatter, headings and overlapping token windows, all within the row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.config import CHUNK_OVERLAP, CHUNK_TOKENS
from corvane.functions import text as T


def windows(text, size: int, overlap: int):
    """Windows of a text's tokens, joined by spaces: array<string>, one window for up to ``size`` tokens."""
    overlap = min(overlap, max(0, size - 1))
    step = max(1, size - overlap)

    def cut(tk):
        last = F.ceil((F.size(tk) - size) / F.lit(step)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(tk, i * step + 1, F.lit(size)), " "))

    def whole(line):
        # most texts are one window and are not split
        return F.when(F.substring_index(line, " ", size) == line, F.array(line)).otherwise(T.bound(F.split(line, " "), cut))

    return T.bound(T.spaced(text), whole)


def chunk_notes(notes: DataFrame, size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(path, title, content) to (id, note_path, note_title, heading, ordinal, text)."""
    sections = T.bound(T.without_frontmatter(F.coalesce("content", F.lit(""))), T.sections)
    parts = F.transform(sections, lambda s: F.transform(F.when(s["body"] != "", windows(s["body"], size, overlap)).otherwise(F.array(s["heading"])), lambda w: F.struct(s["heading"].alias("heading"), w.alias("text"))))
    out = notes.select(F.col("path").alias("note_path"), F.col("title").alias("note_title"), F.posexplode(F.flatten(parts)).alias("ordinal", "chunk"))
    return out.select(F.concat("note_path", F.lit("#"), F.col("ordinal").cast("string")).alias("id"), "note_path", "note_title", "chunk.heading", "ordinal", "chunk.text")
