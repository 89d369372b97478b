"""Small tables with the awkward rows that every operator must take."""

import re
import string

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, `token count` string"
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def documents(spark, texts, start=0):
    """Rows with extra columns whose names clash with those of results."""
    return spark.createDataFrame([(start + i, t, "en", "s", len(t or ""), 0.5, "x") for i, t in enumerate(texts)], DOCS)


def awkward(spark):
    """Null and empty texts, null ids, repeated rows, other scripts, a very long text."""
    texts = [None, "", " ", "\n\t", "a", "é 😀 ñ", "▁ ▁▁x", "  two  spaces ", "a b　c﻿d\x1c\x85e", "The " * 20000, "ß" * 5000, "it's don't I'LL 123 ４５ ½ ﬁ", "a\rb\r\nc"]
    rows = [(i, t, None, None, None, None, None) for i, t in enumerate(texts)]
    rows += [(4, "a", "en", "s", 1, 1.0, "x"), (None, "no id here at all today", None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
