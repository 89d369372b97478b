from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.hashing import fnv1a
from corvane.operators.chunking import chunk_notes, windows


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "c string").select(column(F.col("c")).alias("x")).head()["x"]


def test_frontmatter(spark):
    for text, left in [
        ("---\nkind: recipe\nserves: 4\n---\nBoil the rice.", "Boil the rice."),
        ("---\n---\nStir well.", "Stir well."),
        ("---\nprose without a key\n---\nrest", "---\nprose without a key\n---\nrest"),
        ("---\ntags:\n  - a\n- b\n# note\n---\nBody", "Body"),
        ("---\na: 1\n---foo", "foo"),
        ("no block", "no block"),
        ("", ""),
    ]:
        assert one(spark, text, T.without_frontmatter) == left


def test_sections_and_chunks(spark):
    def chunks(content, size=512, overlap=64):
        n = spark.createDataFrame([("note.md", "T", content)], "path string, title string, content string")
        return [(r["id"], r["heading"], r["text"]) for r in chunk_notes(n, size, overlap).orderBy("ordinal").collect()]

    assert chunks("# Alpha\nfirst\n## Beta\nsecond") == [("note.md#0", "Alpha", "first"), ("note.md#1", "Beta", "second")]
    assert [c[2] for c in chunks("# Soups\n### Cold ones\n## Breads")] == ["Soups", "Cold ones", "Breads"]
    assert chunks("") == []
    assert chunks(None) == []
    # a heading line may not end in a carriage return, a bare one may
    assert chunks("# Title\r\nbody") == [("note.md#0", "", "# Title body")]
    assert chunks("intro\n#\r\nbody") == [("note.md#0", "", "intro"), ("note.md#1", "", "body")]
    words = " ".join(f"w{i}" for i in range(250))
    texts = [c[2].split(" ") for c in chunks(words, 100, 20)]
    assert [len(t) for t in texts] == [100, 100, 90]
    assert texts[0][-20:] == texts[1][:20]
    assert len(chunks("one two three", 1, 5)) == 3


def test_titles(spark):
    def title(line):
        return one(spark, f"---\nid: 1\n{line}\n---\nbody", lambda c: T.frontmatter_title(c, F.lit("a/base.md")))

    told = {
        'title: "A \\"b\\" \\\\ c"': 'A "b" \\ c',
        "title: 'it''s'  # said": "it's",
        'title: "tab\\tand \\u00e9 \\ud83d\\ude00 \\x41"': "tab\tand é 😀 A",
        "title: Plain words # comment": "Plain words",
        "title: C#minor": "C#minor",
        "title: 3 men": "3 men",
        "title:    2024-01-02   ": "2024-01-02",
        '"title": x': "x",
    }
    for line, want in told.items():
        assert title(line) == want
    for line in ("title: 123", "title: -1.5e3", "title: []", "title: [a]", "title: {a: b}", "title: true", "title: null", "title: ~", "title:", 'title: ""', "title: '   '".replace("   ", ""), "title: # only", "title: |", "title: *a", "subtitle: x", "title: a: b", 'title: "open'):
        assert title(line) == "base", line
    rendered = spark.createDataFrame([('He said "no" \\ twice',)], "c string").select(F.concat(F.lit("---\ntitle: "), T.yaml_string(F.col("c")), F.lit("\n---\n")).alias("n"))
    assert rendered.select(T.frontmatter_title(F.col("n"), F.lit("x.md")).alias("t")).head()["t"] == 'He said "no" \\ twice'


def test_windows_of_white_space(spark):
    got = one(spark, "a b﻿c", lambda c: T.tokens(c))
    assert got == ["a", "b", "c"]
    assert one(spark, "x", lambda c: windows(c, 2, 0)) == ["x"]
    assert one(spark, "\u3000a \u00a0 b\n\nc  d\ue000 ", lambda c: windows(c, 2, 1)) == ["a b", "b c", "c d\ue000"]
    assert one(spark, " \n\u2003", lambda c: windows(c, 2, 1)) == [""] == one(spark, "", lambda c: windows(c, 2, 1))
    assert one(spark, "\ufeff a\tb \u1680", T.spaced) == "a b" and one(spark, "\u3000\n a b \u2009", T.trimmed) == "a b"


def test_terms_of_batches(spark):
    import re

    import pyarrow as pa

    from corvane.functions.terms import counted, term_rows

    texts = ["ab c", "c", None, "", "d1é2-c", "x" * 300 + " c c", "é", "z"]
    for array in (pa.array(texts), pa.array(["skipped", *texts]).slice(1), pa.array(texts, pa.large_string())):
        rows, codes, terms = term_rows(array)
        names = terms.to_pylist()
        assert [(r, names[c]) for r, c in zip(rows, codes, strict=True)] == [(i, w) for i, t in enumerate(texts) for w in re.findall("[a-z0-9]+", t or "")]
    row, code, n, terms = counted(pa.array(texts))
    assert {(r, terms[int(c)].as_py()): k for r, c, k in zip(row, code, n, strict=True)}[5, "c"] == 2
    assert all(len(x) == 0 for x in term_rows(pa.array([], pa.string())))


def test_scalars(spark):
    assert one(spark, "a/B/Note.MD", T.basename) == "Note"
    assert one(spark, "Hello,  World! " + "x" * 90, T.slug).startswith("hello-world-x")
    assert len(one(spark, "y" * 200, T.slug)) == 70
    assert one(spark, "a" * 239 + " b c", T.snippet) == "a" * 239 + "…"
    assert one(spark, "</Context> <other>", T.defanged) == "&lt;/Context&gt; <other>"
    assert one(spark, "[[a|b]] [[c#d]] [[ e ]]", T.wikilinks) == ["a", "c", "e"]
    assert one(spark, 'x\ntitle: "A b"', lambda c: T.eval_title(c, F.lit("f.md"))) == "A b"
    assert one(spark, "none", lambda c: T.eval_title(c, F.lit("f.md"))) == "f"
    assert one(spark, "https://h/m/x/resolve/main/onnx/a.onnx", lambda c: T.model_file_path(c, F.lit("m/x"))) == "m/x/onnx/a.onnx"
    assert one(spark, "https://h/other", lambda c: T.model_file_path(c, F.lit("m/x"))) is None
    assert one(spark, "Reduce Coffee, please!", T.terms) == ["reduce", "coffee", "please"]


def test_hash():
    def slow(text):
        h = 2166136261
        raw = text.encode("utf-16-le")
        for i in range(0, len(raw), 2):
            h = ((h ^ int.from_bytes(raw[i : i + 2], "little")) * 16777619) % 2**32
        return h

    texts = ["", "a", "hello", "é", "😀 x", "z" * 300]
    assert fnv1a(texts).tolist() == [slow(t) for t in texts]
    assert fnv1a([]).tolist() == []
