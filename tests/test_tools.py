import json
import math

import pytest

from corvane.config import Settings
from corvane.engine import Engine
from corvane.sources import notes as source
from corvane.tools import corpus, evaluate


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n")
    return str(path)


@pytest.fixture
def built(spark, tmp_path):
    docs = [{"_id": str(i), "title": f"Paper {w}", "text": f"About {w} and its uses"} for i, w in enumerate(["copper", "zinc", "iron", "lead", "tin", "gold"], 8)]
    queries = [{"_id": "1", "text": "uses of zinc"}, {"_id": "2", "text": "gold"}, {"_id": "3", "text": "never judged"}]
    (tmp_path / "judged.tsv").write_text("query-id\tcorpus-id\tscore\n1\t9\t1\n1\t999\t1\n2\t13\t1\n2\t9\t1\n")
    asked = [{"question_id": q, "question": f"which metal, {q}?", "document_title": "D", "answer": a, "label": n} for q, a, n in [("b", "which metal, b? zinc", 1), ("a", "x", 1), ("b", "nothing", 0), ("b", "no", 0), ("b", "other", 1), ("c", "p", 0), ("c", "q", 0), ("c", "r", 0), ("c", "s", 0)]]
    (tmp_path / "asked.json").write_text(json.dumps(asked))
    out = str(tmp_path / "out")
    corpus.build(spark, lines(tmp_path / "corpus.jsonl", docs), lines(tmp_path / "queries.jsonl", queries), str(tmp_path / "judged.tsv"), out, str(tmp_path / "asked.json"))
    return out


def test_corpus(spark, built, tmp_path):
    files = sorted(p.name for p in (tmp_path / "out" / "notes").iterdir() if p.suffix == ".md")
    assert files == ["paper-copper-8.md", "paper-gold-13.md", "paper-iron-10.md", "paper-lead-11.md", "paper-tin-12.md", "paper-zinc-9.md"]
    assert (tmp_path / "out" / "notes" / "paper-zinc-9.md").read_text() == '---\nid: "9"\ntitle: "Paper zinc"\nsource: "BeIR/SciFact"\n---\n# Paper zinc\n\nAbout zinc and its uses\n'
    qrels = {r["query_id"]: (r["query"], r["relevant"]) for r in source.read_jsonl(spark, f"{built}/qrels", source.QRELS).collect()}
    assert qrels == {"1": ("uses of zinc", ["paper-zinc-9.md"]), "2": ("gold", ["paper-gold-13.md", "paper-zinc-9.md"])}
    rows = [r.asDict() for r in source.read_jsonl(spark, f"{built}/questions", source.GROUNDING).collect()]
    assert rows == [{"id": "b", "question": "which metal, b?", "document_title": "D", "answer": "which metal, b? zinc", "answers": ["which metal, b? zinc", "other"], "candidates": ["which metal, b? zinc", "nothing", "no", "other"]}]


def test_selected(spark):
    docs = spark.createDataFrame([(str(i),) for i in (10, 9, 100, 2, 33)], "_id string")
    relevant = spark.createDataFrame([("q", "100"), ("q", "7")], "query_id string, corpus_id string")
    assert {r["_id"] for r in corpus.selected(docs, relevant, 4).collect()} == {"100", "7", "2", "9"}
    assert {r["_id"] for r in corpus.selected(docs, relevant, 1).collect()} == {"100", "7"}


def test_first_seen_questions(spark):
    rows = spark.createDataFrame([(q, q, "", f"a{i}", int(i % 4 == 0), i) for i, q in enumerate("zzzzyyyyxxxx")], "question_id string, question string, document_title string, answer string, label int, pos long")
    assert [r["id"] for r in corpus.questions(rows, most=2).collect()] == ["z", "y"]
    assert corpus.questions(rows.limit(0)).count() == 0


def test_evaluate(spark, built, tmp_path, capsys):
    metrics = evaluate.evaluate(spark, f"{built}/notes", f"{built}/qrels", str(tmp_path / "results"), f"{built}/questions")
    assert metrics["corpus"] == {"notes": 6, "chunks": 6} and metrics["queries"] == 2
    assert metrics["ranking"]["lexical"] == {"ndcg": round((1 + 1 / (1 + 1 / math.log2(3))) / 2, 6), "recall": 0.75}
    assert metrics["grounding"] == {"questions": 1, "accuracyAt1": 1.0, "mrr": 1.0}
    (file,) = (p for p in (tmp_path / "results").iterdir() if p.suffix == ".json")
    assert json.loads(file.read_text()) == metrics and file.name.startswith("metrics_20")
    text = evaluate.summary(metrics)
    assert "questions=1  accuracy@1=1.0000  MRR=1.0000" in text and text.splitlines()[1] == "mode      nDCG@10   recall@10"
    assert evaluate.summary({"ranking": {"hybrid": {"ndcg": 0.5, "recall": 0.25}}}).endswith("hybrid    0.5000    0.2500")


def test_fixed():
    assert [evaluate.fixed(0.0625, 3), evaluate.fixed(1.005, 2), evaluate.fixed(2.5, 0), evaluate.fixed(0.12345)] == ["0.063", "1.00", "3", "0.1235"]


def test_settings(spark, tmp_path):
    raw = {"alpha": "0.62", "backend": "ollama", "ollama_model": " m ", "chunk_tokens": "100"}
    got = Settings.parsed(raw)
    assert (got.alpha, got.backend, got.ollama_model, got.chunk_tokens) == (0.6, "ollama", "m", 100)
    assert [Settings.parsed({"alpha": a}).alpha for a in ("7", "-1", "x", "nan", "0.33")] == [1.0, 0.0, 0.6, 0.6, 0.35]
    assert Settings.parsed({"backend": "other"}).backend == "none"
    assert got.generation_summary() == "Ollama · m" and Settings().generation_summary().startswith("Retrieval-only")
    assert Settings(backend="hosted").generation_summary() == "Hosted · no model set"
    engine, path = Engine(spark, str(tmp_path)), str(tmp_path / "settings.json")
    assert engine.load_settings(path) == Settings()
    for s in (got, Settings(excluded_folders=("a", "b"))):
        engine.save_settings(path, s)
        assert Engine(spark, str(tmp_path)).load_settings(path) == s == engine.settings


def test_progress(spark, tmp_path):
    notes = spark.createDataFrame([("a.md", "A", "one"), ("b.md", "B", "two")], "path string, title string, content string")
    told = []
    engine = Engine(spark, str(tmp_path))
    engine.rebuild(notes, lambda done, total: told.append((done, total, engine.indexing)))
    assert told == [(0, 2, True), (2, 2, False)] and engine.stats()["chunks"] == 2
    with pytest.raises(Exception, match="content"):
        engine.rebuild(notes.drop("content"))
    # the old state is still there
    assert not engine.indexing and engine.stats()["chunks"] == 2


def test_model_file(spark, tmp_path):
    (tmp_path / "org" / "m").mkdir(parents=True)
    (tmp_path / "org" / "m" / "w.bin").write_bytes(b"\0\xff")
    assert source.model_file(spark, str(tmp_path), "org/m/w.bin") == b"\0\xff"
    assert source.model_file(spark, str(tmp_path), "org/m/none.bin") is None and source.model_file(spark, "", "x") is None
    assert source.model_file(spark, str(tmp_path), "../" + tmp_path.name + "/org/m/w.bin") is None
