import json

import pytest
from pyspark.sql import functions as F

from corvane.config import Settings
from corvane.operators import generation
from corvane.operators.index import Index, diff, latest_changes, sessions
from corvane.sources import notes as source
from corvane.streaming import changes as stream

SCHEMA = "path string, title string, content string"


def notes(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_build_merge_reload(spark, tmp_path):
    index = Index(spark, str(tmp_path), Settings(excluded_folders=("private",)))
    assert index.load() is None
    old = index.open_or_build(notes(spark, ("a.md", "A", "# H\none\n# I\ntwo"), ("b.md", "B", "bee"), ("private/c.md", "C", "no")))
    assert {r["id"] for r in old.collect()} == {"a.md#0", "a.md#1", "b.md#0"}
    index.merge(notes(spark, ("a.md", "A", "# H\nchanged"), ("d.md", "D", "new")), notes(spark, ("b.md", "", "")).select("path"))
    now = {r["id"]: r["text"] for r in index.load().collect()}
    assert now == {"a.md#0": "changed", "d.md#0": "new"}
    # who opened the old snapshot keeps it
    assert old.count() == 3
    assert index.meta()["count"] == 2
    index.clean()
    assert index.load() is None


def test_commit_fails_between_steps(spark, tmp_path, monkeypatch):
    from corvane.operators import index as module

    index = Index(spark, str(tmp_path))
    index.rebuild(notes(spark, ("a.md", "A", "one")))

    def broken(*_):
        raise OSError("the store is gone")

    # after the rows, before the pointer
    monkeypatch.setattr(module, "publish", broken)
    with pytest.raises(OSError):
        index.rebuild(notes(spark, ("b.md", "B", "two")))
    monkeypatch.undo()
    assert [r["text"] for r in index.load().collect()] == ["one"]
    assert len(segments(index)) == 2
    # a writer that died while it wrote: nobody sees its draft
    (home(index) / "pointers" / ".0.draft").write_text("{")
    index.merge(notes(spark, ("c.md", "C", "three")), notes(spark).select("path"))
    assert sorted(r["text"] for r in index.load().collect()) == ["one", "three"]
    # what nobody names goes in time
    late = Index(spark, str(tmp_path), orphan_age=-1.0)
    late.merge(notes(spark, ("d.md", "D", "four")), notes(spark).select("path"))
    assert len(segments(index)) == 3 == len(index.meta()["segments"])


def home(index):
    from pathlib import Path

    return Path(index._home)


def segments(index):
    return [p.name for p in (home(index) / "segments").iterdir()]


def test_two_writers(spark, tmp_path):
    from corvane.operators.index import Conflict

    index = Index(spark, str(tmp_path), keep=2)
    index.rebuild(notes(spark, ("a.md", "A", "one")))
    base, head = index._head()
    entry, length = index._write(index._chunked(notes(spark, ("b.md", "B", "two"))), None, None)
    state = {"segments": [*head["segments"], entry], "count": 2, "length": head["length"] + length}
    Index(spark, str(tmp_path)).merge(notes(spark, ("c.md", "C", "three")), notes(spark).select("path"))
    with pytest.raises(Conflict):
        index._publish(base, state, head)
    assert sorted(r["text"] for r in index.load().collect()) == ["one", "three"]
    # nor later, when the number that it wants has long been removed
    for k in range(3):
        index.merge(notes(spark, ("c.md", "C", f"three {k}")), notes(spark).select("path"))
    assert base + 1 not in index._numbers()
    with pytest.raises(Conflict):
        index._publish(base, state, head)
    assert base + 1 not in index._numbers()
    assert sorted(r["text"] for r in index.load().collect()) == ["one", "three 2"]


def test_writers_of_two_processes(spark, tmp_path):
    """Another process takes the number while this one has its pointer drafted, and has not named it yet."""
    import subprocess
    import sys
    from pathlib import Path

    from corvane import storage
    from corvane.operators.index import Conflict

    index = Index(spark, str(tmp_path))
    index.rebuild(notes(spark, ("a.md", "A", "one")))
    other = f"""
import sys
from pyspark.sql import SparkSession
from corvane.operators.index import Index
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
Index(s, {str(tmp_path)!r}).merge(s.createDataFrame([("c.md", "C", "three")], "path string, title string, content string"), s.createDataFrame([], "path string"))
"""
    create, ran = storage.create, []

    def slow(s, path, text):
        done = create(s, path, text)
        if path.endswith(".draft") and not ran:
            ran.append(subprocess.run([sys.executable, "-c", other], cwd=Path(__file__).resolve().parent.parent, capture_output=True, timeout=120, check=True))
        return done

    storage.create = slow
    try:
        with pytest.raises(Conflict):
            index._merge(notes(spark, ("b.md", "B", "two")), notes(spark).select("path"))
    finally:
        storage.create = create
    assert len(ran) == 1
    index.merge(notes(spark, ("b.md", "B", "two")), notes(spark).select("path"))
    assert sorted(r["text"] for r in index.load().collect()) == ["one", "three", "two"]


def test_old_states_go(spark, tmp_path):
    index = Index(spark, str(tmp_path), keep=2)
    for k in range(4):
        index.rebuild(notes(spark, ("a.md", "A", f"text {k}")))
    assert len(index._numbers()) == 2 == len(segments(index)) and index.load().head()["text"] == "text 3"


def test_refuses_damaged(spark, tmp_path):
    from corvane.operators.vectors import CallableEmbedder

    wrong = Index(spark, str(tmp_path), embedder=CallableEmbedder(lambda: lambda texts: [[1.0] for _ in texts], 2, "wrong"))
    with pytest.raises(Exception, match="the model gave"):
        wrong.rebuild(notes(spark, ("a.md", "A", "one")))

    class Short:
        model_id, dim, query_instruction = "short", 3, ""

        def embed(self, rows, text="surface"):
            return rows.select("id", F.array(F.lit(1.0).cast("float")).alias("embedding"))

    short = Index(spark, str(tmp_path), embedder=Short())
    with pytest.raises(ValueError, match="dimension"):
        short.rebuild(notes(spark, ("a.md", "A", "one")))
    assert segments(short) == [] and short.load() is None
    index = Index(spark, str(tmp_path))
    index.rebuild(notes(spark, ("a.md", "A", "one"), ("b.md", "B", "two")))
    name = index.meta()["segments"][0]["name"]
    index.load().select(F.lit(7).cast("long").alias("doc"), "id").limit(1).write.mode("append").parquet(f"{index._at(name)}/rows")
    with pytest.raises(ValueError, match="pointer says"):
        index.load()


def tables(spark):
    """Folders that this application has written to the shared store and not removed."""
    from corvane import storage

    return set(storage._written)


def test_random_changes(spark, tmp_path):
    """After each of many changes the index reads as one built anew: rows, idf, searches; and it compacts."""
    import random

    from corvane.operators import lexical
    from corvane.operators.ranking import surfaces

    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    index = Index(spark, str(tmp_path), Settings(chunk_tokens=12, chunk_overlap=2), fan=3)
    state = {f"n{i}.md": " ".join(rng.choices(words, k=rng.randint(0, 40))) for i in range(30)}
    index.rebuild(notes(spark, *((p, p, t) for p, t in state.items())))
    before = tables(spark)
    most, queries = 0, spark.createDataFrame([(i, " ".join(rng.sample(words, 3))) for i in range(6)], "query_id long, query string")
    for step in range(8):
        gone = rng.sample(sorted(state), 2)
        edits = {f"n{rng.randint(0, 40)}.md": " ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(3)}
        gone = [p for p in gone if p not in edits]
        state = {p: t for p, t in state.items() if p not in gone} | edits
        index.merge(notes(spark, *((p, p, t) for p, t in edits.items())), spark.createDataFrame([(p,) for p in gone], "path string"))
        most = max(most, len(index.meta()["segments"]))
        if step % 4 == 3:
            fresh = index._chunked(notes(spark, *((p, p, t) for p, t in state.items())))
            view = index.view()
            assert sorted((r["id"], r["text"], r["hash"]) for r in view.rows.collect()) == sorted((r["id"], r["text"], r["hash"]) for r in fresh.collect())
            plain = lexical.LexicalIndex.build(surfaces(fresh)[1])
            assert view.postings.frequencies([*words, "zzz", "n1"]) == {r["term"]: r["df"] for r in plain.df.collect() if r["term"] in [*words, "n1"]}
            n, avgdl = plain.stats.head()
            assert (view.postings.n, view.postings.length / view.postings.n) == (n, avgdl)
            for k in (2, 50):
                # with all scores, so that ends and ties count
                assert [sorted(map(tuple, lexical.top(lexical.best_scaled(i, queries, k), k).collect())) for i in (view.postings, plain)][0] == sorted(map(tuple, lexical.top(lexical.best_scaled(plain, queries, k), k).collect()))
            vectors = {r["id"]: r["embedding"] for r in view.vectors.collect()}
            want = {r["id"]: r["embedding"] for r in index.embedder.embed(surfaces(fresh)[0]).collect()}
            assert vectors == want
    assert 1 < most < 8
    index.compact(everything=True)
    meta = index.meta()
    assert len(meta["segments"]) == 1 and meta["segments"][0]["rows"] == meta["count"] and not meta["segments"][0]["dead"]
    assert sorted(r["id"] for r in index.load().collect()) == sorted(r["id"] for r in fresh.collect())
    # nothing is left but what the comparison stored
    assert {p.rsplit("/", 1)[1].split("-")[0] for p in tables(spark) - before} <= {"lexical", "best", "candidates"}


def test_small_change_writes_little(spark, tmp_path):
    from corvane import storage

    index = Index(spark, str(tmp_path))
    index.rebuild(notes(spark, *((f"n{i:04d}.md", f"N{i}", " ".join(f"word{(i * 7 + j) % 900} other{i % 37}" for j in range(60))) for i in range(3000))))
    before = storage.size(spark, f"{index._home}/segments")
    index.merge(notes(spark, ("n0007.md", "N7", "a changed note of a few words")), notes(spark).select("path"))
    assert index.meta()["count"] == 3000 and len(index.meta()["segments"]) == 2
    assert storage.size(spark, f"{index._home}/segments") - before < 40_000 < before / 20


def test_diff(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "id string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "id string, hash string")
    assert {r["id"]: r["action"] for r in diff(old, new).collect()} == {"b": "update", "c": "delete", "d": "insert"}


def test_change_log(spark):
    log = spark.createDataFrame([(1, "create", "a.md", None), (2, "rename", "b.md", "a.md"), (3, "modify", "x/c.md", None), (4, "delete", "x/d.md", None), (5, "create", "e.txt", None)], "seq long, op string, path string, old_path string")
    got = {r["path"]: r["op"] for r in latest_changes(log, ("x",)).collect()}
    assert got == {"a.md": "delete", "b.md": "upsert", "x/d.md": "delete"}


def test_sessions(spark):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(milliseconds=m), p) for m, p in [(0, "a"), (1000, "b"), (2499, "a"), (3999, "c"), (9000, "d")]]
    got = [(r["events"], r["paths"]) for r in sessions(spark.createDataFrame(rows, "ts timestamp, path string"), 1500).orderBy("first_ts").collect()]
    assert got == [(3, 2), (1, 1), (1, 1)]
    assert sessions(spark.createDataFrame([], "ts timestamp, path string"), 1500).count() == 0


def until(query, done, seconds=60):
    import time

    end = time.time() + seconds
    while not done():
        assert query.exception() is None and time.time() < end, query.exception()
        time.sleep(0.05)


def taken(query, after=-1):
    """Rows that a query has read from files in the batches after one."""
    return sum(s["numInputRows"] for p in query.recentProgress if p["batchId"] > after for s in p["sources"] if "File" in s["description"])


def test_stream(spark, tmp_path, monkeypatch):
    """Bursts end when their corpus has been quiet for the gap, deletes pass at once, a restart goes on with what waits."""
    import time

    # longer than the 1.5 s of the engine, so that a slow machine does not end a burst early
    gap = 6.0

    index = Index(spark, str(tmp_path / "index"))
    index.rebuild(notes(spark, ("old.md", "Old", "old text"), ("b.md", "B", "bee")))
    (tmp_path / "in").mkdir()
    applied = []

    def record(i, log):
        applied.append((time.time(), sorted((r["op"], r["path"], r["content"]) for r in log.collect())))
        apply_batch(i, log)

    apply_batch = stream.apply_batch
    monkeypatch.setattr(stream, "apply_batch", record)
    schema = "seq long, op string, path string, old_path string, title string, content string"

    def send(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return time.time()

    def start():
        return stream.maintain(index, spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "state"), int(gap * 1000))

    query = start()
    send((1, "create", "a.md", None, "A", "one"), (2, "modify", "a.md", None, "A", "two"), (3, "create", "gone.md", None, "G", "soon gone"))
    until(query, lambda: taken(query) == 3)
    # the burst goes on: the timer starts anew
    last = send((4, "modify", "a.md", None, "A", "three"), (5, "delete", "gone.md", None, None, None))
    until(query, lambda: len(applied) >= 2 and len(index.load().collect()) == 3)
    assert [x for _, x in applied[:2]] == [[("delete", "gone.md", None)], [("upsert", "a.md", "three")]]
    assert applied[1][0] - last >= gap
    # a delete and a rename are seen while a change still waits
    send((6, "modify", "c.md", None, "C", "cee"), (7, "delete", "b.md", None, None, None), (8, "rename", "new.md", "old.md", "New", "old text"))
    until(query, lambda: len(applied) >= 3)
    assert applied[2][1] == [("delete", "b.md", None), ("delete", "old.md", None), ("upsert", "new.md", "old text")]
    until(query, lambda: len(applied) >= 4 and "c.md#0" in {r["id"] for r in index.load().collect()})
    assert applied[3][1] == [("upsert", "c.md", "cee")]
    # stopped while a change waits
    seen = query.lastProgress["batchId"]
    send((9, "modify", "d.md", None, "D", "dee"))
    until(query, lambda: taken(query, seen) == 1)
    query.stop()
    stopped = len(applied)
    query = start()
    until(query, lambda: "d.md#0" in {r["id"] for r in index.load().collect()})
    query.stop()
    assert len(applied) <= stopped + 1
    assert {r["note_path"]: r["text"] for r in index.load().collect()} == {"a.md": "three", "new.md": "old text", "c.md": "cee", "d.md": "dee"}


def test_stream_of_corpora(spark, tmp_path):
    rows = [("x", 1, "create", "a.md", None, "A", "ex"), ("y", 2, "create", "a.md", None, "A", "why"), (None, 3, "create", "n.md", None, "N", "none")]
    spark.createDataFrame(rows, stream.CHANGES).coalesce(1).write.parquet(str(tmp_path / "in"))
    of = {c: Index(spark, str(tmp_path / c)) for c in "xy"}
    query = stream.maintain(of.__getitem__, spark.readStream.schema(stream.CHANGES).parquet(str(tmp_path / "in")), str(tmp_path / "state"), 200)
    until(query, lambda: all(i.load() is not None for i in of.values()))
    query.stop()
    assert {c: [r["text"] for r in i.load().collect()] for c, i in of.items()} == {"x": ["ex"], "y": ["why"]}


def test_sources(spark, tmp_path):
    folder = tmp_path / "notes"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.md").write_text('---\ntitle: "Alpha"\n---\nbody')
    (folder / "sub" / "b.md").write_text("plain")
    (folder / "c.txt").write_text("no")
    got = {r["path"]: (r["title"], r["content"]) for r in source.read_notes(spark, str(folder)).collect()}
    assert got == {"a.md": ("Alpha", '---\ntitle: "Alpha"\n---\nbody'), "sub/b.md": ("b", "plain")}
    assert source.read_notes(spark, str(folder), ("sub",)).count() == 1
    (tmp_path / "q.jsonl").write_text('{"query_id":"1","query":"x","relevant":["a"]}\n\n \t \u00a0\n \t{"query_id":"2"} \n')
    assert [r["query_id"] for r in source.read_jsonl(spark, str(tmp_path / "q.jsonl"), source.QRELS).orderBy("query_id").collect()] == ["1", "2"]
    (tmp_path / "bad.jsonl").write_text('{"query_id":"1"}\n{"query_id":\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        source.read_jsonl(spark, str(tmp_path / "bad.jsonl"), source.QRELS).collect()
    (tmp_path / "t.tsv").write_text('query-id\tcorpus-id\tscore\n1\t2\t1\n1\t"a\t1\n\n2\t"b"\t0\n')
    assert [tuple(r) for r in source.read_judgements(spark, str(tmp_path / "t.tsv")).collect()] == [("1", "2", 1), ("1", '"a', 1), ("2", '"b"', 0)]
    (tmp_path / "a.json").write_text('[{"question_id":"1","label":1},\n{"question_id":"2"}]')
    assert source.read_json_array(spark, str(tmp_path / "a.json"), source.QA).count() == 2


def test_paths_are_relative(spark, tmp_path):
    folder = tmp_path / "vault"
    inside = str(folder).lstrip("/")
    for name in (f"{inside}/deep.md", "deep.md", "x%20y.md", "x y.md", "vault/vault.md", "ü.md"):
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(name)
    for asked in (str(folder), f"{folder}/", f"file://{folder}"):
        got = {r["path"]: r["content"] for r in source.read_notes(spark, asked).collect()}
        assert got == {n: n for n in (f"{inside}/deep.md", "deep.md", "x%20y.md", "x y.md", "vault/vault.md", "ü.md")}


def test_notes_are_written_whole(spark, tmp_path):
    from pathlib import Path

    def files():
        return {str(p.relative_to(tmp_path)): p.read_text() for p in Path(tmp_path).rglob("*") if p.is_file()}

    rows = spark.createDataFrame([(f"n{i}.md", f"text {i}") for i in range(20)] + [("sub/x.md", "hé"), ("empty.md", None)], "file string, content string").repartition(3)
    source.write_notes(rows, str(tmp_path / "out"))
    assert files() == {f"out/{r['file']}": r["content"] or "" for r in rows.collect()}
    before = files()
    bad = spark.createDataFrame([(f"m{i}.md", "x") for i in range(20)] + [("../up.md", "x")], "file string, content string").repartition(2)
    with pytest.raises(Exception, match="no file below"):
        source.write_notes(bad, str(tmp_path / "out"))
    assert files() == before and not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".")]


def test_reconcile(spark, tmp_path):
    import os

    folder = tmp_path / "vault"
    folder.mkdir()
    for i in range(40):
        (folder / f"n{i}.md").write_text(f"note number {i}")
    index = Index(spark, str(tmp_path / "index"))
    assert index.reconcile(str(folder)) == {"listed": 40, "read": 40, "gone": 0}
    assert index.reconcile(str(folder)) == {"listed": 40, "read": 0, "gone": 0}
    (folder / "n7.md").write_text("another text for number 7")
    (folder / "n8.md").unlink()
    # touched, not changed: opened, and nothing is embedded again
    os.utime(folder / "n9.md", (1, 1))
    opened = []
    read_notes = source.read_notes
    source.read_notes = lambda *a, only=None, **k: opened.extend(only) or read_notes(*a, only=only, **k)
    try:
        assert index.reconcile(str(folder)) == {"listed": 39, "read": 2, "gone": 1}
    finally:
        source.read_notes = read_notes
    assert sorted(f.rsplit("/", 1)[1] for f in opened) == ["n7.md", "n9.md"]
    assert index.meta()["segments"][-1]["rows"] == 1
    assert {r["note_path"]: r["text"] for r in index.load().collect()} == {f"n{i}.md": f"note number {i}" for i in range(40) if i not in (7, 8)} | {"n7.md": "another text for number 7"}
    # after a change by another way all is looked at
    index.merge(notes(spark, ("n1.md", "n1", "elsewhere")), notes(spark).select("path"))
    assert index.reconcile(str(folder))["read"] == 39
    assert {r["text"] for r in index.load().where("note_path = 'n1.md'").collect()} == {"note number 1"}


def test_generators():
    sent = []

    def transport(method, url, headers, body):
        sent.append((method, url, headers, body and json.loads(body)))
        if "bad" in url:
            return 500, ""
        if url.endswith("/api/generate"):
            return 200, '{"response":"hello"}'
        if method == "GET":
            return 200, '{"models":[{"name":"m"},{"name":1}],"data":[{"id":"n"}]}'
        return 200, '{"choices":[{"message":{"content":"yes"}}]}'

    assert generation.generator(Settings()) is None
    assert generation.generator(Settings(backend="ollama", ollama_endpoint="http://l/"), transport)("p") == "hello"
    assert sent[-1][1] == "http://l/api/generate" and sent[-1][3] == {"model": "llama3.1:8b", "prompt": "p", "stream": False}
    hosted = generation.generator(Settings(backend="hosted", hosted_endpoint="http://h/v1/chat", hosted_model="m", hosted_api_key="k"), transport)
    assert hosted("p") == "yes" and sent[-1][1] == "http://h/v1/chat" and sent[-1][2]["Authorization"] == "Bearer k"
    assert generation.generator(Settings(backend="lmstudio"), transport).models() == ["n"]
    assert generation.generator(Settings(backend="ollama"), transport).models() == ["m"]
    with pytest.raises(RuntimeError):
        generation.generator(Settings(backend="ollama", ollama_endpoint="http://bad"), transport)("p")


def test_settings():
    assert Settings.load({"alpha": 0.5, "unknown": 1}).alpha == 0.5
    got = Settings.parsed({"chunk_tokens": "99999", "chunk_overlap": "0", "ann_threshold": "x", "excluded_folders": " a , ,b"})
    assert (got.chunk_tokens, got.chunk_overlap, got.ann_threshold, got.excluded_folders) == (2048, 0, 20000, ("a", "b"))
    assert not Settings().has_backend()
    with pytest.raises(ValueError):
        Settings(alpha=2)
