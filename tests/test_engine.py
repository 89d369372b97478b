import pytest

from corvane.config import Settings
from corvane.engine import Engine
from corvane.operators.vectors import CallableEmbedder


@pytest.fixture
def engine(spark, tmp_path):
    notes = spark.createDataFrame([("caffeine.md", "Caffeine", "reduce coffee intake slowly"), ("sleep.md", "Sleep", "sleep well and rest")], "path string, title string, content string")
    return Engine(spark, str(tmp_path)).open(notes)


def test_search(spark, engine):
    q = spark.createDataFrame([(0, "coffee"), (1, "  ")], "query_id long, query string")
    rows = engine.search(q, k=5).orderBy("rank").collect()
    assert rows[0]["note_path"] == "caffeine.md" and {r["query_id"] for r in rows} == {0}
    assert engine.stats() == {"notes": 2, "chunks": 2, "model_id": "hashing-embedder-v1", "approximate": False}
    with pytest.raises(ValueError):
        Engine(spark, engine.root).search(q)


def test_searches_use_the_snapshot(spark, engine, monkeypatch):
    from corvane import storage
    from corvane.operators import lexical

    def never(*_, **__):
        raise AssertionError("the index was built again")

    monkeypatch.setattr(lexical, "forward", never)
    q, before = spark.createDataFrame([(0, "coffee")], "query_id long, query string"), list(storage._written)
    for mode in ("lexical", "hybrid", "semantic"):
        assert engine.search(q, mode).head()["note_path"] == "caffeine.md"
    # what a search writes goes with it
    assert storage._written == before


def test_nothing_is_left(spark, engine):
    from corvane import storage

    before, q = list(storage._written), spark.createDataFrame([(0, "coffee")], "query_id long, query string")
    for k in range(3):
        engine.update(spark.createDataFrame([("tea.md", "Tea", f"tea number {k}")], "path string, title string, content string"), spark.createDataFrame([], "path string"))
        engine.search(q).collect()
    assert storage._written == before


def test_many_results(spark, engine, monkeypatch):
    from corvane import engine as module

    q = spark.createDataFrame([(i, "coffee sleep") for i in range(4)], "query_id long, query string")
    few = sorted(map(tuple, engine.search(q, k=5).collect()))
    monkeypatch.setattr(module, "LOCAL_ROWS", 3)
    assert sorted(map(tuple, engine.search(q, k=5).collect())) == few


def bytes_read(spark):
    return sum(e.totalInputBytes() for e in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().executorList(True)))


def test_a_search_reads_little(spark, tmp_path):
    """A term of few notes: their postings, the ids and the pages of the found texts, no documents."""
    import random

    from corvane import storage

    rng = random.Random(9)
    words = [f"{rng.choice('abcdefgh')}{i:x}{rng.randint(0, 999)}" for i in range(20000)]
    rows = [(f"n{i:05d}.md", f"N{i}", " ".join(rng.choices(words, k=450)) + (" rarity" if i in (17, 2300) else "")) for i in range(9000)]
    engine = Engine(spark, str(tmp_path)).open(spark.createDataFrame(rows, "path string, title string, content string").repartition(8))
    whole = storage.size(spark, f"{engine.index._home}/segments")
    q = spark.createDataFrame([(0, "rarity")], "query_id long, query string")
    sc, before = spark.sparkContext, bytes_read(spark)
    # reads of several ranges at once are not counted
    spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")
    sc.setJobGroup("one term", "")
    try:
        found = [r["note_path"] for r in engine.search(q, "lexical", 5).orderBy("rank").collect()]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.unset("parquet.hadoop.vectored.io.enabled")
    assert sorted(found) == ["n00017.md", "n02300.md"]
    read = bytes_read(spark) - before
    print(read, whole, len(sc.statusTracker().getJobIdsForGroup("one term")))
    assert 0 < read <= whole / 20


def test_update_moves_both_sides(spark, engine):
    notes = spark.createDataFrame([("tea.md", "Tea", "green tea with jasmine"), ("caffeine.md", "Caffeine", "cocoa")], "path string, title string, content string")
    engine.update(notes, spark.createDataFrame([("sleep.md",)], "path string"))
    q = spark.createDataFrame([(0, "jasmine"), (1, "coffee"), (2, "rest")], "query_id long, query string")
    got = [(r["query_id"], r["note_path"]) for r in engine.search(q, "lexical").collect()]
    assert got == [(0, "tea.md")]
    assert engine.search(q, "semantic").where("note_path = 'sleep.md'").count() == 0


def test_above_the_threshold(spark, tmp_path):
    words = [f"word{i} other{i % 7} third{i % 11}" for i in range(300)]
    notes = spark.createDataFrame([(f"n{i:03d}.md", f"N{i}", w) for i, w in enumerate(words)], "path string, title string, content string")
    few = Engine(spark, str(tmp_path), Settings(ann_threshold=299)).open(notes)
    many = Engine(spark, str(tmp_path), Settings(ann_threshold=300)).open(notes)
    assert few.stats()["approximate"] and not many.stats()["approximate"]
    q = spark.createDataFrame([(i, words[i]) for i in (5, 77, 201)], "query_id long, query string")
    first = [sorted((r["query_id"], r["id"]) for r in e.search(q, "semantic", 1).collect()) for e in (few, many)]
    assert first[0] == first[1] == [(5, "n005.md#0"), (77, "n077.md#0"), (201, "n201.md#0")]


def test_conversation(engine):
    plain = engine.session(floor=0.3)
    assert plain.ask("zzz")["refused"]
    reply = plain.ask("reduce coffee")
    assert not reply["refused"] and reply["citations"][0] == "caffeine.md" and len(plain.turns) == 4
    plain.reset()
    assert plain.turns == []


def test_generated(engine):
    prompts = []

    def generate(prompt):
        prompts.append(prompt)
        if "fail" in prompt.rsplit("Question:", 1)[1]:
            raise RuntimeError
        return "See [[caffeine]] and [[nothing]]."

    chat = engine.session(generate, floor=0.99, history_messages=2)
    first = chat.ask("coffee?")
    assert first["citations"] == ["caffeine.md"] and not first["grounded"] and not first["refused"]
    assert "<conversation>" not in prompts[0]
    chat.ask("more?")
    assert "User: coffee?\nAssistant: See [[caffeine]]" in prompts[1]
    with pytest.raises(RuntimeError):
        chat.ask("fail")
    assert len(chat.turns) == 4


def test_callable_embedder(spark, tmp_path):
    e = CallableEmbedder(lambda: lambda texts: [[float(len(t)), 1.0] for t in texts], 2, "lengths", batch=1)
    rows = spark.createDataFrame([("a", "xx"), ("b", None)], "id string, surface string")
    assert {r["id"]: r["embedding"] for r in e.embed(rows).collect()} == {"a": [2.0, 1.0], "b": [0.0, 1.0]}
    notes = spark.createDataFrame([("n.md", "N", "text")], "path string, title string, content string")
    engine = Engine(spark, str(tmp_path), Settings(), e).open(notes)
    assert engine.index.meta()["model_id"] == "lengths"
