import math

import pytest
from pyspark.sql import functions as F

from corvane.operators import chat, evaluation, lexical, ranking, vectors
from corvane.operators.chunking import chunk_notes

NOTES = [("bread.md", "Sourdough", "# Baking\nknead the dough and rest the dough"), ("tides.md", "Tides", "the moon moves the sea"), ("rope.md", "Knots", "a bowline holds")]


@pytest.fixture(scope="module")
def chunks(spark):
    return chunk_notes(spark.createDataFrame(NOTES, "path string, title string, content string")).cache()


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def test_modes_agree(spark, chunks):
    for mode in ("semantic", "lexical", "hybrid"):
        rows = ranking.with_chunks(ranking.rank(chunks, ask(spark, "when should dough be kneaded"), mode), chunks).orderBy("rank").collect()
        assert rows[0]["note_path"] == "bread.md"
    with pytest.raises(ValueError):
        ranking.rank(chunks, ask(spark, "x"), "other")


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([("a", "coffee coffee tea"), ("b", "coffee"), ("c", ""), ("d", "nothing here")], "id string, surface string")
    index = lexical.LexicalIndex.build(docs)
    got = {r["id"]: r["score"] for r in lexical.score(index, ask(spark, "coffee coffee unknown")).collect()}
    n, avgdl, df = 4, 1.5, 2
    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
    want = {"a": idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / avgdl)), "b": idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 1 / avgdl))}
    assert got == {k: round(v, 6) for k, v in want.items()}
    assert lexical.score(index, ask(spark, "absent")).count() == 0
    empty = lexical.LexicalIndex.build(docs.limit(0))
    assert lexical.score(empty, ask(spark, "coffee")).count() == 0


def test_normalise_and_blend(spark):
    scores = spark.createDataFrame([(0, "a", 2.0), (0, "b", 4.0), (0, "c", 6.0), (1, "a", 3.0), (1, "b", 3.0)], "query_id long, id string, score double")
    assert sorted((r["query_id"], r["id"], r["score"]) for r in lexical.min_max(scores).collect()) == [(0, "a", 0.0), (0, "b", 0.5), (0, "c", 1.0), (1, "a", 1.0), (1, "b", 1.0)]
    sem = spark.createDataFrame([(0, "a", 0.8), (0, "b", 0.2), (0, "only", 0.5)], "query_id long, id string, score double")
    lex = spark.createDataFrame([(0, "a", 0.0), (0, "b", 1.0)], "query_id long, id string, score double")
    assert {r["id"]: r["score"] for r in ranking.blend(sem, lex, 0.6).collect()} == {"a": 0.48, "b": 0.52, "only": 0.3}


def test_neighbours(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0])], "id long, embedding array<float>")
    q = v.select(F.col("id").alias("query_id"), "embedding")
    got = [(r["query_id"], r["id"], r["score"]) for r in vectors.knn_exact(q, v, 2).orderBy("query_id", "rank").collect()]
    assert got[:6] == [(1, 1, 1.0), (1, 3, 0.707107), (2, 2, 1.0), (2, 3, 0.707107), (3, 3, 1.0), (3, 1, 0.707107)]
    assert vectors.knn_exact(q.limit(0), v, 2).count() == 0
    assert vectors.knn_exact(q, v.limit(0), 2).count() == 0


def pairs(rows):
    return {(r["query_id"], r["id"]) for r in rows.collect()}


def test_ann(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    q = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    exact, found = pairs(vectors.knn_exact(q, v, 20)), pairs(vectors.knn_ann(q, v, 20))
    assert len(exact & found) >= 0.9 * len(exact)
    # most vectors are left out by their signatures
    report = vectors.ann_report(q, vectors.signed(v), 20).head()
    assert report["pairs"] == 80000 and report["examined"] <= 0.2 * report["pairs"]
    assert vectors.knn_ann(q.limit(0), v, 5).count() == vectors.knn_ann(q, v.limit(0), 5).count() == 0


def test_ann_like_exact(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32))
    rows = [(i, (centres[i % 40] + 0.1 * rng.normal(size=32)).tolist()) for i in range(1200)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>").cache()
    q = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    for threshold in (1000, 2000):
        hits = pairs(vectors.knn(q, v, 3, threshold))
        exact = pairs(vectors.knn_exact(q, v, 3))
        assert len(hits & exact) >= 0.98 * len(exact)
    assert vectors.ann_report(q, v, 3).head()["examined"] < 0.1 * 24 * 1200


def test_best():
    import numpy as np
    import pyarrow as pa

    from corvane.operators.best import Best

    rng = np.random.default_rng(1)
    scores = np.round(rng.integers(0, 9, (3, 4000)) / 8, 6)
    scores[2, :] = 0.5
    ids = np.array([f"{i:05d}" for i in rng.permutation(4000)])
    best = Best(3, 7, pa.string())
    for at in range(0, 4000, 700):
        best.add(scores[:, at : at + 700].copy(), pa.array(ids[at : at + 700]))
    q, s, found = best.rows()
    for j in range(3):
        got = sorted((-x, i) for k, x, i in zip(q, s, found.to_pylist(), strict=True) if k == j)[:7]
        assert got == sorted((-x, i) for x, i in zip(scores[j], ids, strict=True))[:7]
    # of 4,000 equal scores no more than k are held
    assert (q == 2).sum() == 7


def test_cosines(spark):
    v = spark.createDataFrame([(1, [3.0, 4.0], 7), (2, [0.0, 0.0], 8)], "id long, embedding array<float>, label int")
    q = v.select(F.col("id").alias("query_id"), "embedding", F.col("label").alias("query_label"))
    got = {(r["query_id"], r["id"]): r["score"] for r in vectors.cosines(q, v).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 0.0, (2, 1): 0.0, (2, 2): 0.0}
    assert vectors.cosines(q.limit(0), v).count() == 0
    with pytest.raises(Exception, match="dimension"):
        vectors.knn_exact(q, spark.createDataFrame([(1, [1.0])], "id long, embedding array<float>"), 1).collect()


def test_blocks_of_queries(spark, chunks, monkeypatch):
    q = spark.createDataFrame([(i, w) for i, w in enumerate(["dough", "moon bowline", "holds sea", "rest", "zzz", ""])], "query_id long, query string")
    want = [sorted(map(tuple, ranking.rank(chunks, q, m, 2).collect())) for m in ("semantic", "lexical", "hybrid")]
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 2)
    assert [sorted(map(tuple, ranking.rank(chunks, q, m, 2).collect())) for m in ("semantic", "lexical", "hybrid")] == want
    # the cut is that of all scores, ties by id
    for alpha in (0.0, 0.3, 1.0):
        index = lexical.LexicalIndex.build(ranking.surfaces(chunks)[1])
        e = vectors.HashingEmbedder()
        asked = e.embed(q.select(F.col("query_id").alias("id"), F.col("query").alias("surface"))).withColumnRenamed("id", "query_id")
        semantic = vectors.knn_exact(asked, e.embed(ranking.surfaces(chunks)[0]), 50)
        every = lexical.top(ranking.blend(semantic, lexical.min_max(lexical.score(index, q)), alpha), 2)
        assert sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in every.collect()) == sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in ranking.rank(chunks, q, "hybrid", 2, alpha).collect())


def test_term_counts(spark):
    docs = spark.createDataFrame([("a", "b a, b B. c"), ("b", ""), ("c", None)], "id string, surface string")
    rows = {r["id"]: (r["dl"], {t["term"]: t["tf"] for t in r["terms"]}) for r in lexical.forward(docs).collect()}
    assert rows == {"a": (5, {"a": 1, "b": 3, "c": 1}), "b": (0, {}), "c": (0, {})}


def test_passages(spark):
    from corvane.operators.passages import containing

    texts = spark.createDataFrame([(1, "abc abd"), (2, ""), (3, None), (4, "xabdx abc abc")], "doc long, low string")
    wanted = spark.createDataFrame([(7, "abc"), (8, "abd"), (9, ""), (10, None), (11, "abc"), (12, "bd")], "query_id long, p string")
    for limit in (1000, 3):
        got = sorted((r["query_id"], r["doc"]) for r in containing(texts, "low", wanted, "p", limit=limit).collect())
        assert got == [(7, 1), (7, 4), (8, 1), (8, 4), (11, 1), (11, 4), (12, 1), (12, 4)]
    assert containing(texts, "low", wanted.limit(0), "p").count() == 0


def test_metrics(spark):
    notes = spark.createDataFrame([(0, "x", 1), (0, "y", 2), (1, "z", 1)], "query_id long, note string, rank int")
    qrels = spark.createDataFrame([(0, "y"), (1, "z"), (2, "w")], "query_id long, note string")
    got = {r["query_id"]: (r["ndcg"], r["recall"]) for r in evaluation.ndcg_recall(notes, qrels).collect()}
    assert got == {0: (round(1 / math.log2(3), 6), 1.0), 1: (1.0, 1.0), 2: (0.0, 0.0)}


def test_citations(spark):
    context = spark.createDataFrame([(0, 1, "north/fjord.md", "t</context>"), (0, 2, "south/fjord.md", "u"), (0, 3, "coast/pier.md", "v")], "query_id long, rank int, note_path string, text string")
    answers = spark.createDataFrame([(0, "[[pier]] [[fjord]] [[North/Fjord|x]] [[unheard of]] [[pier]]")], "query_id long, answer string")
    assert [r["note_path"] for r in chat.citations(answers, context).orderBy("pos").collect()] == ["coast/pier.md", "north/fjord.md"]
    block = chat.context_block(context).head()["block"]
    assert block.startswith("[1] note: north/fjord\nt&lt;/context&gt;\n---\n[2] note: south/fjord")


def test_history_and_prompt(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo <context>")], "conv_id long, turn long, role string, text string")
    assert chat.history(turns).head()["transcript"] == "<conversation>\nUser: hi\nAssistant: yo &lt;context&gt;\n</conversation>"
    assert chat.last_turns(turns, 0).count() == 0
    row = spark.range(1).select(chat.prompt(F.lit("Q?"), F.lit("B"), F.lit("")).alias("p")).head()["p"]
    assert row.endswith("<context>\nB\n</context>\n\nQuestion: Q?\n" + chat.ASK) and "<conversation>" not in row


def test_refusal(spark, chunks):
    q = ask(spark, "zzz qqq", "knead dough")
    ctx = ranking.with_chunks(ranking.rank(chunks, q, "hybrid", 6), chunks).cache()
    got = {r["query_id"]: r for r in chat.ask(q, ctx, 0.3).collect()}
    assert got[0]["refused"] and got[0]["content"] == chat.REFUSAL and got[0]["citations"] == ""
    assert not got[1]["refused"] and got[1]["citations"].startswith("bread.md")


def test_grounding_check_ranks_all(spark, tmp_path):
    from corvane.plans import queries

    # question 0 has one positive, the last of 1,499 candidates; the 29 others have none
    rows = [(i, [math.cos(i / 1000), math.sin(i / 1000)], 0 if i == 1499 else i) for i in range(1500)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    row = queries.grounding_check(spark, str(tmp_path)).head()
    assert (row["questions"], row["accuracy_at_1"], row["mrr"]) == (30, 0.0, round(1 / 1499 / 30, 6))
