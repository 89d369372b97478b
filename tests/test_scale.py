"""Work that is dealt over tasks and held in bounded pieces, with the results of the plain form."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corvane.functions import terms
from corvane.operators import best, evaluation, postings, vectors


def _odd_vectors(spark):
    rng = random.Random(5)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(4)], rng.choice([0, 1, None])) for i in range(60)]
    odd = [None, [1.0, None, 0.0, 2.0], [0.0] * 4, [1.0, 2.0], [0.0, 0.0], [float("nan"), 1.0, 1.0, 1.0], [float("inf"), 1.0, 0.0, 1.0], []]
    rows += [(100 + i, v, i % 2) for i, v in enumerate(odd)]
    # cosines of exactly half a step, and one that the order of a sum decides
    rows += [(200, [1e-6, 1.0, 0.0, 0.0], 1), (201, [0.1, 0.2, 0.3, 1e-8], 0)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>, label int").coalesce(1)
    q = v.where("id % 7 = 0 OR id >= 100").select(F.col("id").alias("query_id"), "embedding", F.col("label").alias("query_label"))
    return q, v


def _plain(q, v):
    pairs = q.withColumnRenamed("embedding", "q").crossJoin(v)
    return pairs.select("query_id", "query_label", "id", "label", F.round(vectors.cosine(F.col("q"), F.col("embedding")), 6).alias("score"))


def test_cosines_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TASK_PAIRS", 200)
    q, v = _odd_vectors(spark)
    got = vectors.cosines(q, v)
    assert got.columns == ["query_id", "query_label", "id", "label", "score"]
    shown = lambda df: sorted(repr(tuple(r)) for r in df.select("query_id", "query_label", "id", "label", "score").collect())
    assert shown(got) == shown(_plain(q, v))
    # the vectors are one file, so one task before
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_cosines_come_by_score_in_runs_of_bounded_size(spark, monkeypatch):
    q, v = _odd_vectors(spark)
    shown = lambda df: sorted(repr(tuple(r)) for r in df.select("query_id", "query_label", "id", "label", "score").collect())
    plain = shown(_plain(q, v))
    monkeypatch.setattr(vectors, "blocks", lambda rows, n: best.blocks(rows, n, limit=10))
    for pairs, rows in ((1 << 24, 1 << 20), (300, 1 << 20), (1 << 24, 7)):
        monkeypatch.setattr(vectors, "TASK_PAIRS", pairs)
        monkeypatch.setattr(vectors, "RUN_ROWS", rows)
        monkeypatch.setattr(vectors, "PAIRS", 40)
        got = vectors.cosines(q, v.repartition(2))
        assert shown(got) == plain
        if pairs > 300 and rows > 7:
            found = [[r["score"] for r in task if r["score"] is not None and abs(r["score"]) <= 1] for task in got.select("score").rdd.glom().collect()]
            assert len(found) > 1 and all(x and x == sorted(x) for x in found)


def test_written_cosines_take_fewer_bytes_than_their_scores(spark, tmp_path):
    made = np.random.default_rng(3).normal(size=(4000, 16)).astype(np.float32).tolist()
    v = spark.createDataFrame(list(enumerate(made)), "id long, embedding array<float>").coalesce(1)
    q = v.where("id % 4 = 0").select(F.col("id").alias("query_id"), "embedding")
    vectors.cosines(q, v).write.parquet(f"{tmp_path}/pairs")
    files = list((tmp_path / "pairs").glob("*.parquet"))
    assert sum(pq.read_metadata(f).num_rows for f in files) == 4_000_000
    assert sum(f.stat().st_size for f in files) < 6.5 * 4_000_000


def test_grounding_gives_no_pairs_to_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TASK_PAIRS", 200)
    q, v = _odd_vectors(spark)
    plain = _plain(q, v).where("query_id <> id").select(F.col("query_id").alias("question"), F.col("id").alias("candidate"), "score", (F.col("label") == F.col("query_label")).alias("positive"))
    first = vectors.places(q, v)
    assert evaluation.first_places(first).head() == evaluation.grounding_check(plain).head()
    ranked = {}
    for r in sorted(plain.collect(), key=lambda r: (r["question"], math.inf if r["score"] is None else -math.inf if math.isnan(r["score"]) else -r["score"], r["candidate"])):
        ranked.setdefault(r["question"], []).append(r["positive"])
    assert {r["query_id"]: r["first"] for r in first.collect()} == {q: p.index(True) + 1 if True in p else None for q, p in ranked.items()}
    assert vectors.places(q.limit(0), v).count() == 0
    assert vectors.places(q, v.limit(0)).count() == 0


def test_texts_are_counted_in_bounded_pieces():
    texts = ["word " * n for n in (0, 1, 500, 3, 4, 5, 900, 2)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], names=["id", "surface"])
    got = list(terms.pieces(batch, limit=1000))
    assert pa.Table.from_batches(got).to_pydict() == pa.Table.from_batches([batch]).to_pydict()
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 1000 for p in got)
    assert [p.num_rows for p in got] == [2, 1, 3, 1, 2]
    assert [p.num_rows for p in terms.pieces(batch, align=np.array([0, 0, 0, 0, 1, 1, 1, 2, 2]))] == [4, 3, 2]
    many = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array(["x"] * 5000)], names=["id", "surface"])
    assert max(p.num_rows for p in terms.pieces(many)) <= 2048
    assert list(terms.pieces(batch.slice(0, 0))) == []


def test_a_block_is_scored_in_parts(spark, monkeypatch):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(rng.choices("abcdefghij", k=rng.randint(1, 9)))) for i in range(300)], "doc long, surface string")
    rows = postings.posting_rows(docs.coalesce(1)).toArrow().combine_chunks()
    vocabulary = pa.array(list("abcdefghij"))
    pairs = sorted((t, q) for q in range(40) for t in rng.sample(range(10), 3))
    start = np.concatenate(([0], np.cumsum(np.bincount([t for t, _ in pairs], minlength=10))))
    none = np.zeros(0, dtype=np.int64)
    known = postings._Known(pa.array(range(40)), vocabulary, np.linspace(0.1, 1.0, 10), start, np.array([q for _, q in pairs]), 5.0, ("s",), none, np.zeros(1, dtype=np.int64), none)

    def found():
        scorer = postings._Scorer(known, 7, np.zeros(40), 1.2, 0.75, low := np.full(40, np.inf), high := np.full(40, -np.inf))
        scorer.add(postings._Group("s", 0, rows), np.array([3, 5]), 0)
        q, s, ids = scorer.best.rows()
        return q.tolist(), s.tolist(), ids.to_pylist(), low.tolist(), high.tolist()

    whole, most, bincount = found(), [], np.bincount
    # the queries' postings of a block are not laid out all at once
    monkeypatch.setattr(postings, "ENTRIES", 500)
    monkeypatch.setattr(np, "bincount", lambda x, *a, **k: (most.append(len(x)), bincount(x, *a, **k))[1])
    assert found() == whole
    assert max(most) <= 500


def test_postings_count_texts_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        seen.add(1)
        return text

    docs = spark.range(0, 900, 1, 3).select(F.col("id").alias("doc"), told(F.concat(F.lit("word w"), F.col("id").cast("string"))).alias("surface"))
    postings.write_postings(docs, f"{tmp_path}/p", 4)
    got = spark.read.parquet(f"{tmp_path}/p")
    assert got.where("term = 'word'").agg(F.sum("df")).head()[0] == 900
    # ranges would have them counted for a sample too
    assert seen.value == 900


def test_all_modes_share_one_pool(spark, monkeypatch):
    from corvane.plans import queries

    made, knn, embed = [], vectors.knn_exact, queries.stored
    monkeypatch.setattr(vectors, "knn_exact", lambda *a: (made.append("knn"), knn(*a))[1])
    monkeypatch.setattr(queries, "stored", lambda df, name: (made.append(name), embed(df, name))[1])
    assert queries.eval_all_modes(spark, "/root/testdata/sf0.001").count() == 3
    # before, the modes compared all vectors twice and wrote them once
    assert made.count("knn") == 1 and "embedded" not in made


def test_hashing_holds_little_more_than_the_texts():
    import tracemalloc

    import pandas as pd

    from corvane.functions import hashing

    texts = pd.Series(["ab" * 1000] * 6000 + [None, ""])
    tracemalloc.start()
    got = hashing.content_hash.func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 6002 and got.nunique() == 2 and got.iloc[-1] == got.iloc[-2] == "811c9dc5"
    assert got.iloc[0] == f"{int(hashing.fnv1a([texts.iloc[0]])[0]):08x}"
    # 12 million units at 8 bytes each, and more, before
    assert peak < 60_000_000


def test_posting_rows_are_those_of_a_plain_count(spark):
    from collections import Counter, defaultdict

    rng = random.Random(11)
    texts = [" ".join(rng.choices([f"w{k}" for k in range(60)], [1 / (k + 1) for k in range(60)], k=rng.randint(0, 30))) for _ in range(400)]
    texts[7], texts[8] = None, "--"
    # numbers of two blocks that do not rise
    docs = [(3 * postings.DOCS - 200 + i, t) for i, t in enumerate(texts)]
    docs = docs[100:200] + docs[:100] + docs[200:]
    want = defaultdict(list)
    for doc, text in sorted(docs):
        counts = Counter((text or "").replace("--", "").split())
        for term, n in counts.items():
            want[term, doc // postings.DOCS].append((doc % postings.DOCS, n, sum(counts.values())))

    def ends(of, sign):
        """Pairs that no other exceeds and undercuts."""
        pairs = {(sign * n, sign * dl) for _, n, dl in of}
        return {(sign * n, sign * dl) for n, dl in pairs if not any((m, -k) != (n, -dl) and m >= n and k <= dl for m, k in pairs)}

    got = postings.posting_rows(spark.createDataFrame(docs, "doc long, surface string").coalesce(1)).collect()
    assert len(got) == len(want)
    for r in got:
        of = want[r["term"], r["block"]]
        assert (list(zip(r["pos"], r["tf"], r["dl"], strict=True)), r["df"], r["total"]) == (of, len(of), sum(n for _, n, _ in of))
        if r["df"] == 1:
            # before, a row of one document said the same three times
            assert r["top_tf"] is r["top_dl"] is r["low_tf"] is r["low_dl"] is None
            continue
        for end, sign in (("top", 1), ("low", -1)):
            pairs = list(zip(r[f"{end}_tf"], r[f"{end}_dl"], strict=True))
            assert set(pairs) == ends(of, sign) and len(pairs) == len(set(pairs))


def test_rows_are_numbered_without_python(spark, monkeypatch):
    rows = spark.createDataFrame([(f"n{i:03d}#{i}", f"t{i}") for i in random.Random(2).sample(range(500), 500)], "`id` string, `a b` string").repartition(3)
    got = postings.numbered(rows)
    assert got.columns == ["doc", "id", "a b"]
    found = sorted(map(tuple, got.collect()))
    assert [r[1:] for r in found] == sorted(map(tuple, rows.collect()))
    assert len({r[0] for r in found}) == 500 and found[0][0] % postings.RANGE == 0
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(postings, "RANGE", 10)
    with pytest.raises(Exception, match="too many documents in one task"):
        postings.numbered(rows.limit(100)).collect()


def test_common_texts_are_chunked_without_expressions(spark):
    """The forms that take no search by an expression give what it gives."""
    from corvane.functions import text as T
    from corvane.operators.chunking import windows

    plain = ["a b", "a\nb", " a \n b\n", "\n\n", "", "a  b", "a\tb", "a\r\nb", "é b", "é\u00a0b", "é\u2003\u3000b\ufeff", "é\nb", "a\x0bb\fc", "a\u2028b", None]
    rows = spark.createDataFrame([(t,) for t in plain], "t string")
    strip = lambda t: None if t is None else " ".join(x for x in re.split(T.WS + "+", t) if x)
    assert [r[0] for r in rows.select(T.spaced(F.col("t"))).collect()] == [strip(t) for t in plain]
    # one window up to the size, more above it
    for n in (2, 3, 4):
        assert len(spark.createDataFrame([(" ".join("x" * n),)], "t string").select(windows(F.col("t"), 3, 0)).head()[0]) == (1 if n <= 3 else 2)
    bodies = ["x", "# h\nx", "a # b", "", "x\n# h\ny"]
    got = spark.createDataFrame([(t,) for t in bodies], "t string").select(T.bound(F.col("t"), T.sections)).collect()
    assert [[tuple(s) for s in r[0]] for r in got] == [[("", "x")], [("h", "x")], [("", "a # b")], [], [("", "x"), ("h", "y")]]


def test_hashes_are_those_of_a_plain_loop():
    from corvane.functions import hashing

    def plain(text):
        h, raw = 2166136261, text.encode("utf-16-le", "surrogatepass")
        for i in range(0, len(raw), 2):
            h = (h ^ (raw[i] | raw[i + 1] << 8)) * 16777619 & 0xFFFFFFFF
        return h

    rng = random.Random(1)
    texts = ["".join(rng.choices("ab é一😀\ud800", k=rng.choice([0, 1, 5, 50, 50, 300]))) for _ in range(200)]
    got = hashing.fnv1a(texts)
    assert got.tolist() == [plain(t) for t in texts] and hashing.fnv1a([]).tolist() == []
    # before, products had 64 bits and were cut in a step of their own
    assert got.dtype == np.uint32


def test_frequencies_are_counted_within_tasks(spark, monkeypatch):
    from corvane.operators import lexical

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a", "b é", None, "c a", "--", "b"])], "id long, surface string").repartition(3)
    index = lexical.LexicalIndex.build(docs)
    assert lexical._frequencies(index.docs, ["a", "b", "z"]) == {"a": 2, "b": 3}
    assert lexical._frequencies(index.docs, []) == lexical._frequencies(index.docs.limit(0), ["a"]) == {}
    # before, every term of every document became a row
    taken, explode = [], F.explode
    monkeypatch.setattr(lexical.F, "explode", lambda c: (taken.append(str(c)), explode(c))[1])
    got = lexical.search(index, spark.createDataFrame([("q", "b a")], "query_id string, query string"), 9)
    assert {r["id"] for r in got.collect()} == {0, 1, 3, 5} and not any("terms.term" in c for c in taken)


def test_postings_are_stored_as_bytes(spark, tmp_path):
    """One piece with numbers that fit two bytes, one with a text whose length does not, singles and several in both."""
    docs = [(i, f"a b b {'c' if i % 3 else 'd'} only{i}") for i in range(50)] + [(postings.DOCS + i, "a x" if i else "a " * 70_000 + "y") for i in range(3)]
    rows = spark.createDataFrame(docs, "doc long, surface string").coalesce(1)
    postings.write_postings(rows, f"{tmp_path}/p", 2)
    got = spark.read.parquet(f"{tmp_path}/p")
    # before, seven lists a row were shuffled and written
    assert not [f.name for f in got.schema if f.dataType.typeName() == "array"]
    stored = got.select("term", "block", "df", "total", "entries", "top", "low").toArrow().combine_chunks()
    assert {len(e) // n for e, n in zip(stored["entries"].to_pylist(), stored["df"].to_pylist(), strict=True)} == {6, 12}
    lists = {(r["term"], r["block"]): r.asDict() for r in postings.posting_rows(rows).collect()}
    for r in lists.values():
        r |= {f"{end}_{x}": r[x] for end in ("top", "low") for x in ("tf", "dl") if r[f"{end}_{x}"] is None}
    assert {(r["term"], r["block"]): r for r in postings._unpacked(stored).to_pylist()} == lists
    narrow = stored.filter(pa.array([b == 0 for b in stored["block"].to_pylist()]))
    assert {(r["term"], r["block"]): r for r in postings._unpacked(narrow.slice(2)).to_pylist()}.items() <= lists.items()


def test_terms_are_hashed_from_their_bytes():
    from corvane.functions import hashing

    words = pa.array(["", "a", "w1", "abcdefghij" * 9, "0"])
    for some in (words, words.slice(1, 3), words.slice(0, 0), pa.array([""]), pa.array([], pa.string())):
        assert hashing.fnv1a_ascii(some).tolist() == hashing.fnv1a(some.to_pylist()).tolist()


def test_vectors_are_compared_as_they_are_made(spark):
    rng = random.Random(8)
    rows = spark.createDataFrame([(i, " ".join(rng.choices(["Brot", "mehl", "ÄPFEL", "x1", ""], k=rng.randint(0, 6)))) for i in range(200)] + [(200, None)], "id long, surface string")
    e = vectors.HashingEmbedder(16)
    q = e.embed(rows.where("id % 50 = 0")).withColumnRenamed("id", "query_id")
    shown = lambda df: sorted(tuple(r) for r in df.select("query_id", "id", "score", "rank").collect())
    got = vectors.knn_exact(q, vectors.Texts(rows, e), 7)
    assert shown(got) == shown(vectors.knn_exact(q, e.embed(rows), 7))
    # a second Python worker for each core before, and the vectors through Spark between the two
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    other = vectors.CallableEmbedder(lambda: lambda texts: [[len(t), 1.0] for t in texts], 2, "lengths")
    q = other.embed(rows.where("id < 3")).withColumnRenamed("id", "query_id")
    assert shown(vectors.knn_exact(q, vectors.Texts(rows, other), 3)) == shown(vectors.knn_exact(q, other.embed(rows), 3))


def test_a_pool_makes_no_vectors_apart(spark):
    from corvane.operators import ranking

    chunks = spark.createDataFrame([("a#0", "A", "H", "some text"), ("b#0", "B", "", "other text")], "id string, note_title string, heading string, text string")
    asked = spark.createDataFrame([(1, "text")], "query_id long, query string")
    assert ranking.pool(chunks, asked, 5)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_names_of_terms_need_no_python_workers(spark):
    terms_ = postings._terms(spark, ["b", "a"])
    assert sorted(r[0] for r in terms_.collect()) == ["a", "b"]
    assert "PythonRDD" not in terms_._jdf.rdd().toDebugString()


def test_a_search_shuffles_and_writes_no_texts_again(spark, monkeypatch):
    from corvane.plans import queries

    made, write = [], postings.stored
    monkeypatch.setattr(postings, "stored", lambda df, name: (made.append(name), write(df, name))[1])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    # what is small is far below the size of the texts
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        plan = queries.search_lexical(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "surfaces" not in made
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
