"""Language identification and toxicity by held-out accuracy on the driver's smaller tables."""

import math
import random
import re
import zlib

from pyspark.sql import functions as F

from corvane.llm import language_id, toxicity
from tests.llm.common import awkward, documents, words

SF = "/root/testdata/sf0.01"


def test_language(spark):
    rows = language_id.query(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = rows.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).head()[0]
    assert held > 0.97
    assert rows.where("score < 0 or score > 1").count() == 0


def bucket(gram):
    """The bucket of an n-gram, in plain integers."""
    keys, mask = [int(x) for x in language_id._KEYS], 2**32 - 1
    h = ord(gram[0]) * keys[0] & mask
    for c, k in zip(gram[1:], keys[1:], strict=False):
        h = ((h ^ h >> 13) + ord(c) * k) & mask
    return ((h ^ h >> 15) * 0x2C1B3C6D & mask) >> 17


def naive_grams(text):
    kept = " " + "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text) + " "
    kept = re.sub(" +", " ", kept)
    return [bucket(kept[i : i + n]) for n in language_id.ORDERS for i in range(len(kept) - n + 1)]


def test_language_against_plain_bayes(spark):
    """Predictions and scores of a plain multinomial naive Bayes over the same buckets."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = [r for r in docs.collect() if len(r["text"] or "") < 4000]
    learnt = [r for r in rows if r["lang"] and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]
    counts, number = {}, {}
    for r in learnt:
        number[r["lang"]] = number.get(r["lang"], 0) + 1
        own = counts.setdefault(r["lang"], {})
        for g in naive_grams(r["text"] or "") if re.search(r"[^\W\d_]", r["text"] or "") else ():
            own[g] = own.get(g, 0) + 1
    small = spark.createDataFrame(rows, docs.schema)
    model = spark.sparkContext.broadcast(language_id.train(small.where(language_id.fold(F.col("doc_id"), 3) != 1)))
    got = {r["doc_id"]: r for r in language_id.predict(small, model).collect()}
    size = language_id.SMOOTHING * language_id.BUCKETS
    for r in rows:
        if not any(map(str.isalpha, r["text"] or "")):
            assert (got[r["doc_id"]]["lang_pred"], got[r["doc_id"]]["score"]) == ("und", 0.0)
            continue
        grams = naive_grams(r["text"])
        logs = {x: math.log(number[x] / len(learnt)) + sum(math.log((counts[x].get(g, 0) + language_id.SMOOTHING) / (sum(counts[x].values()) + size)) for g in grams) for x in sorted(counts)}
        best = max(logs, key=logs.get)
        top = 1 / sum(math.exp(v - logs[best]) for v in logs.values())
        assert got[r["doc_id"]]["lang_pred"] == best and abs(got[r["doc_id"]]["score"] - top) < 1e-3
        assert got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_language_awkward(spark):
    train = documents(spark, ["the cat and the dog"] * 4).unionByName(documents(spark, ["der hund und die katze"] * 4, 10).withColumn("lang", F.lit("de")))
    model = spark.sparkContext.broadcast(language_id.train(train))
    rows = {(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.predict(awkward(spark), model).collect()}
    assert {(0, "und", 0.0), (1, "und", 0.0), (2, "und", 0.0), (None, "und", 0.0)} <= rows
    assert all(0 <= s <= 1 for _, _, s in rows)
    assert model.value.predict(["THE DOG", "und der Hund"])[0][0] == "en"
    assert model.value.predict(["und der Hund"])[0][0] == "de"
    none = language_id.train(train.limit(0))
    assert none.predict(["hello"]) == [("und", 0.0)]
    assert language_id.predict(train.limit(0), model).count() == 0
    # a text alone and among others gets the same answer
    texts = ["the dog", "die katze " * 50, "x", "und"]
    together, alone = model.value.predict(texts), [model.value.predict([t])[0] for t in texts]
    assert [x for x, _ in together] == [x for x, _ in alone]
    assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(together, alone, strict=True))


def test_toxicity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = toxicity.query(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out")
    found, missed, false, n = (rows.agg(*(F.count_if(c) for c in (F.expr("toxic = 1 AND predicted = 1"), F.expr("toxic = 1 AND predicted = 0"), F.expr("toxic = 0 AND predicted = 1"))), F.count("*")).head())
    print(f"found {found}, missed {missed}, false alarms {false} of {n}")
    assert docs.count() == 10000 and found + missed > 50
    assert found >= 0.85 * (found + missed) and false <= 0.15 * (found + false)


def test_scorer_by_hand(spark):
    """Scores against a plain mean over words of the mean over their subwords."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["you", "utter", "idiot!", "kind", "friend", "the-idiot", "Moron,", "1234", "…", "été", "a"]) for _ in range(rng.randrange(40))) for _ in range(120)]
    model = toxicity.fit(texts, [int("idiot" in t) for t in texts])
    assert model.by_bucket.any()
    scorer, softmax = model.scorer(), lambda x: 1 / (1 + math.exp(-x))
    for t in [*texts, "", "idiotic idiots", "x " * 50000, "nothing known"]:
        numbers = []
        for part in set(t.split()):
            for word in re.findall(r"[^\W\d_]+", part.lower()):
                marked = f"<{word}>"
                ids, _ = toxicity.subwords([word])
                assert len(ids) == 1 + sum(max(0, len(marked) - n + 1) for n in (3, 4, 5))
                numbers.append(sum(float(model.by_bucket[i]) for i in ids) / len(ids))
        want = softmax(model.bias + (sum(numbers) / len(numbers) if numbers else 0.0))
        assert abs(scorer.score(t) - want) < 1e-9
    # a misspelling shares subwords with the word it resembles
    assert scorer.score("idiott") > scorer.score("friend")


def test_told():
    import numpy as np

    held = np.array([[10, 0, 5], [10, 12, 5]])
    got = toxicity.told(held, np.array([100, 100]))
    assert got[0] == got[2] == 0 and abs(got[1] - math.sqrt(2 * (12 * math.log(2) + 88 * math.log(88 / 94) + 100 * math.log(100 / 94)))) < 1e-9


def test_sample_is_bounded(spark, caplog):
    texts = [("an idiot " if i % 2 else "a friend ") * 50 + f"w{i}" for i in range(40)]
    docs = documents(spark, [*texts, "idiot " * 100000])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(40, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, max_bytes=80_000)
    assert "1 sampled rows beyond" in caplog.text and model.scorer().score("idiot") > 0.5


def test_toxicity_awkward(spark):
    rng = random.Random(3)
    texts = [" ".join([*(f"w{rng.randrange(50)}" for _ in range(12)), "an idiot moron" if i % 2 else "a friendly remark", *(f"w{rng.randrange(50)}" for _ in range(12))]) for i in range(60)]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert model.scorer().score("such an idiot") > 0.5 > model.scorer().score("a friendly remark")
    shared = spark.sparkContext.broadcast(model)
    rows = toxicity.score(awkward(spark), shared).collect()
    assert len(rows) == awkward(spark).count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    kept = toxicity.drop_toxic(docs, shared)
    assert kept.columns == docs.columns and {r["doc_id"] % 2 for r in kept.collect()} == {0}
    assert toxicity.score(docs.limit(0), shared).count() == 0
    one_class = toxicity.train(docs, labels.where("toxic = 0"))
    assert one_class.scorer().score("idiot") < 0.5
    assert toxicity.train(docs.limit(0), labels).scorer().score("idiot") < 0.5


def shingles(text):
    own = words(text)
    return {tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))} if own else set()


def test_first_of_copies():
    rng = random.Random(5)
    draw = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    # a passage that is half of each text makes no copies, whatever its hashes
    passage = draw(60)
    texts = [" ".join(passage + draw(60)) for _ in range(60)]
    assert toxicity.first_of_copies(texts, [i % 2 for i in range(60)]) == list(range(60))
    # a copy goes if it has the label of one kept before, and only then
    assert toxicity.first_of_copies([texts[0], texts[0], texts[0], texts[0]], [0, 1, 0, 1]) == [0, 1]
    assert toxicity.first_of_copies(["", " ", "a", "a", "b"], [0] * 5) == [0, 2, 4]
    assert toxicity.first_of_copies([], []) == []
    # the same rows as by comparing all pairs, on both sides of the bound
    texts, labels = [], []
    for _ in range(30):
        base = draw(rng.randrange(20, 80))
        for _ in range(8):
            own = list(base)
            for at in rng.sample(range(len(own)), rng.randrange(4)):
                own[at : at + 1] = draw(rng.randrange(3))
            texts.append(" ".join(own))
            labels.append(rng.randrange(2))
    kept, near = [], []
    for i, own in enumerate(map(shingles, texts)):
        found = [len(own & shingles(texts[j])) / len(own | shingles(texts[j])) for j in kept if labels[j] == labels[i]]
        near += [x for x in found if x]
        if not any(x >= toxicity.COPY for x in found):
            kept.append(i)
    assert min(near) < 0.75 < max(near) and len(kept) < 200
    assert toxicity.first_of_copies(texts, labels) == kept
