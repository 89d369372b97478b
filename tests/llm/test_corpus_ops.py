"""Phrases, resharding and vector codes against plain Python."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import phrases, resharding, vector_codes
from tests.llm.common import DOCS, LOW, awkward, documents


def plain_phrases(rows, least, longest=5):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    frequent = {key: a for key, a in f.items() if a >= least}
    out = []
    for (lang, p), a in frequent.items():
        inside = any(o == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (o, q), b in frequent.items())
        if len(p) > 1 and not inside:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    return sorted(out)


def test_phrases(spark):
    rng = random.Random(4)
    words = ["New", "york", "CITY", "x", "été", "a", "the", "😀"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "\t", "  ", ", ", ".", "\n", "\x0b"]) for _ in range(rng.randrange(60))) for _ in range(60)] + ["new york city hall"] * 7
    rows = [(i, t, rng.choice(["en", "fr", None, "und"]), None, None, None, None) for i, t in enumerate(texts)]
    rows += [(None, None, "en", None, None, None, None), (1, "", None, None, None, None, None), (1, "a a a a a a", "en", None, None, None, None), *rows[:5]]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    for least in (40, 8, 3):
        got = sorted(map(tuple, phrases.collocations(docs, least).collect()))
        assert got == plain_phrases([(r[2], r[1]) for r in rows], least)
    assert len(got) > 0
    # crowded counters let more through and change nothing
    crowd = phrases.collocations(docs, 3, buckets=phrases.BLOCK)
    assert sorted(map(tuple, crowd.collect())) == plain_phrases([(r[2], r[1]) for r in rows], 3)
    ranked = phrases.first(phrases.collocations(docs, 3), 4).collect()
    want = sorted(plain_phrases([(r[2], r[1]) for r in rows], 3), key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    want = [(r[0], i + 1, r[1]) for _, own in itertools.groupby(want, key=lambda r: r[0]) for i, r in enumerate(list(own)[:4])]
    assert sorted((r["lang"], r["rank"], r["phrase"]) for r in ranked) == want
    assert phrases.collocations(docs.limit(0), 3).count() == 0
    assert phrases.collocations(awkward(spark), 100).count() > 0


def test_phrase_counters():
    c = phrases._Counters(phrases.BLOCK, 100)
    h = np.array([5, 5, 7], dtype=np.uint64) << np.uint64(48)
    for _ in range(60):
        c.add(h)
    (row,) = list(c.rows())
    assert np.frombuffer(row["at"][0].as_py(), "<u2").tolist() == [5, 7] and np.frombuffer(row["cells"][0].as_py(), "<u2").tolist() == [100, 60]


def test_scores_pass_64_bits(spark):
    row = spark.range(1).select(*(F.lit(x).cast("decimal(38,0)").alias(c) for c, x in (("_a", 10**12 - 1), ("_n", 10**14 + 7), ("_l", 10**12 + 1), ("_r", 10**12 + 3))))
    got = row.select(F.expr("cast((cast(1000 AS decimal(38,0)) * _a * _n) div (_l * _r) AS long)").alias("s")).head()["s"]
    assert got == 1000 * (10**12 - 1) * (10**14 + 7) // ((10**12 + 1) * (10**12 + 3))


def test_flow():
    rng = np.random.default_rng(2)
    for _ in range(40):
        n, m = rng.integers(1, 4, 2)
        supply, cost = rng.integers(0, 4, n), rng.integers(0, 5, (n, m))
        capacity = rng.integers(0, 4, m)
        if supply.sum() > capacity.sum():
            with pytest.raises(ValueError):
                resharding.flow(supply.tolist(), capacity.tolist(), cost)
            continue
        got = resharding.flow(supply.tolist(), capacity.tolist(), cost)
        assert (got >= 0).all() and (got.sum(axis=1) == supply).all() and (got.sum(axis=0) <= capacity).all()
        rows = [[x for x in itertools.product(*(range(s + 1) for _ in range(m))) if sum(x) == s] for s in supply.tolist()]
        least = min((int((np.array(x) * cost).sum()) for x in itertools.product(*rows) if (np.array(x).sum(axis=0) <= capacity).all()))
        assert (got * cost).sum() == least


def test_level():
    for loads, amount in (([0, 0, 0], 7), ([5, 1, 9], 6), ([5, 1, 9], 0), ([3], 4), ([9, 9, 0], 30)):
        got = resharding.level(np.array(loads), amount)
        assert got.sum() == amount and (got >= 0).all()
        filled = sorted(x + y for x, y in zip(loads, got.tolist(), strict=True) if y)
        assert not filled or filled[-1] - filled[0] <= 1


def shard_rows(spark, docs, tmp_path, old, new, file_bytes):
    before = resharding.lay_out(docs, "text", F.coalesce(F.pmod(F.col("doc_id"), F.lit(old)), F.lit(0)), old, str(tmp_path / "old"), file_bytes)
    after, plan = resharding.reshard(before, "text", old, new, str(tmp_path / "new"))
    return before, after, plan, resharding.slots(after.read()).collect()


def test_reshard(spark, tmp_path):
    rng = random.Random(3)
    texts = ["x" * rng.randrange(400, 600) for _ in range(9000)]
    docs = documents(spark, texts)
    before, after, plan, rows = shard_rows(spark, docs, tmp_path, 4, 5, 200_000)
    assert sorted((r["doc_id"], r["text"], r["source"]) for r in rows) == [(i, t, "s") for i, t in enumerate(texts)]
    size = Counter()
    for r in rows:
        size[r["shard"]] += len(r["text"]) + 16
    assert sorted(size) == [0, 1, 2, 3, 4] and max(size.values()) - min(size.values()) < 0.01 * sum(size.values()) / 5
    for s in size:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    # only what must move moves
    moved = sum(len(r["text"]) + 16 for r in rows if r["doc_id"] % 4 != r["shard"])
    even, old = sum(size.values()) / 5, Counter()
    for i, t in enumerate(texts):
        old[i % 4] += len(t) + 16
    least = sum(max(0, v - even) for v in old.values())
    assert abs(plan.moved - least) <= 5 and moved < 1.02 * least
    # most files are not written again
    kept = after.roots[0][1]
    assert len(kept) >= 0.5 * len({r["file"] for r in before.read().select("file").distinct().collect()})


def test_reshard_awkward(spark, tmp_path):
    rows = [(i % 3, "same text", None, None, None, None, None) for i in range(30)] + [(7, "y" * 5000, None, None, None, None, None), (None, None, None, None, None, None, None), (None, "z", None, None, None, None, None)]
    docs = spark.createDataFrame([*rows, *rows[:4]], DOCS).unionByName(awkward(spark))
    *_, plan, found = shard_rows(spark, docs, tmp_path / "a", 3, 4, 1000)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] is None, r["text"] or "")
    assert sorted(map(key, found)) == sorted(map(key, docs.collect()))
    size = Counter()
    for r in found:
        size[r["shard"]] += len((r["text"] or "").encode()) + 16
    largest = max(len((r["text"] or "").encode()) + 16 for r in found)
    assert max(size.values()) <= max(largest, 1.1 * sum(size.values()) / 4)
    # nothing changes when nothing needs to
    _, after, plan, _ = shard_rows(spark, documents(spark, ["abc"] * 9), tmp_path / "b", 3, 3, 1000)
    assert plan.moved == 0 and len(after.roots) == 1
    with pytest.raises(ValueError, match="shard"):
        resharding.lay_out(docs.withColumn("shard", F.lit(1)), "text", F.lit(0), 1, str(tmp_path / "c"))


def test_reshard_query(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = resharding.query(spark, "/root/testdata/sf0.001").collect()
    want = {r["doc_id"]: (len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in docs}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == want and len(rows) == len(docs)
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)} and all(0 <= r["shard"] < 40 for r in rows)
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert resharding.query(spark, str(tmp_path)).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, code string"


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = {}
    for i, v, _ in kept:
        if i is not None:
            first[i] = min(v, first.get(i, v))
    books = [[cut(first[i], p) for i in sorted(first)[:entries]] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            own = [near(cut(v, p), book)[1] for _, v, _ in kept]
            for e in set(own):
                members = [cut(v, p) for (_, v, _), x in zip(kept, own, strict=True) if x == e]
                book[e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    coded = [(i, label, [near(cut(v, p), books[p]) for p in range(parts)]) for i, v, label in kept]
    by_label = Counter()
    for _, label, found in coded:
        by_label[label] += sum(d for d, _ in found)
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), by_label[label], digest) for i, label, found in coded]


@pytest.mark.parametrize("n", [5, 16, 90])
def test_codes(spark, tmp_path, n):
    rng = random.Random(n)
    rows = [(rng.randrange(-9, 10**6), [rng.choice([-1.5, -0.25, 0.0, 0.1, 0.3, rng.gauss(0, 1)]) for _ in range(24)], rng.choice([1, 2, None]), "x") for _ in range(n)]
    rows += [rows[0], rows[0], (rows[1][0], rows[2][1], 1, "x"), (None, rows[3][1], 5, "x"), (3, None, 1, "x"), (4, [None] * 24, 1, "x"), (5, [math.nan] * 24, 1, "x"), (6, [math.inf] + [0.0] * 23, None, "x")]
    spark.createDataFrame(rows, VECTORS).repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    own = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()]
    got = [tuple(r) for r in vector_codes.query(spark, str(tmp_path)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(plain_codes(own), key=key)


def test_nearest():
    rng = np.random.default_rng(1)
    for d in (1, 2, 9):
        for spread in (2, 50):
            x, book = rng.integers(-spread, spread, (d, 3000)), rng.integers(-spread, spread, (16, d))
            distance = ((x.T[:, None, :] - book[None]) ** 2).sum(axis=2)
            index, best = vector_codes.nearest(x, book)
            assert (index == distance.argmin(axis=1)).all() and (best == distance.min(axis=1)).all()


def test_codes_awkward(spark, tmp_path):
    schema = "vec_id long, embedding array<float>, label int"

    def write(name, rows):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        return str(tmp_path / name)

    assert vector_codes.query(spark, write("none", [])).count() == 0
    assert vector_codes.query(spark, write("null", [(1, None, 1)])).count() == 0
    for name, rows, what in (("mixed", [(1, [0.0] * 8, 1), (2, [0.0] * 16, 1)], "dimensions"), ("odd", [(1, [0.0] * 9, 1)], "divide"), ("large", [(1, [1e30] * 8, 1)], "too large"), ("wide", [(1, [1e8] * 64, 1)], "too large"), ("ids", [(None, [0.0] * 8, 1)], "no vector")):
        with pytest.raises(Exception, match=what):
            vector_codes.query(spark, write(name, rows)).collect()
    books = vector_codes.Codebooks(np.arange(2 * 3 * 2).reshape(2, 3, 2))
    assert vector_codes.decoded(bytes([1, 2]), books, 1).tolist() == [2.5, 3.5, 10.5, 11.5]
