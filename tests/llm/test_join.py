"""The Jaccard join against all pairs."""

import random

import pytest

from corvane.llm import jaccard_join
from tests.llm.common import awkward, documents, words


def brute(rows):
    sets = []
    for doc_id, text in rows:
        w = words(text)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                label[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted(repr((doc_id, len(s), least.get(root(i)) if s else doc_id)) for i, ((doc_id, _), s) in enumerate(zip(rows, sets, strict=True)))


def check(df):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"])) for r in jaccard_join.components(df).collect())
    assert got == brute(rows)


def varied(seed, families, each, edits):
    """Families of near copies around the threshold, with passages that all share."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=12)
    texts = []
    for _ in range(families):
        base = rng.choices(vocabulary, k=rng.choice([3, 8, 40, 120]))
        for _ in range(each):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.4:
                w[rng.randrange(len(w)) : 0] = passage
            texts.append(" ".join(x.upper() if rng.random() < 0.1 else x for x in w))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "families", "each", "edits"), [(1, 12, 6, 3), (2, 3, 60, 4)])
def test_against_all_pairs(spark, seed, families, each, edits):
    check(documents(spark, varied(seed, families, each, edits)))


def test_awkward(spark):
    check(awkward(spark))
    assert jaccard_join.components(awkward(spark).limit(0)).count() == 0


def test_threshold(spark):
    # 7 shingles of which 6 are shared by 8: exactly 0.75; and one less
    base = [f"a{i}" for i in range(11)]
    check(documents(spark, [" ".join(base), " ".join([*base[:10], "z"]), " ".join([*base[:9], "y", "z"])]))


def test_connected(spark):
    rng = random.Random(5)
    edges = {(a, b) for a, b in ((rng.randrange(300), rng.randrange(300)) for _ in range(220)) if a < b}
    label = {}
    for few in (0, 10, 1000):
        got = {r["node"]: r["label"] for r in jaccard_join.connected(spark.createDataFrame(sorted(edges), "a long, b long"), few).collect()}
        groups = {}
        for node, x in got.items():
            groups.setdefault(x, set()).add(node)
        label[few] = sorted(map(sorted, groups.values()))
        for a, b in edges:
            assert got[a] == got[b]
    assert label[0] == label[10] == label[1000]


def test_drop(spark):
    a, b = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen"
    docs = documents(spark, [a, b, a.upper(), "", "", None])
    docs = docs.unionByName(docs.where("doc_id = 1")).selectExpr("*", "1 AS component_id", "2 AS cls", "3 AS `a.b`")
    out = jaccard_join.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 1, 3, 4, 5]


def test_dealt_pivots(spark, monkeypatch):
    """The same components where every longer list and every class with partners is dealt over several tasks."""
    monkeypatch.setattr(jaccard_join, "PIVOT_ROWS", 20)
    monkeypatch.setattr(jaccard_join, "PARTNERS", 3)
    check(documents(spark, varied(7, 3, 50, 4)))


def shared_lines(n, seed=1):
    rng = random.Random(seed)
    lines = [" ".join(f"w{rng.randrange(5000)}" for _ in range(12)) for _ in range(24)]
    return [" ".join(rng.sample(lines, rng.randrange(8, 15))) for _ in range(n)]


def test_shared_lines_give_few_pairs(spark, monkeypatch):
    """Texts made of the same lines share many shingles and are not linked: pairs stay in proportion to the texts."""
    asked, verify = [], jaccard_join.verify
    monkeypatch.setattr(jaccard_join, "verify", lambda pairs, *rest: asked.append(pairs.count()) or verify(pairs, *rest))
    given = {}
    for n in (300, 1200):
        asked.clear()
        df = documents(spark, shared_lines(n))
        if n == 300:
            check(df)
        else:
            assert jaccard_join.components(df).where("doc_id <> component_id").count() < n / 100
        given[n] = sum(asked)
    # of 719,400 pairs
    assert given[1200] < 10 * 1200


def test_sketches_bound_the_intersection():
    import numpy as np

    rng = np.random.default_rng(4)
    for n in (5, 300, 70_000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 2**63, n // 2).astype(np.uint64) * np.uint64(2) + np.uint64(1)]))
        one, other = (np.frombuffer(jaccard_join._sketch(x), dtype=np.uint8) for x in (a, b))
        both = len(np.intersect1d(a, b))
        assert jaccard_join._may_share(one, other[None], np.array([both]))[0]
        assert n == 70_000 or not jaccard_join._may_share(one, other[None], np.array([n + 1]))[0]
