"""Toxicity: averaged subword-bag embeddings under a linear softmax.

A word is its whole form and its character n-grams of 3 to 5 with boundary
marks, each hashed into ``BUCKETS``; its vector is the mean of their
embeddings, a text's vector the mean over the words of its distinct parts between
white space, so a part that is repeated counts once, and an unseen misspelling
shares the n-grams of the words it resembles. Embeddings and softmax are
trained jointly in numpy (mini-batches, Adam) on a bounded sample of labelled
rows: at most about ``MAX_ROWS`` of each class and ``MAX_BYTES`` in all, taken
by a hash of the id, whole texts. A row of the sample goes only as a near copy
(``COPY``) of a row kept before with the same label. Of the buckets those are trained whose presence in
a text departs far enough from independence of the label; their weights are
scaled to one size and their embeddings decay. ``Setting`` is chosen by
``toxicity_folds``, inside the rows that may be learnt from.

Scoring uses that the model is linear in the bucket vectors: the margin of a
text is the mean over words of a number for each word. The broadcast is one
number for each bucket (1 MB). Words scored before are kept, a bounded
number for each task.

Defined results: empty and null texts, and texts without letters, get the
score of the bias alone; a document labelled twice is toxic if one label says
so; null labels are left out; with fewer than two classes labelled, the score
is the share of toxic labels (0 if none); repeated rows repeat.
"""

from __future__ import annotations

import logging
import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import wordhash
from corvane.llm.arrow import as_texts, by_place, pieces, record
from corvane.llm.language_id import fold
from corvane.storage import stored, table

BUCKETS = 1 << 18
DIMENSIONS = 4
#: Sampled rows by label.
MAX_ROWS = {1: 2000, 0: 6000}
#: Jaccard similarity of 5-word shingles from which two rows of one label are near copies.
COPY = 0.75
#: Bytes of the sampled texts, a quarter of them for label 1; the rows of the least hashes are taken.
MAX_BYTES = 48 << 20
#: Passes over the rows at least; few rows are gone through more often, for about STEPS updates.
EPOCHS = 10
STEPS = 620
BATCH = 128


@dataclass(frozen=True)
class Setting:
    """What ``toxicity_folds`` chooses from, by folds inside the rows that may be learnt from."""

    #: Buckets of fewer sample texts are left out.
    min_texts: int = 2
    #: And those whose presence in a text tells less of its label than this, in standard deviations.
    screen: float = 4.0
    decay: float = 0.01
    #: At most so many buckets are trained, those that tell most.
    most: int = 150
    #: At least so many, of few texts, whatever they tell.
    least: int = 40
    step: float = 0.05


SETTING = Setting()
#: Parts of a text whose words are kept scored by a task.
KEPT = 300_000

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

_WORD = re.compile(r"[^\W\d_]+")


_KEYS = [np.uint64(0x9E3779B97F4A7C15 * (2 * j + 1) % 2**64) for j in range(5)]


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of lower-case words and of their n-grams, and the number of each one's word; not in order."""
    sizes = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    codes = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words), dtype=np.int64), sizes)
    # the word as a whole
    place = np.arange(len(codes)) - starts[owner]
    found, owners = [np.add.reduceat(codes * wordhash.powers(int(sizes.max()))[place], starts) + np.uint64(1)], [np.arange(len(words))]
    for n in (3, 4, 5):
        count = len(codes) - n + 1
        if count <= 0:
            continue
        inside = np.flatnonzero(owner[:count] == owner[n - 1 :])
        value = codes[inside] * _KEYS[0]
        for j in range(1, n):
            value += codes[inside + j] * _KEYS[j]
        found.append(value + np.uint64(n))
        owners.append(owner[inside])
    return (wordhash.mix(np.concatenate(found)) >> np.uint64(46)).astype(np.int32), np.concatenate(owners)


class Bags:
    """For each text its distinct buckets and their weights, which add up to 1 (none: no words); made anew each time they are gone through."""

    def __init__(self, texts: list[str]):
        numbers: dict[str, int] = {}
        self._counts = []
        for t in texts:
            own = Counter(w for part in set(t.split()) for w in _WORD.findall(part.lower()))
            index = np.fromiter((numbers.setdefault(w, len(numbers)) for w in own), dtype=np.int32, count=len(own))
            order = np.argsort(index)
            self._counts.append((index[order], np.fromiter(own.values(), dtype=np.int32, count=len(own))[order]))
        words = list(numbers)
        parts, sizes = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int64)]
        for at in range(0, len(words), 1 << 15):
            ids, owner = subwords(words[at : at + (1 << 15)])
            parts.append(ids[np.argsort(owner, kind="stable")])
            sizes.append(np.bincount(owner, minlength=min(1 << 15, len(words) - at)))
        self._table, self._size = np.concatenate(parts), np.concatenate(sizes)
        self._start = np.cumsum(self._size) - self._size

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for index, n in self._counts:
            own = self._size[index]
            flat = np.repeat(self._start[index] - (np.cumsum(own) - own), own) + np.arange(own.sum())
            distinct, place = np.unique(self._table[flat], return_inverse=True)
            yield distinct, np.bincount(place, weights=np.repeat(n / max(1, n.sum()) / np.maximum(1, own), own)).astype(np.float32)


def first_of_copies(texts: list[str], labels: list[int]) -> list[int]:
    """Numbers of the texts that are no near copy of one kept before with the same label: their shingle sets have a Jaccard similarity below ``COPY``; exact."""
    sets = list(wordhash.shingle_sets([t.encode("utf-8", "replace") for t in texts]))
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    every = np.sort(np.concatenate([np.zeros(0, dtype=np.uint64), *sets]))
    # most shingles are in one text only and can be in no overlap: their number is enough
    shared = np.unique(every[1:][every[1:] == every[:-1]])
    held_by = np.searchsorted(every, shared, "right") - np.searchsorted(every, shared)
    del every
    for i, s in enumerate(sets):
        at = np.searchsorted(shared, s)
        sets[i] = at[(at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == s)].astype(np.int32) if len(shared) else at[:0].astype(np.int32)
    inside = np.zeros(len(shared), dtype=bool)
    # two sets as similar as that meet within the rarest of either, so only these are looked up
    holders: dict[int, dict[int, array]] = {}
    out = []
    for i, own in enumerate(sets):
        n = int(sizes[i])
        rare = own[np.argsort(held_by[own], kind="stable")][: max(0, len(own) - math.ceil(COPY * n) + 1)].tolist() if n else [-1]
        known = holders.setdefault(labels[i], {})
        near = np.unique(np.concatenate([np.zeros(0, dtype=np.int32), *(np.frombuffer(known[h], dtype=np.int32) for h in rare if h in known)]))
        if len(near):
            inside[own] = True
            both = np.bincount(np.repeat(np.arange(len(near)), [len(sets[j]) for j in near]), weights=inside[np.concatenate([sets[j] for j in near])], minlength=len(near))
            inside[own] = False
            if (both >= COPY * (n + sizes[near] - both)).any():
                continue
        out.append(i)
        for h in rare:
            known.setdefault(h, array("i")).append(i)
    return out


class Model:
    """One number for each bucket and a bias; the margin of label 1 over label 0."""

    def __init__(self, by_bucket: np.ndarray, bias: float):
        self.by_bucket, self.bias = by_bucket.astype(np.float32), bias

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Scores texts; keeps (sum of its words' numbers) + (its words) i of parts between white space."""

    def __init__(self, model: Model):
        self._values, self._bias = model.by_bucket.astype(np.float64), model.bias
        self._known: dict[str, complex] = {}

    def _add(self, parts: list[str]) -> None:
        words, owner = [], []
        for i, part in enumerate(parts):
            own = _WORD.findall(part.lower())
            words += own
            owner += [i] * len(own)
        sums, n = np.zeros(len(parts)), np.bincount(owner, minlength=len(parts)) if owner else np.zeros(len(parts))
        if words:
            ids, of = subwords(words)
            sums = np.bincount(owner, weights=np.bincount(of, weights=self._values[ids]) / np.bincount(of), minlength=len(parts))
        self._known.update(zip(parts, (sums + 1j * n).tolist(), strict=True))

    def scores(self, texts: list[str]) -> list[float]:
        out = []
        for at in range(0, len(texts), 128):
            split = [t.split() for t in texts[at : at + 128]]
            new = {p for parts in split for p in parts if p not in self._known}
            if len(self._known) + len(new) > KEPT:
                self._known.clear()
                new = {p for parts in split for p in parts}
            if new:
                self._add(sorted(new))
            get = self._known.__getitem__
            for parts in split:
                found = sum(map(get, sorted(set(parts))), 0j)
                margin = self._bias + (found.real / found.imag if found.imag else 0.0)
                out.append(1 / (1 + math.exp(-max(-60.0, min(60.0, margin)))))
        return out

    def score(self, text: str) -> float:
        return self.scores([text])[0]


def told(held_by: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """How far the presence of each bucket departs from independence of the label: the root of the likelihood ratio, 2 x buckets in."""
    share = held_by.sum(axis=0) / texts.sum()

    def gain(k: np.ndarray, n: int, p: np.ndarray) -> np.ndarray:
        return np.where(k > 0, k * np.log(np.maximum(k, 1) / np.maximum(n * p, 1e-300)), 0.0)

    total = sum(gain(k, n, share) + gain(n - k, n, 1 - share) for k, n in zip(held_by.astype(np.float64), texts.tolist(), strict=True))
    return np.sqrt(np.maximum(0.0, 2 * total))


def fit(texts: list[str], labels: list[int], setting: Setting = SETTING) -> Model:
    """Trains on texts in memory."""
    chosen = first_of_copies(texts, labels)
    y = np.array([labels[i] for i in chosen], dtype=np.int64)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(BUCKETS), 60.0 if share else -60.0)
    found = Bags([texts[i] for i in chosen])
    held_by, squares = np.zeros((2, BUCKETS), dtype=np.int32), np.zeros(BUCKETS)
    for label, (ids, weights) in zip(y.tolist(), found, strict=True):
        held_by[label, ids] += 1
        squares[ids] += weights.astype(np.float64) ** 2
    # only telling buckets are trained: all others add nothing
    tells = np.where(held_by.sum(axis=0) >= setting.min_texts, told(held_by, np.bincount(y, minlength=2)), 0.0)
    enough = min(setting.most, max(int((tells >= setting.screen).sum()), min(setting.least, int((tells > 0).sum()))))
    kept = np.sort(np.argsort(-tells, kind="stable")[:enough])
    number = np.full(BUCKETS, -1, dtype=np.int32)
    number[kept] = np.arange(len(kept))
    # a rare bucket's weights are scaled to those of a common one
    scale = np.concatenate([1 / np.sqrt(squares[kept] / len(y)), np.ones(int(not len(kept)))]).astype(np.float32)
    bags = []
    for ids, weights in found:
        at = number[ids]
        bags.append((at[at >= 0], weights[at >= 0] * scale[at[at >= 0]]))
    del found
    size, rng = max(1, len(kept)), np.random.default_rng(11)
    # the softmax starts at random, embeddings at zero
    params = {"E": np.zeros((size, DIMENSIONS), dtype=np.float32), "W": rng.normal(0, 1, (DIMENSIONS, 2)).astype(np.float32), "b": np.zeros(2, dtype=np.float32)}
    first = {k: np.zeros_like(v) for k, v in params.items()}
    second = {k: np.zeros_like(v) for k, v in params.items()}
    by_class = len(y) / (2 * np.bincount(y, minlength=2))
    steps, epochs = 0, max(EPOCHS, STEPS // -(-len(y) // BATCH))
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        step = setting.step * (1 - 0.9 * epoch / epochs)
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            n = len(rows)
            ids, weights = np.concatenate([bags[i][0] for i in rows]), np.concatenate([bags[i][1] for i in rows])
            owner = np.repeat(np.arange(n), [len(bags[i][0]) for i in rows])
            used = params["E"][ids]
            mean = np.stack([np.bincount(owner, weights=used[:, d] * weights, minlength=n) for d in range(DIMENSIONS)], axis=1)
            z = mean @ params["W"] + params["b"]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), y[rows]] -= 1
            p *= (by_class[y[rows]] / n)[:, None]
            back = (p @ params["W"].T).astype(np.float32)
            grads = {"E": np.stack([np.bincount(ids, weights=back[owner, d] * weights, minlength=size) for d in range(DIMENSIONS)], axis=1) + setting.decay * params["E"], "W": mean.T @ p, "b": p.sum(axis=0)}
            steps += 1
            for name, grad in grads.items():
                grad = grad.astype(np.float32)
                first[name] += 0.1 * (grad - first[name])
                second[name] += 0.01 * (grad * grad - second[name])
                params[name] -= step * (first[name] / (1 - 0.9**steps)) / (np.sqrt(second[name] / (1 - 0.99**steps)) + 1e-8)
    by_bucket = np.zeros(BUCKETS)
    by_bucket[kept] = (params["E"] @ (params["W"][:, 1] - params["W"][:, 0]) * scale)[: len(kept)]
    return Model(by_bucket, float(params["b"][1] - params["b"][0]))


def train(documents: DataFrame, labels: DataFrame, max_rows: dict[int, int] = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """From (doc_id, text) and (doc_id, toxic)."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    steps = 1 << 24
    share = F.lit(0)
    for label, n in sizes.items():
        share = F.when(F.col("toxic") == label, min(steps, -(-steps * max_rows.get(label, 0) // n))).otherwise(share)
    order = F.pmod(F.xxhash64("doc_id"), F.lit(steps))
    sample = marked.where(order < share)
    # about max_rows ids: a bounded broadcast, and as many texts come back
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = stored(documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(sample), "doc_id").select(order.alias("place"), "doc_id", "text", "toxic", F.octet_length("text").cast("long").alias("size")), "toxic-sample")
    # ids and sizes of the sample decide which texts come to the driver: what does not fit is passed over
    room = {1: max_bytes // 4, 0: max_bytes - max_bytes // 4}
    fits: list[tuple[int]] = []
    listed = rows.groupBy("toxic", "place", "doc_id").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    for r in sorted(listed, key=lambda r: (r["toxic"], r["place"], r["doc_id"])):
        if r["size"] <= room[r["toxic"]]:
            room[r["toxic"]] -= r["size"]
            fits.append((r["doc_id"],))
    if len(fits) < len(listed):
        logging.getLogger(__name__).warning("%d sampled rows beyond %d bytes are left out of the fit", len(listed) - len(fits), max_bytes)
    chosen_ids = documents.sparkSession.createDataFrame(fits, "doc_id long")
    bounded = rows.join(F.broadcast(chosen_ids), "doc_id", "left_semi").select("doc_id", "text", "toxic").collect()
    chosen = sorted((r["doc_id"], r["text"], r["toxic"]) for r in bounded)
    return fit([t for _, t, _ in chosen], [x for _, _, x in chosen])


def score(documents: DataFrame, model: Broadcast) -> DataFrame:
    """A row for each document, see SCHEMA; reads ``text``, and the id for the fold only."""

    def run(batches):
        known = model.value.scorer()
        for batch in pieces(batches):
            found = known.scores(as_texts(batch.column(2)))
            yield record(doc_id=(batch.column(0), pa.int64()), held_out=(batch.column(1), pa.bool_()), score=(found, pa.float64()), predicted=([int(x >= 0.5) for x in found], pa.int32()))

    return documents.select(F.col("doc_id").cast("long"), (fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def trained(spark: SparkSession, documents: DataFrame, sf_dir: str) -> Broadcast:
    """The model of the folds other than 0."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold(F.col("doc_id"), 5) != 0)
    return spark.sparkContext.broadcast(train(documents, labels))


def drop_toxic(documents: DataFrame, model: Broadcast) -> DataFrame:
    """The rows, all columns, that the model does not reject."""
    at = documents.columns.index("text")

    def run(batches):
        known = model.value.scorer()
        for batch in pieces(batches):
            yield batch.filter(pa.array([x < 0.5 for x in known.scores(as_texts(batch.column(at)))], pa.bool_()))

    return by_place(documents, run)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(documents, trained(spark, documents, sf_dir))
