"""Language identification by multinomial naive Bayes over hashed character n-grams.

A text is read as lower-case letters, everything else being one space. Its
n-grams of ``ORDERS`` characters are hashed into ``BUCKETS`` counts. Training
sums counts by language over a bounded sample: at most about
``MAX_PER_LANGUAGE`` rows of each language, taken by a hash of the id (all rows
of rarer languages), whole texts. The smoothed log-probability matrix
(buckets x languages, 4 bytes each) is broadcast; a batch is scored as the
sparse matrix of its texts' buckets (CSR, repeated entries not summed up) times
that matrix, in numpy. Priors come from all labelled rows.

Defined results: texts that are null or have no letter are ``und`` with score
0; so is every text if no row is labelled; a null id counts as the empty text
for the fold; repeated rows repeat. The score is the posterior probability.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.arrow import as_texts, pieces, record
from corvane.storage import table

ORDERS = (2, 3, 4)
BUCKETS = 1 << 15
MAX_PER_LANGUAGE = 3000
SMOOTHING = 0.1
UNDETERMINED = "und"
#: Characters worked on at once.
BLOCK = 1 << 20

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"

_KEYS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], dtype=np.uint32)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case code point of each letter, a space for anything else."""
    return np.array([(ord(low) if len(low := c.lower()) == 1 else k) if (c := chr(k)).isalpha() else 32 for k in range(0x110000)], dtype=np.uint32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all n-grams and where each text's begin (CSR); texts must have a letter."""
    raw = np.frombuffer(("\0" + "\0\0".join(texts) + "\0").encode("utf-32-le", "replace"), dtype=np.uint32)
    # a text stands between two spaces of its own
    sizes = np.fromiter((len(t) + 2 for t in texts), dtype=np.int64, count=len(texts))
    codes = _letters()[np.minimum(raw, 0x10FFFF)]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    space = codes == 32
    kept = np.ones(len(codes), dtype=bool)
    kept[1:] = ~(space[1:] & space[:-1]) | (owner[1:] != owner[:-1])
    codes, owner = codes[kept], owner[kept]
    found, owners = [], []
    for n in ORDERS:
        count = len(codes) - n + 1
        if count <= 0:
            continue
        h = codes[:count] * _KEYS[0]
        for j in range(1, n):
            h = (h ^ (h >> np.uint32(13))) + codes[j : j + count] * _KEYS[j]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        inside = owner[:count] == owner[n - 1 :]
        found.append((h >> np.uint32(17))[inside])
        owners.append(owner[:count][inside])
    which = np.concatenate(owners)
    order = np.argsort(which, kind="stable")
    return np.concatenate(found)[order], np.searchsorted(which[order], np.arange(len(texts) + 1))


def _blocks(texts: list[str]):
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > BLOCK:
            yield begin, i
            begin, held = i, 0
        held += len(t)
    if begin < len(texts):
        yield begin, len(texts)


class Model:
    """Languages and their log-probabilities by bucket."""

    def __init__(self, counts: dict[str, np.ndarray], rows: dict[str, int]):
        self.languages = sorted(counts)
        total = sum(rows[x] for x in self.languages) or 1
        self.priors = np.array([np.log(rows[x] / total) for x in self.languages])
        self.log_p = [np.log((counts[x] + SMOOTHING) / (counts[x].sum() + SMOOTHING * BUCKETS)).astype(np.float32) for x in self.languages]

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        out = [(UNDETERMINED, 0.0)] * len(texts)
        if not self.languages:
            return out
        known = [i for i, t in enumerate(texts) if has_letter(t)]
        for begin, end in _blocks([texts[i] for i in known]):
            chosen = known[begin:end]
            index, bounds = features([texts[i] for i in chosen])
            scores = np.stack([np.add.reduceat(p[index], bounds[:-1], dtype=np.float64) for p in self.log_p], axis=1) + self.priors
            scores -= scores.max(axis=1, keepdims=True)
            best = scores.argmax(axis=1)
            posterior = 1 / np.exp(scores).sum(axis=1)
            for i, k, p in zip(chosen, best.tolist(), posterior.tolist(), strict=True):
                out[i] = self.languages[k], min(1.0, p)
        return out


def fold(doc_id: F.Column, folds: int) -> F.Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def train(rows: DataFrame, max_per_language: int = MAX_PER_LANGUAGE) -> Model:
    """From (doc_id, text, lang); rows without a language are left out."""
    rows = rows.where(F.col("lang").isNotNull())
    # one row for each language, not for each document
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model({}, {})
    steps = 1 << 24
    shares = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(steps, -(-steps * max_per_language // n)))])
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(steps)) < shares[F.col("lang")])

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in pieces(batches, 512):
            langs, texts = batch.column(0).to_pylist(), as_texts(batch.column(1))
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang and has_letter(t)]
                total = counts.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                for begin, end in _blocks(own):
                    total += np.bincount(features(own[begin:end])[0], minlength=BUCKETS)
        yield record(lang=(list(counts), pa.string()), counts=([x.tobytes() for x in counts.values()], pa.binary()))

    # the sample is bounded, so a fixed number of tasks counts it and 8 matrices come back
    found: dict[str, np.ndarray] = {}
    for r in sample.select("lang", "text").repartition(8).mapInArrow(run, "lang string, counts binary").toLocalIterator():
        found[r["lang"]] = found.get(r["lang"], 0) + np.frombuffer(bytes(r["counts"]), dtype=np.int64)
    return Model(found, {k: sizes[k] for k in found})


def predict(documents: DataFrame, model: Broadcast, folds: int = 3, held: int = 1) -> DataFrame:
    """A row for each document, see SCHEMA; reads ``text``, and the id for the fold only."""

    def run(batches):
        known = model.value
        for batch in pieces(batches):
            found = known.predict(as_texts(batch.column(2)))
            yield record(doc_id=(batch.column(0), pa.int64()), held_out=(batch.column(1), pa.bool_()), lang_pred=([x for x, _ in found], pa.string()), score=([p for _, p in found], pa.float64()))

    return documents.select(F.col("doc_id").cast("long"), (fold(F.col("doc_id"), folds) == held).alias("held_out"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(documents.where(fold(F.col("doc_id"), 3) != 1))
    return predict(documents, spark.sparkContext.broadcast(model))
