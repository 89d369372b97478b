"""Exact n-gram Jaccard self-join by rare-first prefix filtering.

A document's set holds 64-bit hashes of its distinct 5-word shingles. Documents
with equal sets are one class from the start, so exact copies never meet again.

1. ``features``: one pass gives each row's set size and class, and counts all
   shingles into a table of ``SLOTS`` counters, summed by slices. Quantised to
   a byte each (2 MB in all, whatever the corpus) it is broadcast: shingles are
   ordered by (counter, hash). Any common order is exact; this one is rare-first.
2. ``postings``: each class sends its prefix, the rarest quarter of its set
   (size - ceil(0.75 size) + 1), dealt out by shingle as packed blocks.
3. Classes of similar size that share a prefix shingle are candidates. A list of
   up to ``SMALL`` classes gives all its pairs with what they share there; summed
   over lists, the positional filter bounds a pair's intersection by the shingles
   shared in both prefixes plus what can follow (a class's longer lists count as
   shared). A longer list pairs one pivot with the others; then each class tries
   ``TRIES`` members of other components, turn by turn, in the end all of them.
   Links inside a component change nothing, so none that matters is lost, and a
   large group of near copies costs few pairs for each of its members. Before a
   pair of a longer list is given, a suffix filter compares the sketches of its
   classes (shingles by hash range), so lists of unlike texts give few pairs.
   Lists of one component are not read again; the lists of one pivot are dealt over
   as many tasks as they need.
4. ``verify``: distinct candidate pairs, none twice, meet the sets of their two
   classes; the suffix filter goes before the exact count here too.
   Sets are made anew for the classes that have candidates only, picked by a
   bitmap over text hashes of at most ``BITMAP_BITS`` bits; a full bitmap lets
   more texts through and stays exact.
5. ``connected``: components of the links by hooking to random neighbours and
   contracting, on tables in the shared folder, until few edges are left.

Nothing about documents is collected: the driver sees counts, the counters'
bytes and the bitmap. A posting list is held by one task at 24 bytes a class.

Defined results: null and empty texts and texts without words have size 0 and
are linked with nothing; repeated rows are linked if they have words, and share
a row's id; a null id is never the smallest, a component of null ids only has a
null ``component_id``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import wordhash
from corvane.llm.arrow import as_bytes, pieces, record
from corvane.storage import new_path, scratch, stored, table

WIDTH = 5
SLOTS = 1 << 21
SLICE = 1 << 16
#: Posting lists up to this many classes give all their pairs at once.
SMALL = 12
#: Members of other components that a class of a longer list tries in each turn; None: all.
TRIES = (8, None)
BITMAP_BITS = 1 << 27
#: Postings packed before blocks go out, and bytes of them for a task.
PACKED = 1 << 19
TASK_BYTES = 12 << 20
BUCKETS = 256
#: Ids that may be broadcast; beyond, rows are dropped by a shuffled join.
BROADCAST_IDS = 1_000_000
#: Pairs counted at once.
COUNTED = 1 << 16
#: Edges that one task may join.
FEW_EDGES = 200_000
#: Hash ranges of a set's sketch.
RANGES = 256
#: Rows of one pivot's lists, and partners of one class, that a task takes; a larger number is dealt over several.
PIVOT_ROWS = 4096
PARTNERS = 1024

_POSTING = np.dtype([("shingle", "<u8"), ("cls", "<i8"), ("size", "<u4"), ("place", "<u4")])


def needed(a, b):
    """Least intersection of linked sets of sizes a and b: 100 i >= 75 (a + b - i)."""
    return -(-3 * (a + b) // 7)


def prefix(n: int) -> int:
    return n - -(-3 * n // 4) + 1


def _classes(shingles: np.ndarray, seed: int) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set."""
    sums = np.array([wordhash.mix(shingles + np.uint64(0xA0761D6478BD642F + seed)).sum(dtype=np.uint64), wordhash.mix(shingles ^ np.uint64(0xE7037ED1A0B428DB - seed)).sum(dtype=np.uint64)])
    one, two = wordhash.mix(sums + np.uint64(len(shingles))).view(np.int64).tolist()
    return one, two


def _text_key(text: bytes) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(text)).view(np.int64))


def features(documents: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, n, cls, extra (second hash) and text_key of each row; rows with ``slice`` hold counters instead."""

    def run(batches):
        slots = np.zeros(SLOTS, dtype=np.uint32)
        waiting: list[np.ndarray] = []
        held = 0
        seen: set[int] = set()
        for batch in pieces(batches):
            texts = as_bytes(batch.column(1))
            out: list[tuple] = []
            for shingles, text in zip(wordhash.shingle_sets(texts, WIDTH), texts, strict=True):
                cls, extra = _classes(shingles, seed) if len(shingles) else (None, None)
                out.append((len(shingles), cls, extra, _text_key(text)))
                if cls is not None and cls not in seen:
                    seen.add(cls)
                    waiting.append((shingles >> np.uint64(43)).astype(np.int32))
                    held += len(shingles)
            if held >= 1 << 20:
                slots += np.bincount(np.concatenate(waiting), minlength=SLOTS).astype(np.uint32)
                waiting, held = [], 0
            n = batch.num_rows
            yield record(doc_id=(batch.column(0), pa.int64()), n=([x[0] for x in out], pa.int64()), cls=([x[1] for x in out], pa.int64()), extra=([x[2] for x in out], pa.int64()), text_key=([x[3] for x in out], pa.int64()), slice=([None] * n, pa.int32()), counters=([None] * n, pa.binary()))
        if waiting:
            slots += np.bincount(np.concatenate(waiting), minlength=SLOTS).astype(np.uint32)
        if seen:
            small = np.minimum(slots, 65535).astype(np.uint16).reshape(-1, SLICE)
            packer = zstandard.ZstdCompressor(level=1)
            n = len(small)
            none = [None] * n
            yield record(doc_id=(none, pa.int64()), n=(none, pa.int64()), cls=(none, pa.int64()), extra=(none, pa.int64()), text_key=(none, pa.int64()), slice=(list(range(n)), pa.int32()), counters=([packer.compress(x.tobytes()) for x in small], pa.binary()))

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, cls long, extra long, text_key long, slice int, counters binary")


def rarity(slices: DataFrame) -> Broadcast:
    """A byte for each slot, larger for more frequent; from rows (slice, counters)."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(unpack.decompress(raw), dtype=np.uint16).astype(np.int64)
        levels = [np.minimum(255, np.round(8 * np.log2(1 + x))).astype(np.uint8).tobytes() for x in sums.values()]
        yield record(slice=(list(sums), pa.int32()), level=(levels, pa.binary()))

    out = np.zeros(SLOTS, dtype=np.uint8)
    for r in slices.repartition(SLOTS // SLICE, "slice").mapInArrow(run, "slice int, level binary").collect():
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(bytes(r["level"]), dtype=np.uint8)
    return slices.sparkSession.sparkContext.broadcast(out.tobytes())


def postings(documents: DataFrame, order: Broadcast, seed: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, block): packed postings of each class's prefix; a class that several tasks meet comes once from each."""

    def run(batches):
        levels = np.frombuffer(order.value, dtype=np.uint8)
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0
        for batch in pieces(batches):
            for shingles in wordhash.shingle_sets(as_bytes(batch.column(0)), WIDTH):
                n = len(shingles)
                if n == 0 or (cls := _classes(shingles, seed)[0]) in seen:
                    continue
                seen.add(cls)
                # stable by hash within a level: sets are sorted
                rare = np.argsort(levels[(shingles >> np.uint64(43)).astype(np.int64)], kind="stable")[: prefix(n)]
                entry = np.empty(len(rare), dtype=_POSTING)
                entry["shingle"], entry["cls"], entry["size"], entry["place"] = shingles[rare], cls, n, np.arange(len(rare))
                held.append(entry)
                size += len(entry)
                if size >= PACKED:
                    yield _blocks(held, buckets)
                    held, size = [], 0
        if held:
            yield _blocks(held, buckets)

    return documents.select(F.col("text").cast("string")).mapInArrow(run, "bucket int, block binary")


def _blocks(held: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    all_ = np.concatenate(held)
    bucket = (all_["shingle"] % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    all_, bucket = all_[order], bucket[order]
    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    return record(bucket=(pa.array(bucket[starts]), pa.int32()), block=([x.tobytes() for x in np.split(all_, starts[1:])], pa.binary()))


def _passes(size_a, place_a, size_b, place_b):
    """Length and positional filters at a shared shingle; exact if it is the first that a pair shares."""
    least = needed(size_a, size_b)
    return (4 * np.minimum(size_a, size_b) >= 3 * np.maximum(size_a, size_b)) & (size_a - place_a >= least) & (size_b - place_b >= least)


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)


def _rank(classes: np.ndarray, turn: int) -> np.ndarray:
    return wordhash.mix(classes.view(np.uint64) + np.uint64(0x2545F4914F6CDD1D * (turn + 1) % 2**64))


def _sketch(shingles: np.ndarray) -> bytes:
    """How many shingles fall into each of RANGES hash ranges; a byte each, 255: that or more."""
    return np.minimum(np.bincount((shingles >> np.uint64(64 - RANGES.bit_length() + 1)).astype(np.int64), minlength=RANGES), 255).astype(np.uint8).tobytes()


def _may_share(one: np.ndarray, others: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Suffix filter: what two sets share within a hash range is bounded by the smaller count there."""
    out = np.ones(len(others), dtype=bool)
    for at in range(0, len(others), 1 << 13):
        part = others[at : at + (1 << 13)]
        # a count of 255 bounds nothing
        open_ = ((part == 255) & (one == 255)).any(axis=1)
        out[at : at + (1 << 13)] = open_ | (np.minimum(part, one).sum(axis=1, dtype=np.int64) >= least[at : at + (1 << 13)])
    return out


def _against(members: np.ndarray, one: int, others: np.ndarray, sketches: np.ndarray | None = None) -> np.ndarray:
    """Pairs of a member and others of its list that pass the filters."""
    p, m = members[one], members[others]
    ok = _passes(np.int64(p["size"]), np.int64(p["place"]), m["size"].astype(np.int64), m["place"].astype(np.int64))
    if sketches is not None:
        others, m = others[ok], m[ok]
        ok = _may_share(sketches[one], sketches[others], needed(np.int64(p["size"]), m["size"].astype(np.int64)))
    return _pairs(np.full(ok.sum(), p["cls"]), m["cls"][ok])


#: From short lists: a, b, sizes, shared shingles and the least that can follow; from longer ones: a, b; or a list.
_FOUND = "a long, b long, size_a long, size_b long, shared long, rest long, shingle long, members binary"


def _found(pairs: np.ndarray | None = None, counted: np.ndarray | None = None, lists: list[tuple[int, bytes]] = ()) -> Iterator[pa.RecordBatch]:
    for rows in (pairs, counted):
        for at in range(0, 0 if rows is None else len(rows), 1 << 16):
            part = rows[at : at + (1 << 16)]
            columns = [pa.array(part[:, k]) for k in range(part.shape[1])] + [pa.nulls(len(part), pa.int64())] * (6 - part.shape[1])
            yield record(**{name: (c, pa.int64()) for name, c in zip(("a", "b", "size_a", "size_b", "shared", "rest"), columns, strict=True)}, shingle=(pa.nulls(len(part), pa.int64()), pa.int64()), members=(pa.nulls(len(part), pa.binary()), pa.binary()))
    for at in range(0, len(lists), 64):
        part = lists[at : at + 64]
        none = pa.nulls(len(part), pa.int64())
        yield record(**{name: (none, pa.int64()) for name in ("a", "b", "size_a", "size_b", "shared", "rest")}, shingle=([k for k, _ in part], pa.int64()), members=([m for _, m in part], pa.binary()))


def _summed(rows: np.ndarray) -> np.ndarray:
    """Rows (a, b, size_a, size_b, shared, rest) by pair: shared summed, the least rest."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    starts = np.flatnonzero(np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1))))
    out = rows[starts].copy()
    out[:, 4] = np.add.reduceat(rows[:, 4], starts)
    out[:, 5] = np.minimum.reduceat(rows[:, 5], starts)
    return out


def _short(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Counted rows of pairs at shared shingles, similar sizes only."""
    x, y = x.ravel(), y.ravel()
    n, m = x["size"].astype(np.int64), y["size"].astype(np.int64)
    ok = 4 * np.minimum(n, m) >= 3 * np.maximum(n, m)
    x, y, n, m = x[ok], y[ok], n[ok], m[ok]
    rest = np.minimum(n - 1 - x["place"], m - 1 - y["place"])
    turned = x["cls"] > y["cls"]
    return _summed(np.stack([np.minimum(x["cls"], y["cls"]), np.maximum(x["cls"], y["cls"]), np.where(turned, m, n), np.where(turned, n, m), np.ones_like(n), rest], axis=1)) if len(x) else np.zeros((0, 6), dtype=np.int64)


def candidates(blocks: DataFrame, partitions: int) -> DataFrame:
    """Pairs and longer lists, in the columns of _FOUND."""

    def run(batches):
        raw = [x for batch in batches for x in batch.column(1).to_pylist()]
        if not raw:
            return
        all_ = np.frombuffer(b"".join(raw), dtype=_POSTING)
        del raw
        # few shingles are shared: sort those only
        order = np.argsort(all_["shingle"], kind="stable")
        key = all_["shingle"][order]
        same = np.zeros(len(key) + 1, dtype=bool)
        same[1:-1] = key[1:] == key[:-1]
        all_ = all_[order[same[1:] | same[:-1]]]
        all_ = all_[np.lexsort((all_["cls"], all_["shingle"]))]
        if len(all_) == 0:
            return
        fresh = np.ones(len(all_), dtype=bool)
        fresh[1:] = (all_["shingle"][1:] != all_["shingle"][:-1]) | (all_["cls"][1:] != all_["cls"][:-1])
        all_ = all_[fresh]
        starts = np.flatnonzero(np.concatenate(([True], all_["shingle"][1:] != all_["shingle"][:-1])))
        lengths = np.diff(np.append(starts, len(all_)))
        counted = [np.zeros((0, 6), dtype=np.int64)]
        for m in range(2, SMALL + 1):
            first = starts[lengths == m]
            i, j = np.triu_indices(m, 1)
            for part in np.array_split(first, -(-len(first) * len(i) // COUNTED)) if len(first) else ():
                counted.append(_short(all_[part[:, None] + i], all_[part[:, None] + j]))
                if sum(map(len, counted)) > 4 * COUNTED:
                    yield from _found(counted=_summed(np.concatenate(counted)))
                    counted = counted[:1]
        if sum(map(len, counted)):
            yield from _found(counted=_summed(np.concatenate(counted)))
        pairs: list[np.ndarray] = []
        lists: list[tuple[int, bytes]] = []
        for start, n in zip(starts[lengths > SMALL].tolist(), lengths[lengths > SMALL].tolist(), strict=True):
            members = all_[start : start + n]
            pivot = int(_rank(members["cls"], 0).argmin())
            pairs.append(_against(members, pivot, np.delete(np.arange(n), pivot)))
            lists.append((int(members["shingle"][:1].view(np.int64)[0]), members.tobytes()))
        yield from _found(np.unique(np.concatenate(pairs), axis=0) if pairs else None, None, lists)

    return blocks.repartition(partitions, "bucket").mapInArrow(run, _FOUND)


def _unpacked(lists: DataFrame) -> DataFrame:
    """(pivot, shingle, cls, size, place) of each member of each list."""

    def run(batches):
        for batch in batches:
            for shingle, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                m = np.frombuffer(raw, dtype=_POSTING)
                pivot = int(m["cls"][_rank(m["cls"], 0).argmin()])
                yield record(pivot=([pivot] * len(m), pa.int64()), shingle=([shingle] * len(m), pa.int64()), cls=(pa.array(m["cls"]), pa.int64()), size=(pa.array(m["size"].astype(np.int64)), pa.int64()), place=(pa.array(m["place"].astype(np.int64)), pa.int64()))

    return lists.select("shingle", "members").mapInArrow(run, "pivot long, shingle long, cls long, size long, place long")


def positional(counted: DataFrame, lists: DataFrame) -> DataFrame:
    """(a, b) of the counted pairs whose sets may still be linked."""
    in_long = _unpacked(lists).groupBy("cls").agg(F.count("*").alias("k"))
    summed = counted.groupBy("a", "b", "size_a", "size_b").agg(F.sum("shared").alias("shared"), F.min("rest").alias("rest"))
    known = summed.join(in_long.select(F.col("cls").alias("a"), F.col("k").alias("long_a")), "a", "left").join(in_long.select(F.col("cls").alias("b"), F.col("k").alias("long_b")), "b", "left")
    # common shingles outside the shorter-reaching prefix lie in what is left of that set
    left = F.greatest(F.expr("(3 * size_a + 3) div 4"), F.expr("(3 * size_b + 3) div 4")) - 1
    most = F.col("shared") + F.least(F.coalesce("long_a", F.lit(0)), F.coalesce("long_b", F.lit(0))) + F.least(F.col("rest"), left)
    return known.where(most >= F.expr("(3 * (size_a + size_b) + 6) div 7")).select("a", "b")


def _open_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists with members of different components."""
    known = _unpacked(lists).join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("shingle", F.coalesce("label", "cls").alias("label"))
    mixed = known.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("shingle")
    return lists.join(mixed, "shingle", "left_semi")


def _dealt(rows: DataFrame, key: str, by: str, limit: int, counts: DataFrame) -> DataFrame:
    """The rows with ``salt``: 0, or for keys with more than ``limit`` rows a number by the hash of ``by``; counts: (key, n)."""
    heavy = counts.where(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("int").alias("parts"))
    # at most rows / limit keys are heavy
    heavy = F.broadcast(heavy) if heavy.count() <= BROADCAST_IDS else heavy
    return rows.join(heavy, key, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("parts")), F.lit(0)).cast("int")).drop("parts")


def more_candidates(lists: DataFrame, labels: DataFrame, sets: DataFrame, turn: int, tries: int | None, partitions: int) -> DataFrame:
    """Pairs between members of a list that are in different components, and lists that have such members."""
    rows = stored(_unpacked(lists), "members")
    rows = _dealt(rows, "pivot", "shingle", PIVOT_ROWS, rows.groupBy("pivot").agg(F.count("*").alias("n")))
    known = rows.join(labels.withColumnRenamed("node", "cls"), "cls", "left").join(sets.select("cls", "sketch"), "cls").select("pivot", "salt", "shingle", "cls", "size", "place", F.coalesce("label", "cls").alias("label"), "sketch")

    def pair(members: np.ndarray, label: np.ndarray, sketches: np.ndarray, pairs: list[np.ndarray]) -> bool:
        names, group, counts = np.unique(label, return_inverse=True, return_counts=True)
        if len(names) < 2:
            return False
        # every pair across components has an end outside the largest
        largest = int(counts.argmax())
        order = _rank(members["cls"], turn)
        # only sets of similar size can be linked
        by_size = np.argsort(members["size"], kind="stable")
        sizes = members["size"][by_size].astype(np.int64)
        for i in np.flatnonzero(group != largest).tolist():
            n = int(members["size"][i])
            near = by_size[np.searchsorted(sizes, -(-3 * n // 4)) : np.searchsorted(sizes, 4 * n // 3, "right")]
            others = near[(group[near] != group[i]) & ((group[near] == largest) | (near > i))] if tries is None else near[group[near] != group[i]]
            if tries is not None and len(others) > tries:
                others = others[np.argpartition(order[others] ^ order[i], tries)[:tries]]
            pairs.append(_against(members, i, others, sketches))
        return True

    def run(batches):
        pairs: list[np.ndarray] = []
        kept: list[tuple[int, bytes]] = []
        held: list[list[np.ndarray]] = []
        raw: list[list[bytes]] = []

        def close():
            if held:
                _, _, shingle, cls, size, place, label = (np.concatenate(x) for x in zip(*held, strict=True))
                m = np.empty(len(cls), dtype=_POSTING)
                m["shingle"], m["cls"], m["size"], m["place"] = shingle.view(np.uint64), cls, size, place
                sketches = np.frombuffer(b"".join(x for part in raw for x in part), dtype=np.uint8).reshape(len(m), RANGES)
                order = np.argsort(cls, kind="stable")
                if pair(m[order], label[order], sketches[order], pairs) and tries is not None:
                    kept.append((int(shingle[0]), m[order].tobytes()))
                held.clear()
                raw.clear()
                if sum(map(len, pairs)) > 1 << 20:
                    pairs[:] = [np.unique(np.concatenate(pairs), axis=0)]

        before = None
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
            sketch = batch.column(7).to_pylist()
            cuts = [0, *(np.flatnonzero(columns[2][1:] != columns[2][:-1]) + 1).tolist(), batch.num_rows]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if y > x:
                    here = int(columns[0][x]), int(columns[2][x])
                    if before is not None and here != before:
                        close()
                        if here[0] != before[0]:
                            yield from _found(np.unique(np.concatenate(pairs), axis=0) if pairs else None, None, kept)
                            pairs, kept = [], []
                    before = here
                    held.append([c[x:y] for c in columns])
                    raw.append(sketch[x:y])
        close()
        yield from _found(np.unique(np.concatenate(pairs), axis=0) if pairs else None, None, kept)

    return known.repartition(partitions, "pivot", "salt").sortWithinPartitions("pivot", "salt", "shingle").mapInArrow(run, _FOUND)


def bitmap(keys: DataFrame, count: int) -> tuple[int, Broadcast]:
    """Bits set for hashes in column ``key``: about 16 bits a key, BITMAP_BITS at most."""
    bits = SLICE
    while bits < min(16 * count, BITMAP_BITS):
        bits *= 2

    def run(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            place = batch.column(0).to_numpy()
            for k in np.unique(place // SLICE).tolist():
                own = found.setdefault(k, np.zeros(SLICE, dtype=bool))
                own[place[place // SLICE == k] % SLICE] = True
        yield record(slice=(list(found), pa.int32()), bits=([np.packbits(x, bitorder="little").tobytes() for x in found.values()], pa.binary()))

    place = keys.select(F.pmod("key", F.lit(bits)).alias("place")).distinct()
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in place.repartition(F.floor(F.col("place") / SLICE)).mapInArrow(run, "slice int, bits binary").collect():
        out[r["slice"] * SLICE // 8 : (r["slice"] + 1) * SLICE // 8] |= np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return bits, keys.sparkSession.sparkContext.broadcast(out.tobytes())


def sets_of(documents: DataFrame, bits: int, wanted: Broadcast, seed: int = 0) -> DataFrame:
    """(cls, shingles, sketch) of the texts whose hash is in the bitmap, a class once."""

    def run(batches):
        known = np.frombuffer(wanted.value, dtype=np.uint8)
        seen: set[int] = set()
        for batch in pieces(batches):
            texts = []
            for t in as_bytes(batch.column(0)):
                place = xxhash.xxh3_64_intdigest(t)
                place = (place - (1 << 64) if place >> 63 else place) % bits
                if known[place >> 3] >> (place & 7) & 1:
                    texts.append(t)
            out = {}
            for shingles in wordhash.shingle_sets(texts, WIDTH):
                if len(shingles) and (cls := _classes(shingles, seed)[0]) not in seen:
                    seen.add(cls)
                    out[cls] = shingles.tobytes(), _sketch(shingles)
            yield record(cls=(list(out), pa.int64()), shingles=([x for x, _ in out.values()], pa.binary()), sketch=([x for _, x in out.values()], pa.binary()))

    return documents.select(F.col("text").cast("string")).mapInArrow(run, "cls long, shingles binary, sketch binary").groupBy("cls").agg(F.first("shingles").alias("shingles"), F.first("sketch").alias("sketch"))


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are; the suffix filter goes before the exact count."""
    least = needed(len(a), len(b))
    if min(len(a), len(b)) < least:
        return False
    cuts = np.arange(1, 16, dtype=np.uint64) << np.uint64(60)
    in_a = np.diff(np.concatenate(([0], np.searchsorted(a, cuts), [len(a)])))
    in_b = np.diff(np.concatenate(([0], np.searchsorted(b, cuts), [len(b)])))
    if np.minimum(in_a, in_b).sum() < least:
        return False
    at = np.searchsorted(a, b)
    return int((a[np.minimum(at, len(a) - 1)] == b).sum()) >= least


def verify(pairs: DataFrame, sets: DataFrame, partitions: int) -> DataFrame:
    """The pairs (a, b) whose sets are linked.

    A class with more than PARTNERS partners stands on the left and is dealt,
    with a copy of its set each, over as many tasks as it needs.
    """
    ends = pairs.select(F.col("a").alias("cls")).unionAll(pairs.select(F.col("b").alias("cls"))).groupBy("cls").agg(F.count("*").alias("n")).where(F.col("n") > PARTNERS)
    ends = stored(ends, "heavy")
    few = ends.count() <= BROADCAST_IDS
    hint = F.broadcast if few else (lambda df: df)
    both = pairs.join(hint(ends.select(F.col("cls").alias("a"), F.col("n").alias("na"))), "a", "left").join(hint(ends.select(F.col("cls").alias("b"), F.col("n").alias("nb"))), "b", "left")
    turned = F.coalesce("nb", F.lit(0)) > F.coalesce("na", F.lit(0))
    both = both.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"), F.ceil(F.greatest(F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0))) / PARTNERS).cast("int").alias("parts"))
    both = both.select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.nullif("parts", F.lit(0))), F.lit(0)).cast("int").alias("salt"))
    with_b = both.join(sets.select(F.col("cls").alias("b"), "shingles"), "b").select("a", "salt", "b", "shingles")
    pivots = both.select("a", "salt").distinct().join(sets.select(F.col("cls").alias("a"), "shingles"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "shingles")

    def run(batches):
        current, own = None, None
        for batch in pieces(batches, 512):
            out = []
            for a, salt, b, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                other = np.frombuffer(raw, dtype=np.uint64)
                if b is None:
                    current, own = (a, salt), other
                elif (a, salt) != current:
                    raise ValueError("a candidate's set is missing")
                elif _linked(own, other):
                    out.append((a, b))
            yield record(a=([x for x, _ in out], pa.int64()), b=([y for _, y in out], pa.int64()))

    return with_b.unionByName(pivots).repartition(partitions, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(run, "a long, b long")


def _joined_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one task; a component's label is its smallest node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield record(node=(nodes, pa.int64()), label=([root(x) for x in nodes], pa.int64()))


def connected(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """(node, label): equal labels in a component. Nodes without an edge are not listed.

    While there are more than ``few`` edges, each node hooks to the neighbour of
    the least random rank and the graph is contracted; ``few`` edges, a bound
    of 16 bytes each, are finished by one task.
    """
    labels: DataFrame | None = None
    level = 0
    while edges.count() > few:
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c, level=level: F.struct(F.xxhash64(F.lit(level), F.col(c)).alias("rank"), F.col(c).alias("node"))
        hooked = stored(both.groupBy("a").agg(F.min(rank("b")).alias("near")).select(F.col("a").alias("node"), F.least(F.col("near"), rank("a"))["node"].alias("label")), "hooked")
        labels = hooked if labels is None else stored(_moved(labels, hooked), "moved")
        a = hooked.select(F.col("node").alias("a"), F.col("label").alias("la"))
        b = hooked.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        edges = stored(edges.join(a, "a").join(b, "b").where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "contracted")
        level += 1
    last = edges.select("a", "b").repartition(1).mapInArrow(_joined_in_task, "node long, label long")
    return last if labels is None else _moved(labels, last)


def _moved(labels: DataFrame, step: DataFrame) -> DataFrame:
    """Labels after their own labels have moved."""
    return labels.join(step.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left").select("node", F.coalesce("next", "label").alias("label"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def components(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each row."""
    for seed in range(8):
        both = stored(features(documents, seed), "features")
        rows = both.where("slice IS NULL").select("doc_id", "n", "cls", "extra", "text_key")
        classes = stored(rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.min("text_key").alias("key"), F.min("extra").alias("low"), F.max("extra").alias("high"), F.max("n").alias("n")), "classes")
        # two sets with one hash: the other hash tells, and all starts anew
        if classes.where("low <> high").isEmpty():
            break
    else:
        raise RuntimeError("sets keep colliding")
    spark, path = documents.sparkSession, new_path(documents.sparkSession, "labels")
    with scratch(spark):
        found = _labels(documents, both.where("slice IS NOT NULL").select("slice", "counters"), classes, seed)
        if found is not None:
            found.write.parquet(path)
    if found is None:
        named = classes.select("cls", F.col("doc_id").alias("component_id"))
    else:
        labels = spark.read.schema("node long, label long").parquet(path)
        own = classes.select("cls", "doc_id").join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "doc_id", F.coalesce("label", "cls").alias("label"))
        least = own.groupBy("label").agg(F.min("doc_id").alias("component_id"))
        named = own.join(least, "label").select("cls", "component_id")
    out = rows.join(named, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after more links: only what the links join is worked out anew."""
    if labels is None:
        return stored(connected(links), "labels")
    a, b = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    ends = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("la", "a").alias("x"), F.coalesce("lb", "b").alias("y")).where("x <> y")
    step = stored(connected(stored(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "joins")), "steps")
    # ends that had no link before are nodes of their own
    new = step.join(labels.select("node"), "node", "left_anti").select("node", "label")
    return stored(_moved(labels, step).unionByName(new).distinct(), "labels")


def _labels(documents: DataFrame, counters: DataFrame, classes: DataFrame, seed: int) -> DataFrame | None:
    """(node, label) of the classes that have links; None where there are none."""
    order = rarity(counters)
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    partitions = max(1, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // 4 * _POSTING.itemsize // TASK_BYTES))
    found = stored(candidates(postings(documents, order, seed, max(BUCKETS, 4 * partitions)), partitions), "candidates")
    lists = found.where("shingle IS NOT NULL").select("shingle", "members")
    counted = found.where("shared IS NOT NULL").select("a", "b", "size_a", "size_b", "shared", "rest")
    stars = found.where("a IS NOT NULL AND shared IS NULL").select("a", "b")
    pairs = stored(positional(counted, lists).unionByName(stars).distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("cls")).unionAll(pairs.select(F.col("b").alias("cls"))).unionAll(_unpacked(lists).select("cls")).distinct()
    keys = stored(classes.join(wanted, "cls", "left_semi").select("key"), "keys")
    count = keys.count()
    if count == 0:
        return None
    sets = stored(sets_of(documents, *bitmap(keys, count), seed), "sets")
    labels, tested = None, []
    for turn, tries in enumerate((*TRIES, 0), 1):
        links = stored(verify(pairs, sets, partitions), "links")
        if not links.isEmpty():
            labels = _joined(labels, links)
        if tries == 0 or lists.isEmpty():
            break
        tested.append(pairs)
        now = documents.sparkSession.createDataFrame([], "node long, label long") if labels is None else labels
        lists = stored(_open_lists(lists, now), "open")
        if lists.isEmpty():
            break
        found = stored(more_candidates(lists, now, sets, turn, tries, partitions), "candidates")
        pairs = stored(found.where("a IS NOT NULL").select("a", "b").distinct().join(_union(tested), ["a", "b"], "left_anti"), "pairs")
        lists = found.where("shingle IS NOT NULL").select("shingle", "members")
    return labels


def drop_near_duplicates(documents: DataFrame) -> DataFrame:
    """One row of each component, that with the smallest id; rows with a null id stay.

    Of rows that repeat that id and its text, one stays.
    """
    found = stored(components(documents.select("doc_id", "text")), "components")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    few = gone.count() <= BROADCAST_IDS
    own = [F.col("`" + c.replace("`", "``") + "`") for c in documents.columns]
    kept = documents.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*own)
    repeated = found.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    again = kept.join(repeated, "doc_id", "left_semi").select(*own)
    once = kept.join(repeated, "doc_id", "left_anti").select(*own)
    return once.unionByName(again.dropDuplicates(["doc_id", "text"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The same components in SQL, for small tables: all pairs that share a shingle, then reachability.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""
