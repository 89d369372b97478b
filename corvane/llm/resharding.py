"""Resharding by minimum-cost flow.

A layout is Parquet files in folders ``shard=N``. From the bytes of the old
shards and the capacities of the new ones, flow over the graph old x new says
how many bytes go from where to where, so that the cost of what moves is least
(unless told otherwise, a byte that stays costs nothing and one that moves 1). A shard's files are laid
on a line, its own share first, and each stretch of the line goes to one new
shard. Files that stay whole are kept as they are; only the others are
rewritten, their rows dealt by place, in one pass without a shuffle of texts.

Sizes come near each other although texts differ: rows larger than a
``1 / FINE`` of an even share, at most shards x FINE of them, are placed one by
one, the largest first, where they lie if there is room; the flow fills what is left
to one level. Each end of a stretch then errs by half a small row at most.

The driver holds the large rows, a number for each pair of shards and the names of
the files, which hold ``FILE_BYTES`` each. Law of the query: ``bytes``. Groups of equal
texts are not kept together, as one may be larger than a shard.

Defined results: a null text counts as empty; repeated rows and rows without an id are placed
each on their own; an empty table gives no rows; with fewer rows than shards some
shards stay empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.storage import new_path, stored, table

FILE_BYTES = 128 << 20
#: Files of a shard at least, so that those that stay whole need not be written again.
LEAST_FILES = 4
#: Bytes that each row counts for besides its text.
OVERHEAD = 16
#: Parts of an even share from which a row is placed on its own.
FINE = 256
OLD, NEW = 32, 40


def flow(supply: list[int], capacity: list[int], cost: np.ndarray) -> np.ndarray:
    """Amounts from each supply to each capacity that use all supply at the least cost: successive shortest paths in whole numbers."""
    left, room = np.array(supply, dtype=np.int64), np.array(capacity, dtype=np.int64)
    if left.sum() > room.sum():
        raise ValueError("supply exceeds capacity")
    cost = np.asarray(cost, dtype=np.int64)
    out = np.zeros(cost.shape, dtype=np.int64)
    far = np.iinfo(np.int64).max // 4
    while left.any():
        # cheapest ways from what is left; backwards along what already flows
        near, back = np.where(left > 0, 0, far), np.full(len(left), -1)
        reached, by = np.full(len(room), far), np.full(len(room), -1)
        while True:
            # only what is strictly cheaper replaces a way, so ways have no circles
            ways = near[:, None] + cost
            nearer = ways.min(axis=0) < reached
            by, reached = np.where(nearer, ways.argmin(axis=0), by), np.minimum(ways.min(axis=0), reached)
            returns = np.where(out > 0, reached[None, :] - cost, far)
            nearer = returns.min(axis=1) < near
            if not nearer.any():
                break
            back, near = np.where(nearer, returns.argmin(axis=1), back), np.minimum(returns.min(axis=1), near)
        at = int(np.where(room > 0, reached, far).argmin())
        path, end, amount = [], at, int(room[at])
        while True:
            i = int(by[end])
            path.append((i, end, 1))
            if back[i] < 0:
                break
            end = int(back[i])
            path.append((i, end, -1))
            amount = min(amount, int(out[i, end]))
        amount = min(amount, int(left[i]))
        for x, y, sign in path:
            out[x, y] += sign * amount
        left[i] -= amount
        room[at] -= amount
    return out


def moving_cost(old: int, new: int) -> np.ndarray:
    """Staying costs nothing, moving 1 a byte."""
    return 1 - np.eye(old, new, dtype=np.int64)


def level(loads: np.ndarray, amount: int) -> np.ndarray:
    """Whole numbers that add up to ``amount`` and lift the lowest loads to one level."""
    order = np.argsort(loads, kind="stable")
    line = loads[order]
    for k in range(len(line), 0, -1):
        top, over = divmod(amount + int(line[:k].sum()), k)
        if top >= line[k - 1]:
            break
    out = np.zeros(len(line), dtype=np.int64)
    out[order[:k]] = top - line[:k] + (np.arange(k) < over)
    return out


@dataclass(frozen=True)
class Layout:
    """Files in folders ``shard=N`` under some roots; of a root all files, or those named."""

    spark: SparkSession
    roots: tuple[tuple[str, tuple[str, ...] | None], ...]

    def read(self) -> DataFrame:
        """The rows with ``shard``, ``file`` (its place under the root, after the root's number) and ``row`` (its place in the file)."""
        out: DataFrame | None = None
        for k, (root, files) in enumerate(self.roots):
            if files is not None and not files:
                continue
            paths = [root] if files is None else [f"{root}/{f}" for f in files]
            rows = self.spark.read.option("basePath", root).parquet(*paths)
            name = F.concat(F.lit(f"{k}/"), F.regexp_extract(F.col("_metadata.file_path"), r"shard=-?\d+/[^/]+$", 0))
            part = rows.select("*", name.alias("file"), F.col("_metadata.row_index").alias("row"))
            out = part if out is None else out.unionByName(part)
        if out is None:
            raise ValueError("the layout has no files")
        return out


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def lay_out(rows: DataFrame, text: str, shard: Column, shards: int, path: str, file_bytes: int = FILE_BYTES) -> Layout:
    """A first layout of the rows; those of a shard are dealt evenly over files of about ``file_bytes``."""
    if "shard" in rows.columns:
        raise ValueError("rename the column shard")
    whole = rows.agg(F.coalesce(F.sum(size_of(F.col(text))), F.lit(0))).head()[0]
    files = max(LEAST_FILES, -(-whole // (shards * file_bytes)))
    dealt = rows.withColumns({"shard": shard.cast("int"), "__file": F.pmod(F.monotonically_increasing_id(), F.lit(files))})
    # a task for each file, as nearly as hashing has it: small files are what is later left alone
    dealt.repartition(shards * files, "shard", "__file").drop("__file").write.partitionBy("shard").parquet(path)
    return Layout(rows.sparkSession, ((path, None),))


@dataclass(frozen=True)
class Plan:
    """Bytes by old and new shard of what flows, and where single large rows go: (file, row, size, old, new)."""

    capacity: np.ndarray
    flow: np.ndarray
    large: list[tuple[str, int, int, int, int]]

    @property
    def moved(self) -> int:
        return int(self.flow.sum() - np.trace(self.flow)) + sum(size for _, _, size, old, new in self.large if old != new)


def solve(sizes: DataFrame, old: int, new: int, cost: np.ndarray | None = None, fine: int = FINE) -> Plan:
    """From (shard, file, row, size) of a layout of ``old`` shards."""
    whole = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).head()[0]
    is_large = F.col("size") * (new * fine) > whole
    # at most new x fine rows can be that large
    large = sorted(sizes.where(is_large).select("size", "file", "row", "shard").collect(), key=lambda r: (-r["size"], r["file"], r["row"]))
    small = np.zeros(old, dtype=np.int64)
    for r in sizes.where(~is_large).groupBy("shard").agg(F.sum("size").alias("size")).collect():
        small[r["shard"]] = r["size"]
    even, loads, placed = whole / new, np.zeros(new, dtype=np.int64), []
    for r in large:
        stays = r["shard"] < new and loads[r["shard"]] + r["size"] <= even
        to = r["shard"] if stays else int(loads.argmin())
        loads[to] += r["size"]
        placed.append((r["file"], r["row"], r["size"], r["shard"], to))
    capacity = level(loads, int(small.sum()))
    return Plan(capacity, flow(small.tolist(), capacity.tolist(), moving_cost(old, new) if cost is None else cost), placed)


def assigned(sizes: DataFrame, plan: Plan) -> DataFrame:
    """(file, row, shard, new): where each row goes.

    Running sums are within a file and over the files of a shard, so no task holds
    more than one of either.
    """
    spark = sizes.sparkSession
    old, new = plan.flow.shape
    large = spark.createDataFrame([(f, r, n) for f, r, _, _, n in plan.large], "file string, row long, at_new int")
    lines = []
    for i in range(old):
        # what stays comes first
        order = [j for j in range(new) if plan.flow[i, j] and j == i] + [j for j in range(new) if plan.flow[i, j] and j != i]
        ends = np.cumsum([plan.flow[i, j] for j in order]).tolist()
        lines.append((i, [(int(e), j) for e, j in zip(ends, order, strict=True)]))
    line = spark.createDataFrame(lines, "shard int, line array<struct<until:long,to:int>>")
    rows = sizes.join(F.broadcast(large), ["file", "row"], "left").withColumn("flows", F.when(F.col("at_new").isNull(), F.col("size")).otherwise(F.lit(0).cast("long")))
    files = rows.groupBy("shard", "file").agg(F.sum("flows").alias("flows"))
    before = files.select("shard", "file", (F.sum("flows").over(W.partitionBy("shard").orderBy("file").rowsBetween(W.unboundedPreceding, 0)) - F.col("flows")).alias("before"))
    # old x new numbers
    starts = before.join(F.broadcast(line), "shard").select("file", "before", "line")
    middle = F.col("before") + F.sum("flows").over(W.partitionBy("file").orderBy("row")) - F.col("flows") / 2
    timed = rows.join(starts, "file").withColumn("middle", middle)
    here = F.element_at(F.filter("line", lambda s: s["until"] > F.col("middle")), 1)["to"]
    return timed.select("file", "row", "shard", F.coalesce("at_new", here, F.element_at("line", -1)["to"], "shard").alias("new"))


def reshard(layout: Layout, text: str, old: int, new: int, path: str, cost: np.ndarray | None = None) -> tuple[Layout, Plan]:
    """Writes the files that change to ``path``; the new layout is these and the untouched ones."""
    spark = layout.spark
    sizes = stored(layout.read().select("shard", "file", "row", size_of(F.col(text)).alias("size")), "sizes")
    plan = solve(sizes, old, new, cost)
    rows = stored(assigned(sizes, plan), "assigned")
    # where along a file the shard changes: few places, but for large rows of their own
    w = W.partitionBy("file").orderBy("row")
    turns = rows.withColumn("was", F.lag("new").over(w)).where("was IS NULL OR was <> new").groupBy("file", "shard").agg(F.sort_array(F.collect_list(F.struct("row", "new"))).alias("turns"))
    turns = stored(turns.withColumn("touched", (F.size("turns") > 1) | (F.col("turns")[0]["new"] != F.col("shard"))), "turns")
    touched: dict[bool, list[str]] = {True: [], False: []}
    for r in turns.select("file", "touched").collect():
        touched[r["touched"]].append(r["file"])

    def only(names: list[str]) -> tuple[tuple[str, tuple[str, ...]], ...]:
        own: dict[int, list[str]] = {}
        for f in sorted(names):
            k, name = f.split("/", 1)
            own.setdefault(int(k), []).append(name)
        return tuple((root, tuple(own.get(k, ()))) for k, (root, _) in enumerate(layout.roots))

    kept = only(touched[False])
    if not touched[True]:
        return Layout(spark, kept), plan
    found = Layout(spark, only(touched[True])).read()
    to = F.element_at(F.filter("turns", lambda t: t["row"] <= F.col("row")), -1)["new"]
    moved = found.drop("shard").join(turns.where("touched").select("file", "turns"), "file").withColumn("shard", to)
    moved.drop("file", "row", "turns").write.partitionBy("shard").parquet(path)
    return Layout(spark, (*kept, (path, None))), plan


def slots(rows: DataFrame) -> DataFrame:
    """Rows of a layout with ``slot``, gapless from 0 within a shard, in the order of files and of rows in them."""
    files = stored(rows.groupBy("shard", "file").agg(F.count("*").alias("n")), "files")
    start = files.select("file", (F.sum("n").over(W.partitionBy("shard").orderBy("file").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("start"))
    return rows.join(start, "file").withColumn("slot", F.col("start") + F.col("row")).drop("start")


SCHEMA = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 32 shards by a checksum of the id to 40 of equal bytes; what is returned is read from the new files."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if docs.isEmpty():
        return spark.createDataFrame([], SCHEMA)
    by_id = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(OLD))
    before = lay_out(docs, "text", by_id, OLD, new_path(spark, "shards-old"))
    after, _ = reshard(before, "text", OLD, NEW, new_path(spark, "shards-new"))
    text = F.col("text")
    rows = after.read().select("doc_id", size_of(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), "shard", "file", "row")
    return slots(rows).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
