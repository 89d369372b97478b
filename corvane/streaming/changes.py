"""Keeping indexes current from a stream of note changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from corvane.config import DEBOUNCE_MS
from corvane.operators.index import Index, latest_changes
from corvane.storage import scratch

#: How often a query looks for new changes and for bursts that have ended.
TICK_MS = 250
_STATE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "corpus_id string, seq long, op string, path string, old_path string, title string, content string"


def apply_batch(index: Index, log: DataFrame) -> None:
    """Merges one batch of changes (seq, op, path, old_path, title, content): the last of a path counts."""
    with scratch(index.spark):
        last = latest_changes(log, index.settings.excluded_folders)
        written = last.where("op = 'upsert'").join(log.select("seq", "path", "title", "content"), ["seq", "path"]).where("content IS NOT NULL")
        gone = last.where("op = 'delete'").select("path")
        index.merge(written.select("path", "title", "content"), gone)


class _Debounce(StatefulProcessor):
    """For one corpus, what waits for the end of a burst, and the timer of that end."""

    def __init__(self, gap_ms: int):
        self._gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getMapState("waiting", "path string", "seq long, title string, content string")
        self._end = handle.getValueState("end", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        waits = False
        for r in sorted(rows, key=lambda r: r["seq"]):
            if r["op"] in ("delete", "rename"):
                # at once; what waited for a path that is gone is dropped
                for path, op in ((r["old_path"], "delete"), (r["path"], "upsert")) if r["op"] == "rename" else ((r["path"], "delete"),):
                    if path is not None:
                        if self._waiting.containsKey((path,)):
                            self._waiting.removeKey((path,))
                        yield self._row(key, r["seq"], op, path, *((r["title"], r["content"]) if op == "upsert" else (None, None)))
            else:
                self._waiting.updateValue((r["path"],), (r["seq"], r["title"], r["content"]))
                waits = True
        if waits:
            if self._end.exists():
                self._handle.deleteTimer(self._end.get()[0])
            at = timerValues.getCurrentProcessingTimeInMs() + self._gap
            self._handle.registerTimer(at)
            self._end.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        for (path,), (seq, title, content) in self._waiting.iterator():
            yield self._row(key, seq, "upsert", path, title, content)
        self._waiting.clear()
        self._end.clear()

    def _row(self, key, seq: int, op: str, path: str, title: str | None, content: str | None) -> Row:
        return Row(corpus_id=key[0], seq=seq, op=op, path=path, old_path=None, title=title, content=content)

    def close(self) -> None:
        pass


def debounced(changes: DataFrame, gap_ms: int = DEBOUNCE_MS) -> DataFrame:
    """A stream of ``CHANGES`` with written notes held back until their corpus has been quiet for ``gap_ms``, the last of each path only.

    Deletes and renames pass at once and drop what waits for the old path. Time is
    that of the machine, as with a timer in a program: a burst ends although no
    later event comes. Needs the state store of RocksDB, see ``maintain``.
    """
    return changes.groupBy("corpus_id").transformWithState(_Debounce(gap_ms), CHANGES, "append", "ProcessingTime")


def _heartbeat(spark: SparkSession) -> DataFrame:
    """A row without a corpus each second: a query that has been started again would else let timers wait for the next change."""
    beats = spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    # null for every row, which the optimizer does not see
    none = F.when(F.col("value") < 0, F.lit(""))
    return beats.select(*(none.cast(kind).alias(name) for name, kind in (c.split() for c in CHANGES.split(", "))))


def maintain(index: Index | Callable[[str], Index], changes: DataFrame, checkpoint: str, gap_ms: int = DEBOUNCE_MS, trigger: dict | None = None) -> StreamingQuery:
    """Applies a stream of changes (seq, op, path, old_path, title, content), debounced; one query is the one writer.

    With ``corpus_id`` among the columns ``index`` gives the index of each corpus.
    What waits and its timer are in the checkpoint, so a query that is started again
    goes on with them; a batch that is run again after a failure gives the same
    state, as merging is idempotent.
    """
    spark = changes.sparkSession
    rows = changes if "corpus_id" in changes.columns else changes.withColumn("corpus_id", F.lit("notes"))
    rows = rows.select(*(F.col(c.split()[0]) for c in CHANGES.split(", "))).unionByName(_heartbeat(spark)).where("corpus_id IS NOT NULL AND seq IS NOT NULL AND path IS NOT NULL")

    def run(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            # corpora with changes to apply just now
            for r in batch.select("corpus_id").distinct().collect():
                apply_batch(index(r["corpus_id"]) if callable(index) else index, batch.where(F.col("corpus_id") == r["corpus_id"]))
        finally:
            batch.unpersist()

    was = spark.conf.get(_STATE)
    spark.conf.set(_STATE, _ROCKS)
    try:
        writer = debounced(rows, gap_ms).writeStream.option("checkpointLocation", checkpoint).outputMode("append").foreachBatch(run)
        return writer.trigger(**(trigger or {"processingTime": f"{TICK_MS} milliseconds"})).start()
    finally:
        spark.conf.set(_STATE, was)
