"""The stored index: segments under numbered pointers, hash diffs and change logs."""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.config import INDEX_VERSION, Settings
from corvane.functions import text as T
from corvane.functions.hashing import content_hash
from corvane.operators.chunking import chunk_notes
from corvane.operators.lexical import forward
from corvane.operators.postings import PUSHED, PostingIndex, Segment, numbered, read, small_pages, write_terms
from corvane.operators.ranking import surfaces
from corvane.operators.vectors import Embedder, HashingEmbedder, signed
from corvane.sources import notes as notes_source
from corvane.storage import age, listed, publish, remove, scratch, small_text, stored


def hashed(chunks: DataFrame) -> DataFrame:
    """Chunks with the hash of their text."""
    return chunks.withColumn("hash", content_hash("text"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, action): delete, insert or update of chunks (id, hash); what has not changed is left out."""
    both = old.select("id", F.col("hash").alias("old")).join(new.select("id", F.col("hash").alias("new")), "id", "full_outer")
    action = F.when(F.col("new").isNull(), "delete").when(F.col("old").isNull(), "insert").when(F.col("old") != F.col("new"), "update")
    return both.select("id", action.alias("action")).where("action IS NOT NULL")


def latest_changes(log: DataFrame, folders: tuple[str, ...] = ()) -> DataFrame:
    """The state that a change log (seq, op, path, old_path) leads to: (path, seq, op upsert or delete).

    A rename deletes the old path and writes the new one; only .md paths count;
    writes into excluded folders are ignored.
    """
    deletes = log.where(F.col("op") == "rename").select("seq", F.lit("delete").alias("op"), F.col("old_path").alias("path"))
    own = log.select("seq", F.when(F.col("op") == "delete", "delete").otherwise("upsert").alias("op"), "path")
    rows = own.unionByName(deletes).where(F.col("path").endswith(".md") & ((F.col("op") == "delete") | ~T.excluded(F.col("path"), folders)))
    return rows.groupBy("path").agg(F.max_by(F.struct("seq", "op"), F.struct("seq", "op")).alias("last")).select("path", "last.seq", "last.op")


def apply_changes(notes: DataFrame, changes: DataFrame, contents: DataFrame) -> DataFrame:
    """Notes after the changes; a written path whose content is gone is dropped."""
    kept = notes.join(changes.select("path"), "path", "left_anti")
    written = changes.where("op = 'upsert'").join(contents, "path").select(*notes.columns)
    return kept.select(*notes.columns).unionByName(written)


def sessions(events: DataFrame, gap_ms: int) -> DataFrame:
    """Trailing debounce over all events (ts, path): one row for each quiet-bounded burst.

    The burst is global, so its borders need one order over all events: ranges
    of time are sorted in parallel, each range's borders against the one before
    come from a row for each range.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.select(micros.alias("t"), "path")
    # stored, as the number of a partition must not change between its uses
    spans = stored(rows.repartitionByRange("t").withColumn("part", F.spark_partition_id()), "spans")
    # the last time before each range: one row for each range, whatever the input
    edges = spans.groupBy("part").agg(F.max("t").alias("top"))
    before = edges.select(F.col("part"), F.lag("top").over(W.orderBy("part")).alias("before"))
    w = W.partitionBy("part").orderBy("t")
    timed = spans.join(F.broadcast(before), "part").withColumn("gap", F.col("t") - F.coalesce(F.lag("t").over(w), F.col("before")))
    # as with session windows, an event right at the gap's end starts a new burst
    marked = timed.withColumn("opens", (F.col("gap").isNull() | (F.col("gap") >= gap_ms * 1000)).cast("int")).withColumn("own", F.sum("opens").over(w.rangeBetween(W.unboundedPreceding, 0)))
    per_part = marked.groupBy("part").agg(F.sum("opens").alias("opened"))
    shift = per_part.select("part", F.coalesce(F.sum("opened").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
    numbered = marked.join(F.broadcast(shift), "part").withColumn("session", F.col("own") + F.col("shift"))
    return numbered.groupBy("session").agg(F.timestamp_micros(F.min("t")).alias("first_ts"), F.timestamp_micros(F.max("t") + gap_ms * 1000).alias("flush_ts"), F.count("*").alias("events"), F.count_distinct("path").alias("paths"))


def stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count_distinct("note_path").alias("notes"), F.count("*").alias("chunks"))


class Conflict(RuntimeError):
    """Another writer has committed since the state that a change was based on."""


CHUNK = "id string, note_path string, note_title string, heading string, ordinal int, text string, hash string"
_COLUMNS = [c.split()[0] for c in CHUNK.split(", ")]
#: Ids of removed rows that are broadcast; above, Spark chooses the join.
FEW_DEAD = 200_000


@dataclass(frozen=True)
class View:
    """The index as it was when it was opened: live chunks, their vectors and the inverted index."""

    rows: DataFrame
    vectors: DataFrame
    postings: PostingIndex
    size: int


@dataclass(frozen=True)
class Index:
    """Segments under ``root``, one folder for each (model, dim, version).

    A change writes one segment: the rows, vectors and postings of the chunks that
    are new or whose text has changed, the numbers of those that no longer count, and
    signed counts of terms, all in proportion to the change. A numbered pointer
    lists the segments of a state with the number of live chunks and the sum of their
    lengths. Readers merge: rows without those that a segment has marked dead. When
    ``fan`` segments are of one size class (powers of ``fan``) they become one; when
    more than half of all rows are dead, all do.

    Pointers are written whole under another name and get their number in one
    step that fails where it is taken. A change based on pointer n can only become
    n + 1, so of two writers one gets the number and the other raises ``Conflict``;
    one whose number was passed long ago finds later pointers that do not descend from
    its own and takes its own back. The segments of the last ``keep`` pointers stay
    for those who read them; what a dead writer left goes after ``orphan_age`` seconds.
    """

    spark: SparkSession
    root: str
    settings: Settings = Settings()
    embedder: Embedder = field(default_factory=HashingEmbedder)
    keep: int = 3
    fan: int = 4
    orphan_age: float = 86_400.0

    @property
    def _home(self) -> str:
        return f"{self.root}/{self.embedder.model_id}-{self.embedder.dim}-v{INDEX_VERSION}"

    def _at(self, name: str) -> str:
        return f"{self._home}/segments/{name}"

    def _chunked(self, notes: DataFrame) -> DataFrame:
        kept = notes.where(~T.excluded(F.col("path"), self.settings.excluded_folders))
        return hashed(chunk_notes(kept, self.settings.chunk_tokens, self.settings.chunk_overlap)).select(*_COLUMNS)

    # pointers

    def _numbers(self) -> list[int]:
        return sorted((int(x.removesuffix(".json")) for x in listed(self.spark, f"{self._home}/pointers") if x.endswith(".json") and x[0] != "."), reverse=True)

    def _pointer(self, number: int) -> dict | None:
        raw = small_text(self.spark, f"{self._home}/pointers/{number:012d}.json")
        return json.loads(raw) if raw else None

    def _head(self) -> tuple[int, dict | None]:
        for number in self._numbers():
            if (meta := self._pointer(number)) is not None:
                return number, meta
        return 0, None

    def meta(self) -> dict | None:
        """What the last pointer says, None where there is no usable index."""
        meta = self._head()[1] or {}
        return meta if (meta.get("version"), meta.get("model_id"), meta.get("dim")) == (INDEX_VERSION, self.embedder.model_id, self.embedder.dim) else None

    def _publish(self, base: int, state: dict, parent: dict | None) -> None:
        """Makes ``state`` the pointer after ``base``."""
        token = uuid.uuid4().hex
        meta = {"version": INDEX_VERSION, "model_id": self.embedder.model_id, "dim": self.embedder.dim, **state, "token": token, "parent": (parent or {}).get("token")}
        if not publish(self.spark, f"{self._home}/pointers/{base + 1:012d}.json", json.dumps(meta)):
            raise Conflict(f"the index has changed since pointer {base}")
        if any(n > base + 1 for n in self._numbers()) and (self._pointer(base + 2) or {}).get("parent") != token:
            remove(self.spark, f"{self._home}/pointers/{base + 1:012d}.json")
            raise Conflict(f"pointer {base} was passed long ago")
        self._collect()

    def _collect(self) -> None:
        """Removes pointers beyond ``keep``, the segments that only they name, and what nobody names for long."""
        numbers = self._numbers()
        named = {n: {s["name"] for s in (self._pointer(n) or {}).get("segments", [])} for n in numbers}
        live = set().union(*(named[n] for n in numbers[: self.keep]))
        old = set().union(*(named[n] for n in numbers[self.keep :])) - live
        for name in listed(self.spark, f"{self._home}/segments"):
            if name in old or (name not in live and age(self.spark, self._at(name)) > self.orphan_age):
                remove(self.spark, self._at(name))
        for n in numbers[self.keep :]:
            remove(self.spark, f"{self._home}/pointers/{n:012d}.json")

    # reading

    def _dead(self, segments: list[dict]) -> DataFrame | None:
        paths = [f"{self._at(s['name'])}/dead" for s in segments if s["dead"]]
        return read(self.spark, paths, "segment string, doc long, id string") if paths else None

    def _live(self, segments: list[dict], dead: DataFrame | None, many: int, kind: str, schema: str) -> DataFrame:
        """Rows of some segments with ``segment`` and ``doc`` that no segment has marked dead."""
        paths = [f"{self._at(s['name'])}/{kind}" for s in segments if s["rows"]]
        rows = read(self.spark, paths, f"doc long, {schema}")
        name = F.regexp_extract(F.col("_metadata.file_path"), rf"([^/]+)/{kind}/", 1) if paths else F.lit("")
        rows = rows.withColumn("segment", name)
        if dead is None:
            return rows
        gone = dead.select("segment", "doc")
        return rows.join(F.broadcast(gone) if many <= FEW_DEAD else gone, ["segment", "doc"], "left_anti")

    @property
    def _vector(self) -> str:
        return "id string, embedding array<float>, signature binary"

    def _all(self, meta: dict, kind: str, schema: str) -> DataFrame:
        return self._live(meta["segments"], self._dead(meta["segments"]), sum(s["dead"] for s in meta["segments"]), kind, schema)

    def load(self) -> DataFrame | None:
        """The live chunks; raises if the segments have not as many rows as the pointer says."""
        view = self.view()
        return None if view is None else view.rows

    def view(self) -> View | None:
        meta = self.meta()
        if meta is None:
            return None
        said = sum(s["rows"] for s in meta["segments"])
        stored_rows = read(self.spark, [f"{self._at(s['name'])}/rows" for s in meta["segments"] if s["rows"]], "doc long")
        if (n := stored_rows.count()) != said:
            raise ValueError(f"the segments have {n} chunks, the pointer says {said}")
        segments = tuple(Segment(self._at(s["name"]), s["folders"], tuple(s["postings"]), tuple(s["terms"])) for s in meta["segments"])
        dead, many = self._dead(meta["segments"]), sum(s["dead"] for s in meta["segments"])
        docs = self._live(meta["segments"], None, 0, "rows", "id string").select("segment", "doc", "id")
        postings = PostingIndex(self.spark, segments, docs, meta["count"], meta["length"], dead)
        rows = self._live(meta["segments"], dead, many, "rows", CHUNK).select("segment", "doc", *_COLUMNS)
        vectors = self._live(meta["segments"], dead, many, "vectors", self._vector).drop("segment", "doc")
        return View(rows, vectors, postings, meta["count"])

    # writing

    def _write(self, chunks: DataFrame, counts: DataFrame | None, dead: DataFrame | None, vectors: DataFrame | None = None) -> tuple[dict, int]:
        """Writes a segment of chunks (ids distinct); its entry in a pointer and the sum of its lengths.

        counts: signed (term, df) to write in the place of the chunks' own, or None;
        dead: (segment, doc, id); vectors: (id, embedding, signature), made here where not given.
        """
        name = uuid.uuid4().hex
        path = self._at(name)
        try:
            small_pages(numbered(chunks.select(*_COLUMNS)).write, 32).option("parquet.enable.dictionary#text", "false").parquet(f"{path}/rows")
            rows = read(self.spark, [f"{path}/rows"], f"doc long, {CHUNK}")
            size, gone = rows.count(), 0
            surface = surfaces(rows.drop("id").withColumnRenamed("doc", "id"))
            terms, length = write_terms(surface[1].withColumnRenamed("id", "doc"), path, size, counts)
            if vectors is None:
                key = rows.select(F.struct("doc", "id").alias("id"), "heading", "text")
                made = signed(self.embedder.embed(key.select("id", T.embed_surface(F.col("heading"), F.col("text")).alias("surface"))))
                vectors = made.select("id.doc", "id.id", "embedding", "signature")
            else:
                vectors = vectors.join(rows.select("id", "doc"), "id").select("doc", "id", "embedding", "signature")
            vectors.write.parquet(f"{path}/vectors")
            if not read(self.spark, [f"{path}/vectors"], "embedding array<float>").where(F.size("embedding") != self.embedder.dim).isEmpty():
                raise ValueError(f"embeddings must have dimension {self.embedder.dim}")
            if dead is not None:
                dead.select("segment", "doc", "id").coalesce(1).write.parquet(f"{path}/dead")
                gone = read(self.spark, [f"{path}/dead"], "doc long").count()
        except BaseException:
            remove(self.spark, path)
            raise
        return {"name": name, "rows": size, "dead": gone, **{k: v for k, v in asdict(terms).items() if k != "path"}}, length

    def rebuild(self, notes: DataFrame, manifest: str | None = None) -> None:
        """One segment of all notes in the place of whatever is there; ``manifest`` is for ``reconcile``."""
        with scratch(self.spark):
            entry, length = self._write(stored(self._chunked(notes), "chunks"), None, None)
        while True:
            number, parent = self._head()
            try:
                return self._publish(number, {"segments": [entry], "count": entry["rows"], "length": length, "manifest": manifest}, parent)
            except Conflict:
                # what is written stands for the whole, whoever was first
                continue

    def open_or_build(self, notes: DataFrame) -> DataFrame:
        found = self.load()
        if found is None:
            self.rebuild(notes)
            found = self.load()
        return found

    def merge(self, notes: DataFrame, gone: DataFrame, attempts: int = 3) -> None:
        """Adds the segment that ``notes`` (path, title, content), written, and paths ``gone``, deleted, make.

        Only chunks that are new or whose text has changed are embedded and
        tokenised. Where another writer was first, the change is made again on
        top of theirs, up to ``attempts`` times. Segments are then compacted where due.
        """
        if attempts < 1:
            raise ValueError("attempts must be positive")
        for attempt in range(attempts):
            try:
                self._merge(notes, gone)
                break
            except Conflict:
                if attempt == attempts - 1:
                    raise
        self.compact()

    def reconcile(self, folder: str, attempts: int = 3) -> dict[str, int]:
        """Brings the index to the state of a folder of Markdown files; how many were listed, read and gone.

        The state keeps a manifest (path, length, mtime) of what was listed before.
        Only files that are not in it as they are now are opened, so a changed file among many costs
        one read; whether its text differs, the hashes of its chunks tell. A change by another way
        drops the manifest, and the next call reads all files. A file that is changed
        within the store's clock tick and keeps its length is not noticed.
        """
        for attempt in range(attempts):
            try:
                return self._reconcile(folder)
            except Conflict:
                if attempt == attempts - 1:
                    raise
        raise ValueError("attempts must be positive")

    def _reconcile(self, folder: str) -> dict[str, int]:
        state = self.meta() or {}
        name = uuid.uuid4().hex
        with scratch(self.spark):
            now = stored(notes_source.listing(self.spark, folder), "listing")
            old = read(self.spark, [f"{self._home}/manifests/{state['manifest']}"] if state.get("manifest") else [], "path string, length long, mtime timestamp")
            changed = [r["file"] for r in now.join(old, ["path", "length", "mtime"], "left_anti").select("file").collect()]
            if state.get("manifest"):
                gone = old.join(now, "path", "left_anti").select("path")
            else:
                known = self._all(state, "rows", CHUNK).select(F.col("note_path").alias("path")).distinct() if state else read(self.spark, [], "path string")
                gone = known.join(now, "path", "left_anti")
            gone = stored(gone, "gone")
            counts = {"listed": now.count(), "read": len(changed), "gone": gone.count()}
            if not changed and not counts["gone"] and state.get("manifest"):
                return counts
            opened = notes_source.read_notes(self.spark, folder, only=changed).select("path", "title", "content") if changed else read(self.spark, [], "path string, title string, content string")
            opened = stored(opened, "opened")
            now.select("path", "length", "mtime").coalesce(1).write.parquet(f"{self._home}/manifests/{name}")
            try:
                self._merge(opened, gone, name)
            except BaseException:
                remove(self.spark, f"{self._home}/manifests/{name}")
                raise
        for other in listed(self.spark, f"{self._home}/manifests"):
            if other not in {(self._pointer(n) or {}).get("manifest") for n in self._numbers()} and age(self.spark, f"{self._home}/manifests/{other}") > self.orphan_age:
                remove(self.spark, f"{self._home}/manifests/{other}")
        return counts

    def _merge(self, notes: DataFrame, gone: DataFrame, manifest: str | None = None) -> None:
        number, head = self._head()
        meta = self.meta()
        if meta is None:
            self.rebuild(notes, manifest)
            return
        with scratch(self.spark):
            new = stored(self._chunked(notes), "chunks")
            kept = notes.where(~T.excluded(F.col("path"), self.settings.excluded_folders))
            touched = stored(kept.select(F.col("path").alias("note_path")).unionByName(gone.select(F.col("path").alias("note_path"))).distinct(), "touched")
            rows = self._all(meta, "rows", CHUNK)
            few = [r[0] for r in touched.where("note_path IS NOT NULL").take(PUSHED + 1)]
            if 0 < len(few) <= PUSHED:
                # reaches the pages of the files, which are in the order of ids
                rows = rows.where(reduce(lambda a, b: a | b, [F.col("note_path") == p for p in few]))
            old = stored(rows.join(touched, "note_path", "left_semi"), "old")
            changed = stored(new.join(old.select("id", "hash"), ["id", "hash"], "left_anti"), "changed")
            dead = stored(old.join(new.select("id", "hash"), ["id", "hash"], "left_anti"), "dead")
            if changed.isEmpty() and dead.isEmpty():
                if manifest:
                    self._publish(number, {**{k: meta[k] for k in ("segments", "count", "length")}, "manifest": manifest}, head)
                return
            terms = [forward(surfaces(x)[1]) for x in (changed, dead)]
            signed_counts = [t.select(F.explode("terms.term").alias("term")).groupBy("term").agg((sign * F.count("*")).alias("df")) for t, sign in zip(terms, (1, -1), strict=True)]
            entry, length = self._write(changed, signed_counts[0].unionByName(signed_counts[1]), dead)
            lost = terms[1].agg(F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).head()[0]
        state = {"segments": [*meta["segments"], entry], "count": meta["count"] + entry["rows"] - entry["dead"], "length": meta["length"] + length - lost, "manifest": manifest}
        self._publish_or_remove(number, state, head, entry["name"])

    def _publish_or_remove(self, number: int, state: dict, head: dict | None, name: str) -> None:
        try:
            self._publish(number, state, head)
        except Conflict:
            remove(self.spark, self._at(name))
            raise

    def _due(self, segments: list[dict]) -> list[dict]:
        """The segments to be made one: all where most rows are dead, else those of the smallest size class with ``fan`` of them."""
        if 2 * sum(s["dead"] for s in segments) > sum(s["rows"] for s in segments):
            return segments
        classes: dict[int, list[dict]] = {}
        for s in segments:
            classes.setdefault(int(math.log(s["rows"] + s["dead"] + 1, self.fan)), []).append(s)
        return next((classes[c] for c in sorted(classes) if len(classes[c]) >= self.fan), [])

    def compact(self, everything: bool = False) -> None:
        """Makes segments one where due; another writer's commit in between leaves them for the next time."""
        while True:
            number, head = self._head()
            meta = self.meta()
            due = [] if meta is None else meta["segments"] if everything else self._due(meta["segments"])
            if not due or (len(due) == 1 and not due[0]["dead"]):
                return
            names = {s["name"] for s in due}
            with scratch(self.spark):
                dead, many = self._dead(meta["segments"]), sum(s["dead"] for s in meta["segments"])
                rows = self._live(due, dead, many, "rows", CHUNK).select(*_COLUMNS)
                vectors = self._live(due, dead, many, "vectors", self._vector).select("id", "embedding", "signature")
                own = self._dead(due)
                carried = None if own is None else stored(own.where(~F.col("segment").isin(list(names))), "carried")
                counts = read(self.spark, [f"{self._at(s['name'])}/terms/folder={f}" for s in due for f in s["terms"]], "term string, df long")
                entry, _ = self._write(rows, counts, None if carried is None or carried.isEmpty() else carried, vectors)
            rest = [s for s in meta["segments"] if s["name"] not in names]
            try:
                self._publish_or_remove(number, {**{k: meta.get(k) for k in ("count", "length", "manifest")}, "segments": [*rest, entry]}, head, entry["name"])
            except Conflict:
                return
            everything = False

    def clean(self) -> None:
        remove(self.spark, self._home)
