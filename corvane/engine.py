"""The engine as one object: index, search and conversations."""

from __future__ import annotations

import contextlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.config import CONTEXT_CHUNKS, HISTORY_MESSAGES, MODELS, SIMILARITY_FLOOR, TOP_K, Settings
from corvane.functions import text as T
from corvane.operators import chat, generation, ranking, vectors
from corvane.operators.index import Index, View, stats
from corvane.operators.postings import PUSHED
from corvane.storage import new_path, replace, scratch, small_text

_CHUNK = ("id", "note_path", "note_title", "heading", "ordinal", "text")


#: Result rows that a search gives from the driver; more are written to a table.
LOCAL_ROWS = 100_000


@dataclass
class Engine:
    """Search and chat over the state of the index that was current when the engine was opened."""

    spark: SparkSession
    root: str
    settings: Settings = Settings()
    embedder: vectors.Embedder = field(default_factory=vectors.HashingEmbedder)
    view: View | None = None
    #: Changes of the index that are under way.
    running: int = 0

    def _opened(self) -> Engine:
        self.view = self.index.view()
        return self

    @property
    def index(self) -> Index:
        return Index(self.spark, self.root, self.settings, self.embedder)

    @property
    def size(self) -> int:
        return self.view.size if self.view else 0

    def open(self, notes: DataFrame) -> Engine:
        """Loads the index, or builds it from (path, title, content) where there is none."""
        with self._change():
            self.index.open_or_build(notes)
            return self._opened()

    def rebuild(self, notes: DataFrame, progress: Callable[[int, int], None] | None = None) -> Engine:
        """Indexes all notes anew; ``progress`` is told (notes done, notes) before and after.

        Until the new state is whole, searches see the old one; where indexing
        fails, they go on doing so.
        """
        total = notes.count() if progress else 0
        with self._change():
            if progress:
                progress(0, total)
            self.index.rebuild(notes)
            self._opened()
        if progress:
            progress(total, total)
        return self

    def update(self, notes: DataFrame, gone: DataFrame) -> Engine:
        with self._change():
            self.index.merge(notes, gone)
            return self._opened()

    @contextlib.contextmanager
    def _change(self):
        self.running += 1
        try:
            yield
        finally:
            self.running -= 1

    @property
    def indexing(self) -> bool:
        return self.running > 0

    def save_settings(self, path: str, settings: Settings) -> None:
        """Keeps the settings, which searches use from now on; the index follows at the next rebuild."""
        self.settings = settings
        replace(self.spark, path, json.dumps(settings.saved()))

    def load_settings(self, path: str) -> Settings:
        """The saved settings, defaults where there are none."""
        raw = small_text(self.spark, path)
        self.settings = Settings.load(json.loads(raw)) if raw else Settings()
        return self.settings

    @property
    def chunks(self) -> DataFrame:
        if self.view is None:
            raise ValueError("open the engine first")
        return self.view.rows.select(*_CHUNK)

    def stats(self) -> dict:
        row = stats(self.chunks).head()
        return {"notes": row["notes"], "chunks": row["chunks"], "model_id": self.embedder.model_id, "approximate": self.size > self.settings.ann_threshold}

    def search(self, queries: DataFrame, mode: str = "hybrid", k: int = TOP_K) -> DataFrame:
        """Ranked chunks for (query_id, query); queries that are blank give none.

        The result is worked out at once, and what that wrote goes; results of more
        than ``LOCAL_ROWS`` rows stay in a table of their own until the application ends.
        """
        chunks = self.chunks
        asked = queries.where(T.trimmed(F.col("query")) != "")
        limit = LOCAL_ROWS // max(1, k)
        few = len(asked.select("query_id").take(limit + 1)) <= limit
        path = None if few else new_path(self.spark, "results")
        with scratch(self.spark):
            ranked = ranking.rank(chunks, asked, mode, k, self.settings.alpha, self.embedder, self.view.postings, self.view.vectors, self.settings.ann_threshold, self.size)
            if few:
                found = ranked.collect()
                ids = sorted({r["id"] for r in found})
                if len(ids) <= PUSHED:
                    # reaches the pages that hold the chunks
                    chunks = chunks.where(reduce(lambda a, b: a | b, [F.col("id") == i for i in ids], F.lit(False)))
                out = ranking.with_chunks(F.broadcast(self.spark.createDataFrame(found, ranked.schema)), chunks)
                return self.spark.createDataFrame(out.collect(), out.schema)
            ranking.with_chunks(ranked, chunks).write.parquet(path)
        return self.spark.read.parquet(path)

    def session(self, generate: Callable[[str], str] | None = None, **options) -> Session:
        """A conversation over this snapshot; ``generate`` defaults to the backend of the settings."""
        info = MODELS.get(self.embedder.model_id)
        options.setdefault("floor", info.similarity_floor if info else SIMILARITY_FLOOR)
        return Session(self, generate or generation.generator(self.settings), **options)


@dataclass
class Session:
    """Turns asked one after the other; many questions at once are ``chat.ask``."""

    engine: Engine
    generate: Callable[[str], str] | None
    floor: float = SIMILARITY_FLOOR
    context_chunks: int = CONTEXT_CHUNKS
    history_messages: int = HISTORY_MESSAGES
    turns: list[dict] = field(default_factory=list)

    def reset(self) -> None:
        self.turns.clear()

    def ask(self, message: str) -> dict:
        """The reply: role, content, citations, refused, grounded. A question whose answer fails is forgotten."""
        prior = self.turns[-self.history_messages :] if self.history_messages else []
        self.turns.append({"role": "user", "content": message})
        try:
            reply = self._answer(message, prior)
        except BaseException:
            self.turns.pop()
            raise
        self.turns.append(reply)
        return reply

    def _answer(self, message: str, prior: list[dict]) -> dict:
        spark = self.engine.spark
        question = spark.createDataFrame([(0, message)], "query_id long, query string")
        # the context is a handful of chunks
        rows = self.engine.search(question, "hybrid", self.context_chunks).collect()
        context = spark.createDataFrame([r.asDict() for r in rows], "query_id long, rank int, id string, score double, semantic_score double, lexical_score double, note_path string, note_title string, heading string, text string, snippet string")
        grounded = bool(rows) and max(0.0, *(r["semantic_score"] for r in rows)) >= self.floor
        if self.generate is None:
            if not grounded:
                return {"role": "assistant", "content": chat.REFUSAL, "citations": [], "refused": True, "grounded": False}
            content = chat.extractive(context).head()["answer"]
        else:
            said = spark.createDataFrame([(0, i, t["role"], t["content"]) for i, t in enumerate(prior)], "conv_id long, turn long, role string, text string")
            before = chat.history(said).head()
            block = chat.context_block(context).head()
            text = spark.range(1).select(chat.prompt(F.lit(message), F.lit(block["block"] if block else ""), F.lit(before["transcript"] if before else "")).alias("p"))
            content = self.generate(text.head()["p"])
        answer = spark.createDataFrame([(0, content)], "query_id long, answer string")
        cited = [r["note_path"] for r in chat.citations(answer, context).orderBy("pos").collect()]
        return {"role": "assistant", "content": content, "citations": cited, "refused": False, "grounded": grounded}
