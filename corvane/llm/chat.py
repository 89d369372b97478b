r"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole as ``<|im_start|>role\ntext<|im_end|>\n`` for
each turn. Control strings inside texts and roles are escaped by a backslash
after their first character (one more where some stand there already), which
undoes exactly; a newline in a role becomes ``\n``, a backslash there ``\\``. The text is encoded once, with
offsets, by the byte-level BPE; the sorted spans of assistant turns are
intersected with the sorted token spans by binary search. A token is in the
loss if its span meets an assistant text; the characters of the loss are the
intersections.

Turns of a conversation are read in the order turn, role, text (nulls first)
from a sorted, spillable stream. A conversation of more than ``CHUNK_CHARS``
rendered characters is given in several rows, cut between turns, so memory is
bounded by a chunk and by the longest turn.

Defined results: null texts and roles are empty; a null conversation is one of
its own; repeated rows are turns of their own; an empty table gives no
conversations; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import tokenizers_
from corvane.llm.arrow import record
from corvane.storage import table

VOCABULARY = "byte_bpe_50k.json"
CHUNK_CHARS = 1 << 22
TRAINED = "assistant"

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that models of this kind read as control; texts may not contain them raw.
CONTROL = (START, END, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_RAW = re.compile("|".join(rf"(?:{re.escape(c[0])}\\*{re.escape(c[1:])})" for c in CONTROL))
_ESCAPED = re.compile("|".join(rf"(?:{re.escape(c[0])}\\+{re.escape(c[1:])})" for c in CONTROL))

SCHEMA = "conv_id long, chunk int, turns int, formatted string, ids array<int>, loss_mask array<boolean>, loss_starts array<long>, loss_ends array<long>"


def escape(text: str) -> str:
    return _RAW.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_back(shown: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(shown))


def parse(formatted: str) -> list[tuple[str, str, int]]:
    """(role, text, place of the escaped text) of each turn of a rendered text."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        out.append((_role_back(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end]), line + 1))
        at = end + len(END) + 1
    return out


@dataclass
class Formatted:
    conv_id: int | None
    chunk: int
    turns: int
    formatted: str
    ids: list[int]
    loss_mask: list[bool]
    loss_spans: list[tuple[int, int]]


@lru_cache(maxsize=2)
def _tokenizer(file: str):
    from tokenizers import Tokenizer, processors

    found = Tokenizer.from_file(file)
    found.encode_special_tokens = True
    # offsets must cover the spaces that tokens hold
    found.post_processor = processors.ByteLevel(trim_offsets=False)
    return found


def aligned(spans: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which tokens meet a span, and the merged intersections. Both lists are (start, end), sorted, spans disjoint."""
    mask = np.zeros(len(offsets), dtype=bool)
    if len(spans) == 0 or len(offsets) == 0:
        return mask, []
    starts, ends = offsets[:, 0], offsets[:, 1]
    # token ends and starts never fall, so the tokens that meet a span are consecutive
    first = np.searchsorted(ends, spans[:, 0], "right")
    last = np.searchsorted(starts, spans[:, 1], "left")
    found: list[tuple[int, int]] = []
    for (a, b), i, j in zip(spans.tolist(), first.tolist(), last.tolist(), strict=True):
        mask[i:j] = True
        for x, y in zip(np.maximum(starts[i:j], a).tolist(), np.minimum(ends[i:j], b).tolist(), strict=True):
            if x >= y:
                continue
            if found and found[-1][0] >= a and x <= found[-1][1]:
                found[-1] = (found[-1][0], max(found[-1][1], y))
            else:
                found.append((x, y))
    return mask, found


def _format(conv_id: int | None, chunk: int, turns: list[tuple[str, str]], file: str) -> Formatted:
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{_role(role)}\n", escape(text)
        if role == TRAINED and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END + "\n"]
        at += len(head) + len(body) + len(END) + 1
    whole = "".join(parts)
    code = _tokenizer(file).encode(whole, add_special_tokens=False)
    mask, found = aligned(np.array(spans, dtype=np.int64).reshape(-1, 2), np.array(code.offsets, dtype=np.int64).reshape(-1, 2))
    return Formatted(conv_id, chunk, len(turns), whole, code.ids, mask.tolist(), found)


def formatted(turns: Iterable[tuple[int | None, str, str]], file: str) -> Iterator[Formatted]:
    """Conversations, in chunks, from (conv_id, role, text) in order."""
    held: list[tuple[str, str]] = []
    current, chunk, size, any_yet = None, 0, 0, False
    for conv_id, role, text in turns:
        if any_yet and conv_id != current:
            yield _format(current, chunk, held, file)
            held, chunk, size = [], 0, 0
        elif held and size + len(text) > CHUNK_CHARS:
            yield _format(current, chunk, held, file)
            held, chunk, size = [], chunk + 1, 0
        current, any_yet = conv_id, True
        held.append((role, text))
        size += len(role) + len(text)
    if any_yet:
        yield _format(current, chunk, held, file)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
    for batch in batches:
        for conv_id, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            yield conv_id, role or "", text or ""


def _sorted(conversations: DataFrame) -> DataFrame:
    """All turns of a conversation in one task, in order; the stream is sorted by Spark and may spill."""
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def format_conversations(conversations: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Rendered texts, token ids and loss masks, see SCHEMA; loss spans are places in ``formatted``."""
    file = vocabulary or tokenizers_.path(VOCABULARY)

    def run(batches):
        held: list[Formatted] = []
        size = 0
        for f in formatted(_rows(batches), file):
            held.append(f)
            size += len(f.formatted)
            if size > CHUNK_CHARS // 4:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)

    return _sorted(conversations).mapInArrow(run, SCHEMA)


def _batch(held: list[Formatted]) -> pa.RecordBatch:
    return record(
        conv_id=([f.conv_id for f in held], pa.int64()), chunk=([f.chunk for f in held], pa.int32()), turns=([f.turns for f in held], pa.int32()), formatted=([f.formatted for f in held], pa.string()), ids=([f.ids for f in held], pa.list_(pa.int32())),
        loss_mask=([f.loss_mask for f in held], pa.list_(pa.bool_())), loss_starts=([[a for a, _ in f.loss_spans] for f in held], pa.list_(pa.int64())), loss_ends=([[b for _, b in f.loss_spans] for f in held], pa.list_(pa.int64())),
    )


REPORT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def report(chunks: DataFrame) -> DataFrame:
    """Digests of what ``format_conversations`` gave, read back from its texts and masks.

    Chunks of a conversation follow each other within a task, as they were made.
    """

    def run(batches):
        out: dict[str, list] = {k: [] for k in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
        state: list | None = None

        def close():
            if state is not None:
                for k, v in zip(out, (state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]), strict=True):
                    out[k].append(v)

        for batch in batches:
            for conv_id, chunk, text, starts, ends in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if chunk == 0:
                    close()
                    state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                # spans of one turn stand together: what a turn's loss is, unescaped as a whole
                loss: dict[int, list[str]] = {}
                turns = parse(text)
                places = [p for _, _, p in turns]
                for turn in np.searchsorted(places, starts, "right") - 1 if starts else ():
                    loss.setdefault(int(turn), [])
                for turn, a, b in zip((np.searchsorted(places, starts, "right") - 1).tolist() if starts else (), starts, ends, strict=True):
                    loss[turn].append(text[a:b])
                for role, body, _ in turns:
                    state[1] += 1
                    state[2].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                for turn in sorted(loss):
                    plain = unescape("".join(loss[turn]))
                    state[3] += len(plain)
                    state[4].update(plain.encode("utf-8", "surrogatepass"))
                state[5] += len(text)
            if len(out["conv_id"]) >= 4096:
                yield _report(out)
                out = {k: [] for k in out}
        close()
        if out["conv_id"]:
            yield _report(out)

    return chunks.select("conv_id", "chunk", "formatted", "loss_starts", "loss_ends").mapInArrow(run, REPORT)


def _report(out: dict[str, list]) -> pa.RecordBatch:
    return record(**{k: (v, pa.string() if k.endswith("sha256") else pa.int64()) for k, v in out.items()})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return report(format_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)))
