r"""Secret scans.

One pass of an Aho-Corasick automaton over a text (ASCII letters lower-cased)
finds the places of keywords; regular expressions are tried only there,
anchored at the hit. Long hexadecimal runs have no keyword and are found by one
plain expression. Tokens that carry a checksum are reported only if it holds.

Base kinds, leftmost and non-overlapping within a kind: ``assign`` (a value of
8 characters or more given to a name like a password), ``access`` (key ids of
16 characters or more), ``hex`` (32 characters or more); a base match that is
too short is dropped but still takes its place. Added kinds: ``github`` and
``npm`` tokens whose last six characters are the base-62 CRC-32 of the thirty
before. Spans count code points, the end is exclusive.

Defined results: null and empty texts have no spans; repeated rows repeat;
an empty table gives no rows. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.arrow import as_texts, by_place, pieces, record
from corvane.storage import table

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "github", "npm")

#: Keywords, in lower case, and the kind that each may begin.
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "api_key": "assign", "apikey": "assign", "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm"}

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

Span = tuple[int, int, str]


def checksum(body: str) -> str:
    """Six base-62 digits of the CRC-32 of a token's body."""
    rest, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        rest, digit = divmod(rest, 62)
        out = _DIGITS[digit] + out
    return out


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def spans(text: str) -> list[Span]:
    """(start, end, kind), by start, then kind as in KINDS."""
    out: list[Span] = []
    hits: dict[str, list[int]] = {}
    for last, (kind, size) in _automaton().iter(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")):
        hits.setdefault(kind, []).append(last - size + 1)
    if hits:
        end = 0
        for start in sorted(hits.get("assign", ())):
            if start >= end and (found := _ASSIGN.match(text, start)):
                end = found.end()
                if end - found.start(2) >= 8:
                    out.append((start, end, "assign"))
        end = 0
        for start in hits.get("access", ()):
            if start >= end and (found := _ACCESS.match(text, start)):
                end = found.end()
                if end - start >= 16:
                    out.append((start, end, "access"))
        for kind in ("github", "npm"):
            for start in hits.get(kind, ()):
                if (found := _CHECKED.match(text, start)) and checksum(found[1]) == found[2]:
                    out.append((start, found.end(), kind))
    out += [(found.start(), found.end(), "hex") for found in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def shown(found: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


def scan(documents: DataFrame) -> DataFrame:
    """A row for each document, see SCHEMA."""

    def run(batches):
        for batch in pieces(batches):
            found = [spans(t) for t in as_texts(batch.column(1))]
            base = [[x for x in row if x[2] in BASE] for row in found]
            counts = {f"n_{kind}": ([sum(x[2] == kind for x in row) for row in base], pa.int64()) for kind in BASE}
            yield record(doc_id=(batch.column(0), pa.int64()), **counts, base_sha256=([hashlib.sha256(shown(row).encode()).hexdigest() for row in base], pa.string()), spans=([shown(row) for row in found], pa.string()))

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """The text with each span, or run of touching spans, replaced by the mark."""
    out, last = [], 0
    end = -1
    for start, stop, _ in spans(text):
        if start > end:
            out += [text[last:start], mark]
            end = stop
        end = max(end, stop)
        last = end
    return "".join([*out, text[last:]])


def redact(documents: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns, secrets in ``text`` replaced; null stays null."""
    names = documents.columns
    at = names.index("text")

    def run(batches):
        for batch in pieces(batches):
            texts = [t and redacted(t, mark) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(names))], names=names)

    return by_place(documents, run)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
