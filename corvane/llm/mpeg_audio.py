"""MPEG audio as a media column: writing, reading back and indexing.

``store`` lays a payload into MPEG-1 Layer III frames: an ID3v2 tag with the
payload's size, a frame with a variable-bitrate table (frame and byte counts
and 100 seek points), then CRC-protected frames whose bodies hold the payload
bytes, the last of a smaller bitrate where that is enough.

``read`` works on any bytes: it parses ID3v2 (2.2 to 2.4, with extended headers,
unsynchronised and compressed frames; encrypted ones are passed over) and ID3v1
tags, resynchronises on frame headers (a header counts only if the next one
follows where it says, or the stream ends there), parses variable-bitrate tables
(Xing, Info and VBRI), verifies the CRC of each protected frame of any layer, and
gives exact durations (samples over rate) and the byte offset of every audio
frame. Junk between frames is skipped and counted.

Defined results: a null or empty payload is 64 zero bytes; equal texts give
equal values; bytes without a frame have none and duration 0; cut-off last
frames are not counted, and a stored payload that is not there whole raises; an
ID3v1 tag is none where a whole frame in step covers it; repeated rows repeat.
Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.arrow import as_bytes, pieces, record
from corvane.storage import table

BLOCK = 64

# Fixed values of the format.
#: kbit/s by (version 1 or 2, layer) and header index 1 to 14.
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
#: Samples a second by version bits and header index.
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
#: Bytes of Layer III side information by (version 1, mono).
SIDE = {(True, False): 32, (True, True): 17, (False, False): 17, (False, True): 9}


#: Layer II: bits of an allocation by subband, as (subbands, bits) from the lowest; by table.
ALLOCATED = {"a": ((11, 4), (12, 3), (4, 2)), "b": ((11, 4), (12, 3), (7, 2)), "c": ((2, 4), (6, 3)), "d": ((2, 4), (10, 3)), "low": ((4, 4), (7, 3), (19, 2))}


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    protected: bool
    kbps: int
    rate: int
    mono: bool
    size: int
    samples: int
    #: The subband from which joint stereo shares its allocation; 32: none does.
    bound: int = 32

    @property
    def side(self) -> int:
        return SIDE[self.version == 1, self.mono] if self.layer == 3 else 0

    def alike(self, other: Header) -> bool:
        """Of the same stream: only bitrate, padding and protection may differ."""
        return (self.version, self.layer, self.rate, self.mono) == (other.version, other.layer, other.rate, other.mono)


@lru_cache(maxsize=4096)
def header(word: bytes) -> Header | None:
    """Four bytes as a frame header; None if they aren't one or the bitrate is free."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    bits, layer = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3)
    index, rate = word[2] >> 4, word[2] >> 2 & 3
    if bits == 1 or layer == 4 or index in (0, 15) or rate == 3 or word[3] & 3 == 2:
        return None
    version = 1 if bits == 3 else 2
    kbps, hertz, pad = BITRATES[version, layer][index - 1], RATES[bits][rate], word[2] >> 1 & 1
    if layer == 1:
        size, samples = (12 * kbps * 1000 // hertz + pad) * 4, 384
    else:
        samples = 576 if layer == 3 and version == 2 else 1152
        size = samples // 8 * kbps * 1000 // hertz + pad
    bound = 4 * (1 + (word[3] >> 4 & 3)) if word[3] >> 6 == 1 else 32
    return Header(version, layer, not word[1] & 1, kbps, hertz, word[3] >> 6 == 3, size, samples, bound)


def _table() -> list[int]:
    out = []
    for i in range(256):
        x = i << 8
        for _ in range(8):
            x = x << 1 ^ 0x8005 if x & 0x8000 else x << 1
        out.append(x & 0xFFFF)
    return out


_CRC = _table()


@lru_cache(maxsize=65536)
def crc16(data: bytes) -> int:
    """CRC-16 of the format: polynomial 0x8005, all ones at first."""
    x = 0xFFFF
    for b in data:
        x = x << 8 & 0xFFFF ^ _CRC[x >> 8 ^ b]
    return x


def _crc_bits(head: bytes, data: bytes, bits: int) -> int:
    """CRC-16 over the header's last two bytes and so many bits of what follows the checksum."""
    x = crc16(head + data[: bits // 8])
    for k in range(bits % 8):
        top = x >> 15 ^ data[bits // 8] >> 7 - k & 1
        x = (x << 1 ^ 0x8005 * top) & 0xFFFF
    return x


def covered(h: Header, data: bytes) -> int:
    """How many bits after the checksum it covers: side information, or allocations and, in Layer II, scale factor selections."""
    if h.layer == 3:
        return 8 * h.side
    channels = 1 if h.mono else 2
    if h.layer == 1:
        return 4 * (32 if h.mono else h.bound * 2 + 32 - h.bound)
    each = h.kbps // channels
    if h.version == 2:
        name = "low"
    elif each <= 48:
        name = "d" if h.rate == 32000 else "c"
    else:
        name = "a" if each <= 80 or h.rate == 48000 else "b"
    at = selected = 0
    value, n = int.from_bytes(data, "big"), 8 * len(data)
    for band, width in enumerate(w for count, w in ALLOCATED[name] for _ in range(count)):
        own = channels if band < h.bound else 1
        for _ in range(own):
            if at + width <= n and value >> n - at - width & (1 << width) - 1:
                selected += channels // own
            at += width
    return at + 2 * selected


#: Bytes that a Layer II checksum can cover at most.
_MOST_COVERED = 64


def _frame(index: int, body: bytes) -> bytes:
    """A protected stereo frame at 32 kHz of BITRATES[1, 3][index - 1], its body zero-padded."""
    word = bytes((0xFF, 0xFA, index << 4 | 0x08, 0x00))
    side = bytes(32)
    size = header(word).size
    return b"".join((word, crc16(word[2:] + side).to_bytes(2, "big"), side, body, bytes(size - 38 - len(body))))


#: Body bytes of a frame by bitrate index.
_ROOM = {i: header(bytes((0xFF, 0xFA, i << 4 | 0x08, 0x00))).size - 38 for i in range(1, 15)}


def _safe(n: int) -> bytes:
    return bytes(n >> k & 127 for k in (21, 14, 7, 0))


def _text_frame(name: str, value: str) -> bytes:
    body = b"\x03" + name.encode() + b"\0" + value.encode()
    return b"TXXX" + _safe(len(body)) + b"\0\0" + body


def store(payload: bytes, n_bytes: int | None = None) -> bytes:
    """The payload as an MPEG audio stream; ``n_bytes`` of it are content."""
    tags = _text_frame("payload_bytes", str(len(payload))) + _text_frame("content_bytes", str(len(payload) if n_bytes is None else n_bytes))
    tag = b"ID3\x04\0\0" + _safe(len(tags)) + tags
    room, frames = _ROOM[14], []
    for at in range(0, len(payload), room):
        body = payload[at : at + room]
        frames.append(_frame(14 if len(body) == room else next(i for i in range(1, 15) if _ROOM[i] >= len(body)), body))
    first = 14
    total = header(bytes((0xFF, 0xFA, first << 4 | 0x08, 0))).size + sum(map(len, frames))
    offsets, at = [], total - sum(map(len, frames))
    for f in frames:
        offsets.append(at)
        at += len(f)
    points = bytes(min(255, 256 * offsets[k * len(offsets) // 100] // total) for k in range(100)) if offsets else bytes(100)
    vbr = b"Xing" + struct.pack(">III", 7, len(frames), total) + points
    return b"".join((tag, _frame(first, vbr), *frames))


@dataclass
class Audio:
    """What ``read`` finds; offsets are of audio frames, without the table's frame."""

    tags: dict[str, str] = field(default_factory=dict)
    frames: int = 0
    samples: int = 0
    rate: int = 0
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    crc_good: int = 0
    crc_bad: int = 0
    skipped: int = 0
    table: tuple[int, int, bytes] | None = None
    kbps_low: int = 0
    kbps_high: int = 0
    bodies: list[tuple[int, int]] = field(default_factory=list)

    @property
    def microseconds(self) -> int:
        return self.samples * 1_000_000 // self.rate if self.rate else 0

    def seek(self, seconds: float) -> int | None:
        """Offset of the frame that plays at that time."""
        if not self.offsets or seconds < 0 or seconds * self.rate >= self.samples:
            return None
        return self.offsets[int(seconds * self.rate) // (self.samples // self.frames)]


def _synced(data: bytes) -> bytes:
    return data.replace(b"\xff\0", b"\xff")


def _number(raw: bytes, bits: int = 8) -> int:
    value = 0
    for b in raw:
        value = value << bits | b & (1 << bits) - 1
    return value


#: What a tag's own size can state; a frame that unpacks to more is named under ``TOO_LARGE`` instead of read.
UNPACKED = (1 << 28) - 1
TOO_LARGE = "too large"


def _content(major: int, flags: int, body: bytes, unsynced: bool) -> bytes | None:
    """A frame's content by its format flags; None if it is encrypted or damaged, ``OverflowError`` where it unpacks to more than ``UNPACKED`` bytes."""
    if major == 3:
        if flags & 0x40:
            return None
        skip = 4 * bool(flags & 0x80) + bool(flags & 0x20)
        packed = flags & 0x80
    else:
        if flags & 0x04:
            return None
        if flags & 0x02 or unsynced:
            body = _synced(body)
        skip = bool(flags & 0x40) + 4 * bool(flags & 0x01)
        packed = flags & 0x08
    body = body[skip:]
    if packed:
        unpack, parts, size = zlib.decompressobj(), [], 0
        try:
            while body and not unpack.eof:
                parts.append(unpack.decompress(body, 1 << 20))
                size, body = size + len(parts[-1]), unpack.unconsumed_tail
                if size > UNPACKED:
                    raise OverflowError
            return b"".join([*parts, unpack.flush()])
        except zlib.error:
            return None
    return body


def _tag(major: int, flags: int, body: bytes) -> dict[str, str]:
    """Text frames of one ID3v2 tag."""
    found: dict[str, str] = {}
    if flags & 0x80 and major < 4:
        body = _synced(body)
    p = 0
    if major >= 3 and flags & 0x40:
        # 2.3 counts the extended header without its size, 2.4 with it
        p = 4 + _number(body[:4]) if major == 3 else _number(body[:4], 7)
    named, head = (3, 6) if major == 2 else (4, 10)
    while p + head <= len(body) and body[p]:
        name = body[p : p + named].decode("latin-1")
        n = _number(body[p + named : p + 2 * named], 7 if major == 4 else 8)
        raw = body[p + head : p + head + n]
        p += head + n
        try:
            content = raw if major == 2 else _content(major, body[p - n - 1], raw, bool(flags & 0x80))
        except OverflowError:
            found[TOO_LARGE] = " ".join([*found.get(TOO_LARGE, "").split(), name])
            continue
        if name[:1] == "T" and content:
            text = content[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(content[0], "utf-8"), "replace").rstrip("\0")
            if name in ("TXXX", "TXX"):
                name, _, text = text.partition("\0")
            found[name] = text
    return found


def _tags(data: bytes) -> tuple[dict[str, str], int]:
    """ID3v2 tags at the start and the place after them."""
    found: dict[str, str] = {}
    at = 0
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10:
        major, flags = data[at + 3], data[at + 5]
        size = _number(data[at + 6 : at + 10], 7)
        # 2.2 marks a compression by 0x40 that was never defined
        if major in (3, 4) or major == 2 and not flags & 0x40:
            found |= _tag(major, flags, data[at + 10 : at + 10 + size])
        at = at + 10 + size + 10 * bool(major == 4 and flags & 0x10)
    return found, min(at, len(data))


def _vbr(h: Header, data: bytes, at: int, start: int) -> tuple[int, int, bytes] | None:
    """(frames, bytes, seek table) if the frame at ``at`` holds a variable-bitrate table; its body begins at ``start``."""
    if h.layer != 3:
        return None
    if data[start : start + 4] in (b"Xing", b"Info"):
        flags, p, values = int.from_bytes(data[start + 4 : start + 8], "big"), start + 8, [0, 0]
        for k in (0, 1):
            if flags >> k & 1:
                values[k] = int.from_bytes(data[p : p + 4], "big")
                p += 4
        return values[0], values[1], data[p : p + 100] if flags & 4 else b""
    p = at + 36
    if data[p : p + 4] == b"VBRI" and p + 26 <= at + h.size:
        _, _, _, size, frames, entries, _, width, _ = struct.unpack(">HHHIIHHHH", data[p + 4 : p + 26])
        return frames, size, data[p + 26 : min(p + 26 + entries * width, at + h.size)]
    return None


def read(data: bytes) -> Audio:
    out = Audio()
    out.tags, at = _tags(data)
    tagged = len(data) - at >= 128 and data[-128:-125] == b"TAG"
    end = len(data) - 128 * tagged
    stream: Header | None = None
    locked = False
    while at < end and at + 4 <= len(data):
        h = header(data[at : at + 4])
        if h is not None and at < end < at + h.size <= len(data) and (stream is None or h.alike(stream)):
            # what looks like a tag is the frame's own if the frame ends the stream or the next one follows
            follow = header(data[at + h.size : at + h.size + 4])
            if at + h.size == len(data) or follow is not None and follow.alike(h):
                end = len(data)
        ok = h is not None and at + h.size <= end and (stream is None or h.alike(stream))
        if ok and not locked:
            # out of step: the next header must stand where this one says
            after = at + h.size
            follow = header(data[after : after + 4])
            ok = after == end or follow is not None and follow.alike(h)
        if not ok:
            locked = False
            step = data.find(b"\xff", at + 1, end)
            step = end if step < 0 else step
            out.skipped += step - at
            at = step
            continue
        start = at + 4
        if h.protected:
            start += 2
            body = data[start : min(start + (h.side or _MOST_COVERED), at + h.size)]
            bits = covered(h, body)
            good = bits <= 8 * len(body) and _crc_bits(data[at + 2 : at + 4], body, bits) == int.from_bytes(data[at + 4 : at + 6], "big")
            out.crc_good, out.crc_bad = out.crc_good + good, out.crc_bad + (not good)
        start += h.side
        table_ = _vbr(h, data, at, start) if stream is None else None
        if table_ is not None:
            out.table = table_
        else:
            out.offsets.append(at)
            out.sizes.append(h.size)
            out.bodies.append((start, at + h.size))
            out.frames += 1
            out.samples += h.samples
            out.rate = h.rate
            out.kbps_low = min(out.kbps_low or h.kbps, h.kbps)
            out.kbps_high = max(out.kbps_high, h.kbps)
        stream, locked = h, True
        at += h.size
    out.skipped += max(0, end - at)
    if end < len(data):
        for key, low, high in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93)):
            if text := data[end + low : end + high].rstrip(b" \0").decode("latin-1"):
                out.tags.setdefault(key, text)
    return out


def payload(data: bytes, audio: Audio | None = None) -> bytes:
    """The payload that ``store`` laid down; raises if some of it is missing."""
    audio = audio or read(data)
    n = int(audio.tags["payload_bytes"])
    back = b"".join(data[a:b] for a, b in audio.bodies)[:n]
    if len(back) < n:
        raise ValueError(f"{len(back)} of {n} payload bytes found")
    return back


def padded(content: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return content + bytes(-len(content) % BLOCK if content else BLOCK)


def feature(audio: Audio) -> str:
    """Exact duration, checks and a digest of the seek offsets, as text."""
    digest = zlib.crc32(struct.pack(f"<{len(audio.offsets)}Q", *audio.offsets))
    return f"frames={audio.frames};samples={audio.samples};rate={audio.rate};us={audio.microseconds};kbps={audio.kbps_low}-{audio.kbps_high};crc={audio.crc_good}/{audio.crc_good + audio.crc_bad};table={audio.table[0] if audio.table else 0};seek={digest:08x}"


MEDIA = "doc_id long, media binary"
INDEX = "media_bytes long, frames long, samples long, rate int, duration_us long, crc_good long, crc_bad long, skipped long, offsets array<long>"
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def to_media(documents: DataFrame) -> DataFrame:
    """Each text as a stored stream: doc_id, media."""

    def run(batches):
        for batch in pieces(batches, 512):
            yield record(doc_id=(batch.column(0), pa.int64()), media=([store(padded(t), len(t)) for t in as_bytes(batch.column(1))], pa.binary()))

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, MEDIA)


def index_media(media: DataFrame) -> DataFrame:
    """doc_id and INDEX of each row of (doc_id, media); null media count as empty."""

    def run(batches):
        for batch in pieces(batches, 512):
            raw = [x or b"" for x in batch.column(1).to_pylist()]
            found = [read(x) for x in raw]
            yield record(
                doc_id=(batch.column(0), pa.int64()), media_bytes=([len(x) for x in raw], pa.int64()), frames=([a.frames for a in found], pa.int64()), samples=([a.samples for a in found], pa.int64()), rate=([a.rate for a in found], pa.int32()),
                duration_us=([a.microseconds for a in found], pa.int64()), crc_good=([a.crc_good for a in found], pa.int64()), crc_bad=([a.crc_bad for a in found], pa.int64()), skipped=([a.skipped for a in found], pa.int64()), offsets=([a.offsets for a in found], pa.list_(pa.int64())),
            )

    return media.select(F.col("doc_id").cast("long"), F.col("media").cast("binary")).mapInArrow(run, f"doc_id long, {INDEX}")


def report(media: DataFrame) -> DataFrame:
    """What a stored column says of its payloads, read back from its bytes."""

    def run(batches):
        for batch in pieces(batches, 512):
            out: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for data in batch.column(1).to_pylist():
                audio = read(data)
                back = payload(data, audio)
                for k, v in (("n_bytes", int(audio.tags["content_bytes"])), ("payload_bytes", len(back)), ("payload_sha256", hashlib.sha256(back).hexdigest()), ("tail_crc32", zlib.crc32(back[-BLOCK:])), ("media_bytes", len(data)), ("media_sha256", hashlib.sha256(data).hexdigest()), ("feature", feature(audio))):
                    out[k].append(v)
            yield record(doc_id=(batch.column(0), pa.int64()), **{k: (v, pa.string() if v and isinstance(v[0], str) else pa.int64()) for k, v in out.items()})

    return media.mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(to_media(table(spark, sf_dir, "documents")))
