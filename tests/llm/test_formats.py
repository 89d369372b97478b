"""Exact round trips: chat templates, MPEG audio and WARC archives."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import chat, mpeg_audio, tokenizers_, warc
from tests.llm.common import awkward

CONTROL = st.sampled_from([*chat.CONTROL, "\\", "\n", "<", "|im_end|>", "<\\|im_end|>", "a", " ", "é😀", "[", "INST]"])


@settings(max_examples=400, deadline=None)
@given(parts=st.lists(CONTROL, max_size=12))
def test_escape(parts):
    text = "".join(parts)
    shown = chat.escape(text)
    assert chat.unescape(shown) == text
    assert not any(c in shown for c in chat.CONTROL)
    assert chat._role_back(chat._role(text)) == text


@settings(max_examples=150, deadline=None)
@given(turns=st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a\nb", ""]), st.lists(CONTROL, max_size=8).map("".join)), min_size=1, max_size=6))
def test_round_trip(turns):
    f = chat._format(1, 0, turns, tokenizers_.path(chat.VOCABULARY))
    assert [(r, t) for r, t, _ in chat.parse(f.formatted)] == turns
    covered = "".join(f.formatted[a:b] for a, b in f.loss_spans)
    assert covered == "".join(chat.escape(t) for r, t in turns if r == "assistant")


def test_alignment_against_all_pairs():
    rng = random.Random(2)
    for _ in range(50):
        cuts = sorted(rng.sample(range(60), 12))
        offsets = np.array([(a, b) for a, b in zip([0, *cuts], [*cuts, 60], strict=True)])
        points = sorted(rng.sample(range(60), 6))
        spans = np.array(list(zip(points[::2], points[1::2], strict=True)))
        mask, found = chat.aligned(spans, offsets)
        assert mask.tolist() == [any(x < b and a < y for x, y in spans.tolist()) for a, b in offsets.tolist()]
        assert found == [tuple(x) for x in spans.tolist()]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_chat_query(spark, monkeypatch):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>x"), (2, None, None, None), (2, 3, "assistant", None), (None, 0, "assistant", "n"), (1, 1, "assistant", "<|im_end|>x"), (3, 0, "user", "only")]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    want = {1: (3, "user\nhi\nassistant\n<|im_end|>x\nassistant\n<|im_end|>x\n", "<|im_end|>x<|im_end|>x"), 2: (2, "\n\nassistant\n\n", ""), None: (1, "assistant\nn\n", "n"), 3: (1, "user\nonly\n", "")}
    got = {r["conv_id"]: r for r in chat.report(chat.format_conversations(turns)).collect()}
    assert {k: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for k, r in got.items()} == {k: (n, digest(t), len(x), digest(x)) for k, (n, t, x) in want.items()}
    assert chat.report(chat.format_conversations(turns.limit(0))).count() == 0


def test_chat_chunks(monkeypatch):
    """A conversation in several rows reads back as one."""
    monkeypatch.setattr(chat, "CHUNK_CHARS", 30)
    turns = [(1, "user", "x" * 15), (1, "assistant", "y" * 15), (1, "user", "z"), (2, "assistant", "w")]
    rows = list(chat.formatted(iter(turns), tokenizers_.path(chat.VOCABULARY)))
    assert [(f.conv_id, f.chunk) for f in rows] == [(1, 0), (1, 1), (2, 0)]
    assert [t for f in rows for _, t, _ in chat.parse(f.formatted)] == [t for _, _, t in turns]


def test_chat_parts_equal_the_whole(spark, monkeypatch):
    """Ids, masks and digests of a conversation given in parts are those of one encoded whole."""
    rng = random.Random(13)
    words = ["hello", " world", "\n", "\n\n", "  ", "é", "😀", "<|im_end|>", "</s>", "'s", "\t", "１２", "[INST]"]
    turns = [(c, rng.choice(["user", "assistant", "system\n", ""]), "".join(rng.choices(words, k=rng.randrange(9)))) for c in range(6) for _ in range(25)]
    file, schema = tokenizers_.path(chat.VOCABULARY), chat.SCHEMA

    def made():
        return list(chat.formatted(iter(turns), file))

    def digests(rows):
        df = spark.createDataFrame([(f.conv_id, f.chunk, f.turns, f.formatted, f.ids, f.loss_mask, [a for a, _ in f.loss_spans], [b for _, b in f.loss_spans]) for f in rows], schema).coalesce(1)
        return sorted(tuple(r) for r in chat.report(df).collect())

    whole = made()
    monkeypatch.setattr(chat, "CHUNK_CHARS", 60)
    parts = made()
    assert len(whole) == 6 < len(parts)
    for f in whole:
        own = [p for p in parts if p.conv_id == f.conv_id]
        assert [x for p in own for x in p.ids] == f.ids and [x for p in own for x in p.loss_mask] == f.loss_mask
        assert "".join(p.formatted for p in own) == f.formatted
        at, spans = 0, []
        for p in own:
            spans += [(a + at, b + at) for a, b in p.loss_spans]
            at += len(p.formatted)
        assert spans == f.loss_spans
    assert digests(whole) == digests(parts)


@settings(max_examples=100, deadline=None)
@given(content=st.binary(max_size=6000))
def test_audio_round_trip(content):
    payload = mpeg_audio.padded(content)
    data = mpeg_audio.store(payload, len(content))
    audio = mpeg_audio.read(data)
    assert mpeg_audio.payload(data, audio) == payload and len(payload) % 64 == 0 and payload
    assert audio.crc_bad == 0 and audio.skipped == 0 and audio.crc_good == audio.frames + 1
    assert audio.table[0] == audio.frames and audio.tags["content_bytes"] == str(len(content))


def test_audio_resynchronises():
    payload = bytes(random.Random(1).randbytes(64 * 100))
    data = mpeg_audio.store(payload)
    audio = mpeg_audio.read(data)
    first = audio.offsets[1]
    junk = b"\xff\xfb\x90\x00 junk \xff\xe0"
    broken = mpeg_audio.read(data[:first] + junk + data[first:] + b"TAG" + b"Title".ljust(125, b"\0"))
    assert broken.frames == audio.frames and broken.skipped == len(junk) and broken.tags["title"] == "Title"
    flipped = bytearray(data)
    flipped[first + 10] ^= 1
    assert mpeg_audio.read(bytes(flipped)).crc_bad == 1
    assert mpeg_audio.read(data[:-5]).frames == audio.frames - 1
    assert audio.microseconds == audio.frames * 1152 * 1_000_000 // 32000
    assert audio.seek(0) == audio.offsets[0] and audio.seek(0.036) == audio.offsets[1] and audio.seek(1e9) is None
    for raw in (b"", b"ID3", b"\xff", b"\xff\xfb", bytes(200)):
        assert mpeg_audio.read(raw).frames == 0
    # version 2, mono, unprotected, Layer III at 64 kbit/s and 22.05 kHz
    h = mpeg_audio.header(bytes((0xFF, 0xF3, 0x80, 0xC0)))
    assert (h.version, h.layer, h.protected, h.kbps, h.rate, h.size, h.samples, h.side) == (2, 3, False, 64, 22050, 208, 576, 9)


def bitwise_crc(bits):
    x = 0xFFFF
    for b in bits:
        x = (x << 1 ^ (0x8005 if (x >> 15 & 1) ^ b else 0)) & 0xFFFF
    return x


def to_bits(data):
    return [b >> 7 - k & 1 for b in data for k in range(8)]


def protected(word, bits, more):
    """A frame whose checksum covers ``bits``, followed by some more bits."""
    size = mpeg_audio.header(word).size
    body = bits + more
    body += [0] * (-len(body) % 8)
    raw = bytes(int("".join(map(str, body[k : k + 8])), 2) for k in range(0, len(body), 8))
    return (word + bitwise_crc(to_bits(word[2:]) + bits).to_bytes(2, "big") + raw).ljust(size, b"\0")


def test_audio_checksums_of_layers_one_and_two():
    rng = random.Random(3)
    flip = lambda data, at: data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]
    # Layer I: 4 bits for each subband and channel, shared from the bound on in joint stereo
    for mode, count in ((0x00, 64), (0x40, 4 + 4 + 28), (0x70, 16 + 16 + 16), (0xC0, 32)):
        word = bytes((0xFF, 0xFE, 0x90, mode))
        bits = [rng.randrange(2) for _ in range(4 * count)]
        data = protected(word, bits, [rng.randrange(2) for _ in range(100)]) * 3
        found = mpeg_audio.read(data)
        assert (found.frames, found.crc_good, found.crc_bad, found.rate) == (3, 3, 0, 44100)
        assert mpeg_audio.read(flip(data, 10)).crc_bad == 1
        # what follows is not covered
        assert mpeg_audio.read(flip(data, 6 + len(bits) // 8 + 3)).crc_bad == 0
    # Layer II: allocations by table, then two bits for each one that is not zero
    tables = {"a": [4] * 11 + [3] * 12 + [2] * 4, "b": [4] * 11 + [3] * 12 + [2] * 7, "c": [4] * 2 + [3] * 6, "d": [4] * 2 + [3] * 10, "low": [4] * 4 + [3] * 7 + [2] * 19}
    # first byte after the sync, bitrate index and rate, mode, table: 44.1 kHz at 192, 64 (mono 32) and 160; 32 kHz at 64; 48 kHz at 384; 22.05 kHz
    for second, third, mode, name in ((0xFC, 0xA0, 0x00, "b"), (0xFC, 0x10, 0xC0, "c"), (0xFC, 0x90, 0x40, "a"), (0xFC, 0x48, 0x00, "d"), (0xFC, 0xE4, 0x50, "a"), (0xF4, 0x80, 0x00, "low")):
        for _ in range(5):
            channels, bound = (1 if mode == 0xC0 else 2), (4 * (1 + (mode >> 4 & 3)) if mode >> 6 == 1 else 99)
            bits, chosen = [], 0
            for band, width in enumerate(tables[name]):
                for _ in range(channels if band < bound else 1):
                    value = rng.randrange(1 << width) * rng.randrange(2)
                    bits += [value >> width - 1 - k & 1 for k in range(width)]
                    chosen += (value > 0) * (1 if band < bound else channels)
            bits += [rng.randrange(2) for _ in range(2 * chosen)]
            data = protected(bytes((0xFF, second, third, mode)), bits, [rng.randrange(2) for _ in range(40)]) * 2
            found = mpeg_audio.read(data)
            assert (found.frames, found.crc_good, found.crc_bad) == (2, 2, 0), (name, mode)
            assert mpeg_audio.read(flip(data, 4)).crc_bad == 1


def text_frame(major, name, body, flags=b"\0\0"):
    size = len(body).to_bytes(3 if major == 2 else 4, "big") if major < 4 else mpeg_audio._safe(len(body))
    return name + size + (b"" if major == 2 else flags) + body


def tagged(major, flags, body):
    return b"ID3" + bytes((major, 0, flags)) + mpeg_audio._safe(len(body)) + body


def test_audio_tags():
    data = mpeg_audio.store(bytes(range(64)))
    _, at = mpeg_audio._tags(data)
    stream = data[at:]
    title = b"\0Old title"
    wide = b"\1" + "Ünï".encode("utf-16")
    assert b"\xff" in wide
    stuffed = lambda b: b.replace(b"\xff", b"\xff\0")
    packed = zlib.compress(title)
    cases = [
        (tagged(2, 0, text_frame(2, b"TT2", title) + text_frame(2, b"TXX", b"\0mood\0calm")), {"TT2": "Old title", "mood": "calm"}),
        (tagged(2, 0x80, stuffed(text_frame(2, b"TT2", wide))), {"TT2": "Ünï"}),
        (tagged(2, 0x40, text_frame(2, b"TT2", title)), {}),
        (tagged(3, 0x40, (6).to_bytes(4, "big") + bytes(6) + text_frame(3, b"TIT2", title)), {"TIT2": "Old title"}),
        (tagged(3, 0x80, stuffed(text_frame(3, b"TIT2", wide) + text_frame(3, b"TALB", title))), {"TIT2": "Ünï", "TALB": "Old title"}),
        (tagged(3, 0, text_frame(3, b"TIT2", len(title).to_bytes(4, "big") + packed, b"\0\x80") + text_frame(3, b"TALB", b"?" + title, b"\0\x20") + text_frame(3, b"TCOM", b"??", b"\0\x40")), {"TIT2": "Old title", "TALB": "Old title"}),
        (tagged(4, 0x40, mpeg_audio._safe(6) + b"\1\0" + text_frame(4, b"TIT2", title)), {"TIT2": "Old title"}),
        (tagged(4, 0x80, text_frame(4, b"TIT2", mpeg_audio._safe(len(wide)) + stuffed(wide), b"\0\x03")), {"TIT2": "Ünï"}),
        (tagged(4, 0, text_frame(4, b"TIT2", mpeg_audio._safe(len(title)) + packed, b"\0\x09") + text_frame(4, b"TALB", b"xx", b"\0\x04") + text_frame(4, b"TCON", b"broken", b"\0\x08")), {"TIT2": "Old title"}),
        (tagged(4, 0x10, text_frame(4, b"TIT2", title)) + b"3DI\4\0\x10" + bytes(4), {"TIT2": "Old title"}),
    ]
    for raw, want in cases:
        found = mpeg_audio.read(raw + stream)
        assert found.tags == want and found.frames == 1 and found.skipped == 0
    # two tags in a row, and one that ends beyond the data
    assert mpeg_audio.read(cases[0][0] + cases[3][0] + stream).tags == cases[0][1] | cases[3][1]
    assert mpeg_audio.read(b"ID3\3\0\0" + mpeg_audio._safe(5000) + text_frame(3, b"TIT2", title)).tags == {"TIT2": "Old title"}


def test_audio_vbri():
    seek = bytes(range(1, 21))
    table = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 2, 75, 123456, 789, 10, 1, 2, 50) + seek
    word = bytes((0xFF, 0xFB, 0xE8, 0xC0))
    size = mpeg_audio.header(word).size
    data = (word + bytes(32) + table).ljust(size, b"\0") + (word.ljust(size, b"\0")) * 3
    found = mpeg_audio.read(data)
    assert found.table == (789, 123456, seek) and found.frames == 3 and found.offsets == [size, 2 * size, 3 * size]


def naive_feature(data, content):
    """The feature from the sizes of the format alone."""
    padded = len(content) + (-len(content) % 64 or 0 if content else 64)
    rate = (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
    sizes = [144 * k * 1000 // 32000 for k in rate]
    left, offsets, kbps = padded, [], []
    at = len(data) - sum((lambda rest: [sizes[13]] * (rest // (sizes[13] - 38)) + ([next(x for x in sizes if x - 38 >= rest % (sizes[13] - 38))] if rest % (sizes[13] - 38) else []))(padded))
    while left > 0:
        k = next((i for i, x in enumerate(sizes) if x - 38 >= left), 13)
        offsets.append(at)
        kbps.append(rate[k])
        at += sizes[k]
        left -= sizes[k] - 38
    n = len(offsets)
    return f"frames={n};samples={1152 * n};rate=32000;us={36000 * n};kbps={min(kbps)}-{max(kbps)};crc={n + 1}/{n + 1};table={n};seek={zlib.crc32(struct.pack(f'<{n}Q', *offsets)):08x}"


def test_audio_feature():
    for n in (0, 1, 63, 64, 65, 1402, 5000, 70_000):
        content = random.Random(n).randbytes(n)
        data = mpeg_audio.store(mpeg_audio.padded(content), n)
        assert mpeg_audio.feature(mpeg_audio.read(data)) == naive_feature(data, content)


def test_audio_payload_like_a_tag():
    texts = [b"x" * 14 + b"TAG" + b"x" * 60, b"TAG" * 500, *(b"x" * k + b"TAG" + b"x" * (n - k) for n in (61, 2000) for k in range(n + 1))]
    for content in texts:
        data = mpeg_audio.store(mpeg_audio.padded(content), len(content))
        audio = mpeg_audio.read(data)
        assert mpeg_audio.payload(data, audio) == mpeg_audio.padded(content) and audio.skipped == 0 and set(audio.tags) == {"payload_bytes", "content_bytes"}
    # a tag after the frames, after junk and after a cut-off frame is still one
    tag = b"TAG" + b"Title".ljust(125, b"\0")
    for kept, frames, skipped in ((data, 2, 0), (data + b"junk", 2, 4), (data[:-5], 1, audio.sizes[-1] - 5)):
        found = mpeg_audio.read(kept + tag)
        assert (found.frames, found.skipped, found.tags["title"]) == (frames, skipped, "Title")
    with pytest.raises(ValueError, match="payload bytes"):
        mpeg_audio.payload(data[:-5])


def test_audio_column(spark):
    docs = awkward(spark)
    rows = mpeg_audio.report(mpeg_audio.to_media(docs)).collect()
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, hashlib.sha256(mpeg_audio.padded((r["text"] or "").encode())).hexdigest(), zlib.crc32(mpeg_audio.padded((r["text"] or "").encode())[-64:])) for r in docs.collect())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["payload_sha256"], r["tail_crc32"]) for r in rows) == want
    of = {(r["payload_sha256"], r["n_bytes"]): r for r in rows}
    for r in docs.collect():
        content = (r["text"] or "").encode()
        data = mpeg_audio.store(mpeg_audio.padded(content), len(content))
        row = of[hashlib.sha256(mpeg_audio.padded(content)).hexdigest(), len(content)]
        assert (row["media_bytes"], row["media_sha256"], row["feature"]) == (len(data), hashlib.sha256(data).hexdigest(), naive_feature(data, content))
    assert mpeg_audio.index_media(mpeg_audio.to_media(docs)).where("crc_bad > 0 or frames = 0").count() == 0
    assert mpeg_audio.report(mpeg_audio.to_media(docs.limit(0))).count() == 0


def pages(spark):
    big = "x" * 150
    rows = [(5, "http://www.b.org/p?q=1#f", big), (3, "https://b.org/p", big), (9, None, big), (1, "http://a.com", "small"), (2, "http://a.com", "small"), (7, "u\r\nv", None), (None, "http://c", big), (8, "http://c", "é" * 60), (4, "http://c", "é" * 60)]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")


def test_warc(spark):
    segments = warc.write(pages(spark))
    lines = warc.index(segments).collect()
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in lines}
    assert got == {5: ("revisit", 3, 150), 3: ("response", None, 150), 9: ("revisit", 3, 150), 1: ("response", None, 5), 2: ("response", None, 5), 7: ("response", None, 0), None: ("response", None, 150), 8: ("revisit", 4, 120), 4: ("response", None, 120)}
    assert [warc._order(tuple(r)) for r in lines] == sorted(warc._order(tuple(r)) for r in lines)
    for r in lines:
        headers, body = warc.fetch(segments, r["segment"], r["offset"])
        assert headers["warc-type"] == r["record_type"] and (r["record_type"] == "revisit" or hashlib.sha256(body).hexdigest() == r["payload_digest"])
    assert warc.report(warc.index(warc.write(pages(spark).limit(0)))).count() == 0


def test_warc_runs_and_ranges(spark):
    rng = random.Random(8)
    urls = ["http://hot.org/page"] * 150 + [f"http://h{rng.randrange(30)}.org/{rng.randrange(9)}" for _ in range(150)]
    rows = [(i, u, "page " * rng.randrange(60)) for i, u in enumerate(rng.sample(urls, 300))]
    segments = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5))
    assert segments.count() > 1
    whole = [tuple(r) for r in warc.index(segments).collect()]
    assert [warc._order(x) for x in whole] == sorted(warc._order(x) for x in whole) and len(whole) == 300
    lines = warc.sorted_runs(segments)
    assert lines.select("run").distinct().count() > 1
    for size in (1, 7, 100):
        cuts = warc.borders(lines, size)
        assert len(cuts) >= min(280, 300 // size - 1)
        # the hot address lies in several ranges, each merged by itself, all in order
        parts = warc.index(segments, size)
        assert [tuple(r) for r in parts.collect()] == whole
    assert warc.borders(lines.limit(0), 5) == [] == warc.borders(lines, 300)


def test_warc_reading_is_linear():
    import time

    one = warc.warc_record(1, "http://a", "2024-01-01T00:00:00Z", b"body" * 500, hashlib.sha256(b"body" * 500).hexdigest(), 2000, None)

    def took(n):
        started = time.perf_counter()
        assert sum(1 for _ in warc.records(one * n)) == n
        return time.perf_counter() - started

    assert min(took(8000) for _ in range(3)) < 24 * max(0.001, min(took(1000) for _ in range(3)))
    big = warc.warc_record(2, "http://b", "2024-01-01T00:00:00Z", rng_bytes := random.Random(1).randbytes(300_000), hashlib.sha256(rng_bytes).hexdigest(), 300_000, None)
    assert [len(body) for _, _, _, body in warc.records(one + big + one)] == [2000, 300_000, 2000]


def test_warc_export(spark, tmp_path):
    import gzip

    paths = [r["path"] for r in warc.export(warc.write(pages(spark)), f"file://{tmp_path}/out").collect()]
    whole = b"".join(gzip.open(p).read() for p in paths)
    assert whole.count(b"WARC/1.1\r\n") == 9


def test_warc_damage():
    record = warc.warc_record(1, "http://a", "2024-01-01T00:00:00Z", b"body", hashlib.sha256(b"body").hexdigest(), 4, None)
    assert warc.run_of("s", record)[0][-2] == "response"
    with pytest.raises(ValueError):
        warc.run_of("s", record[:-3])
    with pytest.raises(ValueError):
        warc.run_of("s", warc.warc_record(1, "http://a", "d", b"body", "0" * 64, 4, None))


def test_loser_tree():
    rng = random.Random(4)
    for k in range(8):
        runs = [sorted((rng.randrange(20), i) for i in range(rng.randrange(6))) for _ in range(k)]
        merged = list(warc.LoserTree(runs, key=lambda x: x))
        assert merged == sorted(x for r in runs for x in r)


def test_url_keys():
    assert warc.url_key("https://www.Example.com:443/a?b#c") == "com,example)/a?b"
    assert warc.url_key("http://x.org:8080?q") == "org,x:8080)?q"
    assert warc.url_key("") == ""


def test_packed_tag_frames(monkeypatch):
    """A packed frame is read whole, above 16 MB too; one that is too large is named."""
    import zlib

    from corvane.llm import mpeg_audio

    def tag(text):
        packed = zlib.compress(b"\3" + text)
        body = len(text).to_bytes(4, "big") + packed
        return b"TIT2" + len(body).to_bytes(4, "big") + b"\0\x80" + body

    long = b"a" * ((1 << 24) + 5)
    assert len(mpeg_audio._tag(3, 0, tag(long))["TIT2"]) == len(long)
    monkeypatch.setattr(mpeg_audio, "UNPACKED", 1 << 21)
    assert mpeg_audio._tag(3, 0, tag(long) + tag(b"short")) == {"too large": "TIT2", "TIT2": "short"}
