"""Token counts and packing against the libraries on whole texts."""

import random
import zlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import packing, token_counts, tokenizers_
from tests.llm.common import awkward, documents

TEXTS = st.one_of(st.text(max_size=60), st.text(alphabet=" \n\t\r▁aA'sé.,1𝒜ß́İΣ#|x\x00\x1c\x85 ", max_size=60))
PIECE, WORD = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECE)


@pytest.fixture(scope="module")
def word_model():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(WORD)
    return found


@settings(max_examples=500, deadline=None)
@given(text=TEXTS)
def test_counts_as_whole_texts(pieces, text):
    assert tokenizers_.piece_counter(PIECE).count(text) == len(pieces.encode(text))


@settings(max_examples=500, deadline=None)
@given(text=TEXTS)
def test_ids_as_whole_texts(word_model, text):
    want = word_model.encode(text, add_special_tokens=False).ids
    assert tokenizers_.word_encoder(WORD).encode(text) == b"".join(i.to_bytes(4, "little") for i in want)


@pytest.mark.parametrize("text", ["</s><s>[INST] ok", "<unk> <0x0A>", "<|endoftext|> x<|startoftext|>", "Hello, World! it's", " lead", "trail ", "a  b", ""])
def test_special_strings(pieces, word_model, text):
    assert tokenizers_.piece_counter(PIECE).count(text) == len(pieces.encode(text))
    want = word_model.encode(text, add_special_tokens=False).ids
    assert tokenizers_.word_encoder(WORD).encode(text) == b"".join(i.to_bytes(4, "little") for i in want)


def test_cache(spark, tmp_path, pieces):
    cache = str(tmp_path / "cache")
    docs = awkward(spark)
    got = token_counts.count_tokens(docs, cache).collect()
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == sorted((r["doc_id"] or -1, len((r["text"] or "").encode()), len(pieces.encode(r["text"] or "")), len(pieces.encode(r["text"] or "")) > 4096) for r in docs.collect())
    before = spark.read.parquet(cache).count()
    # known texts add nothing, one new text one row
    token_counts.fill(docs.unionByName(documents(spark, ["brand new"], 100)), cache)
    rows = spark.read.parquet(cache)
    assert rows.count() == before + 1 == rows.select("digest").distinct().count()
    assert token_counts.count_tokens(docs.limit(0), cache).count() == 0


def test_filled_cache_shuffles_no_text(spark, tmp_path, pieces):
    cache = str(tmp_path / "cache")
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "ß", "x"]) + str(i) for _ in range(400)) for i in range(60)]
    docs = documents(spark, texts + texts[:20])
    want = sorted((i, len(pieces.encode(t))) for i, t in enumerate(texts + texts[:20]))
    assert sorted((r["doc_id"], r["n_tokens"]) for r in token_counts.count_tokens(docs, cache).collect()) == want

    def written():
        jvm = spark.sparkContext._jsc.sc().statusStore()
        stages = jvm.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = written()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in token_counts.count_tokens(docs, cache).collect()) == want
    # 80 rows of keys against 160 kB of texts
    assert written() - before < 40_000


def test_heavy_texts(spark, tmp_path, monkeypatch, pieces):
    monkeypatch.setattr(token_counts, "HEAVY", 3)
    docs = documents(spark, ["one text"] * 9 + ["another one"] * 2 + [None] * 5)
    docs = docs.unionByName(docs.where("doc_id < 2")).unionByName(awkward(spark))
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(docs, str(tmp_path / "c")).collect()))
    assert got == sorted(((r["doc_id"] is None, r["doc_id"] or 0, len((r["text"] or "").encode()), len(pieces.encode(r["text"] or ""))) for r in docs.collect()))


def test_many_strings(pieces):
    """40,000 awkward strings, by words and whole."""
    rng = random.Random(6)
    parts = [" ", "  ", "\t", "\n", "▁", "a", "the", "ing", "</s>", "<s>", "[INST]", "<unk>", "<0x0A>", "é", "ß", "ﬁ", "😀", "\u3000", "\u00a0", "\u200b", "\x00", "\x7f", "1", "12", "...", "'s", "A", "Ω", "中", "़", "\u0301", "\ufeff", "\r\n", "tokenization", "   x"]
    counter = tokenizers_.piece_counter(PIECE)
    assert counter.by_word
    for _ in range(40_000):
        text = "".join(rng.choices(parts, k=rng.randrange(1, 12)))
        assert counter.count(text) == len(pieces.encode(text)), text


def test_packing(spark, word_model):
    docs = awkward(spark)
    rows = packing.pack(docs).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    whole = {}
    for r in rows:
        assert r["length"] in {1 << k for k in range(12)} and r["offset"] == 0 and len(r["ids"]) == 4 * r["length"]
        whole.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], bytes(r["ids"])))
    for d in docs.where("doc_id <> 4").collect():
        want = [*word_model.encode(d["text"] or "", add_special_tokens=False).ids, 1]
        parts = sorted(whole[d["doc_id"], len(want)])
        assert b"".join(p for _, p in parts) == b"".join(i.to_bytes(4, "little") for i in want)
        assert [s for s, _ in parts] == [sum(len(p) // 4 for _, p in parts[:k]) for k in range(len(parts))]
    first = packing.report(packing.pack(documents(spark, ["abc"]))).head()
    assert first["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in [*word_model.encode("abc", add_special_tokens=False).ids, 1][: first["length"]]))
    assert packing.pack(docs.limit(0)).count() == 0
    assert packing.lengths(5000) == [2048, 2048, 512, 256, 128, 8]
    with pytest.raises(ValueError):
        packing.pack(docs, limit=1000)


def test_buckets(spark, tmp_path):
    packing.write_buckets(packing.pack(documents(spark, ["one two three", "four"])), str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.where("pow(2, bucket) <> length").count() == 0


def test_many_misses_move_no_hits(spark, tmp_path, monkeypatch):
    """Above the size of a broadcast, the texts that the cache knows stay where they are."""
    old, new = [f"known text number {i}" for i in range(3000)], [f"new text number {i}" for i in range(400)]
    cache = str(tmp_path / "cache")
    token_counts.fill(documents(spark, old), cache)
    monkeypatch.setattr(token_counts, "BROADCAST_ROWS", 100)
    seen = []
    likely = token_counts.likely
    monkeypatch.setattr(token_counts, "likely", lambda *a: seen.append(likely(*a)) or seen[-1])
    docs = documents(spark, [*old, *new, *new])
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, cache).collect()}
    passed = [r["text"] for r in seen[0].collect()]
    assert set(new) <= set(passed) and len(passed) - 2 * len(new) < 0.1 * len(old)
    plain = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, str(tmp_path / "other")).collect()}
    assert got == plain and len(got) == 3800
