"""Exact, cached encoders over the files of public tokenizers.

Both split a text where the tokenizer itself can never join across, encode each
distinct piece once by the library and keep the results of a bounded number of
pieces. The tests compare them with the library's own encoding of whole texts.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from functools import lru_cache

import public_tokenizers

#: Pieces kept by a cache; it starts anew beyond that. About 100 MB at most.
KEPT = 300_000
#: Longer pieces are encoded each time.
KEPT_CHARS = 64


def path(name: str) -> str:
    return public_tokenizers.path(name)


@lru_cache(maxsize=16)
def version(file: str) -> str:
    """Digest of a tokenizer file: results of another version are never reused."""
    with open(file, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class _Kept(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.clear()
            self[key] = value
        return value


class PieceCounter:
    """Numbers of tokens by a sentencepiece BPE model, whole texts.

    Where each piece of the vocabulary has word marks at its start only, and
    spaces are kept and marked by the model, merges never cross from a word into
    the next word's mark: a text's count is that of its words, each with the spaces
    before it. Otherwise whole texts are encoded.
    """

    def __init__(self, file: str):
        import sentencepiece

        self._model = model = sentencepiece.SentencePieceProcessor(model_file=file)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_control(i)]
        # a model that drops spaces, or puts no mark before a text, is asked for whole texts
        marked = all("".join(model.encode(t, out_type=str)) == "▁" + t.replace(" ", "▁") for t in ("a", " a", "a  b", "a "))
        self.by_word = marked and "▁" in pieces and all("▁" not in p.lstrip("▁") for p in pieces)
        # the empty word after one space is the mark alone
        self._kept = _Kept(lambda piece: len(model.encode(piece)) if piece else 1)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.by_word or "\0" in text:
            return len(self._model.encode(text))
        if "▁" in text:
            text = text.replace("▁", " ")
        if text[0] == " " or text[-1] == " " or "  " in text:
            # a run of spaces belongs to the word after it
            return sum(map(self._kept.__getitem__, (x[1:] for x in re.findall(r" +[^ ]*", " " + text))))
        return sum(map(self._kept.__getitem__, text.split(" ")))


#: Words that lower-casing and NFC only change letter by letter, then ASCII signs.
_PLAIN = re.compile(r"([a-zA-ZÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


class WordEncoder:
    """Ids of the word BPE, as little-endian unsigned 32-bit numbers, whole texts.

    White space only separates there, so a text is the sequence of its
    space-separated pieces. A piece of plain letters goes to the BPE model
    directly, in the byte letters that its pre-tokenizer would give it.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._full = full = Tokenizer.from_file(file)
        model = full.model
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}

        def whole(piece: str) -> bytes:
            ids = full.encode(piece, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)

        def core(word: str) -> bytes:
            tokens = model.tokenize(word.encode().decode("latin-1").translate(letters))
            return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])

        self._core, self._signs = _Kept(core), _Kept(whole)

        def piece(text: str) -> bytes:
            if not text:
                return b""
            if found := _PLAIN.fullmatch(text):
                signs = found[2]
                return self._core[found[1].lower()] + (self._signs[signs] if signs else b"")
            return whole(text)

        self._pieces = _Kept(piece)

    def encode(self, text: str) -> bytes:
        if "\0" in text:
            return b"".join(map(self._pieces.__getitem__, re.split(r"[ \n]", text)))
        return b"".join(map(self._pieces.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=4)
def piece_counter(file: str) -> PieceCounter:
    return PieceCounter(file)


@lru_cache(maxsize=4)
def word_encoder(file: str) -> WordEncoder:
    return WordEncoder(file)
