"""Token ids of whole texts by a tokenizers file, with a bounded cache of pieces.

Byte-level and word-end BPE never merge across the boundary between a character that
isn't white space and a blank or newline after it, so a text's ids are those of its pieces
between such boundaries. The pieces' ids come from the tokenizers library and are kept in
a cache; what the two known layouts don't cover is encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import struct

#: Pieces kept; a cache starts anew with the next slice of texts beyond that.
CACHE = 800_000
_other_space = re.compile(r"[^\S \n]").search
_with_space = re.compile(r"[ \n]*[^ \n]+|[ \n]+").findall
_plain = re.compile(r"([ \n]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#$%&*]*)").fullmatch


def _byte_letters() -> dict[int, int]:
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in kept)}


_LETTERS = _byte_letters()
_PACK = [struct.Struct(f"<{n}I").pack for n in range(17)]


def _spelt(s: str) -> str:
    return s.encode().decode("latin-1").translate(_LETTERS)


class _Filled(dict):
    """A dict that makes up its missing values."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self[key] = self.make(key)
        return value


class _OtherSpace(Exception):
    """A piece holds white space that may be joined with its neighbours'."""


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.kind = ""
        if model.get("type") == "BPE" and not model.get("dropout"):
            if kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and not spec.get("normalizer"):
                self.kind = "bytes"
            elif model.get("end_of_word_suffix") == "</w>" and [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
                self.kind = "words"
        self.cache = _Filled(self._piece)
        self.marks = _Filled(lambda marks: self._packed(self.merge(marks)))
        #: Pieces without their blank; those that begin with a newline have none.
        self.after_blank = _Filled(lambda piece: self._piece(piece if piece[:1] == "\n" else " " + piece))
        if self.kind:
            # the same model without the library's own cache, which costs more than it saves behind this one
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            rest = {k: model[k] for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)}
            self.merge = BPE(vocab=model["vocab"], merges=merges, cache_capacity=0, **rest).tokenize

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        if self.kind == "bytes" and piece[:1] == " " and piece.isascii() and piece[1:].isalpha():
            return self._packed(self.merge("Ġ" + piece[1:]))
        if not piece:
            return b""
        m = _plain(piece)
        if not m:
            if self.kind == "bytes" and _other_space(piece):
                raise _OtherSpace
            return self._whole(piece)
        space, word, end = m.groups()
        if end:
            # word and marks are merged apart, and the word is often known
            return (self.after_blank[word] if space == " " else self.cache[space + word]) + self.marks[end]
        if self.kind == "words":
            word = word.lower()
        if not word.isascii():
            word = _spelt(word)
        parts = [word] if self.kind == "words" or not space else ["Ġ" + word] if space == " " else ["Ċ", word]
        return b"".join([self._packed(self.merge(part)) for part in parts])

    @staticmethod
    def _packed(tokens) -> bytes:
        ids = [t.id for t in tokens]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        if not self.kind:
            return [self._whole(x) for x in texts]
        for kept in (self.cache, self.after_blank, self.marks):
            if len(kept) > CACHE:
                kept.clear()
        return [self._words(x) if self.kind == "words" else self._bytes(x) for x in texts]

    def _words(self, text: str) -> bytes:
        return b"".join(map(self.cache.__getitem__, text.replace("\n", " ").split(" ")))

    def _bytes(self, text: str) -> bytes:
        get = self.cache.__getitem__
        try:
            if "  " in text or " \n" in text or "\n " in text or "\n\n" in text:
                return b"".join(map(get, _with_space(text)))
            # single blanks and newlines: a piece that begins with neither follows a blank
            first, *rest = text.replace("\n", " \n").split(" ")
            return get(first) + b"".join(map(self.after_blank.__getitem__, rest))
        except _OtherSpace:
            return self._whole(text)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each file in a Python worker; its cache outlasts the task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
