"""Word-cached encoding with a public tokenizer, shared by packing and token output.

The tokenizer's pre-tokens never span a space or a line feed, so a text's ids are those
of its space-separated words in order. Each Python worker keeps the ids of the words it
has met, as little-endian unsigned 32-bit integers; only new words reach the tokenizer.
New words within Latin-1 are lower-cased and cut into pre-tokens here, which leaves the
library's model alone to do the work; all other words pass through the whole tokenizer.
"""

from __future__ import annotations

import json
import os
from array import array

import regex

#: Words that one worker remembers; beyond them it starts afresh.
CACHE_WORDS = 800_000
#: Longer words are encoded each time.
CACHE_CHARS = 48

# Fixed values of the public tokenizer: the end of a word, its pre-tokens, and the
# letters that stand for bytes (printable ones for themselves, the rest from U+0100).
WORD_END = "</w>"
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
BYTE_LETTERS = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}

_encoders: dict[str, "WordEncoder"] = {}


class _Parts(dict):
    """Ids of normal pre-tokens, each met for the first time passed to the model."""

    def __init__(self, model):
        self._tokenize = model.tokenize

    def __missing__(self, part: str) -> bytes:
        plain = part.isascii() and part.isprintable()
        written = part if plain else part.encode().decode("latin-1").translate(BYTE_LETTERS)
        ids = self[part] = array("I", [t.id for t in self._tokenize(written)]).tobytes()
        return ids


class _Words(dict):
    """Ids of words, each met for the first time cut into pre-tokens or encoded whole."""

    def __init__(self, tokenizer, plain: bool):
        self._encode, self._plain, self._parts = tokenizer.encode, plain, _Parts(tokenizer.model)
        self[""] = b""

    def __missing__(self, word: str) -> bytes:
        if self._plain and word.isascii() and word.isalpha():
            ids = self._parts[word.lower()]
        elif self._plain and (word.isascii() or max(word) < "\u0100") and "<|" not in word:
            ids = b"".join([self._parts[p] for p in PARTS.findall(word.lower())])
        else:
            ids = array("I", self._encode(word, add_special_tokens=False).ids).tobytes()
        if len(word) <= CACHE_CHARS:
            self[word] = ids
        return ids


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._plain = _is_word_model(self._tokenizer)
        self._words = _Words(self._tokenizer, self._plain)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as bytes; null counts as empty."""
        if len(self._words) > CACHE_WORDS:
            self._words = _Words(self._tokenizer, self._plain)
        ids_of = self._words.__getitem__
        return [b"".join(map(ids_of, (t or "").replace("\n", " ").split(" "))) for t in texts]


def _is_word_model(tokenizer) -> bool:
    """Whether the tokenizer is a word-end BPE of lower-cased, byte-written pre-tokens."""
    spec = json.loads(tokenizer.to_str())
    steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    return spec["model"].get("end_of_word_suffix") == WORD_END and steps == ["NFC", "Replace", "Lowercase"]


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for the tokenizer file at ``path``."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
