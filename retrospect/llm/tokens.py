"""Token ids by public tokenizers inside Python tasks, with caches that live as long as the worker.

The word tokenizer works on each pre-token by itself, so the ids of a text are the joined ids of its pre-tokens. For
texts within the Latin blocks a regular expression finds the pre-tokens and a bounded cache holds their ids; only
pre-tokens that the cache lacks, and texts with other letters, go through the library.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
from array import array

_CACHE_ENTRIES = 1_000_000
#: Letters of the Latin blocks up to U+024F, numbers among them, and what of them needs the library
#: (letters whose lower case is not one letter, the long s, and all other characters but common punctuation).
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼-¾"
_PRE_TOKEN = re.compile(
    rf"(?:'[sStTmMdD])|(?:'[rR][eE])|(?:'[vV][eE])|(?:'[lL][lL])|[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+"
)
_UNUSUAL = re.compile("[^\x00-\x1b\x20-\x84\x86-įı-ňŊ-žƀ-ǃǍ-ǰǴ-ɏ‐-—‘-‟•…€]")

#: Byte-level spelling: printable bytes are themselves, the others the letters from U+0100 on, in order.
_PLAIN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_LETTERS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}

_word_tokenizers: dict[str, WordTokenizer] = {}
_encodings: dict[str, object] = {}


class WordTokenizer:
    """encode(texts): for each text its ids as little-endian unsigned 32-bit integers in one bytes object."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.library.model)  # for pre-tokens: no normalizer, no search for pre-tokens
        self.cache: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        coded = self.library.encode_batch(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(c.ids)}I", *c.ids) for c in coded]

    def _pre_token_ids(self, words: list[str]) -> list[bytes]:
        spelled = [w.lower().encode().decode("latin-1").translate(BYTE_LETTERS) for w in words]
        return [array("I", c.ids).tobytes() for c in self.merges.encode_batch(spelled, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for text in texts:
            if _UNUSUAL.search(text) or not unicodedata.is_normalized("NFC", text):
                out.append(self._ids([text])[0])
                continue
            words = _PRE_TOKEN.findall(text)
            missing = list(set(words).difference(self.cache))
            if len(self.cache) + len(missing) > _CACHE_ENTRIES:
                self.cache.clear()
                missing = list(set(words))
            if missing:
                self.cache.update(zip(missing, self._pre_token_ids(missing), strict=True))
            out.append(b"".join(map(self.cache.__getitem__, words)))
        return out


def word_tokenizer(path: str) -> WordTokenizer:
    if path not in _word_tokenizers:
        _word_tokenizers[path] = WordTokenizer(path)
    return _word_tokenizers[path]


def byte_encoding(path: str, pattern: str):
    """A tiktoken encoding of a file of ranks."""
    if path not in _encodings:
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]
