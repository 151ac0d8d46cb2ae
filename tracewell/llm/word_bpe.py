"""Chunks through a BPE tokenizer file of the tokenizers library.

The splitting that the file asks for (letters, single digits, runs of other
signs, English contractions) never crosses white space, and neither do its
normaliser and its special tokens, so a text's ids are those of its chunks. A
letter A-Z followed by one of `.,;:!?` is the end of a chunk as well: a run of
letters ends there, and no special token or composed character goes across. Case
does not matter, except in special tokens, which all hold `<|`.
"""

from __future__ import annotations

import re
from functools import lru_cache

from tokenizers import Tokenizer

from tracewell.llm.words import Splitter

#: Chunks of these characters are their own normal form but for case, and their
#: letters are letters in every version of Unicode.
_PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ňŊ-ž]+")
_PARTS = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^a-z0-9ß-öø-ž]+"
)
_PARTS_KEPT = 1 << 17
SPECIAL = b"<|"


@lru_cache(1)
def _byte_signs() -> list[str]:
    """The sign that stands for each byte: printable Latin-1 for itself, the rest from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Calling it with the UTF-8 bytes of chunks gives the library's ids of each."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.parts: dict[str, list[int]] = {}

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __call__(self, chunks: list[bytes]) -> list[list[int]]:
        return [self.one(chunk) for chunk in chunks]

    def one(self, chunk: bytes) -> list[int]:
        if chunk.isalpha():
            return [t.id for t in self.model.tokenize(chunk.lower().decode())]
        text = chunk.decode()
        if "<|" in text or not _PLAIN.fullmatch(text):
            return self.whole(text)
        if len(self.parts) > _PARTS_KEPT:
            self.parts.clear()
        ids = []
        for part in _PARTS.findall(text.lower()):
            known = self.parts.get(part)
            if known is None:
                signs = part if part.isascii() else "".join([_byte_signs()[b] for b in part.encode()])
                known = self.parts[part] = [t.id for t in self.model.tokenize(signs)]
            ids += known
        return ids


def chunks() -> Splitter:
    return Splitter(fold=True, breaks=b".,;:!?")


@lru_cache(2)
def word_bpe(path: str) -> WordBpe:
    """One per worker and file."""
    return WordBpe(path)
