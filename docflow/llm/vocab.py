"""The tokenizers library over pieces of a text, remembered by piece.

A text is cut where no token of the tokenizer can cross, and each distinct piece is encoded once by the
library. Ordinary words (Latin letters, then ASCII punctuation) go straight to the library's BPE model,
since their pre-tokens are plain; every other piece goes through the whole library.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Letters that are letters in every Unicode version and composed by themselves; U+0130 is not, in lower case.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!-&(-/:-@\[-`{-~]*)|([!-&(-/:-@\[-`{-~]+)")
LONG = 64  # longer pieces are not remembered


def path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(4)
def load(file: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(file)


@lru_cache(1)
def byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: printable bytes stand for themselves, the others for 256 and up in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def spelled(text: str) -> str:
    letters = byte_letters()
    return "".join([letters[b] for b in text.encode()])


class Remembered(dict):
    """A dict that computes what it lacks, in two generations of ``most`` pieces, so memory is bounded."""

    def __init__(self, most: int = 1 << 18):
        super().__init__()
        self.most, self.old = most, {}

    def __missing__(self, piece: bytes):
        value = self.old.get(piece)
        return self.keep(piece, self.compute(piece) if value is None else value)

    def keep(self, piece: bytes, value):
        if len(piece) <= LONG:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = value
        return value
