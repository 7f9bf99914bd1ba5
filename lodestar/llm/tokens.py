"""Byte-level BPE ids, equal to the tokenizers library's for the same vocabulary.

The ranks are read from the library's own json file. Encoding itself runs in tiktoken, which applies the same
split pattern and merges at several times the speed; tests hold the two libraries' ids against each other. Its pattern
engine backtracks over white space, so a text with a run of LONG_RUN such characters goes to the tokenizers library.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

#: The split pattern of this vocabulary's byte-level pre-tokenizer.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_RUN = 1 << 17
LONG_SPACE = re.compile(rf"\s{{{LONG_RUN}}}")


def printable_bytes() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable Latin-1 as itself, others from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class ByteBPE:
    """ids(text) as tokenizers' encode(text, add_special_tokens=False).ids: strings of added tokens become their ids."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        to_byte = printable_bytes()
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        ranks = {bytes(to_byte[c] for c in token): i for token, i in data["model"]["vocab"].items() if token not in self.special}
        self.core = tiktoken.Encoding("byte-bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=self.special)
        self.path, self.library = path, None

    def whole(self, text: str) -> array:
        """The ids by the tokenizers library itself."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        return array("I", self.library.encode(text, add_special_tokens=False).ids)

    def ids(self, text: str | None) -> array:
        """Unsigned 32-bit ids; a null or empty text has none."""
        if not text:
            return array("I")
        if len(text) >= LONG_RUN and LONG_SPACE.search(text):
            return self.whole(text)
        if any(s in text for s in self.special):
            return array("I", self.core.encode(text, allowed_special="all"))
        return array("I", self.core.encode_ordinary(text))


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBPE:
    return ByteBPE(path)
