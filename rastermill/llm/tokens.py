"""Byte-level BPE ids from a public tokenizer file."""

from __future__ import annotations

import json
import re

import numpy as np

#: How this family of vocabularies cuts a text before merging, and its special tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = "<|endoftext|>"
#: The last character before a single space that begins a word.
CUT = re.compile(r"\S(?= \S)")


def vocabulary(file_text: str) -> dict[bytes, int]:
    """Token bytes and ids of a tokenizer file, without special tokens."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # shown as themselves; others from U+0100 on
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return {bytes(shown[c] for c in t): i for t, i in json.loads(file_text)["model"]["vocab"].items() if t != SPECIAL}


class ByteBpe:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    No token crosses a single space between two other characters, so longer texts are cut before such spaces,
    about every `piece` characters, and their parts encoded one by one: numbers of one part at a time are held as
    objects. A text that spells a special token goes through the tokenizers library, which knows it.
    """

    def __init__(self, file_text: str, piece: int = 100_000):
        import tiktoken

        self.file_text, self.piece, self.slow = file_text, piece, None
        self.ids = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=vocabulary(file_text), special_tokens={}).encode_ordinary

    def encode(self, text: str) -> bytes:
        if SPECIAL in text:
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_str(self.file_text)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(text) <= self.piece:
            return np.array(self.ids(text), "<u4").tobytes()
        return b"".join(np.array(self.ids(part), "<u4").tobytes() for part in self.parts(text))

    def parts(self, text: str):
        at = 0
        while m := CUT.search(text, at + self.piece):
            yield text[at : m.end()]
            at = m.end()
        yield text[at:]
