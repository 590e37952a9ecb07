"""Byte-level BPE ids of whole texts, with a cache of words."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

_SLOW = re.compile(r" \s|\s ")
_SPECIAL = "<|endoftext|>"
_KEEP = 48
_CACHE = 600_000


def default_paths() -> tuple[str, str]:
    import public_tokenizers as p

    return p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken")


@lru_cache(4)
def _library(vocab: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocab)


class ByteBpe(dict):
    """Text to ids, as little-endian unsigned 32-bit bytes.

    A blank between two non-blanks always opens a new pre-token, so a text without other runs of white space
    is the concatenation of its blank-led words, whose ids are kept. Any other text is encoded whole. A text
    that spells a special token goes through the vocabulary's own library, which gives it that token's id.
    """

    def __init__(self, vocab: str, ranks: str, keep: int = _CACHE):
        import tiktoken
        from public_tokenizers import PATTERN

        super().__init__()
        self.vocab, self.keep = vocab, keep
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._bpe = tiktoken.Encoding("byte", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.pieces = [b""] * (max(table.values()) + 2)
        for piece, i in table.items():
            self.pieces[i] = piece
        #: ids after which a sentence or line may end
        self.ends = np.array([x.rstrip(b" ")[-1:] in (b".", b"!", b"?", b"\n") if x else False for x in self.pieces])

    def _raw(self, text: str) -> bytes:
        return np.array(self._bpe.encode_ordinary(text), "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self._raw(" " + word)
        if len(word) <= _KEEP:
            if len(self) >= self.keep:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _SPECIAL in text:
            return np.array(_library(self.vocab).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if _SLOW.search(text):
            return self._raw(text)
        head, *rest = text.split(" ")
        return (self._raw(head) if head else b"") + b"".join(map(self.__getitem__, rest))


@lru_cache(4)
def bpe(vocab: str, ranks: str, keep: int = _CACHE) -> ByteBpe:
    """``keep``: words whose ids are kept, about 150 bytes each."""
    return ByteBpe(vocab, ranks, keep)
