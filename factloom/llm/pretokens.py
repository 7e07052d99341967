"""Pre-tokens of byte-level tokenizers, and memos of what they encode to; what runs inside tasks."""

import functools
import os
import re

import numpy as np

#: The public pre-token pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts of LATIN characters only, on which Python's own classes agree with it; it is faster.
FAST = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")
LATIN = re.compile(r"[\t\n\r -~¡«»¿À-ÖØ-öø-ÿĀ-ſ]*")


@functools.cache
def _full():
    import regex

    return regex.compile(PATTERN)


def pretokens(text: str) -> list[str]:
    return (FAST if LATIN.fullmatch(text) else _full()).findall(text)


@functools.cache
def encoder(path: str) -> "Encoder":
    """One for all tasks that a Python worker runs."""
    return Encoder(path)


class Encoder:
    """Ids of texts by a tokenizer file, as little-endian 32-bit bytes.

    Each distinct pre-token is encoded once and remembered, until there are too many. A text that
    holds one of the tokenizer's own control strings is encoded whole.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most, self.seen = most, {}
        self.control = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.seen) > self.most:
            self.seen.clear()
        whole = [any(c in t for c in self.control) for t in texts]
        parts = [[] if w else pretokens(t) for w, t in zip(whole, texts)]
        new = list(set().union(*parts).difference(self.seen))
        for at in range(0, len(new), 10_000):
            some = new[at : at + 10_000]
            for p, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self.seen[p] = self._pack(e.ids)
        return [
            self._pack(self.tokenizer.encode(t, add_special_tokens=False).ids) if w else b"".join(map(self.seen.__getitem__, ps))
            for w, t, ps in zip(whole, texts, parts)
        ]
