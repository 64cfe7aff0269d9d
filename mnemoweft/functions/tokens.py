"""Public byte-level vocabularies: loading, and long texts in pieces whose tokens add up."""

from __future__ import annotations

import base64
from functools import cache

#: Fixed value: the pre-tokenisation pattern that belongs to the published byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONGEST = 20_000  # characters encoded at once


@cache
def _pattern():
    import regex  # only where texts are encoded

    return regex.compile(PATTERN)


def load_encoding(path: str):
    """The encoding of a rank file (base64 token and rank per line)."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str):
    """The whole text in pieces cut where the pre-tokenisation pattern cuts, so that their tokens are the text's.

    The pattern's matches inside a window are those of the whole text but for the last, which the end of
    the window may have shortened.  A match longer than LONGEST stays one piece.
    """
    s, width = 0, LONGEST
    while len(text) - s > width:
        e = s
        for m in _pattern().finditer(text, s, s + width):
            e = m.start()
        if e > s:
            yield text[s:e]
            s, width = e, LONGEST
        else:
            width *= 2
    yield text[s:]
