"""Words of whole texts as bytes, for code that runs inside Arrow UDFs."""

from __future__ import annotations

import re
from collections.abc import Iterator

SPACE = b" \t\n\x0b\x0c\r"
_GAP = re.compile(rb"[\x20\x09-\x0d]")


def encoded(text: str | None) -> bytes:
    """UTF-8 of a text; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def word_blocks(raw: bytes, size: int = 1 << 22) -> Iterator[list[bytes]]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of ``raw`` in order, in lists of about ``size`` bytes of text.

    ``bytes.split`` and ``bytes.lower`` know ASCII alone, which is what the word rule asks for.
    """
    start = 0
    while start < len(raw):
        end = len(raw)
        if end - start > size:
            gap = _GAP.search(raw, start + size)
            end = gap.start() if gap else end
        words = raw[start:end].split()
        if words:
            yield words
        start = end


def n_words(raw: bytes) -> int:
    return sum(map(len, word_blocks(raw)))
