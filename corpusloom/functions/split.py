"""Recursive splitting of text by a ladder of separators."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", " ", "")
PLAIN_SEPARATORS = ("\n\n", "\n", " ", "")
IMAGE = re.compile(r"!\[[^\]]*]\([^)\s]+(?:\s+\"[^\"]*\")?\)")


def estimate_tokens(text: str) -> int:
    return max(1, len(text) // 4) if text else 0


def _pieces(text: str, separator: str) -> list[str]:
    """Parts of the text, each but the first starting with the separator."""
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [p for p in (first, *(separator + r for r in rest)) if p]


def _packed(pieces: list[str], size: int, overlap: int, length: Callable[[str], int]) -> list[str]:
    """Runs of pieces up to ``size``, each starting with the tail of the one before up to ``overlap``."""
    out, window, total = [], [], 0
    for piece in pieces:
        n = length(piece)
        if window and total + n > size:
            out.append("".join(window))
            while window and (total > overlap or total + n > size):
                total -= length(window.pop(0))
        window.append(piece)
        total += n
    out.append("".join(window))
    return [s for s in map(str.strip, out) if s]


def split_text(text: str, size: int = 450, overlap: int = 50, separators: tuple[str, ...] = SEPARATORS, length: Callable[[str], int] = len) -> list[str]:
    """Chunks of at most ``size`` where the separators allow it."""
    k = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    finer = separators[k + 1 :]
    out, small = [], []
    for piece in _pieces(text, separators[k]):
        if length(piece) < size:
            small.append(piece)
            continue
        if small:
            out += _packed(small, size, overlap, length)
            small = []
        out += split_text(piece, size, overlap, finer, length) if finer else [piece]
    return out + (_packed(small, size, overlap, length) if small else [])


def split_keeping_images(text: str, size: int = 450, overlap: int = 50, length: Callable[[str], int] = len) -> list[str]:
    """Like split_text, but each Markdown image is a chunk of its own: what lies between two images is split by itself."""
    out, at = [], 0
    for found in IMAGE.finditer(text):
        out += [*split_text(text[at : found.start()], size, overlap, length=length), found[0]]
        at = found.end()
    return out + split_text(text[at:], size, overlap, length=length)


def recursive_split(text: Column, size: int = 450, overlap: int = 50, tokens: bool = False) -> Column:
    """The chunks of each text as an array."""
    length = estimate_tokens if tokens else len

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_keeping_images(t, size, overlap, length) if t else [])

    return split(text)
