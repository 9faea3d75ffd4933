"""Bounded-space online packing of tokenised documents into sequences.

Each task keeps at most ``OPEN`` windows open. Pieces of ``LENGTH`` tokens go out at once; what is left of a document goes into
the window with the least room that still holds it. When none does and all are in use, the fullest is topped up with
the start of the piece and emitted. At the end of the task the open windows are run together; less than one window
is left over. Leftovers of ``MERGED`` tasks are merged the same way, and what then remains is cut into sequences whose
lengths are powers of two, which need no padding.

Null and empty texts are documents of the end id alone. Repeated rows and rows without doc_id are packed each, as documents of their own. Windows
of equal room are taken in the order they were opened. A text of any length is cut into pieces of full windows; a task holds its ids (4 bytes a token) and
its words. An empty table gives no rows. No column but doc_id and text is read, so others may have any name.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import materialize
from .text import blocks, record_batch

LENGTH = 4096
OPEN = 16
MERGED = 64
END = 2
#: Words whose ids a Python worker remembers.
REMEMBERED = 200_000
#: ASCII signs that the tokenizer keeps together behind letters.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
END_BYTES = array("I", [END]).tobytes()

PIECES = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))])
ROWS = pa.schema([*PIECES, ("part", pa.int64()), ("ids", pa.binary())])
_SQL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: A piece in hand: doc_id, start, ids (little-endian, 4 bytes each), doc_tokens.
Piece = tuple[int, int, bytes, int]


class Encoder(dict):
    """Ids of white-space words, looked up by their bytes and worked out when first seen.

    White space separates the tokenizer's own words, so ids of a text are those of its words in turn. Most words are
    letters with ASCII signs behind; these two parts go to the BPE model alone, other words through the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.parts = Tokenizer.from_file(path), {}
        # the tokenizer's mapping of bytes to characters, read off its byte-level step
        step = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: step.pre_tokenize_str(chr(c))[0][0] for c in range(0x80, 0x250)}

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            if len(self.parts) >= REMEMBERED:
                self.parts.clear()
            ids = self.parts[part] = array("I", [t.id for t in self.tokenizer.model.tokenize(part if part.isascii() else part.translate(self.letters))]).tobytes()
        return ids

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        core = text.rstrip(SIGNS)
        if core.isalpha() and (core.isascii() or max(core) < "\u0250" and "\u0130" not in core):
            ids = self._part(core.lower())
            if len(core) < len(text):
                ids += self._part(text[len(core) :])
        else:
            ids = array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split())) + END_BYTES


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Packer:
    """Open windows of one task; full ones are returned as lists of pieces."""

    def __init__(self, length: int = LENGTH, windows: int = OPEN):
        self.length, self.windows = length, windows
        self.open: list[tuple[int, list[Piece]]] = []  # tokens used, pieces

    def add(self, doc_id: int, ids: bytes) -> Iterator[list[Piece]]:
        n = len(ids) // 4
        start = 0
        while n - start >= self.length:
            yield [(doc_id, start, ids[4 * start : 4 * (start + self.length)], n)]
            start += self.length
        while start < n:
            rest = n - start
            fits = [k for k, (used, _) in enumerate(self.open) if used + rest <= self.length]
            if fits:
                k, take = max(fits, key=lambda k: self.open[k][0]), rest
            elif len(self.open) < self.windows:
                self.open.append((0, []))
                k, take = len(self.open) - 1, rest
            else:
                k = max(range(len(self.open)), key=lambda k: self.open[k][0])
                take = self.length - self.open[k][0]
            used, pieces = self.open[k]
            pieces.append((doc_id, start, ids[4 * start : 4 * (start + take)], n))
            start += take
            if used + take == self.length:
                yield self.open.pop(k)[1]
            else:
                self.open[k] = used + take, pieces

    def rest(self) -> list[Piece]:
        return [p for _, pieces in self.open for p in pieces]


def run_together(pieces: list[Piece], length: int = LENGTH) -> tuple[list[list[Piece]], list[Piece]]:
    """Full windows of the pieces in their order, and what is left over."""
    full, now, room = [], [], length
    for doc_id, start, ids, n in pieces:
        while ids:
            take = ids[: 4 * room]
            now.append((doc_id, start, take, n))
            start, ids, room = start + len(take) // 4, ids[len(take) :], room - len(take) // 4
            if not room:
                full.append(now)
                now, room = [], length
    return full, now


def powers_of_two(pieces: list[Piece]) -> list[list[Piece]]:
    """The pieces cut into windows whose lengths are falling powers of two."""
    total, out = sum(len(p[2]) // 4 for p in pieces), []
    while total:
        size = 1 << (total.bit_length() - 1)
        full, rest = run_together(pieces, size)
        out.append(full[0])
        pieces = [p for w in full[1:] for p in w] + rest
        total -= size
    return out


def _rows(windows: list[tuple[int, list[Piece]]], part: int = 0, keep_ids: bool = False) -> pa.RecordBatch:
    rows = []
    for sequence, pieces in windows:
        at = 0
        for doc_id, start, ids, n in pieces:
            size = len(ids) // 4
            rows.append((doc_id, start, size, zlib.crc32(ids), n, sequence, at, part, ids if keep_ids else None))
            at += size
    return record_batch(ROWS, *(list(x) for x in zip(*rows, strict=True))) if rows else record_batch(ROWS, *([] for _ in ROWS))


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, windows: int = OPEN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents are neither shuffled nor sorted; only a task's leftover (under one window) is. Every id lies in one piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, packer, encoder, made = TaskContext.get().partitionId(), Packer(length, windows), _encoder(tokenizer), 0
        for batch, texts in blocks(batches):
            full = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), (encoder.encode(texts.bytes(i)) for i in range(texts.n)), strict=True):
                for pieces in packer.add(doc_id, ids):
                    full.append(((part << 32) | made, pieces))
                    made += 1
            yield _rows(full, part)
        full, rest = run_together(packer.rest(), length)
        yield _rows([((part << 32) | (made + k), pieces) for k, pieces in enumerate(full)], part)
        yield _rows([(-1, rest)], part, keep_ids=True)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group, made = [], None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["group"] != group:
                    yield _merged(held, group, length)
                    held, group = [], row["group"]
                held.append((row["doc_id"], row["start"], row["ids"], row["doc_tokens"]))
        yield _merged(held, group, length)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"{_SQL}, part long, ids binary")
    rows = materialize(rows, "packing")
    names = [f.name for f in PIECES]
    left = rows.where("sequence_id = -1").select(F.expr(f"part div {MERGED}").alias("group"), "part", "offset", "doc_id", "start", "doc_tokens", "ids")
    merged = left.repartition("group").sortWithinPartitions("group", "part", "offset").mapInArrow(merge, f"{_SQL}, part long, ids binary")
    return rows.where("sequence_id >= 0").select(names).unionByName(merged.select(names))


def _merged(pieces: list[Piece], group: int | None, length: int) -> pa.RecordBatch:
    full, rest = run_together(pieces, length)
    windows = full + powers_of_two(rest)
    return _rows([((1 << 62) | ((group or 0) << 32) | k, w) for k, w in enumerate(windows)])
