"""Packing into fixed windows by the online sum-of-squares rule.

A level array counts the open windows of each fill. A document's last piece goes
to the fill whose choice leaves the smallest sum of squared counts; full windows
leave the array. Each input partition is a stream of its own, so nothing is
shuffled and a lost task repeats its own windows. At its end the open windows
are poured together, pieces cut freely, and the last one into powers of two.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, text_of, text_runs

WINDOW = 2048
END_ID = 1
# a task remembers the ids of this many text pieces before it starts afresh
PIECE_CACHE = 60_000
# texts of a batch are encoded in runs of about this many characters
_RUN = 500_000
# white space that is not one space or line break between other characters, and
# characters that regular-expression engines class differently: encoded whole
_HARD = (
    "[ \\n][ \\n]|^[ \\n]|[ \\n]$|[\\x00-\\x09\\x0b-\\x1f\\x7f-\\x{a0}]"
    "|[\\x{1680}\\x{180e}\\x{2000}-\\x{200f}\\x{2028}-\\x{202f}\\x{205f}-\\x{206f}\\x{3000}\\x{feff}]"
)
_LETTER_STOP = "([A-Za-z\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{24f}])([,.])"


class Encoder:
    """Token ids as unsigned 32-bit numbers, equal to those of ``tokenizers``.

    Some cuts always begin a token of this byte-level vocabulary: before a single
    space, around a single line break, and between a letter and a comma or stop.
    Texts are cut there by Arrow, and each distinct piece is encoded once per
    batch and looked up per task. Texts with other white space are encoded whole.
    The strings of ``added`` are cut out first and have the ids given there; None stands for
    those of the tokenizer file beside the ranks, if there is one.
    """

    def __init__(self, ranks_path: str, pattern: str, added: dict[str, int] | None = None) -> None:
        import base64

        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._encode = tiktoken.Encoding(
            "packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
        self._break = ranks[b"\n"]
        if added is None:
            beside = f"{os.path.splitext(ranks_path)[0]}.json"
            added = added_tokens(beside) if os.path.exists(beside) else {}
        self._added = added
        # the leftmost and then the longest, as tokenizers takes them
        longest = sorted(self._added, key=len, reverse=True)
        self._cut = re.compile("(" + "|".join(map(re.escape, longest)) + ")")
        self._forget()

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        array = pa.array(texts, pa.large_string())
        hard = pc.match_substring_regex(array, _HARD).to_numpy(zero_copy_only=False)
        for token in self._added:
            hard = hard | pc.match_substring(array, token).to_numpy(zero_copy_only=False)
        out: list = [None] * len(texts)
        for row in np.flatnonzero(hard):
            out[row] = np.array(self._whole(texts[row]), "<u4")
        easy = np.flatnonzero(~hard)
        if len(easy):
            for row, ids in zip(easy, self._pieces(array.take(pa.array(easy)))):
                out[row] = ids
        return out

    def encode_text(self, text: str) -> list[int]:
        return self._whole(text)

    def _whole(self, text: str) -> list[int]:
        if not self._added:
            return self._encode(text)
        ids: list[int] = []
        for part in self._cut.split(text):
            ids += [self._added[part]] if part in self._added else self._encode(part)
        return ids

    def _pieces(self, array: pa.Array) -> list[np.ndarray]:
        cut = pc.replace_substring_regex(array, _LETTER_STOP, "\\1\x00\\2")
        cut = pc.replace_substring(cut, " ", "\x00 ")
        lists = pc.split_pattern(pc.replace_substring(cut, "\n", "\x00\n\x00"), "\x00")
        coded = lists.flatten().dictionary_encode()
        number = self._numbers(coded.dictionary.to_pylist())
        piece = coded.indices.to_numpy(zero_copy_only=False)
        size = self._size[number][piece]
        ends = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        shift = (self._first[number][piece] - ends[:-1]).astype(np.int32)
        ids = self._pool[np.repeat(shift, size) + np.arange(ends[-1], dtype=np.int32)]
        bounds = ends[lists.offsets.to_numpy()].tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]

    def _forget(self) -> None:
        """Piece numbers, and per number its ids in the pool; number 0 is the line break, 1 the empty piece."""
        self._known = {"\n": 0, "": 1}
        self._pool = np.array([self._break], "<u4")
        self._first, self._size = np.array([0, 1]), np.array([1, 0], np.int32)

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        if len(self._known) > PIECE_CACHE:
            self._forget()
        known = self._known
        missing = [p for p in pieces if p not in known]
        pools, firsts, sizes = [self._pool], [self._first], [self._size]
        held = len(self._pool)
        for at in range(0, len(missing), 50_000):
            part = missing[at : at + 50_000]
            # a line break between pieces is a token of its own: one call encodes them all
            ids = np.array(self._encode("\n".join(part)) + [self._break], "<u4")
            stops = np.flatnonzero(ids == self._break)
            starts = np.concatenate(([0], stops[:-1] + 1))
            known.update(zip(part, range(len(known), len(known) + len(part))))
            pools.append(ids)
            firsts.append(starts + held)
            sizes.append((stops - starts).astype(np.int32))
            held += len(ids)
        self._pool, self._first, self._size = map(np.concatenate, (pools, firsts, sizes))
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))


class Packer:
    """Windows of one stream. ``place`` and ``close`` yield finished windows: lists of
    (document, start, ids) whose lengths add up to at most ``window``."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.open = np.zeros(window + 1, np.int64)  # open windows per fill
        self.stacks: list[list[list]] = [[] for _ in range(window)]

    def place(self, document: object, ids: np.ndarray) -> Iterator[list]:
        full = len(ids) - len(ids) % self.window
        for at in range(0, full, self.window):
            yield [(document, at, ids[at : at + self.window])]
        if full < len(ids):
            yield from self._add(document, full, ids[full:])

    def _add(self, document: object, start: int, ids: np.ndarray) -> Iterator[list]:
        size, counts = len(ids), self.open
        # change of the sum of squares, halved: a window moves from its fill to fill + size;
        # fill 0 is a new window, and a full one leaves the array
        after = counts[size : self.window + 1].copy()
        after[-1] = -1
        change = after + 1 - counts[: self.window - size + 1]
        change[0] = (after[0] + 1 if size < self.window else 0)
        usable = counts[: self.window - size + 1] > 0
        usable[0] = True
        fill = int(np.argmin(np.where(usable, change, np.iinfo(np.int64).max)))
        window = []
        if fill:
            window = self.stacks[fill].pop()
            counts[fill] -= 1
        window.append((document, start, ids))
        if fill + size == self.window:
            yield window
        else:
            counts[fill + size] += 1
            self.stacks[fill + size].append(window)

    def close(self) -> Iterator[list]:
        """Pour the open windows together from the fullest on; only the last is short of
        the window, and it is cut into powers of two, which need no padding."""
        rest = [w for stack in reversed(self.stacks) for w in stack]
        filled, used = [], 0
        for window in rest:
            for document, start, ids in window:
                while len(ids):
                    take = min(len(ids), self.window - used)
                    filled.append((document, start, ids[:take]))
                    start, ids, used = start + take, ids[take:], used + take
                    if used == self.window:
                        yield filled
                        filled, used = [], 0
        goal = 0
        out: list = []
        for document, start, ids in filled:
            while len(ids):
                goal = goal or 1 << (used.bit_length() - 1)  # the largest power of two left
                take = min(len(ids), goal)
                out.append((document, start, ids[:take]))
                start, ids, used, goal = start + take, ids[take:], used - take, goal - take
                if not goal:
                    yield out
                    out = []


def added_tokens(tokenizer_path: str) -> dict[str, int]:
    """The strings that a tokenizer file lists beside its vocabulary, and their ids."""
    with open(tokenizer_path, encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


def _pack(ranks_path: str, pattern: str, window: int, added: dict[str, int] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = Encoder(ranks_path, pattern, added), Packer(window)
        sequence = TaskContext.get().partitionId() << 40
        pending: list[tuple] = []

        def rows(windows: Iterator[list]) -> None:
            nonlocal sequence
            for pieces in windows:
                offset = 0
                for document, start, ids in pieces:
                    doc_id, total = document
                    pending.append((doc_id, start, len(ids), zlib.crc32(ids), total, sequence, offset))
                    offset += len(ids)
                sequence += 1

        def flush(kind: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*pending)) if pending else [[]] * 7
            pending.clear()
            types = [kind, *[pa.int64()] * 6]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], NAMES)

        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            ids_of = batch.column(0).to_pylist()
            for first, texts in text_runs(batch.column(1).to_pylist(), _RUN):
                for row, ids in enumerate(encoder.encode_batch(texts), first):
                    ids = np.append(ids, END_ID).astype("<u4")
                    rows(packer.place((ids_of[row], len(ids)), ids))
                    if len(pending) > 20_000:
                        yield flush(kind)
        rows(packer.close())
        if pending:
            yield flush(kind)

    return run


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack_documents(
    docs: DataFrame, window: int = WINDOW, ranks_path: str | None = None, pattern: str | None = None,
    id_column: str = "doc_id", text_column: str = "text", added: dict[str, int] | None = None,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its text and then END_ID; a null or empty text
    has END_ID alone. A string of ``added`` (with the default vocabulary: of the
    tokenizer's added tokens) is one id, as in ``tokenizers``. Every id lies in one piece; sequences hold ``window`` ids,
    but for at most a few per partition, whose lengths are powers of two. Sequence ids
    carry the partition's number. Repeated rows are packed as often as they
    occur; a null id is passed on.
    """
    if ranks_path is None:
        import public_tokenizers

        ranks_path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
        added = added_tokens(public_tokenizers.path("byte_bpe_50k.json")) if added is None else added
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    fields = ", ".join(f"{n} bigint" for n in NAMES[1:])
    packed = map_batches(rows, _pack(ranks_path, pattern, window, added), f"doc_id {kind}, {fields}")
    return packed.withColumnRenamed("doc_id", id_column)
