"""Alignment of two tokenizers by merge path.

Both tokenizers cut the same bytes, so each gives a rising list of token ends. Merging
the two lists yields everything: an end that only one list has starts the next
overlap, an end that both have also closes a group. The merge of a batch of texts is cut
into pieces of equal work by binary searches along its diagonals; each piece is
merged on its own and emits its overlaps, and the pieces' group numbers are joined
by a running sum.

How many documents hold a pair of ids linked is counted over all documents. Pairs
that many documents hold are broadcast, their number bounded; the others meet
their counts in a shuffle.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, saved, text_of, text_runs

# ends that one piece of a merge takes
PIECE = 1 << 16
# texts are aligned in runs of about this many characters
_RUN = 1_000_000
# pairs that are broadcast with their counts; all others are joined in a shuffle
HOT_PAIRS = 200_000
SPACE_MARK = "▁"


# ---- merge path -----------------------------------------------------------------

def diagonal_splits(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) where pieces of ``piece`` merged ends begin, and the end of both lists.

    On diagonal d the merge has taken i ends of ``a`` and d - i of ``b``, an end of
    ``a`` before an equal one of ``b``. All diagonals are searched at once.
    """
    total = len(a) + len(b)
    diagonals = np.append(np.arange(0, total, piece), total)
    low, high = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        # is a[middle] merged before the diagonal? it is if it does not exceed b[d - middle - 1]
        other = np.clip(diagonals - middle - 1, 0, max(len(b) - 1, 0))
        taken = open_ & (a[np.minimum(middle, max(len(a) - 1, 0))] <= b[other])
        low = np.where(taken, middle + 1, low)
        high = np.where(open_ & ~taken, middle, high)
    return low, diagonals - low


def merge_piece(
    a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlaps (token of a, token of b) that end in one piece, and the ends of ``a`` among
    them that ``b`` shares. A token whose end lies in a later piece is named all the same."""
    own_a, own_b = a[i0:i1], b[j0:j1]
    partner = j0 + np.searchsorted(own_b, own_a, "left")
    other = i0 + np.searchsorted(own_a, own_b, "left")
    # an equal end of a may be the last one of the piece before
    before = (other == i0) & (i0 > 0) & (a[i0 - 1] == own_b) if i0 else np.zeros(len(own_b), bool)
    within = other < i1
    equal = before.copy()
    equal[within] |= a[other[within]] == own_b[within]
    lone = np.flatnonzero(~equal)
    first = np.concatenate((np.arange(i0, i1), other[lone]))
    second = np.concatenate((partner, j0 + lone))
    shared = np.where(before, i0 - 1, other)[equal]
    return first, second, shared


def align(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token of a, token of b) of every overlap, and the group number of each token of ``a`` and of ``b``.

    ``a`` and ``b`` are rising ends over the same bytes, so their last ends are equal.
    """
    starts_a, starts_b = diagonal_splits(a, b, piece)
    firsts, seconds, closes = [], [], []
    for i0, i1, j0, j1 in zip(starts_a, starts_a[1:], starts_b, starts_b[1:]):
        first, second, shared = merge_piece(a, b, int(i0), int(i1), int(j0), int(j1))
        firsts.append(first)
        seconds.append(second)
        closes.append(shared)
    closing = np.zeros(len(a) + 1, np.int64)
    ends = np.concatenate([np.empty(0, np.int64), *closes])
    closing[ends + 1] = 1
    group_a = np.cumsum(closing)[:-1]
    group_b = np.searchsorted(a[np.sort(ends)], b, "left")
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *firsts]), np.concatenate([empty, *seconds]), group_a, group_b


# ---- tokens ---------------------------------------------------------------------

def byte_level_bytes(vocabulary: dict[str, int]) -> list[bytes]:
    """The bytes of every entry of a byte-level vocabulary: printable bytes stand for
    themselves, the others for the characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(x): x for x in plain}
    of |= {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in set(plain))}
    table = [b""] * (max(vocabulary.values()) + 1)
    for token, number in vocabulary.items():
        table[number] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
    return table


class Tokenizers:
    """A: byte-level BPE of space + text; B: pieces of the text, which add the space themselves."""

    def __init__(self, a_path: str, a_ranks: str, a_pattern: str, b_path: str) -> None:
        import sentencepiece

        from .packing import Encoder

        with open(a_path, encoding="utf-8") as file:
            self.bytes_a = byte_level_bytes(json.load(file)["model"]["vocab"])
        # the strings of special tokens are plain text here
        # strings of added tokens are plain text here
        self._a = Encoder(a_ranks, a_pattern, {}).encode_text
        self._b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        size = self._b.get_piece_size()
        self.bytes_b = [
            bytes([int(self._b.id_to_piece(k)[3:5], 16)]) if self._b.is_byte(k)
            else self._b.id_to_piece(k).replace(SPACE_MARK, " ").encode()
            for k in range(size)
        ]
        self.lengths_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.lengths_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.digits = _digit_table(max(len(self.bytes_a), size))

    def encode(self, texts: list[str]) -> tuple[list, list]:
        """Ids of each text by A and by B; none where the bytes differ from space + text."""
        a_ids, b_ids = [], []
        for text, b in zip(texts, self._b.encode(texts, num_threads=1) if texts else []):
            a: list[int] = []
            if text:
                data = b" " + text.encode("utf-8", "surrogatepass")
                if b"".join(map(self.bytes_b.__getitem__, b)) == data:
                    a = self._a(" " + text)
                    if b"".join(map(self.bytes_a.__getitem__, a)) != data:
                        a = []
            a_ids.append(a)
            b_ids.append(b if a else [])
        return a_ids, b_ids


def _digit_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Per id its decimal digits, right-aligned with a free last column, and which columns count."""
    width = len(str(size))
    numbers = np.arange(size)
    digits = np.zeros((size, width + 1), np.uint8)
    used = np.ones((size, width + 1), bool)
    for k in range(width):
        power = 10 ** (width - 1 - k)
        digits[:, k] = 48 + numbers // power % 10
        used[:, k] = (numbers >= power) | (power == 1)
    return digits, used


def group_texts(
    a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, rows_a: np.ndarray, rows_b: np.ndarray,
    table: tuple[np.ndarray, np.ndarray], count: int,
) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each of ``count`` rows; ``rows_a`` and ``rows_b`` are the rows of the tokens."""
    # a token of a stands behind the tokens of b of the groups before its own, one of b behind all of a's up to its own
    groups = int(group_a[-1]) + 1 if len(group_a) else 0
    before_b = np.concatenate(([0], np.cumsum(np.bincount(group_b, minlength=groups))))
    upto_a = np.cumsum(np.bincount(group_a, minlength=groups))
    place_a = np.arange(len(a)) + before_b[group_a]
    place_b = np.arange(len(b)) + upto_a[group_b]
    ids = np.empty(len(a) + len(b), np.int64)
    ids[place_a], ids[place_b] = a, b
    separator = np.full(len(ids), ord(","), np.uint8)
    separator[place_a[np.append(group_a[1:] != group_a[:-1], True)] if len(a) else []] = ord("|")
    separator[place_b[np.append(group_b[1:] != group_b[:-1], True)] if len(b) else []] = ord(";")
    digits, used = table[0][ids], table[1][ids]
    digits[:, -1] = separator
    data = digits[used].tobytes()
    sizes = np.concatenate(([0], np.cumsum(used.sum(axis=1))))
    tokens = np.bincount(rows_a, minlength=count) + np.bincount(rows_b, minlength=count)
    bounds = sizes[np.concatenate(([0], np.cumsum(tokens)))]
    return [data[x : y - 1] if y > x else b"" for x, y in zip(bounds, bounds[1:])]


_NAMES = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"]
_LINK = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("m", pa.int32())]))
LINKS = "array<struct<a: int, b: int, m: int>>"


def _align_texts(paths: tuple[str, str, str, str], piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Tokenizers(*paths)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column(0)
            for first, texts in text_runs(batch.column(1).to_pylist(), _RUN):
                count = len(texts)
                yield _aligned(both, texts, ids.slice(first, count), row, piece)
                row += count

    return run


def _aligned(both: Tokenizers, texts: list[str], ids: pa.Array, row: int, piece: int) -> pa.RecordBatch:
    count = len(texts)
    a_ids, b_ids = both.encode(texts)
    n_a, n_b = (np.fromiter(map(len, x), np.int64, count) for x in (a_ids, b_ids))
    a, b = (np.fromiter((t for x in part for t in x), np.int64, int(n.sum())) for part, n in ((a_ids, n_a), (b_ids, n_b)))
    rows_a, rows_b = np.repeat(np.arange(count), n_a), np.repeat(np.arange(count), n_b)
    # one merge for all texts of the run: the ends go on counting from text to text
    first, second, group_a, group_b = align(np.cumsum(both.lengths_a[a]), np.cumsum(both.lengths_b[b]), piece)
    texts_of = group_texts(a, b, group_a, group_b, rows_a, rows_b, both.digits, count)
    groups = np.bincount(rows_a[np.append(group_a[1:] != group_a[:-1], True)] if len(a) else rows_a, minlength=count)
    links = np.bincount(rows_a[first], minlength=count)
    bits = max(int(len(both.bytes_b)).bit_length(), 1)
    pairs, times = np.unique((rows_a[first] << (bits + 20)) | (a[first] << bits) | b[second], return_counts=True)
    offsets = np.searchsorted(pairs >> (bits + 20), np.arange(count + 1))
    fields = [pairs >> bits & 0xFFFFF, pairs & ((1 << bits) - 1), times]
    struct = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in fields], fields=list(_LINK.value_type))
    return pa.RecordBatch.from_arrays([
        pa.array(np.arange(row, row + count)), ids, *(pa.array(x) for x in (n_a, n_b, groups, links)),
        pa.array([hashlib.sha256(t).hexdigest() if t else "" for t in texts_of]),
        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), struct),
    ], _NAMES)


# ---- tables ---------------------------------------------------------------------

def aligned_documents(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    paths: tuple[str, str, str, str] | None = None, piece: int = PIECE,
) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links) of every row, in place.

    ``links`` are the distinct pairs of ids whose tokens overlap, and how often.
    """
    if paths is None:
        import public_tokenizers as P

        paths = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, P.path("piece_bpe_32k.model"))
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    numbers = ", ".join(f"{n} bigint" for n in _NAMES[2:6])
    return map_batches(rows, _align_texts(paths, piece), f"row bigint, doc_id {kind}, {numbers}, groups_sha256 string, links {LINKS}")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, count, best): the documents that hold a pair linked, and whether no pair of ``a`` has more."""
    pairs = aligned.select(F.inline("links")).groupBy("a", "b").agg(F.count("*").alias("count"))
    pairs = saved(pairs, "pair-counts")
    # a row per entry of a vocabulary at most
    most = pairs.groupBy("a").agg(F.max("count").alias("most"))
    return saved(
        pairs.join(F.broadcast(most), "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best")),
        "pair-best",
    )


def _hot_bound(counts: DataFrame, most: int) -> int:
    """The smallest power of two that at most ``most`` pairs reach."""
    sizes = dict(counts.groupBy(F.floor(F.log2("count")).cast("int").alias("p")).agg(F.count("*").alias("n")).collect())
    level = max(sizes, default=0) + 1
    held = 0
    while level > 0 and held + sizes.get(level - 1, 0) <= most:
        level -= 1
        held += sizes.get(level, 0)
    return 1 << level


def align_tokenizers(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    paths: tuple[str, str, str, str] | None = None, piece: int = PIECE, hot_pairs: int = HOT_PAIRS,
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``.

    ``count_sum`` adds up, over a row's links, how many rows hold the pair linked;
    ``n_best`` are the links whose pair is the most frequent of its A id, ties
    included. A null or empty text, and one whose tokens do not give back
    space + text byte by byte, has zeros and an empty ``groups_sha256``. Repeated
    rows count as often as they occur, null ids are passed on.
    """
    aligned = saved(aligned_documents(docs, id_column, text_column, paths, piece), "aligned")
    counts = pair_counts(aligned)
    is_hot = F.col("count") >= _hot_bound(counts, hot_pairs)
    hot, cold = F.broadcast(counts.filter(is_hot)), counts.filter(~is_hot)
    links = aligned.select("row", F.inline("links"))
    # links of frequent pairs are summed up where they are, the few others meet their counts
    rest = links.join(hot.select("a", "b"), ["a", "b"], "left_anti").join(cold, ["a", "b"])
    sums = None
    for part in (links.join(hot, ["a", "b"]), rest):
        part = part.groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("m"))).alias("n_best"), F.sum(F.col("m") * F.col("count")).alias("count_sum")
        )
        sums = part if sums is None else sums.unionByName(part)
    sums = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    joined = aligned.drop("links").join(sums, "row", "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        F.col("doc_id").alias(id_column), "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
    )
