"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of at most 23 bits. The perfect
(23,12,7) Golay code decodes any 23-bit word to one codeword; the words one bit
away from a segment decode to a handful of codewords. Two segments that differ
in at most one bit therefore share a key: the codeword of the one is among the
nearby codewords of the other.

Pigeonhole: of three or fewer errors in three segments, either some segment has
none and another at most one, or each has exactly one. The first case is joined
on (exact segment, nearby codeword), the second on the codewords of all three.
Members of a bucket are verified by their Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import components, join_groups, map_batches, saved, small_side, text_of, without_ids

SHINGLE = 3
MAX_DISTANCE = 3
# marks that one task searches as one bucket; larger buckets are split
BUCKET_ROWS = 65_536
# (first bit, bits) of each segment, 23 at most
SEGMENTS = ((0, 22), (22, 21), (43, 21))
# generator polynomial of the binary Golay code: x^11+x^10+x^6+x^5+x^4+x^2+1
GENERATOR = 0b110001110101


# ---- fingerprints ---------------------------------------------------------------

def fingerprint(text: str, size: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the shingles' XXH64 (seed 42).

    Letters A-Z are lowered; shingles are ``size`` words joined by spaces,
    repeats included; fewer words give one shingle, no word gives zero.
    """
    data = text.encode("utf-8", "surrogatepass").lower()  # bytes.lower is A-Z only
    words = data.split()  # bytes.split cuts at the six contract spaces
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, 42)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends)), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = np.fromiter((fingerprint(t) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], ["id", "mark"])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, mark) of every row, in place; ``mark`` is the fingerprint as a signed long."""
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"))
    return map_batches(rows, _fingerprints, f"id {kind}, mark bigint")


# ---- Golay keys -----------------------------------------------------------------

def _remainder(words: np.ndarray) -> np.ndarray:
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0).astype(rest.dtype)
    return rest


@cache
def _leaders() -> np.ndarray:
    """The error of weight three or less for each of the 2,048 syndromes: a perfect code."""
    bits = [0, *(1 << i for i in range(23))]
    errors = np.unique(np.array([a ^ b ^ c for a in bits for b in bits for c in bits], np.int32))
    errors = errors[[int(e).bit_count() <= 3 for e in errors]]
    table = np.zeros(2048, np.int32)
    table[_remainder(errors)] = errors
    return table


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the one codeword within three bits of each 23-bit word."""
    return (words ^ _leaders()[_remainder(words)]) >> 11


@cache
def _own_index(bits: int) -> np.ndarray:
    """The codeword index of every segment value."""
    return codeword_index(np.arange(1 << bits, dtype=np.int32)).astype(np.int16)


def nearby_indices(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of the distinct codewords of the words within one bit of each value."""
    flips = np.concatenate(([0], 1 << np.arange(bits, dtype=np.int64)))
    found = np.sort(_own_index(bits)[values[:, None] ^ flips], axis=1)
    fresh = np.ones(found.shape, bool)
    fresh[:, 1:] = found[:, 1:] != found[:, :-1]
    row, column = np.nonzero(fresh)
    return row, found[row, column].astype(np.int64)


def _keys_of(marks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, row): two marks within the bound meet in at least one key."""
    values = [(marks >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
    own = [_own_index(bits)[v].astype(np.int64) for v, (_, bits) in zip(values, SEGMENTS)]
    near = [nearby_indices(v, bits) for v, (_, bits) in zip(values, SEGMENTS)]
    case = 0
    for exact in range(3):
        for fuzzy in range(3):
            if exact != fuzzy:  # the row's own codeword is among its nearby ones
                row, index = near[fuzzy]
                yield case << 36 | values[exact][row] << 12 | index, row
                case += 1
    # one error in each segment: the first two are spread for the one mark, the third for the other
    (row, a), (row_b, b) = near[0], near[1]
    starts = np.searchsorted(row_b, np.arange(len(marks) + 1))
    many = np.diff(starts)[row]
    left = np.repeat(np.arange(len(row)), many)
    place = np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many) + starts[row][left]
    yield case << 36 | a[left] << 24 | b[place] << 12 | own[2][row[left]], row[left]
    row, c = near[2]
    yield case << 36 | own[0][row] << 24 | own[1][row] << 12 | c, row


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(marks), 4096):
            part = marks[at : at + 4096]
            for key, row in _keys_of(part):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row].view(np.int64))], ["key", "mark"])


def _linked(marks: np.ndarray, bound: int) -> Iterator[tuple[int, int]]:
    """Edges that join all marks reachable in steps of ``bound`` bits: a search that
    compares each mark only with those not yet reached."""
    rest = marks
    while len(rest) > 1:
        root, front, rest = rest[0], [rest[0]], rest[1:]
        while front and len(rest):
            near = np.bitwise_count(rest ^ front.pop()) <= bound
            if near.any():
                reached = rest[near]
                rest = rest[~near]
                front.extend(reached)
                for mark in reached:
                    yield root, mark


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, mark): edges within each key. Groups are read as they come."""
    held_key, held_mark = np.empty(0, np.int64), np.empty(0, np.uint64)
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def edges(key: np.ndarray, mark: np.ndarray) -> pa.RecordBatch | None:
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])
        key, mark = key[fresh], mark[fresh]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, len(key)))
        first, second = [], []
        pairs = starts[sizes == 2]
        near = np.bitwise_count(mark[pairs] ^ mark[pairs + 1]) <= MAX_DISTANCE
        first.append(mark[pairs[near]])
        second.append(mark[pairs[near] + 1])
        for start, size in zip(starts[sizes > 2], sizes[sizes > 2]):
            if found := list(_linked(mark[start : start + size], MAX_DISTANCE)):
                ends = np.array(found, np.uint64)
                first.append(ends[:, 0])
                second.append(ends[:, 1])
        a, b = np.concatenate(first), np.concatenate(second)
        if len(a):
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=kind)
        return None

    for batch in batches:
        key = np.concatenate((held_key, batch.column(0).to_numpy()))
        mark = np.concatenate((held_mark, batch.column(1).to_numpy().view(np.uint64)))
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if cut and (out := edges(key[:cut], mark[:cut])):
            yield out
        held_key, held_mark = key[cut:], mark[cut:]
    if len(held_key) and (out := edges(held_key, held_mark)):
        yield out


def _split_hot(keys: DataFrame) -> DataFrame:
    """Cut buckets of more than BUCKET_ROWS into blocks by a hash of the mark.

    Every pair of blocks becomes a bucket of its own, so any two marks still meet
    and no task holds more than about two blocks.
    """
    blocks = F.ceil(F.col("n") / BUCKET_ROWS).cast("int").alias("blocks")
    hot = saved(keys.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET_ROWS).select("key", blocks), "hot-buckets")
    if not hot.take(1):
        return keys
    rows = keys.join(small_side(hot, BUCKET_ROWS), "key")
    own, other = F.pmod(F.xxhash64("mark"), F.col("blocks")), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.select("key", "mark", own.alias("own"), other.alias("other"))
    pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    cold = keys.join(small_side(hot.select("key"), BUCKET_ROWS), "key", "left_anti")
    return cold.unionByName(rows.select(pair.alias("key"), "mark"))


def near_edges(marks: DataFrame) -> DataFrame:
    """(a, b): links that connect all distinct ``mark`` values within the bound of one another."""
    keys = _split_hot(map_batches(marks.select("mark"), _emit_keys, "key bigint, mark bigint"))
    return map_batches(keys.repartition("key").sortWithinPartitions("key", "mark"), _bucket_edges, "a bigint, b bigint")


# ---- groups ---------------------------------------------------------------------

def near_duplicate_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, mark, component_id) for every row of ``docs``.

    Documents with one fingerprint meet first (map-side minimum), so copies never
    become links; links join distinct fingerprints only. ``component_id`` is the
    smallest id reachable. Null and empty texts have fingerprint zero and are
    linked like any other; a null id takes part, but never names a component
    unless all ids of it are null. Repeated rows give repeated rows.
    """
    rows = saved(fingerprints(docs, id_column, text_column), "fingerprints")
    marks = saved(rows.groupBy("mark").agg(F.min("id").alias("least"), F.count("*").alias("size")), "marks")
    linked = components(near_edges(marks))
    named = marks.join(linked.withColumnRenamed("node", "mark"), "mark", "left")
    named = named.select("mark", "least", "size", F.coalesce("component", "mark").alias("component"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    groups = saved(named.join(names, "component").select("mark", "size", "component_id"), "near-groups")
    return join_groups(rows, groups, "mark", "size").select(F.col("id").alias(id_column), "mark", "component_id")


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with the smallest id of each component, all columns as they were.

    Repeated rows of an id that stays, and rows with a null id, stay.
    """
    groups = near_duplicate_groups(docs, id_column, text_column)
    return without_ids(docs, saved(groups.filter(f"{id_column} <> component_id").select(id_column), "near-dropped"), id_column)
