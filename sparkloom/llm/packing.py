"""Packing of token sequences into sequences of a fixed capacity, by large-item matching and best fit.

The packing is worked out on the histogram of lengths, which has as many rows as the capacity has tokens, whatever the
number of documents: which patterns of lengths make a sequence, and how often. Pieces then take their slots by their
rank among the pieces of the same length.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing, place_in, table
from .tokens import byte_bpe_ids, tokenizer_path

CAPACITY, END = 1024, 2
_RANK_BITS = 40


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern of lengths, number of sequences with it). All lengths are in 1..capacity.

    Items over a third of the capacity go at most two to a sequence: from the largest down, each is matched with the
    largest of the rest that fits. Smaller ones, from the largest down, go to the smallest gap that holds them. Equal
    lengths move together, so the work depends on the capacity and not on the number of items.
    """
    left = defaultdict(int, {n: c for n, c in counts.items() if c})
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    gaps: list[int] = []

    def put(pattern, number):
        gap = capacity - sum(pattern)
        if not open_bins[gap]:
            insort(gaps, gap)
        open_bins[gap].append((pattern, number))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((b for b in large if b <= min(a, capacity - a) and left[b] >= 1 + (a == b)), None)
            n = left[a] if b is None else left[a] // 2 if a == b else min(left[a], left[b])
            put((a,) if b is None else (a, b), n)
            left[a] -= n
            if b is not None:
                left[b] -= n
    for s in sorted((n for n in left if left[n]), reverse=True):
        while left[s]:
            gap = next((g for g in gaps if g >= s), None)
            if gap is None:
                pattern, number = (), left[s]
                gap = capacity
            else:
                pattern, number = open_bins[gap].pop()
                if not open_bins[gap]:
                    gaps.remove(gap)
            each = gap // s
            filled = min(number, left[s] // each)
            rest = left[s] - filled * each if filled < number else 0
            if filled:
                put(pattern + (s,) * each, filled)
            if rest:
                put(pattern + (s,) * rest, 1)
            untouched = number - filled - bool(rest)
            if pattern and untouched:
                put(pattern, untouched)
            left[s] -= filled * each + rest
    return [x for bins in open_bins.values() for x in bins]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length << 40 | first rank), and for each the first sequence and the offset there.

    The piece with rank r of its length has the last key that is not over (length << 40 | r).
    """
    used, out, sequence = defaultdict(int), [], 0
    for pattern, number in patterns:
        at = 0
        for n in pattern:
            out.append((n << _RANK_BITS | used[n], sequence, at))
            used[n] += number
            at += n
        sequence += number
    keys = np.array(sorted(out), np.int64).reshape(-1, 3)
    return keys[:, 0], keys[:, 1], keys[:, 2]


def pieces(docs: DataFrame, capacity: int, json_path: str, ranks_path: str) -> DataFrame:
    """id, piece, start, length, ids_crc32: documents with their end id, cut if they are longer than the capacity."""

    def run(batches):
        for batch in batches:
            ids = batch.column("id").to_pylist()
            rows = []
            texts = (x.as_py() for x in batch.column("text"))
            for i, (doc, found) in enumerate(zip(ids, byte_bpe_ids(texts, json_path, ranks_path))):
                found = np.append(found, np.uint32(END)).astype("<u4")
                start, k = 0, len(found) % capacity or capacity
                piece = 0
                while start < len(found):
                    rows.append((doc, piece, start, k, zlib.crc32(found[start : start + k].tobytes())))
                    start, k, piece = start + k, capacity, piece + 1
                if len(rows) >= 8192 or i == len(ids) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["id", "piece", "start", "length", "ids_crc32"])
                    rows = []

    return docs.mapInArrow(freeing(run), "id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset: every piece of every row's ids, placed in a sequence.

    A document is its ids and the end id. One longer than the capacity is cut into pieces of the capacity, the first
    piece taking the rest. Null or empty text: the end id alone. Ids that are null or repeated are kept as they are,
    each row is a document. Empty input: no rows. The driver gets the histogram of lengths (at most `capacity` rows) and
    sends back the slots: at most one for each length in each pattern, which depends on the capacity alone.
    """
    json_path, ranks_path = json_path or tokenizer_path("byte_bpe_50k.json"), ranks_path or tokenizer_path("byte_bpe_50k.tiktoken")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    cut = table(pieces(rows, capacity, json_path, ranks_path))
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    given = docs.sparkSession.sparkContext.broadcast(slots(plan(counts, capacity)))

    def place(batches):
        keys, sequence, offset = given.value
        for batch in batches:
            key = (batch.column("length").to_numpy() << _RANK_BITS) | batch.column("cell_place").to_numpy()
            i = np.searchsorted(keys, key, "right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")), pa.array(sequence[i] + key - keys[i]), pa.array(offset[i])], names)

    names = [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    kinds = ["long", "int", "long", "long", "long", "long", "long"]
    ranked = place_in(cut, "length", ["id", "piece", "ids_crc32"])
    return ranked.mapInArrow(freeing(place), ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))
