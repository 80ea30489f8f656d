"""Sharding along a Hilbert curve, with DataFrame functions only.

Several metadata columns are quantised to a few bits each; the cell that a row falls in has an index on the
Hilbert curve, so that rows near each other in all columns come near each other in the order. Cutting the
ordered rows into runs gives shards whose min/max statistics prune files by any of the columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import place_in, small, table

CELLS = 1 << 12  # of the grid by default; counts of more cells are not broadcast


def curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """For (state, cell) the rank of the cell on the curve and the next state. A state is (entry corner, direction)."""
    ones = (1 << dims) - 1
    rot_right = lambda x, n: ((x >> n % dims) | (x << (dims - n % dims))) & ones
    rot_left = lambda x, n: rot_right(x, dims - n % dims)
    gray = lambda i: i ^ (i >> 1)
    trailing = lambda i: (~i & (i + 1)).bit_length() - 1  # noqa: E731  number of trailing one bits
    entry = lambda w: 0 if w == 0 else gray(2 * ((w - 1) // 2))
    turn = lambda w: 0 if w == 0 else trailing(w - 1 if w % 2 == 0 else w) % dims
    rank, following = [], []
    for e in range(1 << dims):
        for d in range(dims):
            for cell in range(1 << dims):
                g = rot_right(cell ^ e, d + 1)
                w = next(i for i in range(1 << dims) if gray(i) == g)
                rank.append(w)
                following.append((e ^ rot_left(entry(w), d + 1)) * dims + (d + turn(w) + 1) % dims)
    return rank, following


def hilbert_index(coords: list[Column], bits: int) -> Column:
    """The place on the Hilbert curve of a cell with coordinates in [0, 2**bits), as long."""
    dims = len(coords)
    rank, following = (F.array(*map(F.lit, t)) for t in curve_tables(dims))
    levels = F.array(*(
        sum(((F.shiftright(c.cast("int"), b).bitwiseAND(F.lit(1))) * (1 << j) for j, c in enumerate(coords)), F.lit(0)) for b in range(bits - 1, -1, -1)
    ))
    start = F.struct(F.lit(0).cast("int").alias("state"), F.lit(0).cast("long").alias("index"))

    def step(acc, cell):
        at = (acc["state"] * (1 << dims) + cell).cast("int")
        return F.struct(F.get(following, at).alias("state"), (acc["index"] * (1 << dims) + F.get(rank, at)).cast("long").alias("index"))

    return F.aggregate(levels, start, step, lambda acc: acc["index"])


def cut_runs(df: DataFrame, cell: str, order: list[str], shards: int) -> DataFrame:
    """Adds shard and slot: rows in the order of (cell, place in the cell), cut into runs of equal counts.

    The place of a row in the whole order is the rows of lower cells and its place in its own (see place_in), so no task
    ever sees the whole table.
    """
    # a row for each cell of the grid that is not empty: at most 2 ** (dims * bits)
    starts = df.groupBy(cell).agg(F.count("*").alias("n"))
    below = F.sum("n").over(Window.orderBy(cell).rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.select(cell, F.coalesce(below, F.lit(0)).alias("cell_start"), F.sum("n").over(Window.partitionBy()).alias("rows_all"))
    placed = place_in(df, cell, order, cells=CELLS).join(small(starts, CELLS), cell).withColumn("place", F.col("cell_start") + F.col("cell_place"))
    # run i starts at ceil(i * rows / shards): counts differ by one at most
    whole = lambda a, b: ((a - F.pmod(a, b)) / b).cast("long")
    placed = placed.withColumn("shard", whole(F.col("place") * shards, F.col("rows_all")).cast("int"))
    first = whole(F.col("shard") * F.col("rows_all") + shards - 1, F.lit(shards))
    return placed.withColumn("slot", F.col("place") - first).drop("cell_start", "rows_all", "place", "cell_place", "cell_rows")


def hilbert_shards(docs: DataFrame, shards: int = 8, bits: int = 4) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the curve index of every row.

    Dimensions: log2 of the text's size, hash of lang, hash of source, each 2**bits cells. The law is `rows`: counts
    of shards differ by one at most, slots run from 0. Null text: size 1, crc32 of nothing (0). Null lang or source:
    a cell of their own hash. Ties on the curve and repeated rows are ordered by doc_id, then by text; rows that
    are equal in all of these may change places. Empty input: no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    cells = 1 << bits
    rows = docs.select(
        F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.pmod(F.xxhash64("lang"), F.lit(cells)).alias("lang_cell"), F.pmod(F.xxhash64("source"), F.lit(cells)).alias("source_cell"),
    )
    size_cell = F.least(F.lit(cells - 1), F.floor(F.log2("size") * (cells / 24))).cast("int")
    rows = rows.select("doc_id", "size", "text_crc32", hilbert_index([size_cell, F.col("lang_cell"), F.col("source_cell")], bits).alias("curve"))
    cut = cut_runs(table(rows), "curve", ["doc_id", "text_crc32", "size"], shards)
    return cut.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
