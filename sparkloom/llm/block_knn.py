"""Nearest neighbours by a block matrix join.

Queries and candidates are dealt over a grid of (query tile, candidate tile) blocks. A block multiplies int8
copies of its unit vectors; a bound on the quantisation error then tells which pairs can still be among the k
nearest, and only those are computed again on the original vectors in double precision. Each block keeps a heap
of k per query; the heaps of a query are merged at the end. The result is exact.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids (ascending) and vectors."""
    col = table.column("vec").combine_chunks()
    ids = table.column("id").to_numpy()
    vecs = np.asarray(col.flatten(), np.float64).reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    return ids[order], vecs[order]


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and for each vector the length of what quantisation took away."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    return codes, scale, np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(axis=1)) + 1e-12


def block_top_k(q_ids, q, c_ids, c, k: int, tile: int = 2048):
    """The k nearest of c for each row of q as (score, -vec_id) heaps; a query's own id is no candidate."""
    q_norm, c_norm = np.sqrt((q * q).sum(axis=1)), np.sqrt((c * c).sum(axis=1))
    q_codes, q_scale, q_err = quantise(q / q_norm[:, None])
    q_codes = q_codes.astype(np.float32)
    heaps: list[list[tuple[float, int]]] = [[] for _ in q_ids]
    for at in range(0, len(c_ids), tile):
        ids, part, norm = c_ids[at : at + tile], c[at : at + tile], c_norm[at : at + tile]
        codes, scale, err = quantise(part / norm[:, None])
        # products of int8 codes are whole numbers that float32 holds exactly up to 1040 dimensions; beyond, double does
        kind = np.float32 if q.shape[1] <= 1000 else np.float64
        near = (q_codes.astype(kind) @ codes.T.astype(kind)) * q_scale[:, None] * scale[None, :]
        bound = q_err[:, None] + (1 + q_err[:, None]) * err[None, :] + 1e-6
        low, high = near - bound, near + bound
        own = ids[None, :] == q_ids[:, None]
        low[own] = high[own] = -np.inf
        n = min(k, len(ids))
        floor = np.partition(low, len(ids) - n, axis=1)[:, len(ids) - n]
        held = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
        rows, cols = np.nonzero((high >= np.maximum(floor, held)[:, None]) & ~own)
        for lo in range(0, len(rows), 65536):
            r, j = rows[lo : lo + 65536], cols[lo : lo + 65536]
            exact = np.einsum("ij,ij->i", q[r], part[j]) / (q_norm[r] * norm[j])
            for i, s, v in zip(r.tolist(), exact.tolist(), ids[j].tolist()):
                h = heaps[i]
                if len(h) < k:
                    heapq.heappush(h, (s, -v))
                elif (s, -v) > h[0]:
                    heapq.heapreplace(h, (s, -v))
    return heaps


def knn(vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, query_tile: int = 2048, candidate_tile: int = 8192) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows with the largest cosine for each row where is_query holds.

    Nearest first, ties to the smaller id; all candidates if there are fewer than k. Rows whose id is null, and
    vectors that are null, empty, zero or hold null or non-finite components, take no part. Vectors are compared
    with those of their own length only. A repeated id is a candidate once for each row. Empty input: no rows.
    Memory of a task: one query tile and one candidate tile, whatever the table's size.
    """
    v = F.col(f"`{vec_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("vec"), is_query.alias("asks"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where(F.col("id").isNotNull() & (F.size("vec") > 0) & ~F.exists("vec", odd) & F.exists("vec", lambda x: x != 0))
    n, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    across, down = max(1, -(-n // candidate_tile)), max(1, -(-asking // query_tile))
    of = lambda salt, parts: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(parts)).cast("int")
    spread = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    grid = ["dim", "down", "across"]
    asks = rows.where("asks").select(F.size("vec").alias("dim"), of(1, down).alias("down"), spread(across).alias("across"), "id", "vec")
    given = rows.select(F.size("vec").alias("dim"), spread(down).alias("down"), of(2, across).alias("across"), "id", "vec")

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return OUT.empty_table()
        (q_ids, q), (c_ids, c) = _matrix(left), _matrix(right)
        found = [(int(i), -j, s) for i, h in zip(q_ids, block_top_k(q_ids, q, c_ids, c, k)) for s, j in h]
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*found), OUT)] if found else [pa.array([], f.type) for f in OUT], schema=OUT)

    part = asks.groupBy(*grid).cogroup(given.groupBy(*grid)).applyInArrow(block, "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return part.select("query_id", F.row_number().over(nearest).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
