"""Helpers shared by the training-data operators: shared-folder tables, fixed-size id filters, column hygiene."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Without one, a session on this machine alone has a temporary folder, any other raises
    RuntimeError: each executor would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL[app]


def table(df: DataFrame) -> DataFrame:
    """Cut lineage: write the rows to a Parquet table in the shared folder and read them back.

    A lost executor then costs a reread of the table, not a recomputation of what led to it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that nothing reads any more: all that came from them is in tables of its own."""
    for t in tables:
        jvm = t.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(t.table_path)
        where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def freeing(run):
    """For functions of mapInArrow: the worker gives the memory back to the system at the end of each task.

    Spark keeps idle Python workers, two or more for each core, next to an executor's heap; what they freed stays theirs otherwise.
    """

    def freed(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
            if trim:
                trim(0)

    return freed


def doc_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that other columns of the input can't clash with the operator's own."""
    return docs.select(*(F.col(f"`{n}`") for n in names))


def id_filter(ids: DataFrame, col: str, bits: int = 1 << 23) -> np.ndarray:
    """A bitmap of hashed ids with a fixed size (bits / 8 bytes), whatever the number of ids.

    It has false positives only, so it thins rows before an exact join; it never replaces that join. As more
    ids set more bits it passes more rows, up to all of them: then only the saving is lost.
    """
    h = F.pmod(F.xxhash64(F.col(col)), F.lit(bits))
    words = (
        ids.select(h.alias("h"))
        .groupBy((F.col("h") / 64).cast("int").alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(h, 64) AS int))")).alias("v"))
    )
    out = np.zeros(bits // 64, np.int64)
    got = words.toArrow()  # at most bits / 64 rows
    out[got.column("w").to_numpy()] = got.column("v").to_numpy()
    return out


def id_hash(col: str, bits: int = 1 << 23) -> Column:
    return F.pmod(F.xxhash64(F.col(col)), F.lit(bits))


def passes(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return (bitmap[hashes >> 6] >> (hashes & 63)) & 1 == 1


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has been counted to have no more than so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def place_in(df: DataFrame, cell: str, order: list[str], rows_per_slice: int = 1024, cells: int = 4096) -> DataFrame:
    """Adds cell_place, the gapless place (from 0) of a row among the rows of its cell, and cell_rows, their number.

    A cell is dealt into slices by a hash of the order columns, one for every rows_per_slice of its rows, so that a cell
    that holds a third of the table is split like any other; a place is the rows of lower slices and those before it in
    its own slice. Counts of up to `cells` cells are broadcast, of more they are joined by shuffles.
    df is read four times: give it a table. The place follows the order columns within a slice only.
    """
    counts = df.groupBy(cell).agg(F.count("*").alias("cell_rows"))
    cut = df.join(small(counts, cells), cell).withColumn("slice", F.pmod(F.xxhash64(*order, F.lit(7)), F.ceil(F.col("cell_rows") / rows_per_slice)).cast("int"))
    sizes = cut.groupBy(cell, "slice").agg(F.count("*").alias("slice_rows"))
    below = Window.partitionBy(cell).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(cell, "slice", F.coalesce(F.sum("slice_rows").over(below), F.lit(0)).alias("slice_start"))
    placed = cut.withColumn("in_slice", F.row_number().over(Window.partitionBy(cell, "slice").orderBy(*order))).join(sizes, [cell, "slice"])
    return placed.withColumn("cell_place", (F.col("slice_start") + F.col("in_slice") - 1).cast("long")).drop("slice", "slice_start", "in_slice")
