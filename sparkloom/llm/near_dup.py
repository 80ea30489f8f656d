"""Near-duplicate documents by HyperMinHash: compressed registers, banding, collision-corrected estimates, exact verification.

Every text becomes the set of its shingle hashes and, from it, REGISTERS registers. A register keeps, of the least value
that one hash function takes on the set, the number of leading zeros and the MANTISSA bits after the first one: two bytes
in place of eight. Equal sets are one node from then on. ROWS neighbouring registers make a band; nodes that share a band are
candidates, and a candidate pair is a link only if the full sets say so.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import freeing, id_filter, id_hash, passes, table
from .graph import connected_components
from .shingles import mix, shingle_sets

REGISTERS, ROWS, MANTISSA = 128, 4, 10
#: A pair is verified if its estimate is not under the threshold by more than this: over six standard errors of 128 registers.
MARGIN = 0.24
_KEYS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_ODD = mix(_KEYS) | np.uint64(1)


def registers(hashes: np.ndarray, block: int = 2048) -> np.ndarray:
    """uint16[REGISTERS] of a non-empty set: leading zeros << MANTISSA | the bits after the first one."""
    least = np.full(REGISTERS, np.uint64(2**64 - 1))
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), block):
            part = hashes[None, at : at + block] ^ _KEYS[:, None]
            part *= _ODD[:, None]
            np.minimum(least, part.min(axis=1), out=least)
    fraction, exponent = np.frexp((least >> np.uint64(11)).astype(np.float64))
    mantissa = np.maximum(fraction - 0.5, 0) * 2 * (1 << MANTISSA)
    return (((53 - exponent).astype(np.uint16) << MANTISSA) | mantissa.astype(np.uint16)).astype("<u2")


def band_keys(regs: np.ndarray) -> np.ndarray:
    """int64[n, bands] of uint16[n, REGISTERS]."""
    four = np.ascontiguousarray(regs).view("<u8").reshape(len(regs), -1)
    return mix(mix(four) + np.arange(1, four.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)).view(np.int64)


def collision(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The chance that disjoint sets of n and m shingles agree in a register: of both minima in one of its intervals."""
    total = n + m
    a = 2.0 ** -np.arange(1, 54)[:, None]
    return np.minimum(1, (n * m / total * (a / (1 << MANTISSA)) * (np.exp(-total * a) - np.exp(-2 * total * a))).sum(axis=0))


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarities from registers, without the part of the agreement that is chance."""
    c = collision(n.astype(float), m.astype(float))
    return np.maximum(0, ((a == b).mean(axis=1) - c) / (1 - c))


def _regs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, REGISTERS)


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """id, n_shingles, set_key, registers for rows of id, text."""

    def run(batches):
        for batch in batches:
            ids, out, start = batch.column("id"), [], 0
            for i, (s, more) in enumerate(shingle_sets(batch.column("text"), width)):
                out.append((len(s), hashlib.blake2b(s.tobytes() + more.tobytes(), digest_size=16).digest() if len(s) else None, registers(s).tobytes() if len(s) else None))
                if len(out) == 4096 or i == len(batch) - 1:
                    n, key, regs = zip(*out)
                    yield pa.RecordBatch.from_arrays([ids.slice(start, len(out)), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(regs, pa.binary())], ["id", "n_shingles", "set_key", "registers"])
                    out, start = [], i + 1

    return docs.mapInArrow(freeing(run), "id long, n_shingles long, set_key binary, registers binary")


def _bands(nodes: DataFrame) -> DataFrame:
    """band, node: a row for each band of each node."""

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                keys = band_keys(_regs(part.column("registers")))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part.column("node").to_numpy(), keys.shape[1]))], ["band", "node"])

    return nodes.select("node", "registers").mapInArrow(freeing(run), "band long, node long")


def _sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node, hashes for the given nodes (ids), from the texts again: a bitmap first, then the exact join."""
    bitmap = docs.sparkSession.sparkContext.broadcast(id_filter(nodes, "node"))

    def run(batches):
        for batch in batches:
            kept = batch.filter(pa.array(passes(bitmap.value, batch.column("h").to_numpy())))
            ids, sets, start, size = kept.column("id"), [], 0, 0
            for i, (s, _) in enumerate(shingle_sets(kept.column("text"), width)):
                sets.append(s.view(np.int64))
                size += len(s)
                if size > 1 << 18 or i == len(kept) - 1:
                    at = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([ids.slice(start, len(sets)), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets)))], ["node", "hashes"])
                    sets, start, size = [], i + 1, 0

    found = docs.where("id is not null").select("id", "text", id_hash("id").alias("h")).mapInArrow(freeing(run), "node long, hashes array<long>")
    return found.where(F.size("hashes") > 0).join(nodes.select("node"), "node", "left_semi")


def _likely(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose estimated similarity doesn't rule them out."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))

    def run(batches):
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            keep = estimate(_regs(batch.column("r_a")), _regs(batch.column("r_b")), n, m) >= threshold - MARGIN
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    fit = F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")  # else the sizes alone rule the pair out
    return pairs.join(side("a"), "a").join(side("b"), "b").where(fit).mapInArrow(freeing(run), "a long, b long")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, on full sets."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("s")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("t")), "b")
    common = F.size(F.array_intersect("s", "t"))
    linked = both.select("a", "b", common.alias("i"), (F.size("s") + F.size("t") - common).alias("u"))
    return linked.where(F.col("i") * 100 >= F.col("u") * percent).select("a", "b")


def _across(members: DataFrame, centre: DataFrame, sets: DataFrame, first: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that share a band and no component and may be links, without going through all pairs of the band.

    Let x be a member and c its band's centre, s the sum of the sizes of two sets and r = (100 - percent) / (100 + percent). Two sets are linked if and only if
    their symmetric difference has r * s elements at most. Let D(x) be what x and c differ in. Members x and y differ in |D(x)| + |D(y)| - 2 |D(x) & D(y)|
    elements, so a link needs an overlap of D(x) and D(y) of (|D(x)| + |D(y)| - r * s) / 2 at least. If x is no link of c, this is over 0 for every y; if both
    are links of c, they are one component already. So links show in short prefixes of D(x) and D(y) in a common order (what c lacks first: edits are
    mostly unique), joined on their elements, with the bound on what can still follow.
    """
    r = (100 - percent) / (100 + percent)
    parts = members.join(first, "node", "left").select("band", "node", "size", F.coalesce("component", "node").alias("part"))
    mixed = parts.where("size > 2").groupBy("band").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo != hi")
    held = parts.join(mixed.select("band"), "band", "left_semi").join(centre, "band").select(F.col("node").alias("x"), F.col("b").alias("c"), "part").where("x != c").distinct()
    side = lambda n, h: sets.select(F.col("node").alias(n), F.col("hashes").alias(h))
    both = held.join(side("x", "s"), "x").join(side("c", "t"), "c")
    both = both.select("c", "x", "part", F.size("s").alias("n"), F.size("t").alias("m"), F.array_sort(F.array_except("s", "t")).alias("added"), F.array_sort(F.array_except("t", "s")).alias("removed"))
    d = both.withColumn("d", F.size("added") + F.size("removed"))
    whole = F.floor(F.col("n") * (1 + 100 / percent) * r) + 1
    near = F.when(F.col("d") <= (F.col("n") + F.col("m")) * r, F.floor(F.col("d") / 2 + F.greatest(F.lit(0), F.col("n") - F.col("m")) * r / 2) + 1).otherwise(whole)
    d = d.withColumn("long", F.least(whole, near).cast("int")).withColumn("short", F.least(F.floor((whole - 1) / 2) + 1, near).cast("int"))
    tokens = table(d.select("c", "x", "part", "n", "d", "short", F.posexplode(F.slice(F.concat("added", "removed"), 1, F.col("long"))).alias("at", "token")))
    y, z = tokens.where("at < short").alias("y"), tokens.alias("z")
    order = F.struct("y.d", "y.x") < F.struct("z.d", "z.x")
    fit = F.least("y.n", "z.n") * 100 >= F.greatest("y.n", "z.n") * percent
    follow = F.least(F.col("y.d") - F.col("y.at"), F.col("z.d") - F.col("z.at"))  # this element and those after it
    need = (F.col("y.d") + F.col("z.d") - (F.col("y.n") + F.col("z.n")) * r) / 2
    pairs = y.join(z, (F.col("y.c") == F.col("z.c")) & (F.col("y.token") == F.col("z.token")) & (F.col("y.part") != F.col("z.part")) & order & fit & (follow >= need - 1e-9))
    return pairs.select(F.least("y.x", "z.x").alias("a"), F.greatest("y.x", "z.x").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """id, n_shingles, component_id, kept for every row: components of the graph of links between texts.

    A link: 100 * intersection >= percent * union of the sets of shingles of `width` words. Equal sets are one node, so copies
    are never compared. Nodes of a band are first compared with the one of them that most other nodes share bands with (a star, not all pairs);
    what is one component then needs no more comparisons. Of the other pairs that share a band those are compared
    whose differences from that node overlap enough for a link. A link at the threshold shares no band with a chance of (1 - 0.75**4)**32, about 5 in a million.

    Null or empty text, or only spaces: an empty set, linked with nothing. Fewer than `width` words: the sequence as one shingle.
    Rows that share an id are documents of their own that go by that id. A null id: component null, kept false. Empty input: no rows.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sketches = table(sketch(texts, width))
    groups = sketches.where("n_shingles > 0").groupBy("set_key").agg(F.min("id").alias("node"))
    groups = table(groups)
    nodes = sketches.join(groups.where("node is not null").withColumnRenamed("node", "id"), ["set_key", "id"], "left_semi")
    nodes = table(nodes.select(F.col("id").alias("node"), "n_shingles", "registers").dropDuplicates(["node", "n_shingles", "registers"]))

    bands = _bands(nodes)
    shared = bands.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    members = table(bands.join(shared, "band"))
    central = members.groupBy("node").agg(F.sum("size").alias("weight"))
    weighed = members.join(central, "node")
    centre = weighed.groupBy("band").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("c")).select("band", (-F.col("c.minus")).alias("b"))
    centre = table(centre)
    star = members.join(centre, "band").select(F.col("node").alias("a"), "b").where("a != b").distinct()
    sets = table(_sets(texts, central.select("node"), width))
    links = table(_links(_likely(star, nodes, percent / 100), sets, percent))
    first = table(connected_components(links))

    rest = _across(members, centre, sets, first, percent).join(links, ["a", "b"], "left_anti")
    more = table(_links(_likely(rest, nodes, percent / 100), sets, percent))
    whole = connected_components(table(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))) if not more.isEmpty() else first

    named = groups.join(whole, "node", "left").select("set_key", F.coalesce("component", "node").alias("component_id"))
    out = sketches.select("id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each component stays: the one with the smallest doc_id. Documents with null ids stay too."""
    found = near_duplicates(docs).where("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))
