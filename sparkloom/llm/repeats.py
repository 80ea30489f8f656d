"""Removal of repeated byte strings, by bucket-pointer refinement of suffixes.

Suffixes of all texts fall into buckets by their first 25 bytes. A bucket is refined by the bucket identifiers at later
offsets: the identifier for 50 bytes comes from those for 25 at the suffix and at 25 bytes after it. Bucket identifiers only say where
to look: they are hashes of the content, so every task computes the same ones without seeing the others' text. Whether two strings are
equal is decided by their 128-bit BLAKE2b digests. Spark finds out which buckets hold more than one suffix, and only suffixes in such buckets go on:

1. Each suffix of 400 bytes is filed under the least of the 50-byte identifiers in it (its anchor). Neighbouring suffixes
   mostly share it: they are one segment, with one digest for all its bytes.
2. A segment alone in its anchor's bucket is done: nothing repeats. Equal segments of a bucket are counted once; if a
   bucket holds one kind only, all its suffixes repeat.
3. Of buckets with more kinds, one segment of each kind goes on in groups of 50 suffixes, which are refined by the 350 bytes that a
   group has in common: again a group alone is done, equal groups count once, and a single kind repeats as a whole.
4. Of what is left, one group of each kind sends the digests of the 400 bytes of its suffixes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, passes, table
from .shingles import mix, utf8

FIRST, DOUBLINGS = 25, 1
LENGTH = 400
ANCHOR = FIRST << DOUBLINGS
BLOCK = 1 << 20  # suffixes handled at once
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
TEXT = ("ta", "tb")  # the 128 bits that name a text
BASE = 0x9E3779B97F4A7C55
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)], dtype=np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def identifiers(data: np.ndarray, doublings: int = DOUBLINGS) -> dict[int, np.ndarray]:
    """Bucket identifiers of the suffixes of some bytes, by length: FIRST, 2 * FIRST, ..."""
    n = len(data)
    up, down = powers(BLOCK + LENGTH + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        out, size = {FIRST: mix((total[FIRST:] - total[:-FIRST]) * down[: n - FIRST + 1])}, FIRST
        for _ in range(doublings):
            here = out[size]
            out[2 * size] = mix(here[:-size] * _A + here[size:] * _B)
            size *= 2
    return out


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 128-bit digests of data[start:end] as two arrays of int64."""
    view, hashed = memoryview(np.ascontiguousarray(data)), hashlib.blake2b
    found = b"".join([hashed(view[i:j], digest_size=16).digest() for i, j in zip(starts.tolist(), ends.tolist())])
    both = np.frombuffer(found, "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def blocks(data: np.ndarray):
    """(place, bytes) of blocks of BLOCK suffixes at most, each with the bytes that its suffixes need."""
    for at in range(0, len(data) - LENGTH + 1, BLOCK):
        yield at, data[at : at + BLOCK + LENGTH - 1]


def anchored(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """bucket (the anchor's identifier), first suffix, last suffix and place of the anchor, for each segment of a block."""
    short = identifiers(data)[ANCHOR]
    # the least identifier, its leftmost place at ties: 40 bits of the identifier above 24 bits of the place
    key = (short & ~np.uint64((1 << 24) - 1)) | np.arange(len(short), dtype=np.uint64)
    least = sliding_least(key, LENGTH - ANCHOR + 1)
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    last = np.r_[first[1:], len(least)] - 1
    anchor = (least[first] & np.uint64((1 << 24) - 1)).astype(np.int64)
    return short[anchor], first, last, anchor


COARSE = 50  # suffixes that start within so many bytes before the same multiple of it from the anchor are refined together
CORE = LENGTH - COARSE


def place_key(ta, tb, start) -> np.ndarray:
    """A hash of a place in a text, for bitmaps only."""
    as_unsigned = lambda x: np.asarray(x).astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        return mix(as_unsigned(ta) + mix(as_unsigned(tb) + mix(as_unsigned(start) + _B)))


def in_bits(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return passes(bits, (keys & np.uint64(len(bits) * 64 - 1)).view(np.int64))


def key_filter(df: DataFrame, col: str, bits: int) -> np.ndarray:
    """A bitmap of bits / 8 bytes with the low bits of 64-bit keys."""
    low = df.select(F.col(col).bitwiseAND(F.lit(bits - 1)).alias("h"))
    words = low.groupBy((F.col("h") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(h, 64) AS int))")).alias("v")).toArrow()  # at most bits / 64 rows
    out = np.zeros(bits // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("v").to_numpy()
    return out


def coarse_groups(first: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of the segment, k): a suffix at p belongs to group (anchor - p) // COARSE."""
    lo, hi = (anchor - last) // COARSE, (anchor - first) // COARSE
    n = hi - lo + 1
    row = np.repeat(np.arange(len(first)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + lo[row]


def _segments_of(texts, visit, batch_rows: int = 16384):
    """Record batches of what visit(text key, block place, block) returns for each block of each text: tuples of arrays."""
    parts, size = [], 0
    for key, data in texts:
        for at, block in blocks(data):
            got = visit(key, at, block)
            if got is not None and len(got[0]):
                parts.append((*(np.full(len(got[0]), k) for k in key), *got))
                size += len(got[0])
                if size >= batch_rows:
                    yield parts
                    parts, size = [], 0
    if parts:
        yield parts


def _texts(batch: pa.RecordBatch, keep: np.ndarray | None = None):
    data, at = utf8(batch.column("text"))
    keys = list(zip(*(batch.column(c).to_pylist() for c in TEXT)))
    for i in range(len(batch)) if keep is None else np.flatnonzero(keep).tolist():
        yield keys[i], data[at[i] : at[i + 1]]


def _rows(parts, schema: str) -> pa.RecordBatch:
    """A batch of the columns of a schema of longs and ints."""
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype("i8" if kind == "long" else "i4")) for c, (_, kind) in zip(zip(*parts), fields)], [name for name, _ in fields])


def repeated_spans(texts: DataFrame, bits: int = 1 << 25) -> DataFrame:
    """ta, tb, spans (a table): for texts (ta, tb name the text; text) the sorted byte spans that strings of LENGTH bytes cover which
    start anywhere else too. Texts without any are left out.

    bits: the size of the bitmaps that tell tasks which texts, segments and groups go on, fixed whatever the input; a false
    positive only sends digests that turn out not to repeat.
    """
    share = texts.sparkSession.sparkContext.broadcast
    source = texts.where(F.octet_length("text") >= LENGTH).select(*TEXT, "text")

    segment = "ta long, tb long, bucket long, ka long, kb long, lo int, hi int"

    def find(batches):
        def visit(key, at, block):
            bucket, first, last, _ = anchored(block)
            return bucket.view(np.int64), *digests(block, first, last + LENGTH), first + at, last + at

        for batch in batches:
            for parts in _segments_of(_texts(batch), visit):
                yield _rows(parts, segment)

    segs = table(source.mapInArrow(find, segment))
    kinds = table(_kinds(segs, ["bucket"], ["ka", "kb"], ["ta", "tb", "lo"]))

    def bitmap(df: DataFrame, start: str | None = None) -> "Broadcast":  # noqa: F821
        """Of the texts of some rows, or of places in them."""

        def hashed(batches):
            for batch in batches:
                a, b = (batch.column(c).to_numpy() for c in TEXT)
                yield pa.RecordBatch.from_arrays([pa.array(place_key(a, b, batch.column("start").to_numpy()).view(np.int64))], ["h"])

        places = df.select(*TEXT, (F.lit(-1) if start is None else F.col(start)).alias("start"))
        return share(key_filter(places.distinct().mapInArrow(hashed, "h long"), "h", bits))

    chosen = table(kinds.where("kinds > 1").select("bucket", "ka", "kb", *TEXT, F.col("lo").alias("seg")))
    chosen_texts, chosen_segs = bitmap(chosen), bitmap(chosen, "seg")

    def some(batch, chosen_texts):
        a, b = (batch.column(c).to_numpy() for c in TEXT)
        return in_bits(chosen_texts.value, place_key(a, b, np.full(len(batch), -1)))

    def grouped(key, at, block):
        """Groups of the chosen segments: segment, first and last suffix, anchor less COARSE * k, k."""
        _, first, last, anchor = anchored(block)
        keep = in_bits(chosen_segs.value, place_key(*key, first + at))
        if not keep.any():
            return None
        first, last, anchor = first[keep], last[keep], anchor[keep]
        row, k = coarse_groups(first, last, anchor)
        base = anchor[row] - COARSE * k
        return first[row], np.maximum(first[row], base - COARSE + 1), np.minimum(last[row], base), base, k

    # a group is named by its text and its first suffix
    group = "ta long, tb long, ca long, cb long, sa long, sb long, seg int, lo int, hi int, k int, before int"

    def coarse(batches):
        def visit(key, at, block):
            found = grouped(key, at, block)
            if found is None:
                return None
            seg, lo, hi, base, k = found
            # groups are compared with those at the same distance from the anchor, and of the same reach before the core
            return *digests(block, base, base + CORE), *digests(block, lo, hi + LENGTH), seg + at, lo + at, hi + at, k, base - lo

        for batch in batches:
            for parts in _segments_of(_texts(batch, some(batch, chosen_texts)), visit):
                yield _rows(parts, group)

    core, span = ["ca", "cb", "k"], ["sa", "sb", "before"]
    groups = table(source.mapInArrow(coarse, group))
    spans = table(_kinds(groups, core, span, ["ta", "tb", "lo"]))
    going = table(spans.where("kinds > 1").select(*TEXT, "lo").distinct())
    going_texts, going_groups = bitmap(going), bitmap(going, "lo")

    suffix = "ta long, tb long, da long, db long, lo int, i int"

    def fine(batches):
        def visit(key, at, block):
            found = grouped(key, at, block)
            if found is None:
                return None
            _, lo, hi, _, _ = found
            keep = in_bits(going_groups.value, place_key(*key, lo + at))
            lo, n = lo[keep], (hi - lo + 1)[keep]
            each = np.repeat(np.arange(len(lo)), n)
            i = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            start = lo[each] + i
            return *digests(block, start, start + LENGTH), lo[each] + at, i

        for batch in batches:
            for parts in _segments_of(_texts(batch, some(batch, going_texts)), visit):
                yield _rows(parts, suffix)

    suffixes = table(source.mapInArrow(fine, suffix))
    # texts may come as several equal rows: a suffix is another one only if it is in another text, or at another place
    least, most = (lambda c: F.min(c).alias(f"{c}0")), (lambda c: F.max(c).alias(f"{c}1"))
    place = suffixes.select(*TEXT, "da", "db", (F.col("lo") + F.col("i")).alias("p"))
    twice = place.groupBy("da", "db").agg(*(f(c) for f in (least, most) for c in ("ta", "tb", "p"))).where("ta0 != ta1 OR tb0 != tb1 OR p0 != p1").select("da", "db")
    ends = suffixes.join(twice, ["da", "db"], "left_semi").groupBy(*TEXT, "lo").agg(F.min("i").alias("from"), F.max("i").alias("to"))

    # back: from suffixes to groups, to segments, to texts
    known = spans.join(ends, [*TEXT, "lo"], "left").select(*core, *span, F.when(F.col("n") > 1, 0).otherwise(F.col("from")).alias("from"), F.when(F.col("n") == 1, F.col("to")).alias("to")).where("from is not null")
    skip, reach = F.col("lo") - F.col("seg") + F.col("from"), F.col("lo") - F.col("seg") + F.coalesce(F.col("to"), F.col("hi") - F.col("lo"))
    by_segment = groups.join(known, [*core, *span]).groupBy(*TEXT, "seg").agg(F.min(skip).alias("skip"), F.max(reach).alias("reach"))
    partly = chosen.join(by_segment, [*TEXT, "seg"]).select("bucket", "ka", "kb", "skip", "reach")
    covered = kinds.join(partly, ["bucket", "ka", "kb"], "left").where("n > 1 OR skip is not null")
    covered = table(covered.select("bucket", "ka", "kb", F.when(F.col("n") > 1, 0).otherwise(F.col("skip")).alias("skip"), F.when(F.col("n") == 1, F.col("reach")).alias("reach")))
    forget(suffixes)
    bucket_bits = share(key_filter(covered, "bucket", bits))

    @F.arrow_udf("boolean")
    def may_repeat(bucket: pa.Array) -> pa.Array:
        return pa.array(in_bits(bucket_bits.value, bucket.to_numpy(zero_copy_only=False).view(np.uint64)))

    cover = segs.where(may_repeat("bucket")).join(covered, ["bucket", "ka", "kb"])
    cover = cover.select(*TEXT, (F.col("lo") + F.col("skip")).alias("start"), (F.coalesce(F.col("lo") + F.col("reach"), F.col("hi")) + LENGTH).alias("end"))
    out = table(cover.groupBy(*TEXT).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans")))
    forget(segs, kinds, chosen, groups, spans, going, covered)
    return out


def _kinds(rows: DataFrame, bucket: list[str], kind: list[str], place: list[str]) -> DataFrame:
    """Of buckets with more than one row: each kind with n, its rows, kinds, the kinds of its bucket, and the text and place of one of its rows.

    Rows of a kind are counted before the shuffle, so a bucket with very many equal rows is a few partial counts.
    """
    pick = F.xxhash64(*place)  # all rows of a kind are equal, so any of them will do
    counted = rows.groupBy(*bucket, *kind).agg(F.count("*").alias("n"), *(F.min_by(c, pick).alias(c) for c in place))
    buckets = counted.groupBy(*bucket).agg(F.sum("n").alias("all"), F.count("*").alias("kinds")).where("all > 1")
    return counted.join(buckets, bucket).select(*bucket, *kind, "n", "kinds", *place)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that remain) for every row.

    Every byte goes that is covered by a string of LENGTH bytes which starts anywhere else too, in the same text or another;
    overlaps count, and all strings are judged on the input. Null or empty text: no bytes. Texts under LENGTH bytes keep
    all. Repeated rows are copies of each other, so they go if they are long enough. Empty input: no rows. Strings are equal if
    their 128-bit BLAKE2b digests are; a text is named by two xxHash64 with different seeds.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("ta"), F.xxhash64(F.lit(7), text).alias("tb"))
    cover = repeated_spans(rows.select(*TEXT, "text"))
    covered = docs.sparkSession.sparkContext.broadcast(key_filter(cover, "ta", 1 << 23))

    @F.arrow_udf("boolean")
    def may_be_covered(ta: pa.Array) -> pa.Array:
        return pa.array(in_bits(covered.value, ta.to_numpy(zero_copy_only=False).view(np.uint64)))

    flagged = rows.withColumn("flag", may_be_covered("ta"))

    def cut(batches):
        for batch in batches:
            data, at = utf8(batch.column("text"))
            out = []
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                mine, keep, runs, end = data[at[i] : at[i + 1]], [], 0, 0
                for s in spans or ():
                    if s["start"] > end or not runs:
                        runs += 1
                        keep.append(mine[end : s["start"]])
                    end = max(end, s["end"])
                keep.append(mine[end:])
                left = np.concatenate(keep).tobytes()
                out.append((len(mine), len(mine) - len(left), runs, hashlib.sha256(left).hexdigest(), left))
                if len(out) == 512 or i == len(batch) - 1:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column("id").slice(i + 1 - len(out), len(out)), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
                    out = []

    some = flagged.where("flag").select("id", *TEXT, "text").join(cover, list(TEXT), "left").select("id", "text", "spans")
    some = some.mapInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    none = F.lit(0).cast("long")
    rest = flagged.where("not flag").select("id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.encode("text", "UTF-8").alias("kept"))
    return some.unionByName(rest).withColumnRenamed("id", id_col)
