"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment tells copies from chance.

Texts and test items are words without punctuation or case. An n-gram of an item is a seed if it is rare in the corpus
next to the item's other n-grams. Only documents that hold it without another n-gram of the item count: so a phrase of the
language is frequent, and a passage that leaked into many documents, whole, edited or in part, doesn't make its own n-grams
frequent; one that is rare next to the others over all documents stays a seed, too. N-grams that occur nowhere don't tell what is usual. Windows of documents around seeds are aligned with the item.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, freeing, id_filter, id_hash, passes, table
from .shingles import LOOSE, mix, texts, word_keys

N = 3
RARE_TIMES, RARE_MORE = 8, 20
MATCH, MISMATCH, GAP = 1, -1, -1
LEAST_SCORE, LEAST_SEEDS = 0.5, 2
BLOOM_BITS = 1 << 24
SALTS = 32
_WEIGHTS = mix(np.arange(101, 101 + N, dtype=np.uint64)) | np.uint64(1)


def word_lists(column):
    """The word keys of each text, 64 bits each."""
    for text in texts(pc.utf8_lower(column)):
        yield word_keys(text, LOOSE)[:, 0]


def ngrams(h: np.ndarray) -> np.ndarray:
    """Keys of the N-grams of some words; of fewer than N words, one for all of them."""
    n = len(h) - N + 1
    if n <= 0:
        with np.errstate(over="ignore"):
            return mix(np.uint64(len(h)) + mix(h * _WEIGHTS[: len(h)]).sum(dtype=np.uint64, keepdims=True)) if len(h) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        return mix(sum(h[j : j + n] * _WEIGHTS[j] for j in range(N)))


def bloom(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(BLOOM_BITS // 8, np.uint8)
    for shift in (0, 24):
        bit = (hashes >> np.uint64(shift)) % np.uint64(BLOOM_BITS)
        np.bitwise_or.at(out, (bit >> np.uint64(3)).astype(np.int64), (1 << (bit & np.uint64(7))).astype(np.uint8))
    return out


def in_bloom(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes that may be in it."""
    where = np.arange(len(hashes))
    for shift in (0, 24):
        bit = (hashes[where] >> np.uint64(shift)) & np.uint64(BLOOM_BITS - 1)
        where = where[(bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    return where


def align(windows: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each window with its item, and the place in the window after its end.

    All pairs advance together: one row of their matrices for each word of the windows. Gaps along a row come from a running maximum.
    """
    b, w, m = len(windows), max(map(len, windows)), max(map(len, items))
    win, item = np.zeros((w, b), np.uint32), np.zeros((b, m), np.uint32)
    for i, (x, y) in enumerate(zip(windows, items)):
        win[: len(x), i], item[i, : len(y)] = x, y
    real = np.arange(m)[None, :] < np.array([len(y) for y in items])[:, None]
    sizes = np.array([len(x) for x in windows])
    score = np.zeros((b, m + 1), np.int32)
    best, end = np.zeros(b, np.int32), np.zeros(b, np.int64)
    slope = GAP * np.arange(m + 1, dtype=np.int32)
    for r in range(w):
        same = (win[r][:, None] == item) & real
        grown = score.copy()
        grown[:, 1:] = np.maximum(np.maximum(score[:, :-1] + np.where(same, MATCH, MISMATCH), score[:, 1:] + GAP), 0)
        score = (np.maximum.accumulate(grown - slope, axis=1) + slope).astype(np.int32)
        top = np.where(r < sizes, score.max(axis=1), 0)
        end = np.where(top > best, r + 1, end)
        best = np.maximum(best, top)
    return best, end


def aligned(windows: list[np.ndarray], items: list[np.ndarray], cells: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """align() in groups of similar sizes, each of at most `cells` padded words (or one pair)."""
    best, end = np.zeros(len(windows), np.int32), np.zeros(len(windows), np.int64)
    order = sorted(range(len(windows)), key=lambda i: (len(items[i]), len(windows[i])))
    while order:
        wide, n = 0, 0
        for i in order:
            wide = max(wide, len(windows[i]), len(items[i]))
            if n and wide * (n + 1) > cells:
                break
            n += 1
        some, order = order[:n], order[n:]
        best[some], end[some] = align([windows[i] for i in some], [items[i] for i in some])
    return best, end


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """doc_id, item_id, score, n_seeds, start, end: documents that hold a copy of a test item, exact, edited or in part.

    score: the best alignment's score over the item's number of words, 1 for an exact copy; start and end are words of the document (the end of the
    best alignment, start is the window's). One row for each pair with a score of `least` or more. A window needs LEAST_SEEDS different
    seeds, or all there are in an item with fewer. Null texts or ids, and items without words: no rows. Items of under N words are common phrases: only documents that
    consist of the same words hold them. Equal items are found each. Rows that share an id are scanned row by row, the best counts. Empty tables: no rows.
    Every task holds a bitmap of fixed size; what passes it is joined exactly, the hits of a seed in SALTS parts. Seeds of an item whose diagonals (place in the document less
    place in the item) are near each other share a window; it has about five times the item's words at most, whatever the document's length.
    """
    spark = docs.sparkSession
    sides = lambda df, key: df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id is not null and text is not null")
    texts, items = sides(docs, doc_id), sides(benchmark, item_id)

    def item_rows(batches):
        for batch in batches:
            for i, h in zip(batch.column("id").to_pylist(), word_lists(batch.column("text"))):
                g = ngrams(h)
                if len(g):
                    w = h.astype(np.uint32)
                    yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([len(h)]), pa.array([w.tobytes()]), pa.array([g.view(np.int64)])], ["item", "size", "words", "grams"])

    wanted = table(items.mapInArrow(freeing(item_rows), "item long, size long, words binary, grams array<long>"))
    grams = wanted.select("item", "size", F.posexplode("grams").alias("place", "gram"))

    def bits_of(df: DataFrame):
        def run(batches):
            out = np.zeros(BLOOM_BITS // 8, np.uint8)
            for batch in batches:
                out |= bloom(batch.column("gram").to_numpy().view(np.uint64))
            at = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(out[at].astype(np.int32))], ["at", "bits"])

        out = np.zeros(BLOOM_BITS // 8, np.uint8)
        got = df.select("gram").distinct().mapInArrow(freeing(run), "at int, bits int").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most BLOOM_BITS / 8 rows
        out[got.column("at").to_numpy()] = got.column("bits").to_numpy().astype(np.uint8)
        return spark.sparkContext.broadcast(out)

    all_bits = bits_of(grams)

    def count(batches):
        for batch in batches:
            sets: dict[bytes, int] = {}
            for g in map(ngrams, word_lists(batch.column("text"))):
                key = np.unique(g[in_bloom(all_bits.value, g)]).tobytes()
                sets[key] = sets.get(key, 0) + 1
            sets.pop(b"", None)
            yield pa.RecordBatch.from_arrays([pa.array([np.frombuffer(x, np.int64) for x in sets], pa.list_(pa.int64())), pa.array(list(sets.values()), pa.int64())], ["grams", "docs"])

    sets = table(texts.select("text").mapInArrow(freeing(count), "grams array<long>, docs long").groupBy("grams").agg(F.sum("docs").alias("docs")))
    members = sets.withColumn("set", F.monotonically_increasing_id()).select("set", "docs", F.explode("grams").alias("gram"))
    held = members.join(grams.select("item", "gram").distinct(), "gram").groupBy("set", "item").agg(F.collect_list("gram").alias("held"), F.first("docs").alias("docs"))
    alone = F.when(F.size("held") == 1, F.col("docs")).otherwise(0)
    seen = held.select("item", "docs", alone.alias("alone"), F.explode("held").alias("gram")).groupBy("item", "gram").agg(F.sum("docs").alias("docs"), F.sum("alone").alias("alone"))
    ranked = grams.join(seen, ["item", "gram"], "left").select("item", "size", "place", "gram", "docs", "alone")  # null where no document holds it
    rare = lambda c: F.col(c) <= F.percentile(c, F.lit(0.25)).over(Window.partitionBy("item")) * RARE_TIMES + RARE_MORE
    seeds = ranked.withColumn("rare", rare("alone") | rare("docs")).where("docs is null or rare")
    seeds = table(seeds.withColumn("own", F.size(F.collect_set("gram").over(Window.partitionBy("item")))).select("item", "size", "place", "gram", "own"))
    forget(sets)
    seed_bits = bits_of(seeds)

    def hits(batches):
        for batch in batches:
            ids, grams_found, places = [], [], []
            for i, h in zip(batch.column("id").to_pylist(), word_lists(batch.column("text"))):
                g = ngrams(h)
                at = in_bloom(seed_bits.value, g)
                ids.append(np.full(len(at), i, np.int64))
                grams_found.append(g[at].view(np.int64))
                places.append(at.astype(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, grams_found, places)], ["id", "gram", "at"])

    salted = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    each = texts.mapInArrow(freeing(hits), "id long, gram long, at long").withColumn("salt", F.pmod(F.xxhash64("id", "at"), F.lit(SALTS)).cast("int"))
    each = each.join(salted, ["gram", "salt"]).withColumn("diagonal", F.col("at") - F.col("place")).withColumn("slack", F.floor(F.col("size") / 2) + 2)
    # bins of diagonals as wide as the item and its slack; a hit near an edge counts in both, so hits within a slack of each other share one
    wide = F.col("size") + 2 * F.col("slack")
    bins = F.array_distinct(F.array(F.floor((F.col("diagonal") - F.col("slack")) / wide), F.floor((F.col("diagonal") + F.col("slack")) / wide)))
    pairs = each.withColumn("bin", F.explode(bins)).groupBy("id", "item", "bin").agg(
        F.count_distinct("gram").alias("n_seeds"), F.first("own").alias("own"), F.min(F.col("diagonal") - F.col("slack")).alias("lo"), F.max(F.col("diagonal") + F.col("size") + F.col("slack")).alias("hi")
    )
    pairs = table(pairs.where(F.col("n_seeds") >= F.least(F.lit(LEAST_SEEDS), F.col("own"))).select("id", "item", "n_seeds", "lo", "hi"))
    bitmap = spark.sparkContext.broadcast(id_filter(pairs, "id"))
    spans = pairs.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("spans"))

    def cut(batches):
        for batch in batches:
            rows = []
            for i, h, wanted_spans in zip(batch.column("id").to_pylist(), word_lists(batch.column("text")), batch.column("spans").to_pylist()):
                for x in wanted_spans:
                    rows.append((i, x["lo"], x["hi"], h[max(0, x["lo"]) : max(0, x["hi"])].astype(np.uint32).tobytes()))
                if len(rows) >= 1024:
                    yield pa.RecordBatch.from_pylist([dict(zip(WINDOWS.names, r)) for r in rows], WINDOWS)
                    rows = []
            yield pa.RecordBatch.from_pylist([dict(zip(WINDOWS.names, r)) for r in rows], WINDOWS)

    @F.arrow_udf("boolean")
    def may_have(h: pa.Array) -> pa.Array:
        return pa.array(passes(bitmap.value, h.to_numpy(zero_copy_only=False)))

    windows = texts.where(may_have(id_hash("id"))).join(spans, "id").select("id", "text", "spans").mapInArrow(freeing(cut), "id long, lo long, hi long, words binary")
    ready = table(pairs.join(windows, ["id", "lo", "hi"])).join(wanted.select("item", F.col("words").alias("item_words")), "item")

    def score(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                item, window = ([np.frombuffer(x, np.uint32) for x in part.column(c).to_pylist()] for c in ("item_words", "words"))
                best, end = aligned(window, item)
                begin = np.maximum(part.column("lo").to_numpy(), 0)
                out = [part.column("id"), part.column("item"), pa.array(best / np.array([len(x) for x in item])), part.column("n_seeds"), pa.array(begin), pa.array(begin + end)]
                yield pa.RecordBatch.from_arrays(out, ["id", "item", "score", "n_seeds", "start", "end"])

    scored = ready.select("id", "item", "n_seeds", "lo", "words", "item_words").mapInArrow(freeing(score), "id long, item long, score double, n_seeds long, start long, end long")
    best = scored.where(F.col("score") >= least).groupBy("id", "item").agg(F.max(F.struct("score", "n_seeds", "start", "end")).alias("x"))
    return best.select(F.col("id").alias(doc_id), F.col("item").alias(item_id), "x.score", "x.n_seeds", "x.start", "x.end")


WINDOWS = pa.schema([("id", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("words", pa.binary())])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a copy of a test item. Rows with null ids stay."""
    found = decontaminate(docs, benchmark).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))
