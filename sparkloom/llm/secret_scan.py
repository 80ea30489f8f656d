"""Secret scans with DataFrame functions only: three fixed patterns, and windows of high Shannon entropy.

All positions are code points, end exclusive. Spark has no function for the place of every match; but the text
between the matches (split) and the matches themselves (regexp_extract_all) have lengths, and these add up to places.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns. access and hex runs are maximal, so their least length can stand in the pattern;
# for assign it can't (a match that is too short still uses up its characters).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "entropy")

# The character classes whose windows are measured, with the least bits a character for a hit. A window of random
# characters is expected to have 3.36 bits (16 symbols), 3.79 (32), 3.84 (36), 4.04 (64); hits start at about 0.4 less but in base64.
CLASSES = {
    "hex": ("0123456789abcdef", r"[0-9a-f]{20,}", 3.0),
    "upper_hex": ("0123456789ABCDEF", r"[0-9A-F]{20,}", 3.0),
    "lower": ("abcdefghijklmnopqrstuvwxyz0123456789", r"[a-z0-9]{20,}", 3.4),
    "upper": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", r"[A-Z0-9]{20,}", 3.4),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", r"[A-Za-z0-9+/_-]{20,}", 3.95),
}
# Runs of these classes must hold digits and letters, so that long words and numbers are no candidates.
MIXED = ("upper_hex", "lower", "upper")
WINDOW = 20
# Candidates that hold one of these are placeholders, not secrets.
ALLOWED = r"(?i)example|placeholder|changeme|your[_-]?key|x{6}|0{8}|0123456789|abcdefghij|deadbeef"

SPAN = "struct<start:int,kind:int,end:int>"
HIT = "struct<start:int,kind:int,end:int,hit:string>"
BLOCK = 128


def bound(value: Column, use) -> Column:
    """use(value), where value is worked out once, even if functions of array elements refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def before(values: Column, zero: Column, op) -> Column:
    """For each value of an array, op over all values before it (zero for the first).

    n values in blocks of BLOCK: op over each block, over the blocks before, then over what is before in the block. That is
    n * BLOCK / 2 + (n / BLOCK) ** 2 / 2 steps; an aggregate that carries the array along would copy it n times.
    """

    def spread(blocks, totals):
        start = lambda b: F.aggregate(F.slice(totals, F.lit(1), b), zero, op)
        inside = lambda x, s: F.transform(x, lambda y, i: F.aggregate(F.slice(x, F.lit(1), i), s, op))
        return F.flatten(F.transform(blocks, lambda x, b: bound(start(b), lambda s: inside(x, s))))

    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) + BLOCK - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
    of_blocks = lambda blocks: bound(F.transform(blocks, lambda x: F.aggregate(x, zero, op)), lambda totals: spread(blocks, totals))
    return bound(values, lambda v: bound(cut(v), of_blocks))


def match_spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """array<struct<start, kind, end, hit>> of the leftmost non-overlapping matches; keep(matched) filters them afterwards."""
    found = F.transform(
        F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")),
        lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("size"), x["hit"].alias("hit")),
    )
    found = F.filter(found, lambda x: x["hit"].isNotNull())  # the text after the last match has none

    def place(x, at):
        begin = at + x["gap"]
        return F.struct(begin.alias("start"), F.lit(kind).alias("kind"), (begin + x["size"]).alias("end"), x["hit"].alias("hit"))

    spans = bound(found, lambda f: F.zip_with(f, before(F.transform(f, lambda x: x["gap"] + x["size"]), F.lit(0), lambda a, n: a + n), place))
    spans = F.filter(spans, lambda s: keep(s["hit"])) if keep else spans
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(f"array<{HIT}>"))


def assigned(hit: Column) -> Column:
    """Whether the value of an assignment (group 2) is long enough."""
    return F.length(F.regexp_extract(hit, f"^{ASSIGN}$", 2)) >= ASSIGN_LEAST


def window_entropy(run: Column, alphabet: str, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits a character, of any window of the run; 0 if it is shorter than a window.

    One pass: a character that enters and one that leaves change two counts, and the sum of c * log2(c) over the
    counts changes by their terms only. The counts are a text with one character for each of the alphabet, whose code is the count.
    """
    places = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(alphabet), c))
    places = F.filter(places, lambda p: p > 0)
    # (enters, leaves): leaves is null until the window is full
    steps = bound(places, lambda p: F.slice(F.arrays_zip(p.alias("enters"), F.concat(F.array_repeat(F.lit(None).cast("int"), window), p).alias("leaves")), F.lit(1), F.greatest(F.size(p), F.lit(0))))
    zero = 32  # counts are printable characters
    terms = F.array(F.lit(0.0), *(F.lit(c * math.log2(c)) for c in range(1, window + 2)))
    term = lambda c: F.get(terms, c)
    count = lambda counts, at: F.ascii(F.substring(counts, at, F.lit(1))) - zero
    put = lambda counts, at, c: F.overlay(counts, F.char(c + zero), at, F.lit(1))
    start = F.struct(F.lit(chr(zero) * len(alphabet)).alias("counts"), F.lit(0.0).cast("double").alias("sum"), F.lit(0).alias("seen"), F.lit(float("inf")).alias("least"))

    def step(acc, x):
        c_in, c_out = count(acc["counts"], x["enters"]), count(acc["counts"], x["leaves"])
        grown = acc["sum"] - term(c_in) + term(c_in + 1)
        moved = F.when(x["leaves"].isNull(), grown).when(x["leaves"] == x["enters"], acc["sum"]).otherwise(grown - term(c_out) + term(c_out - 1))
        added = put(acc["counts"], x["enters"], c_in + 1)
        counts = F.when(x["leaves"].isNull(), added).when(x["leaves"] == x["enters"], acc["counts"]).otherwise(put(added, x["leaves"], c_out - 1))
        seen = acc["seen"] + 1
        return F.struct(counts.alias("counts"), moved.alias("sum"), seen.alias("seen"), F.when(seen >= window, F.least(acc["least"], moved)).otherwise(acc["least"]).alias("least"))

    least = F.aggregate(steps, start, step, lambda acc: acc["least"])
    return F.greatest(F.lit(0.0), F.log2(F.lit(float(window))) - least / window)


def entropy_spans(text: Column) -> Column:
    """Spans of candidate runs with a window over the class's threshold and nothing from the allow-list."""
    kind = KINDS.index("entropy")
    mixed = lambda hit, name: hit.rlike("[0-9]") & hit.rlike("[A-Za-z]") if name in MIXED else F.lit(True)
    parts = [
        match_spans(text, pattern, kind, lambda hit, n=name, a=alphabet, t=bits: mixed(hit, n) & ~hit.rlike(ALLOWED) & (window_entropy(hit, a) >= t))
        for name, (alphabet, pattern, bits) in CLASSES.items()
    ]
    return reduce(F.concat, parts)


def _bare(spans: Column) -> Column:
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))


def add_clear(base: Column, more: Column) -> Column:
    """The base spans, and those of `more` that don't overlap one; equal ones of `more` count once. Sorted by start.

    Of all spans in order, one of `more` is clear if base spans before it end before it starts, and the next base span starts after its end.
    """
    extra = lambda s: s["kind"] == KINDS.index("entropy")
    never = F.lit(2**31 - 1)

    def keep(all_spans):
        far = before(F.transform(all_spans, lambda s: F.when(extra(s), 0).otherwise(s["end"])), F.lit(0), lambda a, b: F.greatest(a, b))
        following = F.reverse(before(F.reverse(F.transform(all_spans, lambda s: F.when(extra(s), never).otherwise(s["start"]))), never, lambda a, b: F.least(a, b)))
        again = F.transform(all_spans, lambda s, i: s.eqNullSafe(F.get(all_spans, i - 1)))
        clear = lambda x: ~extra(x["s"]) | ((x["far"] <= x["s"]["start"]) & (x["following"] >= x["s"]["end"]) & ~x["again"])
        zipped = F.arrays_zip(all_spans.alias("s"), far.alias("far"), following.alias("following"), again.alias("again"))
        return F.transform(F.filter(zipped, clear), lambda x: x["s"])

    return bound(F.array_sort(F.concat(base, more)), keep)


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of docs and `secret_base`, `secret_spans`: sorted arrays of (start, kind, end), kind an index of KINDS.

    Base spans come from the fixed patterns. Entropy spans are added where they don't overlap a base span; equal ones
    of two classes count once. Null or empty text: no spans. Each row is on its own; no shuffle. The work is in proportion to
    the text's length and its number of matches (but for their sort).
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = F.concat(match_spans(text, ASSIGN, 0, assigned), match_spans(text, ACCESS, 1), match_spans(text, HEX, 2))
    out = docs.withColumn("secret_base", _bare(base)).withColumn("secret_more", _bare(entropy_spans(text)))
    spans = F.when(F.size("secret_more") > 0, add_clear(F.col("secret_base"), F.col("secret_more"))).otherwise(F.col("secret_base"))
    return out.withColumn("secret_spans", spans).drop("secret_more")


def spans_text(spans: str | Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """docs with every secret span of the text replaced by the mark; overlapping spans get one. Other columns stay."""
    found = scan(docs, text_col)
    text = F.col(f"`{text_col}`")

    # what stands between spans; where one begins before the last ended, there is nothing, and no mark of its own
    far = before(F.transform("secret_spans", lambda s: s["end"]), F.lit(0), lambda a, b: F.greatest(a, b))
    gaps = F.filter(F.zip_with("secret_spans", far, lambda s, at: F.struct(at.alias("from"), s["start"].alias("to"))), lambda g: g["from"] <= g["to"])
    last = F.array_max(F.transform("secret_spans", lambda s: s["end"]))
    # chunks of 1024 code points, as the place of a code point in a long text takes as many steps to find
    chunks = F.regexp_extract_all(text, F.lit("(?s).{1,1024}"), F.lit(0))

    def piece(chunks, a, b):
        first, final = F.shiftright(a, 10), F.shiftright(b, 10)
        at = lambda i: F.coalesce(F.get(chunks, i), F.lit(""))
        one = F.substring(at(first), a - first * 1024 + 1, b - a)
        several = F.concat(F.substring(at(first), a - first * 1024 + 1, F.lit(1024)), F.array_join(F.slice(chunks, first + 2, F.greatest(final - first - 1, F.lit(0))), ""), F.substring(at(final), F.lit(1), b - final * 1024))
        return F.when(first == final, one).otherwise(several)

    clean = bound(chunks, lambda c: F.concat(F.array_join(F.transform(gaps, lambda g: F.concat(piece(c, g["from"], g["to"]), F.lit(mark))), ""), piece(c, last, F.length(text))))
    return found.withColumn(text_col, F.when(F.size("secret_spans") > 0, clean).otherwise(text)).select(*(f"`{c}`" for c in docs.columns))


def secret_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of documents."""
    found = scan(docs.select("doc_id", "text"))
    n = lambda k: F.size(F.filter("secret_base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(spans_text("secret_base"), 256).alias("base_sha256"), spans_text("secret_spans").alias("spans"),
    )
