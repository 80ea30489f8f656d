"""Key patterns and hashes of keys, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FNV-1a with 32 bits.
FNV_OFFSET, FNV_PRIME, FNV_MASK = 2166136261, 16777619, 0xFFFFFFFF


def glob(key: Column, pattern: str) -> Column:
    """No star: the key itself. One star: the text before it and the text after it. More: only the text before the first counts."""
    if "*" not in pattern:
        return key == pattern
    head, _, tail = pattern.partition("*")
    out = key.startswith(head) if head else key.isNotNull()
    return out & key.endswith(tail) if tail and "*" not in tail else out


def fnv1a(key: Column) -> Column:
    """FNV-1a 32 over the key's UTF-8 bytes, as an unsigned number in a long."""
    data = F.encode(key, "UTF-8")
    places = F.filter(F.sequence(F.lit(0), F.octet_length(data)), lambda i: i > 0)
    byte = lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long")
    return F.aggregate(places, F.lit(FNV_OFFSET).cast("long"), lambda h, i: (h.bitwiseXOR(byte(i)) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(F.lit(FNV_MASK).cast("long")))


def partition_of(key: Column, partitions: int, seq: Column | None = None) -> Column:
    """The partition of a key; without a key (null or empty) rows take turns by seq."""
    own = (fnv1a(key) % max(1, partitions)).cast("int")
    turn = F.pmod(seq, F.lit(max(1, partitions))).cast("int") if seq is not None else F.lit(0)
    return F.when(key.isNull() | (key == ""), turn).otherwise(own)
