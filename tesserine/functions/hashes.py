"""Perceptual and placement hashes as Columns (V10-V12, V15, V16). 64-bit hashes are signed longs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def similarity(a: Column, b: Column) -> Column:
    return 1 - hamming(a, b) / F.lit(64.0)


def mean_hamming(a: Column, b: Column) -> Column:
    """The mean distance of three hashes in structs."""
    return (hamming(a["ahash"], b["ahash"]) + hamming(a["dhash"], b["dhash"]) + hamming(a["phash"], b["phash"])) / F.lit(3.0)


def ring_position(key: Column) -> Column:
    """The first four bytes of the MD5, big-endian."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def sub_hash(table: Column, key: Column, image: Column) -> Column:
    """Four bits of the MD5 of table:key:image."""
    first = F.conv(F.substring(F.md5(F.concat_ws(":", table, key, image).cast("binary")), 1, 2), 16, 10).cast("long")
    return F.lpad(F.bin(first % 16), 4, "0")


def bits_to_long(flags: Column) -> Column:
    """An array of 64 booleans, the highest bit first, as a signed long."""
    return F.conv(F.array_join(F.transform(flags, lambda x: F.when(x, "1").otherwise("0")), ""), 2, -10).cast("long")
