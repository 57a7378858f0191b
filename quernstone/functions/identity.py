"""Identities of records and pairs, and what is derived from their hashes: all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unordered(a: Column, b: Column) -> tuple[Column, Column]:
    """The canonical order of a pair; a null member yields the other one twice, as least and greatest skip nulls."""
    return F.least(a, b), F.greatest(a, b)


def strict_unordered(a: Column, b: Column) -> tuple[Column, Column]:
    """As unordered, but null where the pair is a self-pair or a member is null or empty."""
    fine = (a != b) & (F.length(a) > 0) & (F.length(b) > 0)
    return F.when(fine, F.least(a, b)), F.when(fine, F.greatest(a, b))


def short_id(prefix: str, *parts: Column) -> Column:
    """prefix and the first 32 hexadecimal digits of the digest of the parts joined by a bar; null parts are skipped."""
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32))


def pair_id(a: Column, b: Column) -> Column:
    low, high = unordered(a, b)
    return F.concat(F.lit("pair:"), F.sha2(F.concat(low, F.lit("|"), high), 256))


def framed_id(prefix: str, *parts: Column, digits: int = 32) -> Column:
    """A digest over length-framed parts, so that no two lists of parts share their bytes."""
    framed = [x for p in parts for x in (F.unhex(F.lpad(F.hex(F.octet_length(p)), 16, "0")), F.encode(p, "utf-8"))]
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(F.concat(*framed), 256), 1, digits))


def hash_prefix(text: Column) -> Column:
    """The first 64 bits of a text's digest as a number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def hash_bucket(text: Column, buckets: int = 10_000) -> Column:
    return (hash_prefix(text) % buckets).cast("int")


def hash_role(a: Column, b: Column, salt: str, seed: str, train: int = 7_000, development: int = 1_500) -> Column:
    """train, development or test by ten thousand hash buckets of salt, seed and pair."""
    low, high = unordered(a, b)
    at = hash_bucket(F.concat_ws("|", F.lit(salt), F.lit(seed), low, high))
    return F.when(at < train, "train").when(at < train + development, "development").otherwise("test")


def hash_score(text: Column) -> Column:
    """A number in [0, 1] in the order of the digests, from their first 52 bits."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / float(2**52 - 1)


#: Lower bounds and labels of the degree bins, in their order.
DEGREE_BINS = ((100, "100+"), (50, "50-99"), (20, "20-49"), (10, "10-19"), (5, "5-9"), (3, "3-4"), (2, "2"), (1, "1"), (0, "0"))


def degree_bin(degree: Column) -> Column:
    out = F.lit(None).cast("string")
    for low, label in reversed(DEGREE_BINS):
        out = F.when(degree >= low, label).otherwise(out)
    return out


def degree_bin_order(degree: Column) -> Column:
    """The bin's place in the order of degrees, from 0."""
    out = F.lit(None).cast("int")
    for i, (low, _) in enumerate(reversed(DEGREE_BINS)):
        out = F.when(degree >= low, i).otherwise(out)
    return out


def degree_pair_stratum(a: Column, b: Column) -> Column:
    """The bins of two degrees, the lower bin first, by the bins' order and not their text."""
    return F.concat_ws("|", degree_bin(F.least(a, b)), degree_bin(F.greatest(a, b)))


def opaque_token(package: str, cell: Column, pair: Column) -> Column:
    return F.concat(F.lit("candidate:"), F.sha2(F.concat_ws(":", F.lit(package), cell, pair), 256))


def choose_two(n: Column) -> Column:
    return (n * (n - 1) / 2).cast("long")


def seed_u64(*parts: Column) -> Column:
    """The first eight bytes of the digest over the parts, joined by colons, as an unsigned number of at most 20 digits."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16), 16, 10).cast("decimal(20,0)")
