"""Hash splits and keys."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha_mod(key: Column, modulus: int) -> Column:
    """int(sha256(key), 16) % modulus, summed over eight parts of eight hex digits, each times its power of 2 (mod modulus)."""
    if not 0 < modulus < 1 << 28:
        raise ValueError("the modulus must be positive and below 2**28")
    digest = F.sha2(key, 256)
    part = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") % modulus
    return reduce(add, (part(i) * pow(2, 32 * (7 - i), modulus) for i in range(8))) % modulus


def split_of(session: Column) -> Column:
    """A tenth of the sessions is the test split."""
    return F.when(sha_mod(session, 10) == 0, "test").otherwise("train")


def held_out(key: Column, share: float) -> Column:
    return sha_mod(key, 10_000) < share * 10_000


def dedup_key(*parts: Column) -> Column:
    """sha256 of the parts with a NUL between; nulls are empty. The definition is our own."""
    return F.sha2(F.concat_ws("\u0000", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def round_id(session: Column, event: Column, tool: Column, index: Column) -> Column:
    text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.substring(F.sha2(F.concat_ws(":", text(session), text(event), text(tool), text(index)), 256), 1, 16)
