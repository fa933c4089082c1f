"""Score texts and their decisions (P14, P15) and 128-bit ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what counts as an integer: white space, sign and single underscores between digits are allowed.
INTEGER = r"^\s*[+-]?\d+(_\d+)*\s*$"


def as_integer(c: Column) -> Column:
    """The text as a long, null if it is no integer; nothing is trimmed but white space."""
    return F.when(c.rlike(INTEGER), F.regexp_replace(c, r"[\s_]", "").try_cast("long"))


def score_value(c: Column) -> Column:
    """P14's parse: the first line, without commas and then semicolons at its ends, as an integer."""
    return as_integer(F.btrim(F.btrim(F.substring_index(c, "\n", 1), F.lit(",")), F.lit(";")))


def above(c: Column, threshold: int) -> Column:
    """P14 without sampling: false for texts that are no integer."""
    return F.coalesce(score_value(c) >= threshold, F.lit(False))


def uid_hi(uid: Column) -> Column:
    """The upper 64 bits of a hexadecimal id, left-padded to 32 digits, as DECIMAL(20, 0)."""
    return F.conv(F.substring(F.lpad(uid, 32, "0"), 1, 16), 16, 10).cast("decimal(20,0)")


def uid_lo(uid: Column) -> Column:
    return F.conv(F.substring(F.lpad(uid, 32, "0"), 17, 16), 16, 10).cast("decimal(20,0)")


def hash_share(key: Column, seed: int, share: Column | float) -> Column:
    """A keyed Bernoulli draw: true for about `share` of the keys, the same ones on every run."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 31)) < (F.lit(float(1 << 31)) * share)
