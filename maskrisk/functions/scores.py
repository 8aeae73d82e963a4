"""Column expressions of probabilities, counts and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entropy_bits(p: Column) -> Column:
    """Binary entropy in bits, exactly 0 at 0 and 1."""
    return F.when((p > 0) & (p < 1), -(p * F.log2(p) + (1 - p) * F.log2(1 - p))).otherwise(F.lit(0.0))


def entropy_nats(p: Column) -> Column:
    """Binary entropy in nats, exactly 0 at 0 and 1."""
    return F.when((p > 0) & (p < 1), -(p * F.ln(p) + (1 - p) * F.ln(1 - p))).otherwise(F.lit(0.0))


def entropy_nats_clipped(p: Column, eps: float = 1e-12) -> Column:
    """Binary entropy in nats of a probability kept ``eps`` away from 0 and 1."""
    c = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return -(c * F.ln(c) + (1 - c) * F.ln(1 - c))


def hash_unit(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of SHA-256 over the parts joined by ``|``."""
    digits = F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def hash_seed(*parts: Column) -> Column:
    """A 32-bit seed from the first four bytes of SHA-256 over the parts joined by ``|``."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 8), 16, 10).cast("long")


def mix32(x: Column) -> Column:
    """A 32-bit finaliser (two multiplications, three shifts) of a long below 2**32; products stay within a long."""

    def times(v, c: int):
        return (F.shiftleft((v * (c >> 16)).bitwiseAND(0xFFFF), 16) + v * (c & 0xFFFF)).bitwiseAND(0xFFFFFFFF)

    def folded(v, bits: int):
        return v.bitwiseXOR(F.shiftright(v, bits))

    # Each step reads its input twice, so steps are bound by ``transform`` rather than written out as one expression.
    step = lambda v, f: F.transform(F.array(v), f)[0]
    x = step(x.cast("long"), lambda v: folded(v, 16))
    x = step(step(x, lambda v: times(v, 0x85EBCA6B)), lambda v: folded(v, 13))
    return step(step(x, lambda v: times(v, 0xC2B2AE35)), lambda v: folded(v, 16))


def dice_loss(overlap: Column, left: Column, right: Column) -> Column:
    """1 - 2 |A and B| / (|A| + |B|): 0 where both are empty, 1 where one is."""
    return F.when(left + right == 0, F.lit(0.0)).otherwise(1 - 2 * overlap / (left + right))


def soft_dice(inside: Column, total: Column, size: Column, empty: float = 0.0) -> Column:
    """2 (sum of p inside the action) / (sum of p + action size); ``empty`` where the denominator is 0."""
    return F.when(total + size == 0, F.lit(empty)).otherwise(2 * inside / (total + size))


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def sum_if(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value).otherwise(F.lit(0.0)))


def rounded(value: Column, digits: int = 9) -> Column:
    """A double for comparison across engines: rounded, exact halves upwards, and never a negative zero."""
    return F.round(value + F.lit(1e-13), digits) + F.lit(0.0)
