"""Bit fingerprints in longs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def gradient_bits(values: Column, bits: int) -> Column:
    """Bit i is set iff values[i] > values[i + 1], i < bits <= 63."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.when(F.get(values, i) > F.get(values, i + 1), F.expr("1L")).otherwise(F.expr("0L")))
    # shiftleft takes a fixed distance, so the bits are folded from the last
    return F.aggregate(F.reverse(steps), F.expr("0L"), lambda out, bit: F.shiftleft(out, 1).bitwiseOR(bit))
