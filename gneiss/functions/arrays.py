"""Expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def running(lengths: Column) -> Column:
    """What comes before each element: the sums of all earlier ones.  Blocks are summed first, so an array of n elements costs n."""
    zero = F.array(F.lit(0))
    last = lambda acc: F.element_at(acc, -1)
    upto = lambda xs, start: F.aggregate(xs, F.array(start), lambda acc, x: F.concat(acc, F.array(last(acc) + x)))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda acc, x: acc + x)
    with_starts = F.transform(F.array(blocks), lambda bs: F.struct(bs.alias("bs"), upto(F.transform(bs, total), F.lit(0)).alias("starts")))[0]
    out = F.transform(F.array(with_starts), lambda s: F.flatten(F.transform(s.bs, lambda xs, b: F.slice(upto(xs, F.get(s.starts, b)), F.lit(1), F.size(xs)))))[0]
    return F.when(F.size(lengths) > 0, out).otherwise(F.slice(zero, 1, 0))
