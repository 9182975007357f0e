"""Running sums inside groups of any size, in windows of bounded size.

A plain window over a hot key sorts all of its rows in one task.  Here rows
carry a leaf number: a leaf of some thousand rows is one window, leaves are
summed and run over in parents of at most 4,096 children, parents likewise, and
so on; every row gets its leaf's start by a join on (key, leaf).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAF = 4096  # rows a leaf should hold
DIGIT = 12   # bits of a level: a parent has 2**12 children


def leaf_bits(rows: int, leaf: int = LEAF) -> int:
    """Bits that number the leaves of so many rows."""
    return math.ceil(math.log2(max(rows / leaf, 1)))


def leaf_of(digest: str, bits: int):
    """The first ``bits`` bits of a hex digest column as a leaf number; leaves then follow the digest's order."""
    return F.shiftright(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), 60 - bits)


def prefix_sums(rows: DataFrame, by: Sequence[str], at: str, order: Sequence, values: Sequence[str], bits: int,
                digit: int = DIGIT) -> DataFrame:
    """Add ``before_<value>`` for every value: its sum over the rows of the same ``by`` that come first.

    Rows come in the order of ``at`` (a leaf number of ``bits`` bits), then
    ``order``, which has to tell the rows of a group apart.  ``by`` may not be null.
    """
    by = list(by)

    def earlier(partition, along):
        return Window.partitionBy(*partition).orderBy(*along).rowsBetween(Window.unboundedPreceding, -1)

    def sums(w):
        return {f"before_{v}": F.coalesce(F.sum(v).over(w), F.lit(0)) for v in values}

    inside = rows.withColumns(sums(earlier([*by, at], order)))
    if bits == 0:
        return inside

    def starts(table, left):
        if left <= digit:
            return table.withColumns(sums(earlier(by, [at]))).select(*by, at, *[F.col(f"before_{v}").alias(f"start_{v}") for v in values])
        kids = table.withColumn("_up", F.shiftright(at, digit))
        parents = kids.groupBy(*by, F.col("_up").alias(at)).agg(*[F.sum(v).alias(v) for v in values])
        first = starts(parents, left - digit).withColumnsRenamed({at: "_up", **{f"start_{v}": f"_first_{v}" for v in values}})
        return (kids.withColumns(sums(earlier([*by, "_up"], [at]))).join(first, [*by, "_up"])
                .select(*by, at, *[(F.col(f"_first_{v}") + F.col(f"before_{v}")).alias(f"start_{v}") for v in values]))

    leaves = starts(rows.groupBy(*by, at).agg(*[F.sum(v).alias(v) for v in values]), bits)
    return (inside.join(leaves, [*by, at])
            .withColumns({f"before_{v}": F.col(f"before_{v}") + F.col(f"start_{v}") for v in values})
            .drop(*[f"start_{v}" for v in values]))
