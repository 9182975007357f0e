"""Join helpers for skewed keys.

``salted_left_join`` spreads every key of the large side over ``salt``
sub-keys (a hash of the row's own id, the same when a task is run again) and replicates the small side ``salt`` times, so
a key that holds a third of all rows is processed by ``salt`` tasks instead
of one.  Used where the small side is too large to broadcast; when it is
broadcastable no shuffle of the large side happens at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType


def salted_left_join(big: DataFrame, small: DataFrame, big_key: Column, small_key: str,
                     salt: int = 32, row_id: str = "ID") -> DataFrame:
    """``big LEFT JOIN small ON big_key = small[small_key]`` with the key salted ``salt`` ways.

    Rows are told apart by ``row_id``; without such a column, by their atomic columns."""
    own = [row_id] if row_id in big.columns else [f.name for f in big.schema.fields if isinstance(f.dataType, AtomicType)]
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in own])
    b = big.withColumn("_salt", F.pmod(row_hash, F.lit(salt)).cast("int")).withColumn("_bkey", big_key)
    s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    out = b.join(s, (F.col("_bkey") == s[small_key]) & (b["_salt"] == s["_salt"]), "left")
    return out.drop(b["_salt"]).drop(s["_salt"]).drop("_bkey")
