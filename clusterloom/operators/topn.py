"""Top-n per group that never sorts a whole hot group in one task.

Stage 1 ranks inside (group, salt) where salt = hash(tie-break columns) mod S,
so a group holding a third of all rows is spread over S tasks; stage 2 ranks
the at most n * S survivors per group. The result equals a plain
``row_number() over (partition by group order by ...) <= n`` because every
global top-n row is in the top-n of its own salt bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SALT_BUCKETS = 256


def top_n_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int,
                    salt_cols: list[str], rank_col: str = "rank",
                    salt_buckets: int = DEFAULT_SALT_BUCKETS) -> DataFrame:
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in salt_cols]), F.lit(salt_buckets)))
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*order)
    stage1 = salted.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= n).drop("_r1", "_salt")
    w2 = Window.partitionBy(*keys).orderBy(*order)
    return stage1.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= n)
