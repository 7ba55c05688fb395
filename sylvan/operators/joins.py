"""A join for keys that may be hot on the left side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.operators.once import computed_once

LEAST_SALTS = 8


def salts(left: DataFrame) -> int:
    """Sub-keys per key: an eighth of the shuffle partitions, so that a key with
    a third of all rows is no larger than a few partitions."""
    return max(LEAST_SALTS, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)


def join_hot(
    left: DataFrame, right: DataFrame, on: list[str], how: str, spread: str
) -> DataFrame:
    """Join where one key may hold a large share of ``left``.

    Rows of ``left`` are spread over sub-keys by the column
    ``spread``; ``right``, which has few rows per key, is repeated once per
    sub-key. No hint is given: Spark broadcasts ``right`` when its measured
    size allows it and shuffles by the salted key otherwise. It is repeated by a
    join, as Spark counts the repeats of that one; for an exploded list it
    takes the size of the rows before, and broadcasts many times its limit.
    ``left`` may be an exploded list as well: an inner join is made as an outer
    one, which cannot broadcast that side.
    """
    n = salts(left)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(n)).cast("int"))
    # always 0 on both sides, which the optimizer does not see
    sub_keys = left.sparkSession.range(0, n, 1, 1).select(
        F.col("id").cast("int").alias("_salt"), F.pmod("id", F.lit(1)).alias("_all")
    )
    every = right.withColumn("_all", F.pmod(F.xxhash64(*on), F.lit(1)))
    repeated = every.join(sub_keys, "_all").drop("_all")
    if how != "inner":
        return salted.join(repeated, [*on, "_salt"], how).drop("_salt")
    met = salted.join(repeated.withColumn("_met", F.lit(True)), [*on, "_salt"], "left").drop("_salt")
    # without the boundary, this filter or one of the caller makes it an inner join again
    return computed_once(met).filter("_met").drop("_met")
