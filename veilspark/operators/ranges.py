"""Running values over a whole ordered table without bringing it into one task.

Rows are dealt by ranges of their order into a fixed number of parts. Values
run within each part; what the parts before add is known from one row a part.

The ranges follow from the rows alone (those of least hash are the sample), so
every use of them, in any branch of a plan and any attempt of a task, agrees.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the sample for each part.
SAMPLE = 20


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """Adds ``_part``: the number of the range of ``order`` that a row lies in; missing values come first.

    There are as many parts as shuffle partitions, two at least. Equal rows share a part. The order must be the same
    whenever it is computed.
    """
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    width = math.isqrt(parts) + 1
    sample = df.select(F.struct(*order).alias("k")).orderBy(F.xxhash64("k"), "k").limit(SAMPLE * parts).agg(F.sort_array(F.collect_list("k")).alias("s"))
    ends = F.transform(F.sequence(F.lit(1), F.lit(parts - 1)), lambda i: F.get("s", F.floor(i * F.size("s") / parts).cast("int")))
    # in groups, so that a row is compared with the first of each and then with one group
    groups = F.transform(F.sequence(F.lit(0), F.lit((parts - 2) // width)), lambda j: F.slice("e", j * width + 1, F.lit(width)))
    bounds = sample.select(ends.alias("e")).select(groups.alias("g")).scalar()
    key = F.struct(*order)
    out = df.withColumn("_bounds", bounds).withColumn("_group", F.size(F.filter("_bounds", lambda g: F.get(g, F.lit(0)) <= key)))
    within = F.size(F.filter(F.get("_bounds", F.col("_group") - 1), lambda b: b <= key))
    return out.withColumn("_part", F.when(F.col("_group") > 0, (F.col("_group") - 1) * width + within).otherwise(0)).drop("_bounds", "_group")


def carried(df: DataFrame, each: Column, over, by: tuple[str, ...] = ()) -> DataFrame:
    """Joins ``_carried`` to ranged rows: ``over`` (a function of a column) of the parts before, each of which gives the value ``each``.

    There are as many rows to carry as parts (for each value of ``by``).
    """
    keys = [*by, "_part"]
    before = Window.partitionBy(*by, *([] if by else [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = df.groupBy(*keys).agg(each.alias("_each")).withColumn("_carried", over("_each").over(before)).drop("_each")
    ends = ends.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], "_carried")
    same = [df[k].eqNullSafe(ends[f"_{i}"]) for i, k in enumerate(keys)]
    return df.join(ends, same, "left").drop(*[f"_{i}" for i in range(len(keys))])
