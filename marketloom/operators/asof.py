"""Newest row at or before each wanted time, by key, without a join on a range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of(wanted: DataFrame, rows: DataFrame, keys: list[str], at: str, values: list[str], period: str = "year") -> DataFrame:
    """``wanted`` with ``as_of`` and ``values`` of the key's newest row whose ``at`` is not later; NULL where there is none.

    Both sides are put into one series a key and period, in which the last row is carried on. What a period starts
    with comes from its key's earlier periods, of which one row each is looked at; so a key that holds most rows is
    still cut by time, and no pairs are formed. Of rows at the same time the greatest ``values`` count. A wanted row
    whose key or time is null finds nothing, like one before the first row; repeated wanted rows stay apart, and their
    other columns may have any names.
    """
    own = wanted.columns
    part = F.date_trunc(period, F.col(at)).alias("_part")
    found = F.struct(F.col(at).alias("as_of"), *values)
    key = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    known = rows.dropna(subset=[*keys, at]).select(*key, part, F.col(at).alias("_at"), found.alias("_row"))
    asked = wanted.select(*key, part, F.col(at).alias("_at"), F.struct(*own).alias("_own"))
    both = known.unionByName(asked, allowMissingColumns=True)
    within = Window.partitionBy(*names, "_part").orderBy("_at", F.col("_row").isNull(), "_row").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_last", F.last("_row", ignorenulls=True).over(within)).where(F.col("_row").isNull()).drop("_row", "_at")
    periods = both.groupBy(*names, "_part").agg(F.max("_row").alias("_row"))
    earlier = Window.partitionBy(*names).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = periods.withColumn("_start", F.last("_row", ignorenulls=True).over(earlier)).where("_start is not null")
    starts = starts.select(*(F.col(n).alias(f"{n}s") for n in names), F.col("_part").alias("_parts"), "_start")
    same = [F.col(n) == F.col(f"{n}s") for n in [*names, "_part"]]
    on = same[0]
    for more in same[1:]:
        on = on & more
    last = F.coalesce("_last", "_start")
    return met.join(starts, on, "left").select(*(F.col("_own")[c].alias(c) for c in own), last["as_of"].alias("as_of"), *(last[v].alias(v) for v in values))
