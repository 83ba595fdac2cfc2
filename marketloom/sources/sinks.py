"""Keyed writes over DataFrames: the state after a change, to be written back."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], arrival: str | None = None) -> DataFrame:
    """New rows replace old ones with their key; of several new rows the latest arrival counts."""
    if arrival:
        w = Window.partitionBy(*keys).orderBy(F.col(arrival).desc())
        new = new.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return old.join(new.select(*keys), list(keys), "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def insert_if_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti").select(*old.columns))


def precedence_upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], guarded: Sequence[str], keep_old: Column, late: Sequence[str] = ()) -> DataFrame:
    """Like upsert, but ``guarded`` columns stay where ``keep_old`` holds (columns o_*, n_*),
    and ``late`` columns keep the old value where the new one is NULL."""
    values = [c for c in old.columns if c not in keys]
    o = old.select(*keys, *(F.col(c).alias(f"o_{c}") for c in values), F.lit(True).alias("o__"))
    n = new.select(*keys, *(F.col(c).alias(f"n_{c}") for c in values), F.lit(True).alias("n__"))

    def pick(c: str) -> Column:
        fresh = F.coalesce(f"n_{c}", f"o_{c}") if c in late else F.when(F.col("n__").isNotNull(), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}"))
        return F.when(keep_old & F.col("o__").isNotNull(), F.col(f"o_{c}")).otherwise(fresh) if c in guarded else fresh

    return o.join(n, list(keys), "full_outer").select(*keys, *(pick(c).alias(c) for c in values))


def update_from(old: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str], only_missing: bool = False) -> DataFrame:
    """Sets ``columns`` from matching rows; with ``only_missing`` only where they are NULL."""
    fresh = changes.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    pick = (lambda c: F.coalesce(c, f"_{c}")) if only_missing else (lambda c: F.coalesce(f"_{c}", c))
    return old.join(fresh, list(keys), "left").select(*(pick(c).alias(c) if c in columns else F.col(c) for c in old.columns))


def delete_keys(old: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.join(gone.select(*keys), list(keys), "left_anti")


def activate(versions: DataFrame, version: int | None) -> DataFrame:
    """Exactly one version active, or none."""
    return versions.withColumn("active", F.lit(False) if version is None else F.col("version") == version)


def next_dates(latest: DataFrame, wanted: DataFrame, today: Column, fallback_days: int) -> DataFrame:
    """Where each ticker's ingestion goes on: the day after its last bar, or a fallback; up to date if after today."""
    start = F.coalesce(F.date_add("latest", 1), F.date_sub(today, fallback_days))
    rows = wanted.select("ticker").join(latest, "ticker", "left").select("ticker", start.alias("from_date"))
    return rows.withColumn("up_to_date", F.col("from_date") > today)


def write_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Replaces only the partitions that ``df`` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, folder: str, name: str, date: str) -> None:
    df.write.mode("overwrite").csv(f"{folder}/{name}/{date}", header=True)


def append_json(df: DataFrame, folder: str) -> None:
    df.write.mode("append").json(folder)


def _there(spark: SparkSession, path: str) -> bool:
    """Whether a mark was set at ``path``."""
    try:
        return spark.read.schema("id long").parquet(path).count() > 0
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def _mark(spark: SparkSession, path: str) -> None:
    spark.range(1).coalesce(1).write.mode("overwrite").parquet(path)


def finite(df: DataFrame, zero: Sequence[str] = ()) -> DataFrame:
    """NaN and infinite doubles become NULL, or 0 in the columns ``zero``."""
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    bad = lambda c: F.isnan(c) | F.col(c).isin(float("inf"), float("-inf"))
    return df.withColumns({c: F.when(bad(c), F.lit(0.0 if c in zero else None)).otherwise(F.col(c)) for c in doubles}) if doubles else df


def staged_merge(new: DataFrame, folder: str, keys: Sequence[str], by: str, batch: int | str, arrival: str | None = None) -> bool:
    """Merges a batch by key into the table ``folder``/table, which is partitioned by ``by``; whether there was anything to do.

    The rows are staged and checked, merged with those of the partitions that they touch, and only these are
    swapped. Each step's result is written beside the table under the batch's name: a batch that was applied is not
    applied again, even after later ones, and one that was cut off, in the swap too, goes on where it was. One batch is
    merged at a time. ``by`` must be one of ``keys``, so that a key stays in its partition; of rows with
    one key the one with the largest ``arrival`` counts. Without ``arrival`` keys must not repeat. Raises ValueError for null or repeated keys.
    """
    if by not in keys:
        raise ValueError("the table must be partitioned by one of its keys")
    spark, at, table = new.sparkSession, f"{folder}/batches/{batch}", f"{folder}/table"
    if _there(spark, f"{at}/applied"):
        return False
    columns = [*(c for c in new.columns if c != by), by]
    schema = new.select(*columns).schema
    if not _there(spark, f"{at}/ready"):
        new.select(*columns).write.mode("overwrite").partitionBy(by).parquet(f"{at}/stage")
        staged = spark.read.schema(schema).parquet(f"{at}/stage")
        told = staged.agg(F.count_if(reduce(or_, (F.col(k).isNull() for k in keys))).alias("nulls")).first()
        if told["nulls"]:
            raise ValueError(f"{told['nulls']} rows of batch {batch} have a null key")
        if arrival is None and staged.groupBy(*keys).count().where("count > 1").limit(1).count():
            raise ValueError(f"batch {batch} repeats a key and names no arrival")
        merged = upsert(_live(staged, table, by, schema), staged, keys, arrival)
        merged.hint("rebalance", by).write.mode("overwrite").partitionBy(by).parquet(f"{at}/merged")
        _mark(spark, f"{at}/ready")
    # dealt well already
    write_partitions(spark.read.schema(schema).parquet(f"{at}/merged"), table, by)
    _mark(spark, f"{at}/applied")
    return True


def _live(staged: DataFrame, table: str, by: str, schema: StructType) -> DataFrame:
    """The table's rows in the partitions that ``staged`` touches; none before the first batch."""
    spark = staged.sparkSession
    # no more values than the table will have partitions
    touched = [r[by] for r in staged.select(by).distinct().collect()]
    try:
        return spark.read.schema(schema).parquet(table).where(F.col(by).isin(touched))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def merged_table(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """The table that ``staged_merge`` keeps in ``folder``."""
    return spark.read.schema(schema).parquet(f"{folder}/table")
