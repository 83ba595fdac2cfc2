"""Memories of past picks: stored pending, closed by what prices did, found again and told.

A table of memories is keyed by (date, list_type, ticker); every step gives its state after a change,
so that running it again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import sinks

KEYS = ["date", "list_type", "ticker"]
#: Calendar days before outcomes are looked up, days after which a memory without them is given up,
#: and forward bars that an outcome needs.
FIRST_LOOK, GIVEN_UP, LEAST_BARS = 7, 30, 5
OUTCOME = {"outcome_return_5d": "double", "outcome_stop_hit": "boolean", "outcome_target_hit": "boolean", "outcome_summary": "string"}


def stored(old: DataFrame | None, picks: DataFrame) -> DataFrame:
    """Memories after picks (date, list_type, ticker, prompt_version, setup, conviction, entry_low, entry_high, stop)
    were stored; a pick stored again is pending again."""
    money = lambda c: F.format_string("$%.2f", F.round(c, 2))
    new = picks.select(
        *KEYS, "prompt_version", F.concat_ws("|", "ticker", "list_type", F.concat(F.lit("setup_"), F.coalesce("setup", F.lit("")))).alias("context_summary"),
        F.nullif("setup", F.lit("")).alias("setup"), F.nullif("conviction", F.lit("")).alias("conviction"),
        F.when(F.col("entry_low").isNotNull() & F.col("entry_high").isNotNull(), F.concat(money(F.col("entry_low")), F.lit("-"), money(F.col("entry_high")))).alias("entry"),
        F.when(F.col("stop").isNotNull(), money(F.col("stop"))).alias("stop"), F.lit("pending").alias("outcome_status"), *(F.lit(None).cast(t).alias(c) for c, t in OUTCOME.items()),
    ).dropDuplicates(KEYS)
    return new if old is None else sinks.upsert(old, new, KEYS)


def status(age_days: Column, evaluated_days: Column) -> Column:
    """What a pending memory becomes: pending until the first look, then verified once there are bars enough."""
    enough = F.coalesce(evaluated_days >= LEAST_BARS, F.lit(False))
    return F.when(age_days < FIRST_LOOK, "pending").when(enough, "verified").when(age_days > GIVEN_UP, "insufficient_data").otherwise("pending")


def summary(ticker: Column, stop_hit: Column, stop: Column, target_hit: Column, return_5d: Column) -> Column:
    """An outcome in words, with the ticker in brackets."""
    parts = F.array_compact(
        F.array(
            F.when(stop_hit, F.concat(F.lit("Stop hit at "), F.when(stop.isNotNull(), F.format_string("$%.2f", F.round(stop, 2))).otherwise("unknown level"), F.lit("."))),
            F.when(target_hit, "Target 1 reached."),
            F.when(return_5d.isNotNull(), F.format_string("5D return: %+.1f%%.", return_5d * 100)),
        )
    )
    said = F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise("Outcome recorded.")
    return F.concat(said, F.lit(" ["), ticker, F.lit("]"))


def updated(memories: DataFrame, outcomes: DataFrame, today: Column) -> DataFrame:
    """Memories after ``outcomes`` (date, list_type, ticker, evaluated_days, return_5d, stop_hit, target1_hit,
    recommended_stop) were looked up on ``today``. Only pending ones change; one row a key is matched."""
    found = outcomes.select(
        *KEYS, F.struct("evaluated_days", "return_5d", "stop_hit", "target1_hit", "recommended_stop").alias("o")
    ).groupBy(*KEYS).agg(F.max("o").alias("o"))
    rows = memories.join(found, KEYS, "left")
    now = F.when(F.col("outcome_status") == "pending", status(F.datediff(today, "date"), F.col("o.evaluated_days"))).otherwise(F.col("outcome_status"))
    fresh = (F.col("outcome_status") == "pending") & (now == "verified")
    told = summary(F.col("ticker"), F.coalesce("o.stop_hit", F.lit(False)), F.col("o.recommended_stop"), F.coalesce("o.target1_hit", F.lit(False)), F.col("o.return_5d"))
    new = {"outcome_return_5d": F.col("o.return_5d"), "outcome_stop_hit": F.col("o.stop_hit"), "outcome_target_hit": F.col("o.target1_hit"), "outcome_summary": told}
    # the old status decides about all columns, so all are set at once
    return rows.withColumns({c: F.when(fresh, v).otherwise(F.col(c)) for c, v in new.items()} | {"outcome_status": now}).select(*memories.columns)


def retrievable(memories: DataFrame, today: Column, max_age_days: int) -> DataFrame:
    """Verified memories with a vector, of the last ``max_age_days``."""
    return memories.where((F.col("outcome_status") == "verified") & F.col("embedding").isNotNull() & (F.col("date") >= F.date_sub(today, max_age_days)))


def recalled(asked: DataFrame, memories: DataFrame, k: int = 3) -> DataFrame:
    """For rows asked (ask_id, list_type, exclude_ticker, vector) the ``k`` nearest memories of their list by cosine, of
    other tickers ('' excludes none), with their rank; ties go to the newer, then by ticker.

    The asked rows are those of one run (a few a list) and meet only memories of their own list.
    """
    from ..functions.columns import cosine_distance

    met = asked.join(memories.select(*KEYS, "context_summary", "setup", "conviction", *OUTCOME, "embedding"), "list_type")
    met = met.where((F.col("exclude_ticker") == "") | (F.col("ticker") != F.col("exclude_ticker"))).withColumn("distance", F.round(cosine_distance(F.col("embedding"), F.col("vector")), 6))
    w = Window.partitionBy("ask_id").orderBy("distance", F.desc("date"), "ticker")
    return met.where("distance is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("embedding", "vector")


def told(memory_rows: DataFrame, by: str = "ask_id") -> DataFrame:
    """The memories recalled for each ``by`` (with their rank) as one block of text; at most k of them are gathered."""
    flag = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"- {name}: "), F.col(c).cast("string"), F.lit("\n")))
    context = F.when(F.char_length("context_summary") > 100, F.concat(F.substring("context_summary", 1, 97), F.lit("..."))).otherwise(F.col("context_summary"))
    block = F.concat(
        F.format_string("### Memory %d: %s (%s)\n", "rank", F.date_format("date", "yyyy-MM-dd"), "ticker"), F.concat(F.lit("- List type: "), "list_type", F.lit("\n- Context: "), context, F.lit("\n")),
        *(F.coalesce(x, F.lit("")) for x in (
            flag("Setup", "setup"), flag("Conviction", "conviction"),
            F.when(F.col("outcome_return_5d").isNotNull(), F.format_string("- Return 5D: %+.1f%%\n", F.col("outcome_return_5d") * 100)), flag("Stop hit", "outcome_stop_hit"), flag("Target hit", "outcome_target_hit"),
        )), F.lit("\n"),
    )
    blocks = F.array_sort(F.collect_list(F.struct("rank", block.alias("b"))))
    return memory_rows.groupBy(by).agg(F.concat(F.lit("## Similar past evaluations\n\n"), F.array_join(F.transform(blocks, lambda x: x["b"]), "")).alias("text"))
