"""Coin and die rolls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabletide.schemas import DICE, HISTORY


def valid_rolls(rolls: DataFrame) -> DataFrame:
    """Flips with a side, and rolls of a known die with a result of 1 to its sides."""
    die = (F.col("kind") == "die") & F.col("die").isin(*DICE) & F.col("result").between(1, F.col("die"))
    return rolls.where((F.col("kind") == "coin") & F.col("heads").isNotNull() | die)


def label() -> Column:
    die = F.concat(F.lit("d"), F.col("die").cast("string"), F.lit(": "), F.col("result").cast("string"))
    return F.when(F.col("kind") == "die", die).otherwise(F.when(F.col("heads"), "H").otherwise("T"))


def roll_summary(rolls: DataFrame) -> DataFrame:
    """dialog_id, kind, n, last (its label), natural_max (of the last roll), heads, tails."""
    rows = valid_rolls(rolls).withColumns({"label": label(), "top": F.col("result") == F.col("die")})
    return rows.groupBy("dialog_id", "kind").agg(
        F.count("*").alias("n"), F.max_by("label", "seq").alias("last"), F.coalesce(F.max_by("top", "seq"), F.lit(False)).alias("natural_max"),
        F.count_if(F.col("heads")).alias("heads"), F.count_if(~F.col("heads")).alias("tails"),
    )


def roll_history(rolls: DataFrame, k: int = HISTORY) -> DataFrame:
    """dialog_id, kind, position (1 is newest), text: the newest k valid rolls of each dialog and kind."""
    place = F.row_number().over(Window.partitionBy("dialog_id", "kind").orderBy(F.desc("seq")))
    return valid_rolls(rolls).withColumn("position", place).where(F.col("position") <= k).select("dialog_id", "kind", "position", label().alias("text"))
