"""Exclusive effects: holders, tenures and orphans. A new effect is a row of the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabletide.operators.actions import STARTS, game_epochs, last_epoch, so_far
from tabletide.schemas import EFFECTS

CHANGES = ("set_effect", "clear_effect")


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EFFECTS, "effect_type string, outline_argb long")


def current_effects(log: DataFrame, effects: DataFrame) -> DataFrame:
    """game_id, position, effect_type, player_id, outline_argb: holders in the last epoch, in the order in which they were
    last set (position from 1). The last set or clear of a type wins."""
    rows = last_epoch(log).where(F.col("action").isin(*CHANGES))
    last = rows.groupBy("game_id", "effect_type").agg(F.max_by(F.struct("action", "player_id", "seq"), "seq").alias("x"))
    held = last.where(F.col("x.action") == "set_effect").select("game_id", "effect_type", F.col("x.player_id").alias("player_id"), F.col("x.seq").alias("seq"))
    place = F.row_number().over(Window.partitionBy("game_id").orderBy("seq"))
    return held.join(F.broadcast(effects), "effect_type", "left").select("game_id", place.alias("position"), "effect_type", "player_id", "outline_argb")


def outline_color(current: DataFrame) -> DataFrame:
    """game_id, player_id, outline_argb: the first outline in a player's effects, if any."""
    return current.where(F.col("outline_argb").isNotNull()).groupBy("game_id", "player_id").agg(F.min_by("outline_argb", "position").alias("outline_argb"))


def effect_tenures(log: DataFrame, effects: DataFrame) -> DataFrame:
    """game_id, effect_type, player_id, from_seq, to_seq: from a set to the next set or clear of its type, new game or
    reset; to_seq is null if none follows."""
    own = log.where(F.col("action").isin(*CHANGES)).select("game_id", "seq", "action", "effect_type", "player_id")
    ends = log.where(F.col("action").isin(*STARTS)).crossJoin(F.broadcast(effects.select(F.col("effect_type").alias("type"))))  # one row an effect
    ends = ends.select("game_id", "seq", "action", F.col("type").alias("effect_type"), F.lit(None).cast("string").alias("player_id"))
    after = F.lead("seq").over(Window.partitionBy("game_id", "effect_type").orderBy("seq"))
    rows = own.unionByName(ends).withColumn("to_seq", after)
    return rows.where(F.col("action") == "set_effect").select("game_id", "effect_type", "player_id", F.col("seq").alias("from_seq"), "to_seq")


def effects_at_event(log: DataFrame, types: list[str] | None = None) -> DataFrame:
    """game_id, seq, player_id, effects: which effects the affected player held at each life and damage action."""
    types = types or [t for t, _ in EFFECTS]
    rows = game_epochs(log)
    for t in types:
        own = F.col("effect_type") == t
        change = F.when(own & (F.col("action") == "set_effect"), F.col("player_id")).when(own & (F.col("action") == "clear_effect"), "")
        rows = rows.withColumn(f"of_{t}", F.last(change, ignorenulls=True).over(so_far("game_id", "epoch")))
    held = F.array_compact(F.array(*[F.when(F.col(f"of_{t}") == F.col("player_id"), F.lit(t)) for t in types]))
    return rows.where(F.col("action").isin("life", "cmd_damage")).select("game_id", "seq", "player_id", F.array_join(held, ",").alias("effects"))


def orphan_effects(current: DataFrame, roster: DataFrame) -> DataFrame:
    """Effects whose holder the game no longer has."""
    return current.join(roster.select("game_id", "player_id"), ["game_id", "player_id"], "left_anti").select(*current.columns)
