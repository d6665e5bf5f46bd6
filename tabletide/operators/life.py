"""Life totals and timelines, pending changes, and gestures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabletide.functions import hold_threshold_ms
from tabletide.operators.actions import drop_absorbed_inputs, game_epochs, last_epoch, so_far
from tabletide.operators.damage import with_applied


def effective() -> Column:
    """By how much an action changes a player's life."""
    return F.when(F.col("action") == "life", F.col("delta")).when(F.col("action") == "cmd_damage", -F.col("applied"))


def starting_life(games: DataFrame) -> Column:
    """Of a row: the last new game's starting life, else the game's."""
    return F.coalesce(F.last("starting_life", ignorenulls=True).over(so_far("game_id")), F.col("game_life"))


def life_totals(log: DataFrame, games: DataFrame, roster: DataFrame, apply_absorption: bool = False) -> DataFrame:
    """game_id, player_id, life: each rostered player's life in the last epoch. The log is shuffled once, by game."""
    log = drop_absorbed_inputs(log, games) if apply_absorption else log
    rows = log.withColumn("start", F.last("starting_life", ignorenulls=True).over(so_far("game_id")))
    rows = with_applied(last_epoch(rows))
    changes = rows.where(F.col("player_id").isNotNull()).groupBy("game_id", "player_id").agg(F.sum(effective()).alias("change"))
    starts = rows.groupBy("game_id").agg(F.max_by("start", "seq").alias("start"))
    own = roster.select("game_id", "player_id").join(games.select("game_id", "starting_life"), "game_id")
    joined = own.join(changes, ["game_id", "player_id"], "left").join(starts, "game_id", "left")
    return joined.select("game_id", "player_id", (F.coalesce("start", "starting_life") + F.coalesce("change", F.lit(0))).cast("long").alias("life"))


def life_sums(changes: DataFrame, start: int = 40) -> DataFrame:
    """game_id, player_id, life of a log of plain deltas in which order doesn't matter: one partial aggregation, no sort."""
    return changes.groupBy("game_id", "player_id").agg((F.lit(start) + F.sum("delta")).cast("long").alias("life"))


def life_timeline(log: DataFrame, games: DataFrame) -> DataFrame:
    """game_id, epoch, seq, player_id, life: a player's life after each of their life and damage actions."""
    rows = game_epochs(log).join(games.select("game_id", F.col("starting_life").alias("game_life")), "game_id")
    rows = with_applied(rows.withColumn("start", starting_life(games))).where(F.col("action").isin("life", "cmd_damage"))
    total = F.sum(effective()).over(so_far("game_id", "epoch", "player_id"))
    return rows.select("game_id", "epoch", "seq", "player_id", (F.col("start") + total).cast("long").alias("life"))


def pending_delta(log: DataFrame, gap: str = "5 seconds") -> DataFrame:
    """game_id, epoch, player_id, source_id, seq, session, pending: the change since the last pause longer than gap. Direct
    life actions are a series of a player (source_id null), applied damage one of each attacker. A pause of exactly gap
    goes on; a new epoch begins anew."""
    rows = with_applied(game_epochs(log))
    change = F.when(F.col("action") == "life", F.col("delta")).when(F.col("action") == "cmd_damage", F.col("applied"))
    moved = rows.withColumn("change", change).where(F.col("change").isNotNull() & ((F.col("action") == "life") | (F.col("change") != 0)))
    keys = ("game_id", "epoch", "player_id", "source_id")
    before = F.lag("ts").over(Window.partitionBy(*keys).orderBy("seq"))
    broken = moved.withColumn("new", (before.isNull() | (F.col("ts") > before + F.expr(f"INTERVAL {gap}"))).cast("int"))
    session = broken.withColumn("session", F.sum("new").over(so_far(*keys)))
    return session.select(*keys, "seq", "session", F.sum("change").over(so_far(*keys, "session")).cast("long").alias("pending"))


def pending_sessions(log: DataFrame, gap: str = "5 seconds") -> DataFrame:
    """The closed form of direct life actions, without running values: game_id, epoch, player_id, start, pending, n."""
    rows = game_epochs(log).where(F.col("action") == "life")
    grouped = rows.groupBy("game_id", "epoch", "player_id", F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.sum("delta").alias("pending"), F.count("*").alias("n")).select("game_id", "epoch", "player_id", F.col("w.start").alias("start"), "pending", "n")


def gesture_to_deltas(gestures: DataFrame, threshold: Column | None = None, repeat_ms: int = 500) -> DataFrame:
    """game_id, seq, i, player_id, ts, delta: the life actions of presses. Shorter than the threshold: one step if not
    cancelled. Else ten at the threshold and again every repeat_ms, cancelled or not."""
    limit = hold_threshold_ms(F.col("sensitivity")) if threshold is None else threshold
    held = F.col("held_ms") >= F.col("limit")
    n = F.when(held, 1 + F.floor((F.col("held_ms") - F.col("limit")) / repeat_ms)).otherwise(F.when(F.col("cancelled"), 0).otherwise(1)).cast("int")
    rows = gestures.withColumn("limit", limit).withColumn("n", n).where("n > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    ms = F.when(held, F.col("limit") + F.col("i") * repeat_ms).otherwise(F.col("held_ms"))
    moment = F.timestamp_micros(F.unix_micros("ts") + ms.cast("long") * 1000)
    return rows.select("game_id", "seq", "i", "player_id", moment.alias("ts"), (F.col("side") * F.when(held, 10).otherwise(1)).cast("long").alias("delta"))
