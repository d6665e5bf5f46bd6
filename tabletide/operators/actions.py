"""Validity, epochs and phases of the action log. A game's rows are always ordered by seq."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

STARTS = ("new_game", "reset")
INPUTS = ("life", "cmd_damage")


def so_far(*keys: str) -> WindowSpec:
    """All rows of the keys up to this one."""
    return Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def game_epochs(log: DataFrame) -> DataFrame:
    """log with epoch: how many new games and resets the game has had, this row included."""
    return log.withColumn("epoch", F.sum(F.when(F.col("action").isin(*STARTS), 1).otherwise(0)).over(so_far("game_id")))


def last_epoch(log: DataFrame) -> DataFrame:
    """Rows of each game's last epoch, with epoch. The same partitioning serves both windows."""
    of_game = F.max("epoch").over(Window.partitionBy("game_id"))
    return game_epochs(log).withColumn("last", of_game).where(F.col("epoch") == F.col("last")).drop("last")


def valid_actions(log: DataFrame, roster: DataFrame) -> DataFrame:
    """log without life actions on, and damage to, players whom the game doesn't have. An unknown attacker is accepted."""
    needs = F.col("action").isin(*INPUTS)
    known = roster.select("game_id", "player_id")
    return log.where(~needs).unionByName(log.where(needs).join(known, ["game_id", "player_id"], "left_semi"))


def valid_roster_changes(changes: DataFrame) -> DataFrame:
    """changes (action, n_players before it) without an add at six players and a remove at one."""
    return changes.where(~((F.col("action") == "add_player") & (F.col("n_players") >= 6)) & ~((F.col("action") == "remove_player") & (F.col("n_players") <= 1)))


def flag(on: Column, off: Column) -> Column:
    return F.coalesce(F.last(F.when(on, True).when(off, False), ignorenulls=True).over(so_far("game_id")), F.lit(False))


def table_phase(log: DataFrame, games: DataFrame) -> DataFrame:
    """log with phase and absorbing after each action. The first that holds: pick, gamba_ok, choosing_starter, random_ok,
    idle. A new game resets both roulettes but not an open pick. games: (game_id, n_players)."""
    is_ = lambda *names: F.col("action").isin(*names)
    several = F.coalesce(F.col("n_players"), F.lit(1)) > 1
    known = log.join(games.select("game_id", "n_players"), "game_id", "left")
    flags = known.withColumns({
        "picking": flag(is_("pick_open"), is_("pick_close")),
        "gamba_ok": flag(is_("gamba_done"), is_("gamba_confirm", "new_game")),
        "choosing": flag(is_("new_game") & several, is_("new_game", "gamba_done", "gamba_skip")),
        "spinning": flag(is_("random_start"), is_("random_done", "new_game")),
        "random_ok": flag(is_("random_done"), is_("random_confirm", "new_game")),
    })
    phase = F.when(F.col("picking"), "pick").when(F.col("gamba_ok"), "gamba_ok").when(F.col("choosing"), "choosing_starter").when(F.col("random_ok"), "random_ok").otherwise("idle")
    absorbing = F.col("picking") | F.col("gamba_ok") | F.col("choosing") | F.col("spinning")
    return flags.select(*log.columns, phase.alias("phase"), absorbing.alias("absorbing"))


def drop_absorbed_inputs(log: DataFrame, games: DataFrame) -> DataFrame:
    """log without life and damage actions that were made while the table absorbs input."""
    return table_phase(log, games).where(~(F.col("action").isin(*INPUTS) & F.col("absorbing"))).select(*log.columns)
