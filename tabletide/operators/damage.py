"""Commander damage: floored timelines, matrices, and the damage maps of a wide roster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabletide.functions import palette
from tabletide.operators.actions import game_epochs, last_epoch, so_far
from tabletide.schemas import MOST_PLAYERS

CELL = ("game_id", "epoch", "player_id", "source_id")


def with_applied(log: DataFrame) -> DataFrame:
    """log (with epoch) with damage (the cell's value after the action) and applied (by how much it changed) on damage
    actions, null on others. A sum that never falls below zero has a closed form: S - min(0, least S so far)."""
    is_damage = F.col("action") == "cmd_damage"
    total = log.withColumn("total", F.when(is_damage, F.sum(F.when(is_damage, F.col("delta"))).over(so_far(*CELL))))
    least = F.least(F.lit(0), F.min("total").over(so_far(*CELL)))
    value = total.withColumn("damage", F.when(is_damage, F.col("total") - least))
    earlier = Window.partitionBy(*CELL).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("damage", ignorenulls=True).over(earlier)  # damage without a known attacker shares its cell with other actions
    return value.withColumn("applied", F.when(is_damage, F.col("damage") - F.coalesce(before, F.lit(0)))).drop("total")


def commander_damage_timeline(log: DataFrame) -> DataFrame:
    """game_id, epoch, seq, player_id (defender), source_id, delta, applied, damage of damage actions; applied may be 0.
    The damage of all attackers is kept apart, and life falls by what is applied."""
    rows = with_applied(game_epochs(log)).where(F.col("action") == "cmd_damage")
    return rows.select("game_id", "epoch", "seq", "player_id", "source_id", "delta", "applied", "damage")


def commander_damage_matrix(log: DataFrame, roster: DataFrame, floored: bool = True) -> DataFrame:
    """game_id, player_id, source_id, damage: for every player and opponent, in the last epoch; 0 where there is none."""
    rows = last_epoch(log)
    if floored:
        cells = with_applied(rows).where(F.col("action") == "cmd_damage").groupBy("game_id", "player_id", "source_id").agg(F.max_by("damage", "seq").alias("damage"))
    else:
        cells = rows.where(F.col("action") == "cmd_damage").groupBy("game_id", "player_id", "source_id").agg(F.sum("delta").alias("damage"))
    a, b = roster.select("game_id", "player_id"), roster.select("game_id", F.col("player_id").alias("source_id"))
    pairs = a.join(b, "game_id").where(F.col("player_id") != F.col("source_id"))  # at most 30 a game
    return pairs.join(cells, ["game_id", "player_id", "source_id"], "left").select("game_id", "player_id", "source_id", F.coalesce("damage", F.lit(0)).cast("long").alias("damage"))


def damage_maps(matrix: DataFrame) -> DataFrame:
    """The matrix with one map a defender."""
    return matrix.groupBy("game_id", "player_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source_id", "damage")))).alias("commander_damage"))


def damaged_by(matrix: DataFrame, roster: DataFrame) -> DataFrame:
    """game_id, player_id, attackers: opponents who have damaged a player, in the order of the player list."""
    slots = roster.select("game_id", F.col("player_id").alias("source_id"), "slot")
    hit = matrix.where("damage > 0").join(slots, ["game_id", "source_id"])
    ordered = F.array_sort(F.collect_list(F.struct("slot", "source_id")))
    return hit.groupBy("game_id", "player_id").agg(F.transform(ordered, lambda x: x["source_id"]).alias("attackers"))


def damage_map_add(wide: DataFrame, games: DataFrame, new_id: Column) -> DataFrame:
    """wide (game_id, slot, player_id, color_argb, seat, life, commander_damage) with one more player in each game of
    fewer than six: starting life, no damage from anyone, the palette's colour at the count; everyone else's map gets the
    new player with 0. new_id is a column of games (game_id, starting_life)."""
    size = F.count("*").over(Window.partitionBy("game_id"))
    own = wide.join(games.select("game_id", "starting_life", new_id.alias("new_id")), "game_id").withColumn("size", size)
    room = F.col("size") < MOST_PLAYERS
    grown = F.when(room, F.map_concat("commander_damage", F.create_map("new_id", F.lit(0).cast("long")))).otherwise(F.col("commander_damage"))
    old = own.withColumn("commander_damage", grown).select(*wide.columns)
    zeros = F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("slot", "player_id"))), lambda x: F.struct(x["player_id"], F.lit(0).cast("long"))))
    new = own.where(room).groupBy("game_id", "new_id", "starting_life", "size").agg(zeros.alias("commander_damage"))
    new = new.select(
        "game_id", F.col("size").cast("int").alias("slot"), F.col("new_id").alias("player_id"), F.get(palette(), F.col("size").cast("int")).alias("color_argb"),
        F.lit("rightSide").alias("seat"), F.col("starting_life").alias("life"), "commander_damage",
    )
    return old.unionByName(new)


def damage_map_remove(wide: DataFrame, gone: DataFrame) -> DataFrame:
    """wide without the players of gone (game_id, player_id), whose keys leave all maps. A game's last player stays."""
    size = F.count("*").over(Window.partitionBy("game_id"))
    ids = gone.groupBy("game_id").agg(F.collect_set("player_id").alias("gone"))
    own = wide.withColumn("size", size).join(ids, "game_id", "left")
    leaves = (F.col("size") > 1) & F.array_contains("gone", F.col("player_id"))
    maps = F.when((F.col("size") > 1) & F.col("gone").isNotNull(), F.map_filter("commander_damage", lambda k, v: ~F.array_contains("gone", k))).otherwise(F.col("commander_damage"))
    return own.where(~F.coalesce(leaves, F.lit(False))).withColumn("commander_damage", maps).select(*wide.columns)
