"""Seats, clockwise orders, labels, picks and seat drafts. The order of a player list is the column slot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabletide.functions import lookup, palette, quarter_turns
from tabletide.schemas import MOST_PLAYERS

SIDES = ("leftSide", "rightSide")
LABELS = {"topEdge": "Top", "bottomEdge": "Bottom", "leftSide": "Left", "rightSide": "Right"}


def with_quarter_turns(roster: DataFrame) -> DataFrame:
    return roster.withColumn("quarter_turns", quarter_turns(F.col("seat")))


def next_color(drafts: DataFrame) -> DataFrame:
    """game_id, color_argb: the first palette colour that no player of the draft has, else the last colour."""
    used = drafts.groupBy("game_id").agg(F.collect_set("color_argb").alias("used"))
    return used.select("game_id", F.coalesce(F.get(F.array_except(palette(), "used"), F.lit(0)), F.get(palette(), F.lit(MOST_PLAYERS - 1))).alias("color_argb"))


def opponents(roster: DataFrame) -> DataFrame:
    """game_id, player_id, opponent_id: every other player of the game, 30 rows a game at most."""
    other = roster.select("game_id", F.col("player_id").alias("opponent_id"))
    return roster.select("game_id", "player_id").join(other, "game_id").where(F.col("player_id") != F.col("opponent_id"))


def bucket(seat: str, where: Column) -> Column:
    hit = F.when(where == seat, F.struct("slot", "player_id"))
    return F.transform(F.array_sort(F.collect_list(hit)), lambda x: x["player_id"])


def players_by_position(roster: DataFrame, seat_col: str = "seat") -> DataFrame:
    """game_id, right, left, top, bottom (player lists in order), side_count."""
    seat = F.col(seat_col)
    return roster.groupBy("game_id").agg(
        bucket("rightSide", seat).alias("right"), bucket("leftSide", seat).alias("left"), bucket("topEdge", seat).alias("top"),
        bucket("bottomEdge", seat).alias("bottom"), F.count_if(seat.isin(*SIDES)).alias("side_count"),
    )


def clockwise_order(roster: DataFrame) -> DataFrame:
    """roster with position (from 0): top, right, bottom in list order, then left in reverse."""
    seat = lookup(F.col("seat"), {"topEdge": 0, "rightSide": 1, "bottomEdge": 2, "leftSide": 3})
    within = F.when(F.col("seat") == "leftSide", -F.col("slot")).otherwise(F.col("slot"))
    return roster.withColumn("position", (F.row_number().over(Window.partitionBy("game_id").orderBy(seat, within)) - 1).cast("int"))


def opponent_rotation(roster: DataFrame) -> DataFrame:
    """game_id, player_id, opponent_id, turn: opponents clockwise from each player at the top or bottom; none for sides."""
    ordered = clockwise_order(roster).withColumn("n", F.count("*").over(Window.partitionBy("game_id")))
    other = ordered.select("game_id", F.col("player_id").alias("opponent_id"), F.col("position").alias("at"))
    pairs = ordered.where(~F.col("seat").isin(*SIDES)).join(other, "game_id").where(F.col("player_id") != F.col("opponent_id"))
    turn = F.pmod(F.col("at") - F.col("position") - 1 + F.col("n"), F.col("n")).cast("int")
    return pairs.select("game_id", "player_id", "opponent_id", turn.alias("turn"))


def player_labels(roster: DataFrame) -> DataFrame:
    """game_id, player_id, label: the seat's name, with a number in list order if it is shared."""
    seat = Window.partitionBy("game_id", "seat")
    name, n, k = lookup(F.col("seat"), LABELS), F.count("*").over(seat), F.row_number().over(seat.orderBy("slot"))
    return roster.select("game_id", "player_id", F.when(n == 1, name).otherwise(F.concat(name, F.lit(" "), k.cast("string"))).alias("label"))


def visible_slots(roster: DataFrame) -> DataFrame:
    """roster with visible: side players, and the first of each edge."""
    first = F.row_number().over(Window.partitionBy("game_id", "seat").orderBy("slot")) == 1
    return roster.withColumn("visible", F.col("seat").isin(*SIDES) | first)


def pick_player(roster: DataFrame, exclude: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """game_id, player_id: one player a game out of those not excluded (game_id, player_id), uniform over games and the same
    for the same seed (the first 15 digits of an MD5, modulo the pool's size); no row for an empty pool."""
    ordered = clockwise_order(roster)
    pool = ordered if exclude is None else ordered.join(exclude, ["game_id", "player_id"], "left_anti")
    game = Window.partitionBy("game_id")
    ranked = pool.withColumns({"k": F.row_number().over(game.orderBy("position")) - 1, "n": F.count("*").over(game)})
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("game_id").cast("string"), F.lit(str(seed)))), 1, 15), 16, 10).cast("long")
    return ranked.where(F.col("k") == drawn % F.col("n")).select("game_id", "player_id")


def current_roster(log: DataFrame, roster: DataFrame) -> DataFrame:
    """roster with each player's last seat; a player alone sits at the bottom."""
    moves = log.where(F.col("action") == "seat_move").groupBy("game_id", "player_id").agg(F.max_by("seat", "seq").alias("moved"))
    alone = F.count("*").over(Window.partitionBy("game_id")) == 1
    joined = roster.join(moves, ["game_id", "player_id"], "left").withColumn("alone", alone)
    seat = F.when(F.col("alone"), "bottomEdge").otherwise(F.coalesce("moved", "seat"))
    return joined.select("game_id", "slot", "player_id", "color_argb", seat.alias("seat"))


def count_of(seats: Column, seat: str) -> Column:
    return F.size(F.filter(seats, lambda x: x["seat"] == seat))


def added(players: Column, new_id: Column) -> Column:
    """A seat list (structs player_id, seat) with one more player."""
    smaller = F.when(count_of(players, "leftSide") <= count_of(players, "rightSide"), "leftSide").otherwise("rightSide")
    other = F.when(smaller == "leftSide", "rightSide").otherwise("leftSide")
    bottom = F.array_position(F.transform(players, lambda x: x["seat"]), "bottomEdge")
    moved = F.transform(players, lambda x, i: F.struct(x["player_id"].alias("player_id"), F.when(i + 1 == bottom, smaller).otherwise(x["seat"]).alias("seat")))
    seat = F.when(F.size(players) % 2 == 0, "bottomEdge").when(bottom > 0, other).otherwise(smaller)
    grown = F.concat(F.when(F.size(players) % 2 == 0, players).otherwise(moved), F.array(F.struct(new_id.alias("player_id"), seat.alias("seat"))))
    return F.when(F.size(players) < MOST_PLAYERS, grown).otherwise(players)


def alone(players: Column) -> Column:
    """A list of one sits at the bottom."""
    seated = F.transform(players, lambda x: F.struct(x["player_id"].alias("player_id"), F.lit("bottomEdge").alias("seat")))
    return F.when(F.size(players) == 1, seated).otherwise(players)


def seat_plan(drafts: DataFrame) -> DataFrame:
    """lobby_id, slot, player_id, seat after the drafts (lobby_id, seq, op, player_id, seat, target), replayed in order: add,
    remove (not the last player), seat, and format, which cuts from the end or adds up to target players. Players
    that a format adds are named player_id and a number. A lobby's list has six players at most."""
    ops = drafts.groupBy("lobby_id").agg(F.array_sort(F.collect_list(F.struct("seq", "op", "player_id", "seat", "target"))).alias("ops"))

    def step(now: Column, op: Column) -> Column:
        size = F.size(now)
        target = F.greatest(F.lit(1), F.least(F.lit(MOST_PLAYERS), op["target"]))
        without = F.when(size > 1, F.filter(now, lambda x: x["player_id"] != op["player_id"])).otherwise(now)
        seated = F.transform(now, lambda x: F.struct(x["player_id"].alias("player_id"), F.when(x["player_id"] == op["player_id"], op["seat"]).otherwise(x["seat"]).alias("seat")))
        cut = alone(F.slice(now, 1, F.least(size, target)))
        missing = F.when(target > size, F.sequence(size + 1, target)).otherwise(F.array().cast("array<int>"))
        filled = F.aggregate(missing, cut, lambda acc, i: added(acc, F.concat(op["player_id"], F.lit("_"), i.cast("string"))))
        return F.when(op["op"] == "add", added(now, op["player_id"])).when(op["op"] == "remove", alone(without)).when(op["op"] == "seat", alone(seated)).when(op["op"] == "format", filled).otherwise(now)

    players = F.aggregate("ops", F.array().cast("array<struct<player_id:string,seat:string>>"), step)
    return ops.select("lobby_id", F.posexplode(players).alias("slot", "p")).select("lobby_id", "slot", "p.player_id", "p.seat")
