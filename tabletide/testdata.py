"""Adapters: the driver's star tables as game-log tables. `SQL` has the same tables as common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabletide.schemas import DICE, GAME_LOG, PALETTE, SETTINGS_LOG
from tabletide.sources import typed

SEATS = ["rightSide", "leftSide", "topEdge", "bottomEdge"]
SETTING_KEYS = ["app.themeMode", "app.colorProfileId", "app.keepAwake", "app.hapticLevel", "app.logLevel", "gt.confirmNewGame", "gt.holdSensitivity"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list, at: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type",
        F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("k"), F.floor("value").cast("long").alias("v"),
        (F.lit(2) + F.col("user_id") % 5).cast("int").alias("n"),
    )


def action() -> Column:
    k, kind = F.col("k"), F.col("event_type")
    seat = F.when(k < 10, "new_game").when(k < 20, "reset").when(k < 35, "gamba_done").when(k < 45, "gamba_confirm").when(k < 50, "gamba_skip")
    return (
        F.when(kind == "click", "life").when(kind == "view", "cmd_damage")
        .when(kind == "purchase", F.when(k >= 85, "clear_effect").otherwise("set_effect"))
        .when(kind == "signup", seat.when(k < 55, "random_start").when(k < 60, "random_done").otherwise("seat_move"))
        .otherwise(F.when(k < 30, "pick_open").when(k < 60, "pick_close").when(k < 75, "coin_flip").otherwise("die_roll"))
    )


def player(slot: Column) -> Column:
    return F.concat(F.lit("p"), slot.cast("string"))


def game_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("action", action())
    a, slot = F.col("action"), F.col("k") % F.col("n")
    source = (slot + 1 + F.col("v") % (F.col("n") - 1)) % F.col("n")
    return typed(
        e.select(
            F.col("user_id").alias("game_id"), F.col("event_id").alias("seq"), "ts", "action",
            F.when(a.isin("life", "cmd_damage", "set_effect", "seat_move"), player(slot)).alias("player_id"),
            F.when(a == "cmd_damage", player(source)).alias("source_id"),
            F.when(a.isin("life", "cmd_damage"), pick([-1, 1, -10, 10], F.col("v") % 4)).alias("delta"),
            F.when(a.isin("set_effect", "clear_effect"), F.when(F.col("k") % 2 == 0, "monarch").otherwise("initiative")).alias("effect_type"),
            F.when(a == "seat_move", pick(SEATS, F.col("v") % 4)).alias("seat"),
            F.when(a == "new_game", F.lit(40)).alias("starting_life"),
        ),
        GAME_LOG,
    )


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(game_id, starting_life, n_players)."""
    return events(spark, sf_dir).select(F.col("user_id").alias("game_id"), F.lit(40).cast("long").alias("starting_life"), F.col("n").alias("n_players")).distinct()


def fresh_seat(slot: Column, n: Column) -> Column:
    return F.when((n == 1) | ((n % 2 == 1) & (slot == n - 1)), "bottomEdge").when(slot % 2 == 0, "leftSide").otherwise("rightSide")


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(game_id, slot, player_id, color_argb, seat) of fresh games."""
    g = games(spark, sf_dir).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("n_players") - 1)))
    return g.select("game_id", "slot", player(F.col("slot")).alias("player_id"), pick(PALETTE, F.col("slot")).cast("long").alias("color_argb"), fresh_seat(F.col("slot"), F.col("n_players")).alias("seat"))


def mixed_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A roster with all four seats: seat (slot * 3 + game) mod 4."""
    return roster(spark, sf_dir).withColumn("seat", pick(SEATS, (F.col("slot") * 3 + F.col("game_id")) % 4))


def rolls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dialog_id, seq, kind, die, result, heads)."""
    e = events(spark, sf_dir).withColumn("action", action()).where(F.col("action").isin("coin_flip", "die_roll"))
    die = pick(DICE, F.col("k") % 6)
    coin = F.col("action") == "coin_flip"
    return e.select(
        F.col("user_id").alias("dialog_id"), F.col("event_id").alias("seq"), F.when(coin, "coin").otherwise("die").alias("kind"),
        F.when(~coin, die).cast("int").alias("die"), F.when(~coin, F.col("v") % die + 1).cast("int").alias("result"), F.when(coin, F.col("v") % 2 == 0).alias("heads"),
    )


def settings_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumns({"x": F.floor("o_totalprice").cast("long") % 5, "key": pick(SETTING_KEYS, F.col("o_orderkey") % 7)})
    x, key = F.col("x"), F.col("key")
    value = (
        F.when(key == "app.themeMode", pick(["system", "light", "dark", "custom", "sepia"], x))
        .when(key == "app.colorProfileId", F.concat(F.lit("p"), x.cast("string")))
        .when(key == "app.hapticLevel", pick(["off", "on", "low", "high", "off"], x))
        .when(key == "app.logLevel", pick(["off", "errors", "verbose", "debug", "errors"], x))
        .when(key == "gt.holdSensitivity", pick(["short", "medium", "long", "tiny", "medium"], x))
        .otherwise(F.when(x % 2 == 0, "true").otherwise("false"))
    )
    return typed(o.select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"), "key", value.alias("value")), SETTINGS_LOG)


def presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(owner_id, pos, id, name, starting_life, player_count), about six an owner."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.floor(F.col("p_partkey") / 6).cast("long").alias("owner_id"), (F.col("p_partkey") % 6).cast("int").alias("pos"),
        F.concat(F.lit("f"), (F.col("p_partkey") % 4).cast("string")).alias("id"), F.col("p_name").alias("name"),
        F.col("p_size").cast("long").alias("starting_life"), (F.col("p_partkey") % 9).cast("long").alias("player_count"),
    )


def preset_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(owner_id, json): a list of one preset, in ten ways by part key of which some are malformed."""
    p = table(spark, sf_dir, "part").withColumn("c", F.col("p_partkey") % 10)
    s = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    head = s('{"id":"f', F.col("p_partkey"), '","name":"', F.col("p_name"), '","startingLife":', F.col("p_size"))
    c = F.col("c")
    text = (
        F.when(c == 1, s("[", head, "}]")).when(c == 2, s("[", head, ',"playerCount":null}]')).when(c == 3, s("[", head, ',"playerCount":"4"}]'))
        .when(c == 4, s("[", head, '.0,"playerCount":4}]')).when(c == 5, s(head, ',"playerCount":4}')).when(c == 6, s("[", head, ',"playerCount":4}]x'))
        .when(c == 7, s('[{"name":"', F.col("p_name"), '","startingLife":1}]')).when(c == 8, s("[", head, ',"playerCount":3,"extra":[1]}]')).when(c == 9, F.lit(None))
        .otherwise(s("[", head, ',"playerCount":', c + 2, "}]"))
    )
    return p.select(F.col("p_partkey").alias("owner_id"), text.alias("json"))


def gestures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(game_id, seq, player_id, ts, side, held_ms, cancelled, sensitivity)."""
    e = events(spark, sf_dir).where(F.col("event_type").isin("click", "view"))
    return e.select(
        F.col("user_id").alias("game_id"), F.col("event_id").alias("seq"), player(F.col("k") % F.col("n")).alias("player_id"), "ts",
        F.when(F.col("k") % 2 == 0, 1).otherwise(-1).alias("side"), (F.col("v") * 137 % 3000).cast("int").alias("held_ms"),
        (F.col("k") % 5 == 0).alias("cancelled"), pick(["short", "medium", "long"], F.col("k") % 3).alias("sensitivity"),
    )


def diag_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    letter = pick(["T", "D", "I", "W", "E"], F.col("k") % 5)
    head = F.concat(F.lit("["), letter, F.lit("] TIME: "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit(" "), F.col("event_type"))
    return e.select(F.col("user_id").alias("device_id"), F.lit(0).cast("long").alias("session_id"), F.col("event_id").alias("line_no"), F.when(F.col("k") % 10 == 9, F.concat(F.lit("  at "), F.col("event_type"))).otherwise(head).alias("line"))


def device_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(device_id, session_no, bytes): a session a day."""
    e = events(spark, sf_dir).groupBy(F.col("user_id").alias("device_id"), F.to_date("ts").alias("day")).agg((F.sum("v") * 2000).cast("long").alias("bytes"))
    return e.select("device_id", F.datediff("day", F.lit("2024-01-01")).alias("session_no"), "bytes")


def profile_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settings log and, for some customers, a list of colours, a text scale, and lists of none to several presets, some broken."""
    c = F.col("c_custkey")
    own = table(spark, sf_dir, "customer")
    put = lambda k, value, n: own.select(c.alias("user_id"), F.lit("2020-01-01").cast("timestamp").alias("ts"), (-c * 4 - n).alias("seq"), F.lit(k).alias("key"), value.alias("value")).where("value is not null")
    s = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    colors = F.when(c % 4 == 1, s("[", F.lit(4278190080) + c, ",", c, "]")).when(c % 4 == 2, "[1,x]").when(c % 4 == 3, "[]")
    two = s('[{"id":"a', c, '","name":"A","startingLife":40},{"id":"b","name":"B ', c, '","startingLife":20,"playerCount":3}')
    lists = F.when(c % 5 == 1, s(two, "]")).when(c % 5 == 2, s(two, ',{"id":5,"name":"C","startingLife":1}]')).when(c % 5 == 3, "[]")
    scale = F.when(c % 7 == 1, "1.25").when(c % 7 == 2, "wide")
    extra = put("gt.playerColors", colors, 0).unionByName(put("gt.formatPresets", lists, 1)).unionByName(put("app.textScale", scale, 2))
    return settings_log(spark, sf_dir).unionByName(typed(extra, SETTINGS_LOG))


def roster_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(game_id, seq, action, player_id): clicks and views as adds and removes, and what starts anew."""
    e = events(spark, sf_dir)
    kind = F.col("event_type")
    what = F.when(kind.isin("click", "view"), F.when(F.col("k") % 100 < 52, "add_player").otherwise("remove_player")).when(kind == "signup", F.when(F.col("k") < 20, "new_game").otherwise("reset"))
    return e.select(F.col("user_id").alias("game_id"), F.col("event_id").alias("seq"), what.alias("action"), player(F.col("k") % F.col("n")).alias("player_id")).where("action is not null")


def preset_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(owner_id, seq, op, id, name, starting_life, player_count): orders as edits of few ids."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(
        F.floor(F.col("o_custkey") / 6).cast("long").alias("owner_id"), key.alias("seq"), pick(["add", "add", "update", "update", "remove"], key % 5).alias("op"),
        F.concat(F.lit("f"), (F.floor("o_totalprice").cast("long") % 5).cast("string")).alias("id"), F.concat(F.lit("n"), key.cast("string")).alias("name"),
        (key % 60).cast("long").alias("starting_life"), (key % 9).cast("long").alias("player_count"),
    )


def seat_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lobby_id, seq, op, player_id, seat, target): drafts of all kinds."""
    e = events(spark, sf_dir)
    op = pick(["add", "seat", "remove", "format", "add"], F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "purchase", 3).otherwise(4))
    name = F.concat(F.when(op == "format", "y").otherwise("x"), (F.col("k") % 7).cast("string"))
    return e.select(F.col("user_id").alias("lobby_id"), F.col("event_id").alias("seq"), op.alias("op"), name.alias("player_id"), pick(SEATS, F.col("v") % 4).alias("seat"), (F.col("v") % 9).cast("int").alias("target"))


def order_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large life log without an order: (game_id, player_id, delta)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("game_id"), player((F.col("l_linenumber") - 1) % 6).alias("player_id"), (-F.col("l_quantity").cast("int")).cast("long").alias("delta"))


#: The same tables for DuckDB.
SQL = """
ev AS (SELECT event_id, ts, user_id, event_type, CAST(regexp_extract(props, '[0-9]+') AS INT) k, CAST(floor(value) AS BIGINT) v,
    CAST(2 + user_id % 5 AS INT) n FROM events),
act AS (SELECT *, CASE event_type WHEN 'click' THEN 'life' WHEN 'view' THEN 'cmd_damage'
    WHEN 'purchase' THEN CASE WHEN k >= 85 THEN 'clear_effect' ELSE 'set_effect' END
    WHEN 'signup' THEN CASE WHEN k < 10 THEN 'new_game' WHEN k < 20 THEN 'reset' WHEN k < 35 THEN 'gamba_done' WHEN k < 45 THEN 'gamba_confirm'
        WHEN k < 50 THEN 'gamba_skip' WHEN k < 55 THEN 'random_start' WHEN k < 60 THEN 'random_done' ELSE 'seat_move' END
    ELSE CASE WHEN k < 30 THEN 'pick_open' WHEN k < 60 THEN 'pick_close' WHEN k < 75 THEN 'coin_flip' ELSE 'die_roll' END END action FROM ev),
game_log AS (SELECT user_id game_id, event_id seq, ts, action,
    CASE WHEN action IN ('life', 'cmd_damage', 'set_effect', 'seat_move') THEN 'p' || (k % n) END player_id,
    CASE WHEN action = 'cmd_damage' THEN 'p' || ((k % n + 1 + v % (n - 1)) % n) END source_id,
    CAST(CASE WHEN action IN ('life', 'cmd_damage') THEN CASE v % 4 WHEN 0 THEN -1 WHEN 1 THEN 1 WHEN 2 THEN -10 ELSE 10 END END AS BIGINT) delta,
    CASE WHEN action IN ('set_effect', 'clear_effect') THEN CASE WHEN k % 2 = 0 THEN 'monarch' ELSE 'initiative' END END effect_type,
    CASE WHEN action = 'seat_move' THEN CASE v % 4 WHEN 0 THEN 'rightSide' WHEN 1 THEN 'leftSide' WHEN 2 THEN 'topEdge' ELSE 'bottomEdge' END END seat,
    CAST(CASE WHEN action = 'new_game' THEN 40 END AS BIGINT) starting_life FROM act),
games AS (SELECT DISTINCT user_id game_id, CAST(40 AS BIGINT) starting_life, n n_players FROM ev),
roster AS (SELECT game_id, CAST(slot AS INT) slot, 'p' || slot player_id,
    CAST({palette}[slot + 1] AS BIGINT) color_argb,
    CASE WHEN n_players = 1 OR (n_players % 2 = 1 AND slot = n_players - 1) THEN 'bottomEdge' WHEN slot % 2 = 0 THEN 'leftSide' ELSE 'rightSide' END seat
    FROM (SELECT *, unnest(range(0, n_players)) slot FROM games)),
mixed AS (SELECT * REPLACE (CASE (slot * 3 + game_id) % 4 WHEN 0 THEN 'rightSide' WHEN 1 THEN 'leftSide' WHEN 2 THEN 'topEdge' ELSE 'bottomEdge' END AS seat) FROM roster),
rolls AS (SELECT user_id dialog_id, event_id seq, CASE action WHEN 'coin_flip' THEN 'coin' ELSE 'die' END kind,
    CASE WHEN action = 'die_roll' THEN [4, 6, 8, 10, 12, 20][k % 6 + 1] END die,
    CAST(CASE WHEN action = 'die_roll' THEN v % [4, 6, 8, 10, 12, 20][k % 6 + 1] + 1 END AS INT) result,
    CASE WHEN action = 'coin_flip' THEN v % 2 = 0 END heads FROM act WHERE action IN ('coin_flip', 'die_roll')),
setting_rows AS (SELECT *, CAST(floor(o_totalprice) AS BIGINT) % 5 x, ['app.themeMode', 'app.colorProfileId', 'app.keepAwake', 'app.hapticLevel', 'app.logLevel',
    'gt.confirmNewGame', 'gt.holdSensitivity'][o_orderkey % 7 + 1] AS key FROM orders),
settings_log AS (SELECT o_custkey user_id, o_orderdate ts, o_orderkey seq, key, CASE key
    WHEN 'app.themeMode' THEN ['system', 'light', 'dark', 'custom', 'sepia'][x + 1] WHEN 'app.colorProfileId' THEN 'p' || x
    WHEN 'app.hapticLevel' THEN ['off', 'on', 'low', 'high', 'off'][x + 1] WHEN 'app.logLevel' THEN ['off', 'errors', 'verbose', 'debug', 'errors'][x + 1]
    WHEN 'gt.holdSensitivity' THEN ['short', 'medium', 'long', 'tiny', 'medium'][x + 1] ELSE CASE WHEN x % 2 = 0 THEN 'true' ELSE 'false' END END AS value FROM setting_rows),
presets AS (SELECT p_partkey // 6 owner_id, CAST(p_partkey % 6 AS INT) pos, 'f' || (p_partkey % 4) id, p_name AS name, CAST(p_size AS BIGINT) starting_life,
    p_partkey % 9 player_count FROM part),
gestures AS (SELECT user_id game_id, event_id seq, 'p' || (k % n) player_id, ts, CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END side,
    CAST(v * 137 % 3000 AS INT) held_ms, k % 5 = 0 cancelled, ['short', 'medium', 'long'][k % 3 + 1] sensitivity FROM ev WHERE event_type IN ('click', 'view')),
sessions AS (SELECT user_id device_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) session_no, CAST(sum(v) * 2000 AS BIGINT) bytes
    FROM ev GROUP BY user_id, CAST(ts AS DATE)),
roster_log AS (SELECT * FROM (SELECT user_id game_id, event_id seq, CASE WHEN event_type IN ('click', 'view') THEN CASE WHEN k % 100 < 52 THEN 'add_player' ELSE 'remove_player' END
    WHEN event_type = 'signup' THEN CASE WHEN k < 20 THEN 'new_game' ELSE 'reset' END END action, 'p' || (k % n) player_id, n FROM ev) WHERE action IS NOT NULL),
preset_edits AS (SELECT o_custkey // 6 owner_id, o_orderkey seq, ['add', 'add', 'update', 'update', 'remove'][o_orderkey % 5 + 1] op, 'f' || (CAST(floor(o_totalprice) AS BIGINT) % 5) id,
    'n' || o_orderkey AS name, CAST(o_orderkey % 60 AS BIGINT) starting_life, CAST(o_orderkey % 9 AS BIGINT) player_count FROM orders),
seat_drafts AS (SELECT user_id lobby_id, event_id seq, op, CASE WHEN op = 'format' THEN 'y' ELSE 'x' END || (k % 7) player_id,
    ['rightSide', 'leftSide', 'topEdge', 'bottomEdge'][v % 4 + 1] seat, greatest(1, least(6, CAST(v % 9 AS INT))) target
    FROM (SELECT *, CASE event_type WHEN 'click' THEN 'add' WHEN 'view' THEN 'seat' WHEN 'signup' THEN 'remove' WHEN 'purchase' THEN 'format' ELSE 'add' END op FROM ev))
"""
