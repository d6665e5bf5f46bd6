"""The registered queries of the game-log library, each named by its operator, and the same in DuckDB's SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabletide import functions as fn
from tabletide import sources, streaming
from tabletide import testdata as td
from tabletide.operators import actions, damage, diag, effects, life, presets, rolls, scans, seating, settings
from tabletide.schemas import GAME_LOG, PALETTE
from tabletide.sources import read_diag_log

Query = Callable[[SparkSession, str], DataFrame]


def as_json(rows: DataFrame, tag: str) -> str:
    """A log as lines of JSON in the shared folder, some of them cut short (seq % 50 = 7) or without what they need (11)."""
    whole = F.to_json(F.struct(*rows.columns), {"timestampFormat": sources.JSON_TIME})
    lacking = F.to_json(F.struct(*[c for c in rows.columns if c not in ("game_id", "user_id")]), {"timestampFormat": sources.JSON_TIME})
    at = F.col("seq") % 50
    line = F.when(at == 7, F.substring(whole, 1, 20)).when(at == 11, lacking).otherwise(whole)
    return sources.stored_path(rows.select(line.alias("value")), tag, "text")


def json_log(s: SparkSession, d: str) -> DataFrame:
    return sources.read_game_log(s, as_json(td.game_log(s, d), "game-log"), form="json")


def json_settings(s: SparkSession, d: str) -> DataFrame:
    return sources.read_settings_log(s, as_json(td.settings_log(s, d), "settings-log"), form="json")


def left_out(s: SparkSession, d: str) -> DataFrame:
    """Records that the readers leave out, by log and reason."""
    actions_ = sources.read_game_log_with_rest(s, as_json(td.game_log(s, d), "game-log"))[1].select(F.lit("game").alias("log"), "reason")
    writes = sources.read_settings_log_with_rest(s, as_json(td.settings_log(s, d), "settings-log"))[1].select(F.lit("settings").alias("log"), "reason")
    return actions_.unionByName(writes).groupBy("log", "reason").agg(F.count("*").alias("n"))


def flat_profiles(s: SparkSession, d: str) -> DataFrame:
    """Profiles of all customers; a list can't be compared: as text."""
    users = td.table(s, d, "customer").select(F.col("c_custkey").alias("user_id"))
    texts = F.transform("format_presets", lambda p: F.concat_ws(":", p["id"], p["name"], p["startingLife"].cast("string"), p["playerCount"].cast("string")))
    rows = settings.settings_profiles(td.profile_log(s, d), users)
    return rows.withColumns({"player_colors": fn.encode_colors(F.col("player_colors")), "format_presets": F.array_join(texts, "|")})


def effect_log(s: SparkSession, d: str) -> DataFrame:
    return effects.current_effects(td.game_log(s, d), effects.registry(s))


def some_roster(s: SparkSession, d: str) -> DataFrame:
    """A roster without its second player, so that there are unknown players."""
    return td.roster(s, d).where("slot <> 1")


def matrix(s: SparkSession, d: str) -> DataFrame:
    return damage.commander_damage_matrix(td.game_log(s, d), td.roster(s, d))


def wide_roster(s: SparkSession, d: str) -> DataFrame:
    totals = life.life_totals(td.game_log(s, d), td.games(s, d), td.roster(s, d))
    return td.roster(s, d).join(totals, ["game_id", "player_id"]).join(damage.damage_maps(matrix(s, d)), ["game_id", "player_id"]).select("game_id", "slot", "player_id", "color_argb", "seat", "life", "commander_damage")


def flat_maps(wide: DataFrame) -> DataFrame:
    """A map column can't be compared: its entries as sorted text."""
    return wide.withColumn("commander_damage", F.array_join(F.array_sort(F.transform(F.map_entries("commander_damage"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ","))


def color_texts(s: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    text = F.when(c % 4 == 1, F.concat(F.lit("["), (F.lit(4278190080) + c).cast("string"), F.lit(","), c.cast("string"), F.lit("]"))).when(c % 4 == 2, F.lit("[1,x]")).when(c % 4 == 3, F.lit("[]"))
    rows = td.table(s, d, "customer").select(c.alias("user_id"), text.alias("text"))
    colors = fn.decode_colors(F.col("text"))
    return rows.select("user_id", fn.encode_colors(colors).alias("colors"), fn.colors_malformed(F.col("text")).alias("malformed"))


def drafts(s: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    return td.table(s, d, "part").select(
        p.alias("draft_id"), F.when(p % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit("\t"))).alias("name"),
        F.when(p % 3 == 0, F.lit("12a")).otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"))).alias("life"), (p % 9).cast("string").alias("count"),
    )


def format_games(s: SparkSession, d: str) -> DataFrame:
    p = td.table(s, d, "part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_size").cast("long").alias("starting_life"), (F.col("p_partkey") % 9).alias("player_count"))
    g = td.games(s, d).select("game_id", F.concat(F.lit("f"), F.col("game_id").cast("string")).alias("format_id"))
    return presets.apply_format(g, p)


def seeded_presets(s: SparkSession, d: str) -> DataFrame:
    p = td.presets(s, d)
    ids = F.when(F.col("owner_id") % 3 == 0, F.lit("commander")).when(F.col("owner_id") % 3 == 1, F.lit("solo"))
    seeded = p.select("owner_id").distinct().select("owner_id", ids.alias("id"))
    return presets.seed_defaults(seeded, p, presets.default_presets(s))


def preset_changes(s: SparkSession, d: str) -> DataFrame:
    p = td.presets(s, d)
    o = p.select("owner_id").distinct()
    ops = [("update", "f1", "new", 7, 1), ("remove", "f2", None, None, None), ("add", "f2", "again", 8, 2)]
    changes = s.createDataFrame([(i, *x) for i, x in enumerate(ops)], "seq long, op string, id string, name string, starting_life long, player_count long")
    return presets.upsert_presets(p, o.crossJoin(F.broadcast(changes)).where(F.col("owner_id") % 3 != F.col("seq")))


def preset_moves(s: SparkSession, d: str) -> DataFrame:
    p = td.presets(s, d)
    o = F.col("owner_id")
    moves = p.select("owner_id").distinct().select("owner_id", (o % 7).cast("int").alias("from_pos"), (o * 5 % 6).cast("int").alias("to_pos")).where(o % 4 != 0)
    return presets.reorder_presets(p, moves)


def decoded_presets(s: SparkSession, d: str) -> DataFrame:
    rows = td.preset_json(s, d).select("owner_id", presets.decode_presets(F.col("json")).alias("p"))
    first = F.get("p", F.lit(0))
    return rows.select("owner_id", F.size("p").alias("n"), first["id"].alias("id"), first["name"].alias("name"), first["startingLife"].alias("starting_life"), first["playerCount"].alias("player_count"))


def filtered_lines(s: SparkSession, d: str) -> DataFrame:
    levels = td.games(s, d).select(F.col("game_id").alias("device_id"), td.pick(["off", "errors", "verbose"], F.col("game_id") % 3).alias("log_level")).where(F.col("device_id") % 10 != 9)
    return diag.log_level_filter(read_diag_log(td.diag_lines(s, d)).select("device_id", "line_no", "level"), levels)


def lobby_drafts(s: SparkSession, d: str) -> DataFrame:
    """n adds a lobby: a fresh list."""
    r = td.roster(s, d)
    return seating.seat_plan(r.select(F.col("game_id").alias("lobby_id"), F.col("slot").cast("long").alias("seq"), F.lit("add").alias("op"), "player_id", F.lit(None).cast("string").alias("seat"), F.lit(None).cast("int").alias("target")))


def files_of(rows: DataFrame, tag: str) -> str:
    """A log as a folder of files, closed by a row of game -1 so much later that the watermark passes all others. A stream takes
    files by age, so that row is written when the others are there: in a batch before theirs it would make them late."""
    path = sources.stored_path(rows, tag)
    last = rows.sparkSession.read.schema(rows.schema).parquet(path).agg((F.max("ts") + F.expr("interval 2000 days")).alias("ts"))
    end = last.select(F.lit(-1).alias("game_id"), F.lit(-1).alias("seq"), "ts", F.lit("life").alias("action"), F.lit("").alias("player_id"), F.lit(0).alias("delta")).where("ts is not null")
    td.typed(end, GAME_LOG).write.mode("append").parquet(path)
    return path


def streamed(s: SparkSession, rows: DataFrame, build: Callable[[DataFrame], DataFrame], keys: list[str], tag: str) -> DataFrame:
    """What a stream over this log, in update mode and run to the end of its input, says last of each key."""
    out = f"{sources.shared_dir(s)}/{tag}-{uuid.uuid4().hex}"
    stream = build(sources.read_game_log(s, files_of(rows, f"{tag}-log"), streaming=True, files_per_batch=4))
    sources.write_batches(stream, out, f"{out}-state").awaitTermination()
    return sources.newest(sources.read_batches(s, out), keys).where("game_id >= 0")


def streamed_life(s: SparkSession, d: str) -> DataFrame:
    rows = td.game_log(s, d).where("action = 'life'")
    return streamed(s, rows, streaming.stream_life_totals, ["game_id", "player_id"], "stream-life").select("game_id", "player_id", "life")


def streamed_effects(s: SparkSession, d: str) -> DataFrame:
    return streamed(s, td.game_log(s, d), streaming.stream_current_effects, ["game_id", "effect_type"], "stream-effects").select("game_id", "effect_type", "player_id")


def streamed_games(s: SparkSession, d: str) -> DataFrame:
    """Epoch, life change, damage by attacker and effects of each player after the whole log."""
    build = lambda log: streaming.stream_game_state(log, idle="9000 days", lateness="1000 days")
    rows = streamed(s, td.game_log(s, d), build, ["game_id"], "stream-games")
    cells = F.array_join(F.array_sort(F.transform(F.filter(F.map_entries("damage"), lambda e: e["value"] > 0), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ",")
    return rows.where("life_change <> 0 or damage_taken <> 0 or effects <> ''").select("game_id", "player_id", "epoch", "life_change", "damage_taken", cells.alias("damage"), "effects")


def streamed_sessions(s: SparkSession, d: str) -> DataFrame:
    """Pending sessions that the stream has closed, and those that its state still holds."""
    out = f"{sources.shared_dir(s)}/stream-sessions-{uuid.uuid4().hex}"
    log = sources.read_game_log(s, sources.stored_path(td.game_log(s, d), "stream-sessions-log"), streaming=True)
    sources.write_stream(streaming.stream_pending_delta(log, "6 hours", "1000 days"), f"{out}-rows", f"{out}-state").awaitTermination()
    closed = s.read.schema("game_id long, player_id string, start timestamp, pending long, n long").parquet(f"{out}-rows")
    return closed.unionByName(streaming.open_sessions(s, f"{out}-state"))


def stored_roster(s: SparkSession, d: str) -> DataFrame:
    """A roster that was stored in folders by seat, and read back."""
    path = f"{sources.shared_dir(s)}/roster-{uuid.uuid4().hex}"
    rows = td.mixed_roster(s, d)
    sources.write_table(rows, path, ["seat"])
    return s.read.schema(rows.schema).parquet(path).select(*rows.columns)


#: Rows of a block where a query is to cut games of the size that the test tables have.
SMALL_BLOCK = 40

QUERIES: dict[str, Query] = {
    "read_game_log": json_log,
    "read_settings_log": json_settings,
    "quarantine": left_out,
    "read_diag_log": lambda s, d: read_diag_log(td.diag_lines(s, d)).select("device_id", "line_no", "level", "time", "message"),
    "with_quarter_turns": lambda s, d: seating.with_quarter_turns(td.mixed_roster(s, d)).select("game_id", "slot", "seat", "quarter_turns"),
    "hold_threshold_ms": lambda s, d: td.gestures(s, d).select("game_id", "seq", fn.hold_threshold_ms(F.col("sensitivity")).alias("ms"), fn.hold_sensitivity(fn.hold_threshold_ms(F.col("sensitivity"))).alias("back")),
    "gesture_to_deltas": lambda s, d: life.gesture_to_deltas(td.gestures(s, d)),
    "pending_label": lambda s, d: td.game_log(s, d).where("action = 'life'").select("game_id", "seq", fn.pending_label(F.col("delta") + 1).alias("label")),
    "decode_colors": color_texts,
    "preset_labels": lambda s, d: presets.preset_labels(td.presets(s, d)).select("owner_id", "pos", "chip", "subtitle"),
    "resolve_theme": lambda s, d: td.settings_log(s, d).where("key = 'app.themeMode'").select("user_id", "seq", fn.resolve_theme(F.col("value")).alias("theme")),
    "damage_map_add": lambda s, d: flat_maps(damage.damage_map_add(wide_roster(s, d), td.games(s, d), F.lit("new"))),
    "damage_map_remove": lambda s, d: flat_maps(damage.damage_map_remove(wide_roster(s, d), td.roster(s, d).where("slot = 1"))),
    "next_color": lambda s, d: seating.next_color(td.roster(s, d).where((F.col("slot") != F.col("game_id") % 3) | (F.col("slot") == 5))),
    "decode_presets": decoded_presets,
    "valid_actions": lambda s, d: actions.valid_actions(td.game_log(s, d), some_roster(s, d)).select("game_id", "seq", "action", "player_id"),
    "valid_presets": lambda s, d: presets.valid_presets(drafts(s, d)),
    "log_level_filter": filtered_lines,
    "damaged_by": lambda s, d: damage.damaged_by(matrix(s, d), td.roster(s, d)).select("game_id", "player_id", F.array_join("attackers", ",").alias("attackers")),
    "opponents": lambda s, d: seating.opponents(td.roster(s, d)),
    "drop_absorbed_inputs": lambda s, d: actions.drop_absorbed_inputs(td.game_log(s, d), td.games(s, d)).select("game_id", "seq", "action"),
    "orphan_effects": lambda s, d: effects.orphan_effects(effect_log(s, d), some_roster(s, d)).select("game_id", "effect_type", "player_id"),
    "effects_at_event": lambda s, d: effects.effects_at_event(td.game_log(s, d)),
    "apply_format": format_games,
    "seed_defaults": seeded_presets,
    "upsert_presets": preset_changes,
    "life_totals": lambda s, d: life.life_totals(td.game_log(s, d), td.games(s, d), td.roster(s, d)),
    "life_sums": lambda s, d: life.life_sums(td.order_life(s, d)),
    "commander_damage_matrix": matrix,
    "current_effects": effect_log,
    "players_by_position": lambda s, d: seating.players_by_position(td.mixed_roster(s, d)).select("game_id", *[F.array_join(c, ",").alias(c) for c in ("right", "left", "top", "bottom")], "side_count"),
    "roll_summary": lambda s, d: rolls.roll_summary(td.rolls(s, d)),
    "commander_damage_timeline": lambda s, d: damage.commander_damage_timeline(td.game_log(s, d)),
    "game_epochs": lambda s, d: actions.game_epochs(td.game_log(s, d)).select("game_id", "seq", "epoch"),
    "table_phase": lambda s, d: actions.table_phase(td.game_log(s, d), td.games(s, d)).select("game_id", "seq", "phase", "absorbing"),
    "life_timeline": lambda s, d: life.life_timeline(td.game_log(s, d), td.games(s, d)),
    "pending_delta": lambda s, d: life.pending_delta(td.game_log(s, d), "6 hours"),
    "pending_sessions": lambda s, d: life.pending_sessions(td.game_log(s, d), "6 hours"),
    "effect_tenures": lambda s, d: effects.effect_tenures(td.game_log(s, d), effects.registry(s)),
    "clockwise_order": lambda s, d: seating.clockwise_order(td.mixed_roster(s, d)).select("game_id", "player_id", "position"),
    "opponent_rotation": lambda s, d: seating.opponent_rotation(td.mixed_roster(s, d)),
    "player_labels": lambda s, d: seating.player_labels(td.mixed_roster(s, d)),
    "visible_slots": lambda s, d: seating.visible_slots(td.mixed_roster(s, d)).select("game_id", "slot", "visible"),
    "settings_changes": lambda s, d: settings.settings_changes(td.settings_log(s, d)),
    "reorder_presets": preset_moves,
    "roll_history": lambda s, d: rolls.roll_history(td.rolls(s, d)),
    "pick_player": lambda s, d: seating.pick_player(td.mixed_roster(s, d), td.roster(s, d).where("slot = 0").select("game_id", "player_id"), 7),
    "settings_snapshot": lambda s, d: settings.settings_snapshot(td.settings_log(s, d)),
    "settings_profiles": flat_profiles,
    "write_table": stored_roster,
    "stream_life_totals": streamed_life,
    "stream_pending_delta": streamed_sessions,
    "stream_current_effects": streamed_effects,
    "stream_game_state": streamed_games,
    "current_roster": lambda s, d: seating.current_roster(td.game_log(s, d), td.roster(s, d)),
    "seat_plan": lobby_drafts,
    "log_rotation": lambda s, d: diag.log_rotation(td.device_sessions(s, d)),
    "life_totals_in_blocks": lambda s, d: scans.life_totals_in_blocks(td.game_log(s, d), td.games(s, d), td.roster(s, d), SMALL_BLOCK),
    "damage_timeline_in_blocks": lambda s, d: scans.damage_timeline_in_blocks(td.game_log(s, d), SMALL_BLOCK),
    "damage_matrix_in_blocks": lambda s, d: scans.damage_matrix_in_blocks(td.game_log(s, d), td.roster(s, d), SMALL_BLOCK),
    "roster_changes": lambda s, d: scans.roster_changes(td.roster_log(s, d), td.games(s, d), SMALL_BLOCK, 8),
    "replay_presets": lambda s, d: presets.replay_presets(td.presets(s, d), td.preset_edits(s, d)),
    "seat_plan_drafts": lambda s, d: seating.seat_plan(td.seat_drafts(s, d)),
    "log_rotation_split": lambda s, d: diag.log_rotation(td.device_sessions(s, d), 20000, SMALL_BLOCK, 16),
}


EPOCHS = "ep AS (SELECT *, sum(CASE WHEN action IN ('new_game', 'reset') THEN 1 ELSE 0 END) OVER (PARTITION BY game_id ORDER BY seq) epoch FROM game_log)"
LAST = "lst AS (SELECT * FROM ep QUALIFY epoch = max(epoch) OVER (PARTITION BY game_id))"
CELLS = """run AS (SELECT *, sum(delta) OVER (PARTITION BY game_id, epoch, player_id, source_id ORDER BY seq) s FROM ep WHERE action = 'cmd_damage'),
val AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY game_id, epoch, player_id, source_id ORDER BY seq)) damage FROM run),
dmg AS (SELECT *, damage - lag(damage, 1, 0) OVER (PARTITION BY game_id, epoch, player_id, source_id ORDER BY seq) applied FROM val)"""
MATRIX = """cells AS (SELECT game_id, player_id, source_id, arg_max(damage, seq) damage FROM dmg
    WHERE epoch = (SELECT max(epoch) FROM ep e WHERE e.game_id = dmg.game_id) GROUP BY ALL),
matrix AS (SELECT a.game_id, a.player_id, b.player_id source_id, CAST(coalesce(c.damage, 0) AS BIGINT) damage FROM roster a JOIN roster b ON a.game_id = b.game_id AND a.player_id <> b.player_id
    LEFT JOIN cells c ON c.game_id = a.game_id AND c.player_id = a.player_id AND c.source_id = b.player_id)"""
FLAGS = """fl AS (SELECT *, last_value(CASE action WHEN 'pick_open' THEN 1 WHEN 'pick_close' THEN 0 END IGNORE NULLS) OVER w p,
    last_value(CASE action WHEN 'gamba_done' THEN 1 WHEN 'gamba_confirm' THEN 0 WHEN 'new_game' THEN 0 END IGNORE NULLS) OVER w g,
    last_value(CASE action WHEN 'new_game' THEN 1 WHEN 'gamba_done' THEN 0 WHEN 'gamba_skip' THEN 0 END IGNORE NULLS) OVER w c,
    last_value(CASE action WHEN 'random_start' THEN 1 WHEN 'random_done' THEN 0 WHEN 'new_game' THEN 0 END IGNORE NULLS) OVER w r,
    last_value(CASE action WHEN 'random_done' THEN 1 WHEN 'new_game' THEN 0 END IGNORE NULLS) OVER w o
    FROM game_log WINDOW w AS (PARTITION BY game_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
phase AS (SELECT *, CASE WHEN p = 1 THEN 'pick' WHEN g = 1 THEN 'gamba_ok' WHEN c = 1 THEN 'choosing_starter' WHEN o = 1 THEN 'random_ok' ELSE 'idle' END phase,
    coalesce(p = 1, false) OR coalesce(g = 1, false) OR coalesce(c = 1, false) OR coalesce(r = 1, false) absorbing FROM fl)"""
TOTALS = """totals AS (SELECT r.game_id, r.player_id, CAST(40 + coalesce((SELECT sum(delta) FROM lst l WHERE l.action = 'life' AND l.game_id = r.game_id AND l.player_id = r.player_id), 0)
    - coalesce((SELECT sum(applied) FROM dmg d WHERE d.game_id = r.game_id AND d.player_id = r.player_id AND d.epoch = (SELECT max(epoch) FROM ep e WHERE e.game_id = r.game_id)), 0) AS BIGINT) life FROM roster r)"""
HELD = """chg AS (SELECT game_id, effect_type, arg_max(action, seq) action, arg_max(player_id, seq) FILTER (player_id IS NOT NULL) holder, max(seq) seq FROM lst
    WHERE action IN ('set_effect', 'clear_effect') GROUP BY ALL),
cur AS (SELECT game_id, CAST(row_number() OVER (PARTITION BY game_id ORDER BY seq) AS INT) AS position, effect_type, holder player_id,
    CAST(CASE effect_type WHEN 'monarch' THEN 4294956800 END AS BIGINT) outline_argb FROM chg WHERE action = 'set_effect')"""
CLOCK = """clock AS (SELECT *, CAST(row_number() OVER (PARTITION BY game_id ORDER BY CASE seat WHEN 'topEdge' THEN 0 WHEN 'rightSide' THEN 1 WHEN 'bottomEdge' THEN 2 ELSE 3 END,
    CASE WHEN seat = 'leftSide' THEN -slot ELSE slot END) - 1 AS INT) AS position, count(*) OVER (PARTITION BY game_id) n FROM mixed)"""
RESOLVED = """best AS (SELECT user_id, key, arg_max(value, (ts, seq)) AS value FROM settings_log GROUP BY ALL),
wide AS (SELECT user_id, max(value) FILTER (key = 'app.themeMode') theme, max(value) FILTER (key = 'app.colorProfileId') profile, max(value) FILTER (key = 'app.keepAwake') wake,
    max(value) FILTER (key = 'app.hapticLevel') haptic, max(value) FILTER (key = 'app.logLevel') lvl, max(value) FILTER (key = 'gt.confirmNewGame') confirm,
    max(value) FILTER (key = 'gt.holdSensitivity') hold FROM best GROUP BY ALL)"""

#: name -> (further common table expressions, the query)
ORACLE: dict[str, tuple[list[str], str]] = {
    "read_game_log": ([], "SELECT * FROM game_log WHERE seq % 50 NOT IN (7, 11)"),
    "read_settings_log": ([], "SELECT user_id, CAST(ts AS TIMESTAMP) ts, seq, key, value FROM settings_log WHERE seq % 50 NOT IN (7, 11)"),
    "quarantine": ([], """SELECT log, reason, count(*) n FROM (SELECT 'game' log, CASE seq % 50 WHEN 7 THEN 'unreadable' ELSE 'no game' END reason, seq FROM game_log
        UNION ALL SELECT 'settings', CASE seq % 50 WHEN 7 THEN 'unreadable' ELSE 'no user' END, seq FROM settings_log) WHERE seq % 50 IN (7, 11) GROUP BY ALL"""),
    "read_diag_log": ([], """SELECT user_id device_id, event_id line_no, CASE WHEN k % 10 <> 9 THEN ['trace', 'debug', 'info', 'warning', 'error'][k % 5 + 1] END AS level,
        CASE WHEN k % 10 <> 9 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS time, CASE WHEN k % 10 <> 9 THEN event_type ELSE '  at ' || event_type END message FROM ev"""),
    "with_quarter_turns": ([], "SELECT game_id, slot, seat, CASE seat WHEN 'rightSide' THEN 3 WHEN 'leftSide' THEN 1 WHEN 'topEdge' THEN 2 ELSE 0 END quarter_turns FROM mixed"),
    "hold_threshold_ms": ([], "SELECT game_id, seq, CASE sensitivity WHEN 'short' THEN 250 WHEN 'long' THEN 600 ELSE 400 END ms, sensitivity back FROM gestures"),
    "gesture_to_deltas": ([], """SELECT game_id, seq, CAST(i AS INT) i, player_id, ts + to_milliseconds(CASE WHEN held_ms >= lim THEN lim + 500 * i ELSE held_ms END) ts,
        CAST(side * CASE WHEN held_ms >= lim THEN 10 ELSE 1 END AS BIGINT) delta FROM (SELECT *, unnest(range(0, CASE WHEN held_ms >= lim THEN 1 + (held_ms - lim) // 500 WHEN cancelled THEN 0 ELSE 1 END)) i
        FROM (SELECT *, CASE sensitivity WHEN 'short' THEN 250 WHEN 'long' THEN 600 ELSE 400 END lim FROM gestures))"""),
    "pending_label": ([], "SELECT game_id, seq, CASE WHEN delta + 1 > 0 THEN '+' || (delta + 1) WHEN delta + 1 < 0 THEN CAST(delta + 1 AS VARCHAR) END label FROM game_log WHERE action = 'life'"),
    "decode_colors": ([], """SELECT c_custkey user_id, CASE c_custkey % 4 WHEN 0 THEN '{palette_text}'
        WHEN 1 THEN '[' || (4278190080 + c_custkey) || ',' || c_custkey || ']' WHEN 3 THEN '[]' END colors, c_custkey % 4 = 2 malformed FROM customer"""),
    "preset_labels": ([], "SELECT owner_id, pos, name || '  ' || starting_life || '♥' chip, starting_life || ' life · ' || player_count || ' players' subtitle FROM presets"),
    "resolve_theme": ([], "SELECT user_id, seq, CASE value WHEN 'custom' THEN 'light' ELSE value END theme FROM settings_log WHERE key = 'app.themeMode'"),
    "damage_map_add": ([EPOCHS, LAST, CELLS, MATRIX, TOTALS], """SELECT r.game_id, r.slot, r.player_id, r.color_argb, r.seat, t.life,
        (SELECT string_agg(e, ',' ORDER BY e) FROM (SELECT source_id || '=' || damage e FROM matrix m WHERE m.game_id = r.game_id AND m.player_id = r.player_id UNION ALL SELECT 'new=0' WHERE g.n_players < 6)) commander_damage
        FROM roster r JOIN games g USING (game_id) JOIN totals t ON t.game_id = r.game_id AND t.player_id = r.player_id
        UNION ALL SELECT game_id, n_players, 'new', CAST({palette}[n_players + 1] AS BIGINT), 'rightSide', 40,
        (SELECT string_agg(player_id || '=0', ',' ORDER BY player_id) FROM roster r WHERE r.game_id = g.game_id) FROM games g WHERE n_players < 6"""),
    "damage_map_remove": ([EPOCHS, LAST, CELLS, MATRIX, TOTALS], """SELECT r.game_id, r.slot, r.player_id, r.color_argb, r.seat, t.life,
        coalesce((SELECT string_agg(source_id || '=' || damage, ',' ORDER BY source_id) FROM matrix m WHERE m.game_id = r.game_id AND m.player_id = r.player_id AND source_id <> 'p1'), '') commander_damage
        FROM roster r JOIN totals t ON t.game_id = r.game_id AND t.player_id = r.player_id WHERE r.slot <> 1"""),
    "decode_presets": ([], """SELECT p_partkey owner_id, CASE WHEN p_partkey % 10 IN (0, 1, 2, 8) THEN 1 ELSE 0 END n, CASE WHEN p_partkey % 10 IN (0, 1, 2, 8) THEN 'f' || p_partkey END id,
        CASE WHEN p_partkey % 10 IN (0, 1, 2, 8) THEN p_name END AS name, CAST(CASE WHEN p_partkey % 10 IN (0, 1, 2, 8) THEN p_size END AS BIGINT) starting_life,
        CAST(CASE p_partkey % 10 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 8 THEN 3 END AS BIGINT) player_count FROM part"""),
    "valid_actions": ([], """SELECT game_id, seq, action, player_id FROM game_log l WHERE action NOT IN ('life', 'cmd_damage')
        OR EXISTS (SELECT 1 FROM roster r WHERE r.game_id = l.game_id AND r.player_id = l.player_id AND r.slot <> 1)"""),
    "valid_presets": ([], """SELECT p_partkey draft_id, p_name AS name, CAST(p_size AS BIGINT) starting_life, p_partkey % 9 player_count FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 3 <> 0 AND p_size > 0 AND p_partkey % 9 > 0"""),
    "log_level_filter": ([], """SELECT user_id device_id, event_id line_no, level FROM (SELECT *, CASE WHEN k % 10 <> 9 THEN ['trace', 'debug', 'info', 'warning', 'error'][k % 5 + 1] END AS level,
        CASE WHEN user_id % 10 = 9 THEN 1 ELSE user_id % 3 END setting FROM ev) WHERE setting = 2 OR (setting = 1 AND (level = 'error' OR level IS NULL))"""),
    "damaged_by": ([EPOCHS, LAST, CELLS, MATRIX], """SELECT game_id, player_id, string_agg(source_id, ',' ORDER BY source_id) attackers FROM matrix WHERE damage > 0 GROUP BY ALL"""),
    "opponents": ([], "SELECT a.game_id, a.player_id, b.player_id opponent_id FROM roster a JOIN roster b ON a.game_id = b.game_id AND a.player_id <> b.player_id"),
    "drop_absorbed_inputs": ([FLAGS], "SELECT game_id, seq, action FROM phase WHERE NOT (absorbing AND action IN ('life', 'cmd_damage'))"),
    "orphan_effects": ([EPOCHS, LAST, HELD], "SELECT game_id, effect_type, player_id FROM cur c WHERE NOT EXISTS (SELECT 1 FROM roster r WHERE r.game_id = c.game_id AND r.player_id = c.player_id AND r.slot <> 1)"),
    "effects_at_event": ([EPOCHS], """SELECT game_id, seq, player_id, concat_ws(',', CASE WHEN m = player_id THEN 'monarch' END, CASE WHEN i = player_id THEN 'initiative' END) effects FROM (SELECT *,
        last_value(CASE WHEN effect_type = 'monarch' THEN coalesce(player_id, '') END IGNORE NULLS) OVER w m, last_value(CASE WHEN effect_type = 'initiative' THEN coalesce(player_id, '') END IGNORE NULLS) OVER w i
        FROM ep WINDOW w AS (PARTITION BY game_id, epoch ORDER BY seq ROWS UNBOUNDED PRECEDING)) WHERE action IN ('life', 'cmd_damage')"""),
    "apply_format": ([], "SELECT 'f' || game_id format_id, game_id, CAST(p_size AS BIGINT) starting_life, CAST(greatest(1, least(6, p_partkey % 9)) AS INT) target_players FROM games JOIN part ON p_partkey = game_id"),
    "seed_defaults": ([], """SELECT owner_id, pos, id, name, starting_life, player_count FROM presets UNION ALL
        SELECT owner_id, CAST(size + row_number() OVER (PARTITION BY owner_id ORDER BY k) - 1 AS INT), id, name, l, c FROM (SELECT owner_id, max(pos) + 1 size FROM presets GROUP BY ALL) o,
        (VALUES (0, 'commander', 'Commander', 40, 4), (1, 'standard', 'Standard', 20, 2), (2, 'solo', 'Solo', 20, 1)) d(k, id, name, l, c)
        WHERE NOT (owner_id % 3 = 0 AND id = 'commander') AND NOT (owner_id % 3 = 1 AND id = 'solo')"""),
    "upsert_presets": ([], """SELECT owner_id, CAST(row_number() OVER (PARTITION BY owner_id ORDER BY part, place) - 1 AS INT) pos, id, name, starting_life, player_count FROM (
        SELECT owner_id, pos AS place, 0 part, id, CASE WHEN hit THEN 'new' ELSE name END AS name, CASE WHEN hit THEN 7 ELSE starting_life END starting_life, CASE WHEN hit THEN 1 ELSE player_count END player_count
        FROM (SELECT *, id = 'f1' AND owner_id % 3 <> 0 AND row_number() OVER (PARTITION BY owner_id, id ORDER BY pos) = 1 hit FROM presets) WHERE NOT (id = 'f2' AND owner_id % 3 <> 1)
        UNION ALL SELECT DISTINCT owner_id, 2, 1, 'f2', 'again', 8, 2 FROM presets WHERE owner_id % 3 <> 2)"""),
    "life_totals": ([EPOCHS, LAST, CELLS, TOTALS], "SELECT * FROM totals"),
    "life_sums": ([], "SELECT l_orderkey game_id, 'p' || ((l_linenumber - 1) % 6) player_id, CAST(40 - sum(CAST(l_quantity AS INT)) AS BIGINT) life FROM lineitem GROUP BY ALL"),
    "commander_damage_matrix": ([EPOCHS, LAST, CELLS, MATRIX], "SELECT * FROM matrix"),
    "current_effects": ([EPOCHS, LAST, HELD], "SELECT * FROM cur"),
    "players_by_position": ([], """SELECT game_id, coalesce(string_agg(player_id, ',' ORDER BY slot) FILTER (seat = 'rightSide'), '') AS right, coalesce(string_agg(player_id, ',' ORDER BY slot) FILTER (seat = 'leftSide'), '') AS left,
        coalesce(string_agg(player_id, ',' ORDER BY slot) FILTER (seat = 'topEdge'), '') top, coalesce(string_agg(player_id, ',' ORDER BY slot) FILTER (seat = 'bottomEdge'), '') bottom,
        count(*) FILTER (seat IN ('leftSide', 'rightSide')) side_count FROM mixed GROUP BY ALL"""),
    "roll_summary": ([], """SELECT dialog_id, kind, count(*) n, arg_max(CASE kind WHEN 'die' THEN 'd' || die || ': ' || result ELSE CASE WHEN heads THEN 'H' ELSE 'T' END END, seq) AS last,
        coalesce(arg_max(result = die, seq) FILTER (result IS NOT NULL), false) natural_max, count(*) FILTER (heads) heads, count(*) FILTER (NOT heads) tails FROM rolls GROUP BY ALL"""),
    "commander_damage_timeline": ([EPOCHS, CELLS], "SELECT game_id, CAST(epoch AS BIGINT) epoch, seq, player_id, source_id, delta, CAST(applied AS BIGINT) applied, CAST(damage AS BIGINT) damage FROM dmg"),
    "game_epochs": ([EPOCHS], "SELECT game_id, seq, CAST(epoch AS BIGINT) epoch FROM ep"),
    "table_phase": ([FLAGS], "SELECT game_id, seq, phase, absorbing FROM phase"),
    "life_timeline": ([EPOCHS, CELLS], """SELECT game_id, CAST(epoch AS BIGINT) epoch, seq, player_id, CAST(40 + sum(d) OVER (PARTITION BY game_id, epoch, player_id ORDER BY seq) AS BIGINT) life FROM (
        SELECT game_id, epoch, seq, player_id, delta d FROM ep WHERE action = 'life' UNION ALL SELECT game_id, epoch, seq, player_id, -applied FROM dmg)"""),
    "pending_delta": ([EPOCHS, CELLS], """SELECT game_id, CAST(epoch AS BIGINT) epoch, player_id, source_id, seq, CAST(session AS BIGINT) AS session, CAST(sum(d) OVER (PARTITION BY game_id, epoch, player_id, source_id, session ORDER BY seq) AS BIGINT) pending
        FROM (SELECT *, sum(new) OVER (PARTITION BY game_id, epoch, player_id, source_id ORDER BY seq) AS session FROM (
        SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY game_id, epoch, player_id, source_id ORDER BY seq) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM (
        SELECT game_id, epoch, player_id, source_id, seq, ts, delta d FROM ep WHERE action = 'life' UNION ALL SELECT game_id, epoch, player_id, source_id, seq, ts, applied FROM dmg WHERE applied <> 0)))"""),
    "pending_sessions": ([EPOCHS], """SELECT game_id, CAST(epoch AS BIGINT) epoch, player_id, min(ts) AS start, CAST(sum(delta) AS BIGINT) pending, count(*) n FROM (SELECT *, sum(new) OVER (PARTITION BY game_id, epoch, player_id ORDER BY seq) AS session FROM (
        SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY game_id, epoch, player_id ORDER BY seq) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM ep WHERE action = 'life')) GROUP BY game_id, epoch, player_id, session"""),
    "effect_tenures": ([], """SELECT game_id, effect_type, player_id, seq from_seq, to_seq FROM (SELECT *, lead(seq) OVER (PARTITION BY game_id, effect_type ORDER BY seq) to_seq FROM (
        SELECT game_id, seq, action, effect_type, player_id FROM game_log WHERE action IN ('set_effect', 'clear_effect') UNION ALL
        SELECT game_id, seq, action, t, NULL FROM game_log, (VALUES ('monarch'), ('initiative')) e(t) WHERE action IN ('new_game', 'reset'))) WHERE action = 'set_effect'"""),
    "clockwise_order": ([CLOCK], "SELECT game_id, player_id, position FROM clock"),
    "opponent_rotation": ([CLOCK], """SELECT a.game_id, a.player_id, b.player_id opponent_id, CAST((b.position - a.position - 1 + a.n) % a.n AS INT) turn FROM clock a JOIN clock b ON a.game_id = b.game_id AND a.player_id <> b.player_id
        WHERE a.seat IN ('topEdge', 'bottomEdge')"""),
    "player_labels": ([], """SELECT game_id, player_id, CASE seat WHEN 'topEdge' THEN 'Top' WHEN 'bottomEdge' THEN 'Bottom' WHEN 'leftSide' THEN 'Left' ELSE 'Right' END ||
        CASE WHEN count(*) OVER (PARTITION BY game_id, seat) = 1 THEN '' ELSE ' ' || row_number() OVER (PARTITION BY game_id, seat ORDER BY slot) END label FROM mixed"""),
    "visible_slots": ([], "SELECT game_id, slot, seat IN ('leftSide', 'rightSide') OR row_number() OVER (PARTITION BY game_id, seat ORDER BY slot) = 1 visible FROM mixed"),
    "settings_changes": ([], """SELECT user_id, seq, key, m IS DISTINCT FROM lag(m, 1, 'system') OVER w OR p IS DISTINCT FROM lag(p, 1, 'default') OVER w theme_changed,
        k IS DISTINCT FROM lag(k, 1, 'false') OVER w wake_changed, l IS DISTINCT FROM lag(l, 1, 'errors') OVER w log_changed FROM (SELECT user_id, ts, seq, key,
        coalesce(last_value(CASE WHEN key = 'app.themeMode' THEN CASE WHEN value IN ('light', 'dark', 'custom') THEN value ELSE 'system' END END IGNORE NULLS) OVER u, 'system') m,
        coalesce(last_value(CASE WHEN key = 'app.colorProfileId' THEN value END IGNORE NULLS) OVER u, 'default') p, coalesce(last_value(CASE WHEN key = 'app.keepAwake' THEN value END IGNORE NULLS) OVER u, 'false') k,
        coalesce(last_value(CASE WHEN key = 'app.logLevel' THEN CASE WHEN value IN ('off', 'verbose') THEN value ELSE 'errors' END END IGNORE NULLS) OVER u, 'errors') l
        FROM settings_log WINDOW u AS (PARTITION BY user_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)) WINDOW w AS (PARTITION BY user_id ORDER BY ts, seq)"""),
    "reorder_presets": ([], """SELECT owner_id, CAST(CASE WHEN a IS NULL OR bad THEN pos WHEN pos = a THEN b ELSE rest + CASE WHEN rest >= b THEN 1 ELSE 0 END END AS INT) pos, id, name, starting_life, player_count, a IS NOT NULL AND bad AS error
        FROM (SELECT *, pos - CASE WHEN pos > a THEN 1 ELSE 0 END rest, a >= n OR b >= n bad FROM (SELECT *, count(*) OVER (PARTITION BY owner_id) n,
        CASE WHEN owner_id % 4 <> 0 THEN owner_id % 7 END a, CASE WHEN owner_id % 4 <> 0 THEN owner_id * 5 % 6 END b FROM presets))"""),
    "roll_history": ([], """SELECT dialog_id, kind, CAST(r AS INT) AS position, CASE kind WHEN 'die' THEN 'd' || die || ': ' || result ELSE CASE WHEN heads THEN 'H' ELSE 'T' END END AS text
        FROM (SELECT *, row_number() OVER (PARTITION BY dialog_id, kind ORDER BY seq DESC) r FROM rolls) WHERE r <= 5"""),
    "settings_snapshot": ([RESOLVED], """SELECT user_id, CASE WHEN theme IN ('light', 'dark', 'custom') THEN theme ELSE 'system' END theme_mode, coalesce(profile, 'default') color_profile_id, CAST(1.0 AS DOUBLE) text_scale,
        coalesce(wake = 'true', false) keep_awake, CASE WHEN haptic = 'on' THEN 'on' ELSE 'off' END haptic_level, CASE WHEN lvl IN ('off', 'verbose') THEN lvl ELSE 'errors' END log_level,
        coalesce(confirm = 'true', false) confirm_new_game, CASE hold WHEN 'short' THEN 250 WHEN 'long' THEN 600 ELSE 400 END hold_ms, false bad_values FROM wide"""),
    "current_roster": ([], """SELECT r.game_id, r.slot, r.player_id, r.color_argb, coalesce(m.seat, r.seat) seat FROM roster r LEFT JOIN
        (SELECT game_id, player_id, arg_max(seat, seq) seat FROM game_log WHERE action = 'seat_move' GROUP BY ALL) m ON m.game_id = r.game_id AND m.player_id = r.player_id"""),
    "seat_plan": ([], "SELECT game_id lobby_id, slot, player_id, seat FROM roster"),
}
ORACLE["pick_player"] = ([CLOCK], """SELECT game_id, player_id FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY position) - 1 k, count(*) OVER (PARTITION BY game_id) m FROM clock WHERE slot <> 0)
    WHERE k = CAST('0x' || left(md5(game_id || ':7'), 15) AS BIGINT) % m""")
ORACLE["next_color"] = ([], """SELECT game_id, CAST({palette}[least(coalesce(min(i) FILTER (NOT used), 5), 5) + 1] AS BIGINT) color_argb FROM (
    SELECT game_id, i, EXISTS (SELECT 1 FROM roster r WHERE r.game_id = g.game_id AND r.slot = i AND (r.slot <> r.game_id % 3 OR r.slot = 5)) used FROM games g, range(0, 6) t(i)) GROUP BY ALL""")
ROTATION = ["ordered AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY session_no) rn FROM sessions)",
    """fold AS (SELECT device_id, rn, CAST(session_no AS BIGINT) session_no, CAST(0 AS BIGINT) start_bytes, false rotated, 0 generation, bytes size FROM ordered WHERE rn = 1
    UNION ALL SELECT o.device_id, o.rn, CAST(o.session_no AS BIGINT), f.size, f.size > {0}, f.generation + CASE WHEN f.size > {0} THEN 1 ELSE 0 END, CASE WHEN f.size > {0} THEN 0 ELSE f.size END + o.bytes
    FROM fold f JOIN ordered o ON o.device_id = f.device_id AND o.rn = f.rn + 1)"""]  # fmt: skip
for name, limit in (("log_rotation", "524288"), ("log_rotation_split", "20000")):
    ORACLE[name] = ([x.replace("{0}", limit) for x in ROTATION], "SELECT device_id, session_no, start_bytes, rotated, generation FROM fold")
ORACLE["write_table"] = ([], "SELECT * FROM mixed")
ORACLE["stream_life_totals"] = ([], "SELECT game_id, player_id, CAST(40 + sum(delta) AS BIGINT) life FROM game_log WHERE action = 'life' GROUP BY ALL")
ORACLE["stream_pending_delta"] = ([], """SELECT game_id, player_id, min(ts) AS start, CAST(sum(delta) AS BIGINT) pending, count(*) n FROM (SELECT *, sum(new) OVER (PARTITION BY game_id, player_id ORDER BY seq) AS session FROM (
    SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY game_id, player_id ORDER BY seq) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM game_log WHERE action = 'life')) GROUP BY game_id, player_id, session""")
ORACLE["stream_current_effects"] = ([], """SELECT game_id, effect_type, CASE WHEN arg_max(action, seq) = 'set_effect' THEN arg_max(player_id, seq) FILTER (action = 'set_effect') END player_id
    FROM game_log WHERE action IN ('set_effect', 'clear_effect') GROUP BY ALL""")
ORACLE["stream_game_state"] = ([EPOCHS, LAST, CELLS, HELD, """last_cells AS (SELECT game_id, player_id, source_id, arg_max(damage, seq) damage FROM dmg WHERE epoch = (SELECT max(epoch) FROM ep e WHERE e.game_id = dmg.game_id) GROUP BY ALL)""",
    "taken AS (SELECT game_id, player_id, sum(damage) damage_taken, string_agg(source_id || '=' || damage, ',' ORDER BY source_id) FILTER (damage > 0) damage FROM last_cells GROUP BY ALL)",
    "changed AS (SELECT game_id, player_id, sum(delta) direct FROM lst WHERE action = 'life' GROUP BY ALL)",
    "owned AS (SELECT game_id, player_id, string_agg(effect_type, ',' ORDER BY position) effects FROM cur GROUP BY ALL)",
    "final AS (SELECT game_id, max(epoch) epoch FROM ep GROUP BY ALL)"], """SELECT * FROM (SELECT r.game_id, r.player_id, CAST(f.epoch AS BIGINT) epoch, CAST(coalesce(c.direct, 0) - coalesce(t.damage_taken, 0) AS BIGINT) life_change,
    CAST(coalesce(t.damage_taken, 0) AS BIGINT) damage_taken, coalesce(t.damage, '') damage, coalesce(o.effects, '') effects FROM roster r JOIN final f USING (game_id) LEFT JOIN taken t ON t.game_id = r.game_id AND t.player_id = r.player_id
    LEFT JOIN changed c ON c.game_id = r.game_id AND c.player_id = r.player_id LEFT JOIN owned o ON o.game_id = r.game_id AND o.player_id = r.player_id)
    WHERE life_change <> 0 OR damage_taken <> 0 OR effects <> ''""")  # fmt: skip
ORACLE["settings_profiles"] = ([RESOLVED], """SELECT c_custkey user_id, CASE WHEN theme IN ('light', 'dark', 'custom') THEN theme ELSE 'system' END theme_mode, coalesce(profile, 'default') color_profile_id,
    CAST(CASE WHEN c_custkey % 7 = 1 THEN 1.25 ELSE 1.0 END AS DOUBLE) text_scale, coalesce(wake = 'true', false) keep_awake, CASE WHEN haptic = 'on' THEN 'on' ELSE 'off' END haptic_level,
    CASE WHEN lvl IN ('off', 'verbose') THEN lvl ELSE 'errors' END log_level, coalesce(confirm = 'true', false) confirm_new_game, CASE hold WHEN 'short' THEN 250 WHEN 'long' THEN 600 ELSE 400 END hold_ms,
    c_custkey % 7 = 2 bad_values, CASE c_custkey % 4 WHEN 0 THEN '{palette_text}' WHEN 1 THEN '[' || (4278190080 + c_custkey) || ',' || c_custkey || ']' WHEN 3 THEN '[]' END player_colors,
    c_custkey % 4 = 2 colors_malformed, CASE WHEN c_custkey % 5 = 1 THEN 'a' || c_custkey || ':A:40:2|b:B ' || c_custkey || ':20:3' ELSE '' END format_presets
    FROM customer LEFT JOIN wide ON wide.user_id = c_custkey""")
ORACLE["life_totals_in_blocks"] = ORACLE["life_totals"]
ORACLE["damage_timeline_in_blocks"] = ORACLE["commander_damage_timeline"]
ORACLE["damage_matrix_in_blocks"] = ORACLE["commander_damage_matrix"]
ORACLE["roster_changes"] = (["ordered AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY seq) rn FROM roster_log)",
    """step AS (SELECT game_id, 0 rn, CAST(NULL AS BIGINT) seq, CAST(NULL AS VARCHAR) action, CAST(NULL AS VARCHAR) player_id, n_players n_before, n_players n_after FROM games
    UNION ALL SELECT o.game_id, o.rn, o.seq, o.action, o.player_id, s.n_after, CASE o.action WHEN 'add_player' THEN least(6, s.n_after + 1) WHEN 'remove_player' THEN greatest(1, s.n_after - 1)
    WHEN 'new_game' THEN o.n ELSE s.n_after END FROM step s JOIN ordered o ON o.game_id = s.game_id AND o.rn = s.rn + 1)"""],
    "SELECT game_id, seq, action, player_id, n_before, n_after, n_before = n_after refused FROM step WHERE action IN ('add_player', 'remove_player')")
ORACLE["replay_presets"] = (["ordered AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY seq) rn FROM preset_edits)",
    """fold AS (SELECT owner_id, 0 rn, coalesce(now, []) AS now FROM (SELECT DISTINCT owner_id FROM presets UNION SELECT DISTINCT owner_id FROM preset_edits) LEFT JOIN
        (SELECT owner_id, list({'id': id, 'name': name, 'l': starting_life, 'c': player_count} ORDER BY pos) AS now FROM presets GROUP BY ALL) USING (owner_id)
    UNION ALL SELECT owner_id, rn, CASE WHEN op = 'add' THEN now || [new] WHEN op = 'remove' THEN [x for x in now if x.id <> new.id]
        WHEN p > 0 THEN now[:p - 1] || [new] || now[p + 1:] ELSE now END FROM (SELECT f.owner_id, e.rn, e.op, f.now, {'id': e.id, 'name': e.name, 'l': e.starting_life, 'c': e.player_count} AS new,
        coalesce(list_position([x.id for x in f.now], e.id), 0) p FROM fold f JOIN ordered e ON e.owner_id = f.owner_id AND e.rn = f.rn + 1))"""],
    """SELECT owner_id, CAST(pos - 1 AS INT) pos, now[pos].id id, now[pos].name AS name, now[pos].l starting_life, now[pos].c player_count
    FROM (SELECT owner_id, now, unnest(range(1, len(now) + 1)) pos FROM (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY owner_id ORDER BY rn DESC) = 1))""")  # fmt: skip
ORACLE["seat_plan_drafts"] = (["""ordered AS (SELECT *, row_number() OVER (PARTITION BY lobby_id ORDER BY seq, sub) rn FROM
        (SELECT *, unnest(CASE WHEN op = 'format' THEN range(0, 7) ELSE [0] END) sub FROM seat_drafts))""",
    """fold AS (SELECT DISTINCT lobby_id, CAST(0 AS BIGINT) rn, CAST([] AS STRUCT(p VARCHAR, s VARCHAR)[]) AS now FROM seat_drafts
    UNION ALL SELECT lobby_id, rn, CASE WHEN op IN ('remove', 'seat', 'cut') AND len(after) = 1 THEN [{'p': after[1].p, 's': 'bottomEdge'}] ELSE after END FROM (SELECT lobby_id, rn, op,
        CASE WHEN op = 'remove' THEN CASE WHEN n > 1 THEN [x for x in now if x.p <> id] ELSE now END WHEN op = 'seat' THEN [{'p': x.p, 's': CASE WHEN x.p = id THEN seat ELSE x.s END} for x in now]
        WHEN op = 'cut' THEN now[:target] WHEN n >= 6 OR op = 'fill' AND n >= target THEN now
        WHEN n % 2 = 0 THEN now || [{'p': id, 's': 'bottomEdge'}] WHEN b > 0 THEN now[:b - 1] || [{'p': now[b].p, 's': small}] || now[b + 1:] || [{'p': id, 's': CASE small WHEN 'leftSide' THEN 'rightSide' ELSE 'leftSide' END}]
        ELSE now || [{'p': id, 's': small}] END AS after
        FROM (SELECT *, CASE WHEN op = 'fill' THEN player_id || '_' || (n + 1) ELSE player_id END id FROM (SELECT o.lobby_id, o.rn, o.player_id, o.seat, o.target, f.now, CAST(len(f.now) AS BIGINT) n,
            CASE WHEN o.op <> 'format' THEN o.op WHEN o.sub = 0 THEN 'cut' ELSE 'fill' END op, coalesce(list_position([x.s for x in f.now], 'bottomEdge'), 0) b,
            CASE WHEN len([x for x in f.now if x.s = 'leftSide']) <= len([x for x in f.now if x.s = 'rightSide']) THEN 'leftSide' ELSE 'rightSide' END small
            FROM fold f JOIN ordered o ON o.lobby_id = f.lobby_id AND o.rn = f.rn + 1))))"""],
    """SELECT lobby_id, CAST(pos - 1 AS INT) slot, now[pos].p player_id, now[pos].s seat
    FROM (SELECT lobby_id, now, unnest(range(1, len(now) + 1)) pos FROM (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY lobby_id ORDER BY rn DESC) = 1))""")  # fmt: skip


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    whole = {name: "WITH RECURSIVE " + ",\n".join([td.SQL.strip(), *more]) + "\n" + sql for name, (more, sql) in ORACLE.items()}
    return {name: sql.replace("{palette_text}", str(PALETTE).replace(" ", "")).replace("{palette}", str(PALETTE)) for name, sql in whole.items()}
