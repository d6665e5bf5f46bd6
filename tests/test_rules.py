"""Hand-made rows: the key rows of FIXTURES.md, and plans."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tabletide import functions as fn
from tabletide import sources
from tabletide import testdata as td
from tabletide.operators import actions, damage, diag, effects, life, presets, rolls, seating, settings
from tabletide.schemas import GAME_LOG, PALETTE

T0 = datetime.datetime(2024, 1, 1)


def log(spark, rows):
    """rows: dicts with action and more; seq and ts by place."""
    names = [x.split()[0] for x in GAME_LOG.split(", ")]
    full = [{"game_id": 1, "seq": i, "ts": T0 + datetime.timedelta(seconds=i), **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], GAME_LOG)


def hit(delta, a="A", b="B", **more):
    return {"action": "cmd_damage", "player_id": a, "source_id": b, "delta": delta, **more}


def change(delta, a="A", **more):
    return {"action": "life", "player_id": a, "delta": delta, **more}


def games(spark, n=2):
    return spark.createDataFrame([(1, 40, n)], "game_id long, starting_life long, n_players int")


def roster(spark, seats, game=1):
    return spark.createDataFrame([(game, i, chr(65 + i), PALETTE[i], s) for i, s in enumerate(seats)], "game_id long, slot int, player_id string, color_argb long, seat string")


def test_damage_floor(spark):
    rows = damage.commander_damage_timeline(log(spark, [hit(d) for d in (1, -10, 10, -3, -10)])).orderBy("seq").collect()
    assert [r.damage for r in rows] == [1, 0, 10, 7, 0]
    assert [r.applied for r in rows] == [1, -1, 10, -3, -7]
    totals = life.life_totals(log(spark, [hit(d) for d in (1, -10, 10, -3, -10)]), games(spark), roster(spark, ["leftSide", "rightSide"]))
    assert {r.player_id: r.life for r in totals.collect()} == {"A": 40, "B": 40}


def test_damage_below_zero_is_no_change(spark):
    rows = log(spark, [hit(-1)])
    assert damage.commander_damage_timeline(rows).first().applied == 0
    assert life.pending_delta(rows).count() == 0


def test_epochs(spark):
    rows = log(spark, [{"action": "new_game", "starting_life": 40}, change(1), {"action": "reset"}, change(-1)])
    assert [r.epoch for r in actions.game_epochs(rows).orderBy("seq").collect()] == [1, 1, 2, 2]
    assert [r.life for r in life.life_timeline(rows, games(spark)).orderBy("seq").collect()] == [41, 39]


def test_pending_gap(spark):
    at = lambda us: {"ts": T0 + datetime.timedelta(microseconds=us)}
    rows = log(spark, [change(1, **at(0)), change(1, **at(5_000_000)), change(-1, **at(10_000_001))])
    assert [(r.session, r.pending) for r in life.pending_delta(rows).orderBy("seq").collect()] == [(1, 1), (1, 2), (2, -1)]
    assert sorted(r.pending for r in life.pending_sessions(rows).collect()) == [-1, 2]


def test_gestures(spark):
    held = [(399, False), (400, False), (899, False), (900, False), (399, True), (950, True)]
    g = spark.createDataFrame([(1, i, "A", T0, 1, h, c, "medium") for i, (h, c) in enumerate(held)], "game_id long, seq long, player_id string, ts timestamp, side int, held_ms int, cancelled boolean, sensitivity string")
    got = {r.seq: r.d for r in life.gesture_to_deltas(g).groupBy("seq").agg(F.sum("delta").alias("d")).collect()}
    assert got == {0: 1, 1: 10, 2: 10, 3: 20, 5: 20}


def test_effects(spark):
    set_ = lambda t, p: {"action": "set_effect", "effect_type": t, "player_id": p}
    rows = log(spark, [set_("monarch", "A"), set_("initiative", "B"), set_("monarch", "C")])
    now = effects.current_effects(rows, effects.registry(spark))
    assert [(r.effect_type, r.player_id) for r in now.orderBy("position").collect()] == [("initiative", "B"), ("monarch", "C")]
    assert [(r.player_id, r.outline_argb) for r in effects.outline_color(now).collect()] == [("C", 0xFFFFD700)]
    left = roster(spark, ["leftSide", "rightSide"])
    assert [r.player_id for r in effects.orphan_effects(now, left).collect()] == ["C"]
    rows = log(spark, [set_("monarch", "A") | {"seq": 1}, set_("monarch", "B") | {"seq": 5}, {"action": "reset", "seq": 9}])
    spans = effects.effect_tenures(rows, effects.registry(spark)).orderBy("from_seq").collect()
    assert [(r.player_id, r.from_seq, r.to_seq) for r in spans] == [("A", 1, 5), ("B", 5, 9)]


def test_seats(spark):
    r = roster(spark, ["leftSide", "rightSide", "leftSide", "rightSide", "topEdge", "bottomEdge"])
    assert [x.slot for x in seating.clockwise_order(r).orderBy("position").collect()] == [4, 1, 3, 5, 2, 0]
    turns = seating.opponent_rotation(r).where("player_id = 'E'").orderBy("turn").collect()
    assert [ord(x.opponent_id) - 65 for x in turns] == [1, 3, 5, 2, 0]
    assert seating.opponent_rotation(r).where("player_id = 'A'").count() == 0
    assert [x.label for x in seating.player_labels(r).orderBy("player_id").collect()] == ["Left 1", "Right 1", "Left 2", "Right 2", "Top", "Bottom"]
    two = roster(spark, ["topEdge", "topEdge"])
    assert [x.visible for x in seating.visible_slots(two).orderBy("slot").collect()] == [True, False]
    assert seating.pick_player(roster(spark, ["bottomEdge"]), roster(spark, ["bottomEdge"]).select("game_id", "player_id")).count() == 0
    assert seating.next_color(r).first().color_argb == PALETTE[-1]
    assert seating.next_color(r.where("slot in (0, 2)")).first().color_argb == PALETTE[1]


def plan(spark, ops):
    rows = [(1, i, op, p, seat, target) for i, (op, p, seat, target) in enumerate(ops)]
    d = spark.createDataFrame(rows, "lobby_id long, seq long, op string, player_id string, seat string, target int")
    return "".join(r.seat[0].upper() for r in seating.seat_plan(d).orderBy("slot").collect())


def test_seat_plan(spark):
    add = lambda n, at=0: [("add", f"p{at + i}", None, None) for i in range(n)]
    assert [plan(spark, add(n)) for n in range(1, 7)] == ["B", "LR", "LRB", "LRLR", "LRLRB", "LRLRLR"]
    assert plan(spark, add(4) + [("format", "x", None, 3)]) == "LRL"
    assert plan(spark, add(4) + [("format", "x", None, 3)] + add(1, 9)) == "LRLR"
    assert plan(spark, add(7)) == "LRLRLR"
    assert plan(spark, add(2) + [("remove", "p0", None, None)]) == "B"


def test_presets(spark):
    texts = {
        '[{"id":"a","name":"n","startingLife":20}]': [("a", "n", 20, 2)], '[{"id":"a","name":"n","startingLife":20,"playerCount":null,"z":1}]': [("a", "n", 20, 2)],
        '[{"id":"a","name":"n","startingLife":20},{"name":"n","startingLife":20}]': [], '[{"id":"a","name":"n","startingLife":20,"playerCount":"4"}]': [],
        '[{"id":"a","name":"n","startingLife":40.0}]': [], '{"id":"a","name":"n","startingLife":40}': [], "[]x": [], "[]": [], "": [], "nonsense": [],
    }
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", presets.decode_presets(F.col("t")).alias("p")).collect()
    assert {r.t: [tuple(x) for x in r.p] for r in rows} == {**texts, None: []}
    base = spark.createDataFrame([(1, i, c, c, 20, 2) for i, c in enumerate("abc")], "owner_id long, pos int, id string, name string, starting_life long, player_count long")
    moves = spark.createDataFrame([(1, 0, 1)], "owner_id long, from_pos int, to_pos int")
    order = lambda df: [r.id for r in df.orderBy("pos").collect()]
    assert order(presets.reorder_presets(base, moves)) == ["b", "a", "c"]
    many = presets.reorder_many(spark.createDataFrame([(1, ["a", "b", "c"])], "owner_id long, items array<string>"), spark.createDataFrame([(1, 0, 0, 2), (1, 1, 0, 1), (1, 2, 5, 0)], "owner_id long, seq long, from_pos int, to_pos int"))
    assert tuple(many.first())[1:] == (["c", "b", "a"], 1)
    changes = spark.createDataFrame([(1, 0, "remove", "a", None, None, None), (1, 1, "add", "a", "a", 20, 2)], "owner_id long, seq long, op string, id string, name string, starting_life long, player_count long")
    assert order(presets.upsert_presets(base, changes)) == ["b", "c", "a"]
    seeded = spark.createDataFrame([(2, "commander")], "owner_id long, id string")
    assert order(presets.seed_defaults(seeded, base.where("false"), presets.default_presets(spark))) == ["standard", "solo"]
    limits = presets.apply_format(spark.createDataFrame([(1, "a"), (2, "b")], "game_id long, format_id string"), spark.createDataFrame([("a", 20, 9), ("b", 20, 0)], "id string, starting_life long, player_count long"))
    assert {r.game_id: r.target_players for r in limits.collect()} == {1: 6, 2: 1}
    assert presets.valid_presets(spark.createDataFrame([("  ", "0", "x")], "name string, life string, count string")).count() == 0


def test_settings(spark):
    rows = spark.createDataFrame([(1, T0, 0, "app.hapticLevel", "high"), (1, T0, 1, "app.themeMode", "sepia"), (1, T0, 2, "app.keepAwake", "maybe")], "user_id long, ts timestamp, seq long, key string, value string")
    got = settings.settings_snapshot(rows).first().asDict()
    assert got == {"user_id": 1, "theme_mode": "system", "color_profile_id": "default", "text_scale": 1.0, "keep_awake": False, "haptic_level": "off", "log_level": "errors", "confirm_new_game": False, "hold_ms": 400, "bad_values": True}
    assert not any(r.theme_changed or r.wake_changed or r.log_changed for r in settings.settings_changes(rows).collect())


def test_logs(spark):
    levels = ["error", "warning", "info", "debug"]
    lines = spark.createDataFrame([(d, x) for d in range(3) for x in levels], "device_id long, level string")
    chosen = spark.createDataFrame([(0, "off"), (1, "errors"), (2, "verbose")], "device_id long, log_level string")
    got = diag.log_level_filter(lines, chosen).groupBy("device_id").count().collect()
    assert {r.device_id: r["count"] for r in got} == {1: 1, 2: 4}
    kib = spark.createDataFrame([(1, i, 300 * 1024) for i in range(3)] + [(2, 0, 524288), (2, 1, 1)], "device_id long, session_no int, bytes long")
    rows = diag.log_rotation(kib).orderBy("device_id", "session_no").collect()
    assert [(r.start_bytes // 1024, r.generation) for r in rows] == [(0, 0), (300, 0), (600, 1), (0, 0), (512, 0)]


def test_rolls(spark):
    r = spark.createDataFrame([(1, i, "die", 20 if i == 6 else 6, 20 if i == 6 else 3, None) for i in range(7)] + [(1, 9, "die", 7, 1, None)], "dialog_id long, seq long, kind string, die int, result int, heads boolean")
    assert [x.text for x in rolls.roll_history(r).orderBy("position").collect()] == ["d20: 20"] + ["d6: 3"] * 4
    assert rolls.roll_summary(r).first().natural_max


def test_wide_maps(spark):
    two = spark.createDataFrame([(1, 0, "A", 1, "leftSide", 40, {"B": 3}), (1, 1, "B", 2, "rightSide", 37, {"A": 0})], "game_id long, slot int, player_id string, color_argb long, seat string, life long, commander_damage map<string,long>")
    more = {r.player_id: r.commander_damage for r in damage.damage_map_add(two, games(spark), F.lit("C")).collect()}
    assert more == {"A": {"B": 3, "C": 0}, "B": {"A": 0, "C": 0}, "C": {"A": 0, "B": 0}}
    gone = spark.createDataFrame([(1, "B")], "game_id long, player_id string")
    assert [(r.player_id, r.commander_damage) for r in damage.damage_map_remove(two, gone).collect()] == [("A", {})]


def test_small_functions(spark):
    row = spark.range(1).select(fn.pending_label(F.lit(5)).alias("a"), fn.pending_label(F.lit(-3)).alias("b"), fn.pending_label(F.lit(0)).alias("c"), fn.hold_sensitivity(F.lit(300)).alias("d")).first()
    assert tuple(row) == ("+5", "-3", None, "medium")


def test_one_shuffle_of_the_log(spark):
    sf = "/root/testdata/sf0.001"
    df = damage.with_applied(actions.last_epoch(td.game_log(spark, sf))).groupBy("game_id", "player_id").agg(F.sum(life.effective()).alias("change"))
    text = df._jdf.queryExecution().executedPlan().toString()
    assert text.split("== Initial Plan ==")[-1].count("Exchange ") == 1


def test_sink_and_reader(spark, tmp_path):
    rows = log(spark, [change(1), hit(2)])
    sources.write_table(rows, str(tmp_path / "log"), ["game_id"])
    assert sources.read_game_log(spark, str(tmp_path / "log")).orderBy("seq").select("seq", "delta").collect() == rows.orderBy("seq").select("seq", "delta").collect()


def test_profile_of_a_user_without_rows(spark):
    users = spark.createDataFrame([(1,), (1,), (2,)], "user_id long")
    none = spark.createDataFrame([], "user_id long, ts timestamp, seq long, key string, value string")
    rows = settings.settings_profiles(none, users).collect()
    assert len(rows) == 2
    for r in rows:
        assert (r.theme_mode, r.color_profile_id, r.text_scale, r.keep_awake, r.haptic_level, r.log_level) == ("system", "default", 1.0, False, "off", "errors")
        assert (r.confirm_new_game, r.hold_ms, r.bad_values, r.player_colors, r.colors_malformed, r.format_presets) == (False, 400, False, PALETTE, False, [])


def test_broken_records_are_kept_apart(spark, tmp_path):
    good = '{"game_id":1,"seq":1,"ts":"2024-01-01T00:00:00.123456Z","action":"life","player_id":"A","delta":-1}'
    bad = ["{", "[1]", "", good.replace("life", "lives"), good.replace('"delta":-1', '"delta":"x"'), good.replace(',"delta":-1', ""), good.replace('"game_id":1,', ""), good.replace('"seq":1,', ""),
        '{"game_id":1,"seq":2,"action":"seat_move","player_id":"A","seat":"roof"}', '{"game_id":1,"seq":2,"action":"set_effect","player_id":"A"}', '{"game_id":1,"seq":2,"action":"life","delta":1}']
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text("\n".join([good, *bad, good.replace('"seq":1', '"seq":3,"more":[1]')]))
    kept, rest = sources.read_game_log_with_rest(spark, str(tmp_path / "log"))
    assert sorted(r.seq for r in kept.collect()) == [1, 3] and kept.columns == [x.split()[0] for x in GAME_LOG.split(", ")]
    assert kept.where("seq = 1").first().ts.microsecond == 123456
    reasons = sorted(r.reason for r in rest.collect())
    assert reasons == sorted(["unreadable"] * 3 + ["unknown action", "no delta", "no game", "no seq", "unknown seat", "no effect", "no player"])
    assert all(r.record for r in rest.collect())
    assert sources.read_game_log(spark, str(tmp_path / "log"), form="json").count() == 2
    sources.quarantine(rest, str(tmp_path / "rest"))
    sources.quarantine(rest, str(tmp_path / "rest"))
    assert spark.read.parquet(str(tmp_path / "rest")).where("reason = 'no game'").count() == 2
    (tmp_path / "settings").mkdir()
    (tmp_path / "settings" / "a.json").write_text('{"user_id":1,"ts":"2024-01-01T00:00:00Z","seq":1,"key":"app.themeMode","value":"dark"}\n{"user_id":1}\nx')
    kept, rest = sources.read_settings_log_with_rest(spark, str(tmp_path / "settings"))
    assert kept.count() == 1 and sorted(r.reason for r in rest.collect()) == ["no key", "unreadable"]
    assert sources.read_settings_log(spark, str(tmp_path / "settings"), form="json").first().value == "dark"
