"""What is computed by blocks and in closed form against small sequential models, on seeded random logs."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tabletide.operators import actions, damage, diag, life, presets, scans
from tabletide.schemas import GAME_LOG
from tests.test_rules import T0, games, roster

NAMES = [x.split()[0] for x in GAME_LOG.split(", ")]


class Game:
    """A game, action by action."""

    def __init__(self, start: int) -> None:
        self.start, self.epoch = start, 0
        self.clear()

    def clear(self):
        self.life, self.cells = {}, {}

    def act(self, a):
        if a["action"] in ("new_game", "reset"):
            self.epoch += 1
            self.start = a.get("starting_life") or self.start
            self.clear()
        elif a["action"] == "life":
            self.life[a["player_id"]] = self.life.get(a["player_id"], 0) + a["delta"]
        elif a["action"] == "cmd_damage":
            cell = (a["player_id"], a["source_id"])
            now = self.cells.get(cell, 0)
            self.cells[cell] = max(0, now + a["delta"])
            applied = self.cells[cell] - now
            self.life[a["player_id"]] = self.life.get(a["player_id"], 0) - applied
            return applied, self.cells[cell]
        return None


def random_log(seed, game, n, starts=0.02, gap=3):
    r, seq, rows = random.Random(seed), 0, []
    for _ in range(n):
        seq += r.randint(1, gap) if r.random() < 0.98 else 5000  # clustered and spread
        kind = "new_game" if r.random() < starts / 2 else "reset" if r.random() < starts / 2 else r.choice(["life", "cmd_damage", "cmd_damage", "pick_open"])
        a = {"game_id": game, "seq": seq, "ts": T0, "action": kind}
        if kind in ("life", "cmd_damage"):
            a |= {"player_id": r.choice("ABC"), "delta": r.choice([-1, 1, -10, 10, 3])}
        if kind == "cmd_damage":
            a["source_id"] = r.choice(["A", "B", None])
        if kind == "new_game":
            a["starting_life"] = r.choice([20, 40, 30])
        rows.append(a)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([tuple(a.get(n) for n in NAMES) for a in rows], GAME_LOG).repartition(7)


@pytest.mark.parametrize("starts", [0.02, 0.0])
def test_one_large_game(spark, starts):
    rows = random_log(1, 1, 3000, starts) + random_log(2, 2, 20)
    log, model, want = frame(spark, rows), {}, {}
    for a in rows:
        g = model.setdefault(a["game_id"], Game(40))
        if (found := g.act(a)) is not None:
            want[a["game_id"], a["seq"]] = (g.epoch, *found)
    cut = scans.in_blocks(log, 100)
    sizes = {(r.game_id, r.block): r["count"] for r in cut.groupBy("game_id", "block").count().collect()}
    assert len([k for k in sizes if k[0] == 1]) > 10 and max(sizes.values()) < 400 and sizes[2, 0] == 20
    got = {(r.game_id, r.seq): (r.epoch, r.applied, r.damage) for r in scans.damage_timeline_in_blocks(log, 100).collect()}
    assert got == want
    people = roster(spark, ["leftSide", "rightSide", "topEdge"]).unionByName(roster(spark, ["leftSide", "rightSide"], 2))
    both = spark.createDataFrame([(1, 40, 3), (2, 40, 2)], "game_id long, starting_life long, n_players int")
    totals = {(r.game_id, r.player_id): r.life for r in scans.life_totals_in_blocks(log, both, people, 100).collect()}
    assert totals == {(g, p): m.start + m.life.get(p, 0) for g, m in model.items() for p in ("ABC" if g == 1 else "AB")}
    cells = {(r.game_id, r.player_id, r.source_id): r.damage for r in scans.damage_matrix_in_blocks(log, people, 100).collect()}
    assert cells == {(g, a, b): m.cells.get((a, b), 0) for g, m in model.items() for a in ("ABC" if g == 1 else "AB") for b in ("ABC" if g == 1 else "AB") if a != b}
    assert sorted(map(tuple, life.life_totals(log, both, people).collect())) == sorted((*k, v) for k, v in totals.items())
    plain = damage.commander_damage_matrix(log, people, floored=False).collect()
    sums = {}
    for a in rows:
        g, at = model[a["game_id"]], (a["game_id"], a.get("player_id"), a.get("source_id"))
        if a["action"] in ("new_game", "reset"):
            sums = {k: v for k, v in sums.items() if k[0] != a["game_id"]}
        elif a["action"] == "cmd_damage":
            sums[at] = sums.get(at, 0) + a["delta"]
    assert {(r.game_id, r.player_id, r.source_id): r.damage for r in plain} == {k: sums.get(k, 0) for k in cells}


def test_absorbed_inputs_do_not_count(spark):
    rows = [{"action": "pick_open"}, {"action": "life", "player_id": "A", "delta": -3}, {"action": "pick_close"}, {"action": "life", "player_id": "A", "delta": -2}]
    log = frame(spark, [{"game_id": 1, "seq": i, "ts": T0, **a} for i, a in enumerate(rows)])
    people = roster(spark, ["leftSide", "rightSide"])
    got = {r.player_id: r.life for r in life.life_totals(log, games(spark), people, apply_absorption=True).collect()}
    assert got == {"A": 38, "B": 40}


def test_blocks_of_empty_and_null(spark):
    none = frame(spark, [{"game_id": None, "seq": 1, "ts": T0, "action": "life", "player_id": "A", "delta": 1}])
    assert scans.damage_timeline_in_blocks(none.where("false")).count() == 0
    assert scans.epochs_in_blocks(none).count() == 0


@pytest.mark.parametrize(("most", "group"), [(1000, 256), (50, 7)])
def test_roster_changes(spark, most, group):
    r = random.Random(4)
    rows, want = [], {}
    for game, n, start in ((1, 900, 4), (2, 30, 6), (3, 5, None)):
        now = start or 1
        for seq in range(n):
            kind = r.choices(["add_player", "remove_player", "new_game", "reset", "life"], [50, 50 if seq % 100 < 60 else 10, 1, 2, 5])[0]
            rows.append({"game_id": game, "seq": seq * 3, "ts": T0, "action": kind, "player_id": f"p{seq}"})
            before = now
            now = min(6, now + 1) if kind == "add_player" else max(1, now - 1) if kind == "remove_player" else (start or now) if kind == "new_game" else now
            if kind in ("add_player", "remove_player"):
                want[game, seq * 3] = (before, now, before == now)
    known = spark.createDataFrame([(1, 40, 4), (2, 40, 6)], "game_id long, starting_life long, n_players int")
    got = scans.roster_changes(frame(spark, rows), known, most, group).collect()
    assert {(x.game_id, x.seq): (x.n_before, x.n_after, x.refused) for x in got} == want and len(got) == len(want)
    assert any(x.refused for x in got)
    checked = actions.valid_roster_changes(spark.createDataFrame(got).withColumnRenamed("n_before", "n_players"))
    assert checked.count() == sum(not x[2] for x in want.values())


class Presets:
    """One owner's list, edit by edit."""

    def __init__(self, items):
        self.items = list(items)

    def edit(self, op, item, a=None, b=None):
        ids = [x[0] for x in self.items]
        if op == "add":
            self.items.append(item)
        elif op == "update" and item[0] in ids:
            self.items[ids.index(item[0])] = item
        elif op == "remove":
            self.items = [x for x in self.items if x[0] != item[0]]
        elif op == "move" and 0 <= a < len(ids) and 0 <= b < len(ids):
            x = self.items.pop(a)
            self.items.insert(b, x)


OLD = "owner_id long, pos int, id string, name string, starting_life long, player_count long"
EDIT = "owner_id long, seq long, op string, id string, name string, starting_life long, player_count long, from_pos int, to_pos int"


def owners(seed, moves):
    r = random.Random(seed)
    old, edits, model = [], [], {}
    for o in range(40):
        items = [(r.choice("abc"), f"old{i}", i, 2) for i in range(r.randint(0, 4))]
        old += [(o, i, *x) for i, x in enumerate(items)]
        model[o] = Presets(items)
        for seq in range(r.randint(0, 15)):
            op = r.choice(["add", "update", "update", "remove", *(["move"] * 2 if moves else [])])
            item, a, b = (r.choice("abcd"), None if r.random() < 0.1 else f"n{seq}", seq, seq % 7), r.randint(-1, 4), r.randint(0, 5)
            edits.append((o, seq, op, *item, a, b))
            model[o].edit(op, item, a, b)
    # update after remove, add then remove, several updates of an id, an owner without presets
    for o, ops in ((100, "add remove update"), (101, "add update update"), (102, "update add add remove add"), (103, "update")):
        model[o] = Presets([])
        for seq, op in enumerate(ops.split()):
            item = ("z", f"{op}{seq}", seq, 1)
            edits.append((o, seq, op, *item, 0, 0))
            model[o].edit(op, item)
    return old, edits, sorted((o, i, *x) for o, m in model.items() for i, x in enumerate(m.items))


def by_place(df):
    return sorted(map(tuple, df.select(*[x.split()[0] for x in OLD.split(", ")]).collect()), key=lambda x: x[:2])


def test_preset_edits(spark):
    old, edits, want = owners(5, False)
    want.sort(key=lambda x: x[:2])
    before, told = spark.createDataFrame(old, OLD), spark.createDataFrame(edits, EDIT)
    assert by_place(presets.replay_presets(before, told)) == want
    assert by_place(presets.replay_lists(before, told)) == want
    assert by_place(presets.replay_presets(before, told.where("false"))) == sorted(old, key=lambda x: x[:2])


def test_preset_edits_with_moves(spark):
    old, edits, want = owners(6, True)
    assert by_place(presets.replay_lists(spark.createDataFrame(old, OLD), spark.createDataFrame(edits, EDIT))) == sorted(want, key=lambda x: x[:2])


def test_pending_changes_against_the_model(spark):
    r, rows, want, state = random.Random(12), [], {}, {}
    at = T0
    for seq in range(400):
        at += datetime.timedelta(microseconds=r.choice([10**6, 5 * 10**6, 5 * 10**6 + 1, 9 * 10**6]))
        kind = r.choice(["life", "cmd_damage", "life", "cmd_damage", "reset" if r.random() < 0.1 else "life"])
        a = {"game_id": 1, "seq": seq, "ts": at, "action": kind}
        if kind == "reset":
            state = {}
        else:
            a |= {"player_id": r.choice("AB"), "delta": r.choice([-3, 1, 5, -1]), "source_id": "C" if kind == "cmd_damage" else None}
            s = state.setdefault((a["player_id"], a["source_id"]), {"cell": 0, "pending": 0, "last": None})
            change = a["delta"] if kind == "life" else max(a["delta"], -s["cell"])
            s["cell"] += change
            if kind == "life" or change:
                s["pending"] = change + (s["pending"] if s["last"] and at <= s["last"] + datetime.timedelta(seconds=5) else 0)
                s["last"], want[seq] = at, s["pending"]
        rows.append(a)
    assert {x.seq: x.pending for x in life.pending_delta(frame(spark, rows)).collect()} == want


def test_several_moves_against_the_model(spark):
    r, lists, moves, want = random.Random(13), [], [], {}
    for o in range(30):
        items = [f"{o}-{i}" for i in range(r.randint(0, 6))]
        lists.append((o, list(items)))
        errors = 0
        for seq in range(r.randint(0, 8)):
            a, b = r.randint(-1, 6), r.randint(-1, 6)
            moves.append((o, seq, a, b))
            if 0 <= a < len(items) and 0 <= b < len(items):
                items.insert(b, items.pop(a))
            else:
                errors += 1
        want[o] = (items, errors)
    got = presets.reorder_many(spark.createDataFrame(lists, "owner_id long, items array<string>"), spark.createDataFrame(moves, "owner_id long, seq long, from_pos int, to_pos int")).collect()
    assert {x.owner_id: (list(x["items"]), x.errors) for x in got} == want


@pytest.mark.parametrize(("most", "group"), [(1 << 18, 4096), (30, 8)])
def test_rotation_against_the_model(spark, most, group):
    r = random.Random(8)
    rows = [(d, s * 2, r.choice([0, 0, 1, 5, 40, 101, 350, None])) for d, n in ((1, 400), (2, 9), (3, 1)) for s in range(n)]
    want, state = {}, {}
    for d, s, b in rows:
        size, generation = state.get(d, (0, 0))
        rotated = size > 100
        want[d, s] = (size, rotated, generation + rotated)
        state[d] = ((0 if rotated else size) + (b or 0), generation + rotated)
    df = spark.createDataFrame(rows, "device_id long, session_no int, bytes long").repartition(5)
    got = {(x.device_id, x.session_no): (x.start_bytes, x.rotated, x.generation) for x in diag.log_rotation(df, 100, most, group).collect()}
    assert got == want
    assert diag.log_rotation(df.where("false"), 100, most, group).count() == 0


def test_pointers_are_doubled_once(spark, monkeypatch):
    """A list's rounds of doubling are written out once in a plan, not anew for each use of the round before."""
    plans, stored = [], diag.stored

    def seen(df, tag):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stored(df, tag)

    monkeypatch.setattr(diag, "stored", seen)
    rows = [(d, s, 7 * s % 60) for d in (1, 2) for s in range(40)]
    diag.log_rotation(spark.createDataFrame(rows, "device_id long, session_no int, bytes long"), 100, 30, 8).count()
    doubled = [p.count("lambdafunction(") for p in plans if "Generate" in p]
    assert doubled and all(0 < n <= 8 for n in doubled), doubled  # 21 as columns on columns
