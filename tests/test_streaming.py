"""Streams that are run to the end of their input against the batch operators."""

from __future__ import annotations

import datetime
import glob
import os
import random
import time
from typing import NamedTuple

import pytest
from pyspark.sql import Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import TimerValues

from tabletide import sources, streaming
from tabletide import testdata as td
from tabletide.operators import actions, damage, effects, life
from tabletide.plans import queries as plans
from tabletide.schemas import GAME_LOG
from tabletide.streaming.state import GameState

SF = "/root/testdata/sf0.001"


class Moment(NamedTuple):
    ts: datetime.datetime


def in_files(spark, parts, tmp_path):
    """A folder with a file for each part, in this order of time."""
    folder = tmp_path / "files"
    folder.mkdir()
    for k, rows in enumerate(parts):
        out = tmp_path / f"part{k}"
        spark.createDataFrame([tuple(r) for r in rows], GAME_LOG).coalesce(1).write.parquet(str(out))
        (file,) = out.glob("*.parquet")
        file.rename(folder / f"{k:03}.parquet")
        os.utime(folder / f"{k:03}.parquet", (10**9 + k, 10**9 + k))
    return str(folder)


def wait_until(test):
    """Progress events come a little after a query's end."""
    for _ in range(100):
        if test():
            return
        time.sleep(0.1)
    raise AssertionError("no such progress")


def stored(spark, tmp_path, where="true"):
    path = str(tmp_path / "log")
    td.game_log(spark, SF).where(where).repartition(3).write.parquet(path)
    return path, sources.read_game_log(spark, path, streaming=True)


def ran(spark, df, tmp_path, mode):
    out = str(tmp_path / "out")
    sources.write_stream(df, out, str(tmp_path / "cp"), mode).awaitTermination()
    return spark.read.parquet(out)


def test_life_totals(spark, tmp_path):
    path, stream = stored(spark, tmp_path, "action = 'life'")
    got = ran(spark, streaming.stream_life_totals(stream), tmp_path, "update").groupBy("game_id", "player_id").agg(F.max_by("life", "batch").alias("life"))
    want = life.life_sums(sources.read_game_log(spark, path).select("game_id", "player_id", "delta"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_sessions_add_up(spark, tmp_path):
    """Closed sessions, open ones and rows dropped as late are the whole input, and closed and open ones are the batch's."""
    log = td.game_log(spark, SF).where("action = 'life'").orderBy("seq").collect()
    third = len(log) // 3
    late = (log[3].game_id, 10**6, *log[3][2:])
    parts = [log[:third], log[third : 2 * third], [*log[2 * third :], late]]
    folder = in_files(spark, parts, tmp_path)
    account = streaming.Account()
    spark.streams.addListener(account)
    stream = streaming.stream_pending_delta(sources.read_game_log(spark, folder, streaming=True, files_per_batch=1), "6 hours")
    query = sources.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "append")
    query.awaitTermination()
    wait_until(lambda: account.counts.get(str(query.id), {}).get("pending.rows", 0) >= len(log) + 1)
    spark.streams.removeListener(account)
    closed = spark.read.parquet(str(tmp_path / "out"))
    still = streaming.open_sessions(spark, str(tmp_path / "cp"))
    counts = account.counts[str(query.id)]
    rows = lambda df: df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    assert counts["input"] == counts["pending.rows"] == len(log) + 1 == rows(closed) + rows(still) + counts["dropped"]
    assert counts["dropped"] == 1 and still.count() > 0
    batch = spark.createDataFrame(log, GAME_LOG)
    want = {tuple(r) for r in life.pending_sessions(batch, "6 hours").select("game_id", "player_id", "start", "pending", "n").collect()}
    assert {tuple(r) for r in closed.unionByName(still).collect()} == want


def test_current_effects(spark, tmp_path):
    path, stream = stored(spark, tmp_path)
    got = ran(spark, streaming.stream_current_effects(stream), tmp_path, "update")
    last = got.withColumn("r", F.row_number().over(Window.partitionBy("game_id", "effect_type").orderBy(F.desc("batch")))).where("r = 1")
    rows = sources.read_game_log(spark, path).where("action in ('set_effect', 'clear_effect')").orderBy("seq").collect()
    want = {(r.game_id, r.effect_type): r.player_id if r.action == "set_effect" else None for r in rows}
    assert {(r.game_id, r.effect_type): r.player_id for r in last.collect()} == want


def splits(rows, seed):
    """A log in several files, in order of time but for rows that are near each other."""
    r = random.Random(seed)
    rows = sorted(rows, key=lambda x: x.ts.timestamp() + r.uniform(0, 12 * 3600))
    cuts = sorted(r.sample(range(1, len(rows)), [0, 2, 9][seed]))
    return [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]


def end_of(rows, game=-1):
    """A row so late that the watermark passes all others."""
    last = max(r.ts for r in rows)
    return (game, 10**9, last + datetime.timedelta(days=3), "pick_open", *[None] * 6)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_game_state_of_any_split(spark, tmp_path, seed):
    log = td.game_log(spark, SF)
    rows = log.collect()
    parts = splits(rows, seed)
    parts.append([end_of(rows)])
    folder = in_files(spark, parts, tmp_path)
    stream = streaming.stream_game_state(sources.read_game_log(spark, folder, streaming=True, files_per_batch=1), idle="1000 days", lateness="1 day")
    sources.write_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = sources.newest(sources.read_batches(spark, str(tmp_path / "out")), ["game_id"]).where("game_id >= 0").collect()
    totals = {(r.game_id, r.player_id): r.life for r in life.life_totals(log, td.games(spark, SF), td.roster(spark, SF)).collect()}
    cells = {(r.game_id, r.player_id, r.source_id): r.damage for r in damage.commander_damage_matrix(log, td.roster(spark, SF)).collect()}
    held = {}
    for r in effects.current_effects(log, effects.registry(spark)).orderBy("game_id", "position").collect():
        held.setdefault((r.game_id, r.player_id), []).append(r.effect_type)
    epochs = {r.game_id: (r.e, r.s, r.n) for r in actions.game_epochs(log).groupBy("game_id").agg(F.max("epoch").alias("e"), F.max("seq").alias("s"), F.count("*").alias("n")).collect()}
    assert {r.game_id: (r.epoch, r.seq, r.applied) for r in got} == epochs and not any(r.late or r.evicted for r in got)
    found = {(r.game_id, r.player_id): r for r in got if r.player_id is not None}
    for key, total in totals.items():
        r = found.pop(key, None)
        assert total == 40 + (r.life_change if r else 0)
        assert {k[2]: v for k, v in cells.items() if k[:2] == key and v} == ({a: v for a, v in r.damage.items() if v} if r else {})
        assert ",".join(held.get(key, [])) == (r.effects if r else "")
        assert (r.damage_taken if r else 0) == sum(v for k, v in cells.items() if k[:2] == key)
    assert not found


def test_late_and_repeated_actions_are_counted(spark, tmp_path):
    t = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    hit = lambda seq, h: (1, seq, t(h), "life", "A", None, 1, None, None, None)
    parts = [[hit(1, 0), hit(2, 1), hit(2, 1)], [hit(4, 10)], [hit(3, 9.95)], [(2, 1, t(40), "reset", *[None] * 6)], [hit(5, 9), hit(3, 60), hit(9, 61)], [end_of([Moment(t(200))])]]
    folder = in_files(spark, parts, tmp_path)
    account = streaming.Account()
    spark.streams.addListener(account)
    stream = streaming.stream_game_state(sources.read_game_log(spark, folder, streaming=True, files_per_batch=1), idle="2 days", lateness="10 minutes")
    query = sources.write_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    wait_until(lambda: account.counts.get(str(query.id), {}).get("input", 0) >= 10)
    spark.streams.removeListener(account)
    rows = sources.read_batches(spark, str(tmp_path / "out")).where("game_id = 1").orderBy("batch", "evicted").collect()
    # seq 2 is there twice, seq 5 is below the watermark, the second seq 3 has been passed; 1, 2, 3, 4 and 9 count
    assert rows[-1].evicted and (rows[-1].life_change, rows[-1].applied, rows[-1].late, rows[-1].seq) == (5, 5, 2, 9)
    assert account.counts[str(query.id)]["dropped"] == 1
    # the reset of game 2 leaves a row without a player
    other = sources.read_batches(spark, str(tmp_path / "out")).where("game_id = 2").orderBy("batch", "evicted").collect()
    assert [(r.player_id, r.epoch, r.evicted) for r in other] == [(None, 1, False), (None, 1, True)]


def test_state_stays_small(spark, tmp_path):
    """Keys that come and go: the state holds the recent ones only, and evicted and present changes add up."""
    t = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    parts = [[(10 * k + g, k, t(k), "life", "A", None, g + 1, None, None, None) for g in range(10)] + [(5, 1000 + k, t(k), "life", "B", None, 1, None, None, None)] for k in range(0, 60, 5)]
    parts.append([(10**6, 10**9, t(200), "life", "Z", None, 1, None, None, None)])
    folder = in_files(spark, parts, tmp_path)
    log = sources.read_game_log(spark, folder, streaming=True, files_per_batch=1)
    query = sources.write_batches(streaming.stream_life_totals(log, idle="8 hours"), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    sizes = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert len(sizes) > 10 and max(sizes) <= 40  # of 132 keys in all
    rows = sources.read_batches(spark, str(tmp_path / "out"))
    gone = {(r.game_id, r.player_id): r.s for r in rows.where("evicted").groupBy("game_id", "player_id").agg(F.sum("change").alias("s")).collect()}
    want = {}
    for g, _, _, _, p, _, d, *_ in [x for part in parts[:-1] for x in part]:
        want[g, p] = want.get((g, p), 0) + d
    assert gone == want
    assert rows.where("life <> 40 + change").count() == 0


def test_effects_leave_the_state(spark, tmp_path):
    t = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    mark = lambda g, seq, h, kind, p: (g, seq, t(h), kind, p, None, None, "monarch", None, None)
    parts = [[mark(1, 1, 0, "set_effect", "A"), mark(1, 3, 0.1, "set_effect", "B"), mark(1, 2, 0.05, "set_effect", "C"), mark(2, 1, 0, "set_effect", "A")], [mark(2, 2, 1, "clear_effect", None)], [mark(3, 1, 30, "set_effect", "Z")], [mark(4, 1, 90, "set_effect", "Z")]]
    folder = in_files(spark, parts, tmp_path)
    log = sources.read_game_log(spark, folder, streaming=True, files_per_batch=1)
    sources.write_batches(streaming.stream_current_effects(log, idle="8 hours"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    rows = sources.read_batches(spark, str(tmp_path / "out"))
    assert {(r.game_id, r.player_id, r.seq) for r in rows.where("evicted").collect()} == {(1, "B", 3), (2, None, 2), (3, "Z", 1)}


def test_a_repeated_batch_leaves_the_same_table(spark, tmp_path):
    path = str(tmp_path / "table")
    write = sources.batch_sink(path, ["kind"])
    frame = lambda rows: spark.createDataFrame(rows, "id long, kind string")
    write(frame([(1, "a"), (2, "b")]), 0)
    write(frame([(3, "a"), (4, "c")]), 1)
    write(frame([(3, "a"), (4, "d")]), 1)  # again, with another partition
    got = lambda: sorted((r.id, r.kind, r.batch) for r in sources.read_batches(spark, path).collect())
    assert got() == [(1, "a", 0), (2, "b", 0), (3, "a", 1), (4, "d", 1)]
    frame([(9, "z")]).withColumns({"batch": F.lit(2), "attempt": F.lit("x")}).write.mode("append").partitionBy("batch", "attempt", "kind").parquet(f"{path}/rows")
    assert len(got()) == 4  # rows without a line of the manifest aren't seen
    assert {(r.batch, r.rows) for r in spark.read.parquet(f"{path}/manifest").collect()} == {(0, 2), (1, 2)}
    assert sorted((r.id, r.kind) for r in sources.newest(sources.read_batches(spark, path), ["kind"]).collect()) == [(2, "b"), (3, "a"), (4, "d")]


class Held:
    """A state variable of a fake handle, which counts the actions that are read from it and written to it."""

    def __init__(self, counts):
        self.rows, self.counts = [], counts

    def count(self, rows):
        self.counts.append(sum(len(r[0]) if isinstance(r[0], list) else 1 for r in rows))
        return rows

    def exists(self):
        return bool(self.rows)

    def clear(self):
        self.rows = []

    def appendList(self, rows):  # noqa: N802
        self.rows += self.count(rows)

    def put(self, rows):
        self.rows = self.count(list(rows))

    def get(self):
        return iter(self.count(self.rows))


class Value(Held):
    def update(self, row):
        self.rows = [row]

    def get(self):
        return self.rows[0] if self.rows else None


class Cells(dict):
    iterator = dict.items
    updateValue = dict.__setitem__  # noqa: N815


class Handle:
    def __init__(self):
        self.counts, self.timers = [], set()
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.discard  # noqa: N815

    def getValueState(self, name, schema):  # noqa: N802
        return Value(self.counts)

    def getListState(self, name, schema):  # noqa: N802
        return Held(self.counts)

    def getMapState(self, name, key, schema):  # noqa: N802
        return Cells()


def test_a_batch_costs_what_it_brings():
    """Actions that wait are written once and read once, however many batches come before the watermark passes them."""
    at = lambda mark: TimerValues(0, mark)
    row = lambda k: Row(seq=k, ms=1000 + k, action="life", player_id="A", source_id=None, delta=1, effect_type=None, what='{"action":"life","player_id":"A","delta":1}')
    handle, game = Handle(), GameState(10**6)
    game.init(handle)
    for k in range(100):
        assert not list(game.handleInputRows((1,), iter([row(k), row(k)]), at(0)))
    assert handle.timers == {1000}
    (said,) = game.handleExpiredTimer((1,), at(5000), None)
    assert (said.life_change, said.applied, said.late, said.seq) == (100, 100, 100, 99)
    assert sum(handle.counts) <= 400  # 5,000 writes and as many reads when each batch rewrites what waits


def test_the_closing_row_is_the_newest_file(spark):
    """A log of slow files: a stream takes files by age, and a closing row in an earlier batch would make the others late."""

    def slowly(frames):
        time.sleep(1.5)
        yield from frames

    rows = td.game_log(spark, SF).repartition(3).mapInPandas(slowly, GAME_LOG)
    folder = plans.files_of(rows, "closed").removeprefix("file:")
    found = sorted(((os.stat(f).st_mtime_ns, f) for f in glob.glob(f"{folder}/*.parquet")))
    kinds = [{r.game_id < 0 for r in spark.read.parquet(f).select("game_id").distinct().collect()} for _, f in found]
    assert kinds == [{False}] * (len(kinds) - 1) + [{True}] and len(kinds) >= 2
