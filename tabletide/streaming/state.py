"""Keyed state of the streams: what a game, a player's life and an effect keep between batches, in typed state variables
with event-time timers. A key has one timer at a time: the next moment at which something is due."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

NEVER = -1
GAME = (
    "game_id long, seq long, epoch long, player_id string, life_change long, damage_taken long, damage map<string,long>, effects string, "
    "applied long, late long, evicted boolean"
)
LIFE = "game_id long, player_id string, life long, change long, n long, began_us long, evicted boolean"
#: Actions that wait, what they do as JSON, and a game's maps of life changes, damage and effects.
WAITING = "seq array<bigint>, ms array<bigint>, what array<string>"
DOES = ("action", "player_id", "source_id", "delta", "effect_type")
TABLE = (
    "life_player array<string>, life array<bigint>, damage_player array<string>, damage_source array<string>, damage array<bigint>, "
    "effect_type array<string>, effect_player array<string>, effect_seq array<bigint>"
)
PIECE = 4096
HOLDER = "game_id long, effect_type string, player_id string, seq long, evicted boolean"


class Expiring(StatefulProcessor):
    """A key that leaves the state, with a last row that says so, when the watermark is idle_ms past its newest row."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def timed(self, old: int, new: int) -> int:
        """One timer in place of another; times in milliseconds."""
        if old != new:
            if old != NEVER:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(new)
        return new

    def close(self) -> None:
        pass


class LifeState(Expiring):
    """Sum of changes of a player since the key came into the state."""

    def __init__(self, idle_ms: int, start: int) -> None:
        super().__init__(idle_ms)
        self.start = start

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.sum = handle.getValueState("sum", "change long, n long, began_us long, last_ms long, timer long")

    def told(self, key: tuple, change: int, n: int, began: int, evicted: bool) -> Row:
        return Row(game_id=key[0], player_id=key[1], life=self.start + change, change=change, n=n, began_us=began, evicted=evicted)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        change, n, began, last, timer = self.sum.get() if self.sum.exists() else (0, 0, None, NEVER, NEVER)
        for r in rows:
            change, n, last = change + (r.change or 0), n + 1, max(last, r.ms)
            began = r.us if began is None else min(began, r.us)
        self.sum.update((change, n, began, last, self.timed(timer, last + self.idle_ms)))
        yield self.told(key, change, n, began, False)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N802, N803
        if self.sum.exists():
            change, n, began, *_ = self.sum.get()
            self.sum.clear()
            yield self.told(key, change, n, began, True)


class EffectState(Expiring):
    """The last change of an effect by seq."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "player_id string, seq long, last_ms long, timer long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        holder, seq, last, timer = self.last.get() if self.last.exists() else (None, NEVER, NEVER, NEVER)
        for r in rows:
            last = max(last, r.ms)
            if r.seq > seq:
                holder, seq = r.player_id if r.action == "set_effect" else None, r.seq
        self.last.update((holder, seq, last, self.timed(timer, last + self.idle_ms)))
        yield Row(game_id=key[0], effect_type=key[1], player_id=holder, seq=seq, evicted=False)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N802, N803
        if self.last.exists():
            holder, seq, *_ = self.last.get()
            self.last.clear()
            yield Row(game_id=key[0], effect_type=key[1], player_id=holder, seq=seq, evicted=True)


class GameState(Expiring):
    """The whole fold of a game. Actions wait in a list until the watermark has passed them, and are then applied in order of
    seq, so the state doesn't depend on how the log is cut into batches. An action that can't be applied any more (its
    seq has been passed or is there twice) is counted in late.

    What comes in is appended in pieces of PIECE actions at most, a column an array, and what waits is read only when something is due: a
    batch costs what it brings, however much waits, and a call of the store is made for a piece or a table, not for a row or a cell.
    What an action does is one text (`what`) until it is applied, for each column of a row costs a worker about as much as that."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.progress = handle.getValueState("progress", "epoch long, seq long, applied long, late long, last_ms long, due long, timer long")
        self.waiting = handle.getListState("waiting", WAITING)
        self.table = handle.getValueState("table", TABLE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        epoch, seq, applied, late, last, due, timer = self.progress.get() or (0, NEVER, 0, 0, NEVER, NEVER, NEVER)
        came = []
        for r in rows:
            k, ms = r.seq, r.ms  # a row's fields are searched by name
            if ms > last:
                last = ms
            if k <= seq:
                late += 1
            else:
                came.append((k, ms, r.what))
        first = min((w[1] for w in came), default=NEVER)
        mark = timerValues.getCurrentWatermarkInMs()
        if NEVER < first <= mark or NEVER < due <= mark:
            return self.settle(key, came, (epoch, seq, applied, late, last, due, timer), mark, False)
        if came:
            self.waiting.appendList(pieces(came))
            due = first if due == NEVER else min(due, first)
        self.keep((epoch, seq, applied, late, last, due, timer))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N802, N803
        found = self.progress.get()
        if not found:
            return iter(())
        return self.settle(key, [], (*found[:-1], NEVER), timerValues.getCurrentWatermarkInMs(), True)

    def keep(self, progress: tuple) -> None:
        """The game's progress, with a timer at the first waiting action or else where the game is idle."""
        *said, last, due, timer = progress
        end = last + self.idle_ms
        self.progress.update((*said, last, due, self.timed(timer, end if due == NEVER else min(due, end))))

    def settle(self, key: tuple, came: list[tuple], progress: tuple, mark: int, expired: bool) -> Iterator[Row]:
        epoch, seq, applied, late, last, due, timer = progress
        held: dict[int, tuple] = {}
        for w in chain((w for piece in (self.waiting.get() if due != NEVER else ()) for w in zip(*piece, strict=True)), came):
            if w[0] in held:
                late += 1
            else:
                held[w[0]] = w
        ready = sorted(w for w in held.values() if w[1] <= mark)
        rest = sorted(w for w in held.values() if w[1] > mark)
        out: list[Row] = []
        ends = expired and not rest and mark >= last + self.idle_ms
        if ready or ends:
            life, damage, effects = opened(self.table.get())
            for w in ready:
                if w[0] <= seq:  # its time has come after that of a later action
                    late += 1
                else:
                    epoch, seq, applied = epoch + apply(life, damage, effects, w[0], json.loads(w[2])), w[0], applied + 1
            out = told(key[0], seq, epoch, applied, late, life, damage, effects, ends)
            if not ends:
                self.table.update(closed(life, damage, effects))
        if ends:
            for state in (self.progress, self.waiting, self.table):
                state.clear()
            return iter(out)
        if rest:
            self.waiting.put(pieces(rest))
        elif due != NEVER:
            self.waiting.clear()
        self.keep((epoch, seq, applied, late, last, min((w[1] for w in rest), default=NEVER), timer))
        return iter(out)


def pieces(actions: list[tuple]) -> list[tuple]:
    """Actions as rows of WAITING, in the same order."""
    return [tuple(map(list, zip(*actions[i : i + PIECE], strict=True))) for i in range(0, len(actions), PIECE)]


def closed(life: dict, damage: dict, effects: dict) -> tuple:
    """A game's maps as a row of TABLE."""
    held = effects.values()
    return (
        list(life), list(life.values()), [p for p, _ in damage], [a for _, a in damage], list(damage.values()),
        list(effects), [p for p, _ in held], [seq for _, seq in held],
    )


def opened(row: tuple | None) -> tuple[dict, dict, dict]:
    players, changes, hurt, sources, amounts, kinds, holders, seqs = row or ((),) * 8
    return (
        dict(zip(players, changes, strict=True)), dict(zip(zip(hurt, sources, strict=True), amounts, strict=True)),
        dict(zip(kinds, zip(holders, seqs, strict=True), strict=True)),
    )


def apply(life: dict, damage: dict, effects: dict, seq: int, what: dict) -> int:
    """The rule of an action (the DOES that it has) on a game's maps; 1 for a new epoch."""
    kind, player, source, delta, effect = (what.get(c) for c in DOES)
    if kind in ("new_game", "reset"):
        for state in (life, damage, effects):
            state.clear()
        return 1
    if kind == "life":
        life[player] = life.get(player, 0) + delta
    elif kind == "cmd_damage":
        before = damage.get((player, source), 0)
        damage[player, source] = max(0, before + delta)
        life[player] = life.get(player, 0) - (damage[player, source] - before)
    elif kind == "set_effect":
        effects[effect] = (player, seq)
    elif kind == "clear_effect":
        effects.pop(effect, None)
    return 0


def told(game: int, seq: int, epoch: int, applied: int, late: int, life: dict, damage: dict, effects: dict, evicted: bool) -> list[Row]:
    """A row for each player with a change, damage or an effect; one without a player if there is none."""
    players = sorted({*life, *(p for p, _ in damage), *(p for p, _ in effects.values())}, key=lambda p: (p is not None, p or ""))
    held = sorted(effects, key=lambda e: effects[e][1])
    rows = []
    for p in players or [None]:
        cells = {a if a is not None else "": v for (d, a), v in damage.items() if d == p}
        own = ",".join(e for e in held if effects[e][0] == p and players)
        rows.append(Row(game_id=game, seq=seq, epoch=epoch, player_id=p, life_change=life.get(p, 0), damage_taken=sum(cells.values()), damage=cells, effects=own, applied=applied, late=late, evicted=evicted))
    return rows
