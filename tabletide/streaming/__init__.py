"""The action log as a stream.

Rows that arrive later than the watermark (10 minutes by default) are dropped; that is a policy of these jobs, as the
rules themselves know no lateness. `Account` counts what came in and what was dropped, and `open_sessions` shows what is still
in the state, so that input, output, state and dropped rows add up. `stream_game_state` applies actions in order of seq once
the watermark has passed them: however the log is cut into batches, and whatever the order of rows within the lateness, it ends
in one state. Keys leave the state when the watermark is `idle` past their newest row, with a last row that is marked
evicted; a key that comes back begins anew."""

from __future__ import annotations

from collections import Counter
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQueryListener

from tabletide.streaming.state import DOES, GAME, HOLDER, LIFE, EffectState, GameState, LifeState

LATENESS, IDLE = "10 minutes", "1 day"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def on_time(log: DataFrame, lateness: str = LATENESS) -> DataFrame:
    return log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)


def milliseconds(spark: SparkSession, interval: str) -> int:
    return int(spark.range(1).select(F.unix_millis(F.lit(0).cast("timestamp") + F.expr(f"interval {interval}"))).first()[0])


def keyed(rows: DataFrame, keys: list[str], processor: StatefulProcessor, form: str) -> DataFrame:
    """rows through a processor by keys, in update mode by event time. Its state needs the RocksDB store, which this sets for the
    session's further streams."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    moment = F.ceil(F.unix_micros("ts") / 1000).cast("long")
    return rows.withColumn("ms", moment).groupBy(*keys).transformWithState(processor, form, "update", "EventTime")


def stream_life_totals(log: DataFrame, start: int = 40, idle: str | None = None, lateness: str = LATENESS) -> DataFrame:
    """Update mode: game_id, player_id, life of logs of a single epoch without damage floors. Without idle, every player stays in
    the state. With it, columns change, n, began and evicted as well: sums since the player came into the state, whose last
    row before leaving is marked; the changes of evicted rows and of the present one add up to the whole."""
    change = F.when(F.col("action") == "cmd_damage", -F.col("delta")).otherwise(F.col("delta"))
    if idle is None:
        rows = log.where(F.col("action").isin("life", "cmd_damage"))
        return rows.groupBy("game_id", "player_id").agg((F.lit(start) + F.sum(change)).cast("long").alias("life"))
    rows = on_time(log, lateness).where(F.col("action").isin("life", "cmd_damage")).select("game_id", "player_id", "ts", F.unix_micros("ts").alias("us"), change.alias("change"))
    sums = keyed(rows, ["game_id", "player_id"], LifeState(milliseconds(log.sparkSession, idle), start), LIFE)
    return sums.select("game_id", "player_id", "life", "change", "n", F.timestamp_micros("began_us").alias("began"), "evicted")


def stream_pending_delta(log: DataFrame, gap: str = "5 seconds", lateness: str = LATENESS) -> DataFrame:
    """Append mode: game_id, player_id, start, pending, n of direct life actions, a row when a session is over. The rows that
    come in are counted as the metric `rows` of the observation "pending" (see `Account`)."""
    rows = on_time(log, lateness).where("action = 'life'").observe("pending", F.count("*").alias("rows"))
    grouped = rows.groupBy("game_id", "player_id", F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.sum("delta").alias("pending"), F.count("*").alias("n")).select("game_id", "player_id", F.col("w.start").alias("start"), "pending", "n")


def open_sessions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What a `stream_pending_delta` query with this checkpoint still holds after its last batch, in the same columns:
    sessions that the watermark hasn't passed."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select(
        F.col("key.game_id").alias("game_id"), F.col("key.player_id").alias("player_id"), F.col("value.session_window.start").alias("start"),
        F.col("value.sum").alias("pending"), F.col("value.count").alias("n"),
    )


class Account(StreamingQueryListener):
    """Counts over all batches of the session's queries since it was added: by query name (or id), rows read, rows that an
    observation saw (name.metric), and rows dropped as late by the watermark."""

    def __init__(self) -> None:
        self.counts: dict[str, Counter] = {}
        self.lock = Lock()

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        p = event.progress
        with self.lock:
            own = self.counts.setdefault(p.name or str(p.id), Counter())
            own["input"] += p.numInputRows
            own["dropped"] += sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
            own["batches"] += 1
            for name, row in p.observedMetrics.items():
                for metric, value in row.asDict().items():
                    own[f"{name}.{metric}"] += value or 0


def stream_current_effects(log: DataFrame, idle: str | None = None, lateness: str = LATENESS) -> DataFrame:
    """Update mode: game_id, effect_type, player_id (null after a clear) of logs of a single epoch. With idle, seq and evicted as
    well, and effects leave the state, with a last row, when they haven't changed for so long."""
    changes = F.col("action").isin("set_effect", "clear_effect")
    if idle is None:
        last = F.max_by(F.struct(F.when(F.col("action") == "set_effect", F.col("player_id")).alias("player_id")), "seq")
        return log.where(changes).groupBy("game_id", "effect_type").agg(last.alias("x")).select("game_id", "effect_type", F.col("x.player_id").alias("player_id"))
    rows = on_time(log, lateness).where(changes).select("game_id", "effect_type", "ts", "seq", "action", "player_id")
    return keyed(rows, ["game_id", "effect_type"], EffectState(milliseconds(log.sparkSession, idle)), HOLDER)


def stream_game_state(log: DataFrame, idle: str = IDLE, lateness: str = LATENESS) -> DataFrame:
    """Update mode: for each game whose actions the watermark has passed, its players' state: seq of the last action, epoch,
    life_change (of the epoch), damage_taken and damage (by attacker, floored), effects (in the order in which they were set),
    and of the game the number of actions applied and of those too late to be. A game without players has one row
    without a player. ts must not fall as seq grows within a game: an action that does is late if others have passed it.
    A game leaves the state, its last rows marked evicted, when the watermark is `idle` past its newest action. Rows that
    the watermark itself drops are counted by Spark (`Account`)."""
    rows = on_time(log, lateness).select("game_id", "ts", "seq", F.to_json(F.struct(*DOES)).alias("what"))
    return keyed(rows, ["game_id"], GameState(milliseconds(log.sparkSession, idle)), GAME)
