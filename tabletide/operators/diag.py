"""Diagnostic logs: visibility by level, and rotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabletide.functions import lookup
from tabletide.operators.scans import BLOCK, in_blocks, large_keys, upto
from tabletide.schemas import ROTATION_LIMIT
from tabletide.sources import stored

RANKS = {"trace": 0, "debug": 1, "info": 2, "warning": 3, "error": 4, "fatal": 5}
LEAST = {"off": 9, "errors": 4, "verbose": 0}


def log_level_filter(lines: DataFrame, settings: DataFrame) -> DataFrame:
    """Lines (device_id, level) that a device's setting (device_id, log_level) lets through: nothing, errors and above, or
    all. A device without a setting logs errors; a line without a level passes unless logging is off."""
    joined = lines.join(settings.select("device_id", "log_level"), "device_id", "left")
    least = F.coalesce(lookup(F.col("log_level"), LEAST), F.lit(LEAST["errors"]))
    rank = F.coalesce(lookup(F.col("level"), RANKS), F.lit(8))
    return joined.where(rank >= least).select(*lines.columns)


def folded(rows: DataFrame, limit: int) -> DataFrame:
    """Rotation of devices with few sessions, each as one list."""
    row = "array<struct<session_no:bigint,start_bytes:bigint,rotated:boolean,generation:int>>"
    start = F.struct(F.lit(0).cast("long").alias("size"), F.lit(0).alias("generation"), F.array().cast(row).alias("rows"))

    def step(s: Column, x: Column) -> Column:
        rotated = s["size"] > limit
        generation = s["generation"] + rotated.cast("int")
        told = F.struct(x["session_no"].alias("session_no"), s["size"].alias("start_bytes"), rotated.alias("rotated"), generation.alias("generation"))
        return F.struct((F.when(rotated, 0).otherwise(s["size"]) + x["bytes"]).alias("size"), generation.alias("generation"), F.concat(s["rows"], F.array(told)).alias("rows"))

    lists = rows.groupBy("device_id").agg(F.array_sort(F.collect_list(F.struct("session_no", "bytes"))).alias("own"))
    return lists.select("device_id", F.inline(F.aggregate("own", start, step)["rows"]))


def running_totals(rows: DataFrame) -> DataFrame:
    """device_id, block, session_no, i (place of the session among its device's), total (bytes of those before it).
    Of rows with block: a device's blocks are summed side by side."""
    sums = rows.groupBy("device_id", "block").agg(F.sum("bytes").alias("b"), F.count("*").alias("k"))
    before = upto("device_id", order="block", last=-1)
    sums = sums.select("device_id", "block", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k"))
    own = Window.partitionBy("device_id", "block").orderBy("session_no", "bytes").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = rows.withColumns({"t": F.sum("bytes").over(own) - F.col("bytes"), "r": F.count("*").over(own) - 1})
    return within.join(sums, ["device_id", "block"]).select("device_id", "block", "session_no", (F.col("k") + F.col("r")).alias("i"), (F.col("b") + F.col("t")).alias("total"))


def next_rotations(totals: DataFrame, limit: int, span: int = 64) -> DataFrame:
    """device_id, i, total, next: the first session at whose start the file has outgrown limit, if it began at session i. Totals
    only grow, so that is the first with a total above total + limit: a search by range. Totals and what is searched are put in
    ranges of span * limit bytes; in a range one descending scan answers, else the first session of the next range that has one."""
    width = span * (limit + 1)
    bucket = F.floor(F.col("at") / width).cast("long").alias("bucket")
    point = totals.select("device_id", "i", F.col("total").alias("at"), F.col("i").alias("hit"), F.lit(1).alias("kind"))
    probe = totals.select("device_id", "i", (F.col("total") + limit).alias("at"), F.lit(None).cast("long").alias("hit"), F.lit(0).alias("kind"))
    rows = point.unionByName(probe).select("*", bucket)
    # descending: a probe comes before points of its own total, so it sees those above it; the last seen is the first session
    down = Window.partitionBy("device_id", "bucket").orderBy(F.desc("at"), "kind", F.desc("i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.withColumn("near", F.last("hit", ignorenulls=True).over(down))
    heads = rows.groupBy("device_id", "bucket").agg(F.min("hit").alias("head"))
    later = Window.partitionBy("device_id").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("device_id", "bucket", F.last("head", ignorenulls=True).over(later).alias("far"))
    found = seen.where("kind = 0").join(heads, ["device_id", "bucket"])
    return found.select("device_id", "i", (F.col("at") - limit).alias("total"), F.coalesce("near", "far").alias("next"))


def beginnings(jumps: DataFrame, group: int, steps: int) -> DataFrame:
    """device_id, i of the sessions that begin a file: 0, and what follows from there by next. Sessions are taken in groups by
    place, as lists of pointers; steps is the largest group's number. If a device has more than one, pointers are doubled within the lists until each session
    knows where its files leave the group, and those are then doubled from group to group (a stored table a round), which
    gives the session that enters each group; from there a list is walked.

    A list is doubled in one expression over its own variable, and explodes as outer. In a chain of columns, merged below the filter
    for empty lists that Spark derives from a plain explode, each element would have the round before evaluated anew."""
    part = F.floor(F.col("i") / group).cast("long").alias("part")
    lists = jumps.groupBy("device_id", part).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "next"))), lambda x: x["next"]).alias("next"))
    base = F.col("part") * group
    inside = lambda p: F.coalesce(p < base + group, F.lit(False))
    entries = lists.where("part = 0").select("device_id", F.lit(0).cast("long").alias("i"))
    if steps:
        doubled = lambda s, _: F.transform(s, lambda p: F.when(inside(p), F.get(s, (p - base).cast("int"))).otherwise(p))
        left = F.aggregate(F.sequence(F.lit(1), F.lit(group.bit_length())), F.col("next"), doubled)
        ahead = lists.select("device_id", F.posexplode_outer(left).alias("place", "next"), base.alias("base")).where("next is not null")
        ahead = stored(ahead.select("device_id", (F.col("base") + F.col("place")).alias("i"), "next"), "rotation-exits")
        for k in range(steps.bit_length()):
            entries = stored(entries.unionByName(entries.join(ahead, ["device_id", "i"]).select("device_id", F.col("next").alias("i"))), "rotation-entries")
            if k + 1 < steps.bit_length():
                far = ahead.select("device_id", F.col("i").alias("next"), F.col("next").alias("far"))
                ahead = stored(ahead.join(far, ["device_id", "next"]).select("device_id", "i", F.col("far").alias("next")), "rotation-exits")
    begun = entries.select("device_id", part, F.col("i").alias("entry"))
    now = F.struct(F.col("entry").alias("at"), F.array().cast("array<bigint>").alias("found"))

    def walk(s: Column, _: Column) -> Column:
        there = F.struct(F.get(F.col("next"), (s["at"] - base).cast("int")).alias("at"), F.concat(s["found"], F.array(s["at"])).alias("found"))
        return F.when(inside(s["at"]), there).otherwise(s)

    walked = lists.join(begun, ["device_id", "part"]).withColumn("found", F.aggregate("next", now, walk)["found"])
    return walked.select("device_id", F.explode_outer("found").alias("i"))


def log_rotation(sessions: DataFrame, limit: int = ROTATION_LIMIT, most: int = BLOCK, group: int = 4096) -> DataFrame:
    """device_id, session_no, start_bytes, rotated, generation of sessions (device_id, session_no, bytes). The file grows over
    sessions; at a session's start it is moved away if it is larger than limit, and begins at 0. A session without bytes
    adds none; one without a device or number takes no part.

    If no device has more than `group` sessions, each is one fold over its list. Else each session points to the next that
    would rotate, by a search in the running totals, and the sessions that begin a file are those that the pointers reach from
    session 0; a device's sessions are spread over tasks throughout."""
    rows = sessions.select("device_id", F.col("session_no").cast("long").alias("session_no"), F.greatest(F.coalesce("bytes", F.lit(0)), F.lit(0)).cast("long").alias("bytes"))
    large = large_keys(rows, min(most, group), "device_id", "session_no")
    if not large[1]:
        return folded(rows.where(F.col("device_id").isNotNull() & F.col("session_no").isNotNull()), limit)
    rows = stored(rows, "rotation-sessions")  # read four times
    totals = stored(running_totals(in_blocks(rows, most, "device_id", "session_no", large)), "rotation-totals")
    steps = int(totals.agg(F.max("i")).first()[0]) // group
    starts = beginnings(next_rotations(totals, limit), group, steps).withColumn("begins", F.lit(True))
    marked = totals.join(starts, ["device_id", "i"], "left").withColumn("begins", F.coalesce("begins", F.lit(False)))
    return generations(marked)


def generations(rows: DataFrame) -> DataFrame:
    """Of totals with begins: the file that each session starts with, by the last beginning before it."""
    k, at = F.sum(F.col("begins").cast("int")), F.max(F.when(F.col("begins"), F.col("total")))
    blocks = rows.groupBy("device_id", "block").agg(k.alias("k"), at.alias("at"))
    before = upto("device_id", order="block", last=-1)
    blocks = blocks.select("device_id", "block", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k"), F.max("at").over(before).alias("at_before"))
    own, earlier = upto("device_id", "block", order="i"), upto("device_id", "block", order="i", last=-1)
    within = rows.withColumns({"own_k": k.over(own), "own_at": at.over(earlier)}).join(blocks, ["device_id", "block"])
    rotated = F.col("begins") & (F.col("i") > 0)
    start = F.col("total") - F.coalesce("own_at", "at_before", F.lit(0))
    return within.select("device_id", "session_no", start.cast("long").alias("start_bytes"), rotated.alias("rotated"), (F.col("k") + F.col("own_k") - 1).cast("int").alias("generation"))
