"""Format presets: labels, validity, strict JSON, seeding and edits. The order of presets is the column pos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabletide.functions import preset_chip, preset_subtitle, trimmed
from tabletide.schemas import DEFAULT_PRESETS, MOST_PLAYERS

PRESET = "array<struct<id:string,name:string,startingLife:bigint,playerCount:bigint>>"
COLUMNS = ["owner_id", "pos", "id", "name", "starting_life", "player_count"]


def default_presets(spark: SparkSession) -> DataFrame:
    rows = [(i, *p) for i, p in enumerate(DEFAULT_PRESETS)]
    return spark.createDataFrame(rows, "pos int, id string, name string, starting_life long, player_count long")


def preset_labels(presets: DataFrame) -> DataFrame:
    return presets.withColumns({"chip": preset_chip(F.col("name"), F.col("starting_life")), "subtitle": preset_subtitle(F.col("starting_life"), F.col("player_count"))})


def valid_presets(drafts: DataFrame) -> DataFrame:
    """drafts (with texts name, life, count) as typed presets: the name trimmed, numbers that don't parse 0; kept are those
    with a name and both numbers above 0."""
    number = lambda c: F.coalesce(trimmed(F.col(c)).try_cast("bigint"), F.lit(0)).cast("long")
    rest = [c for c in drafts.columns if c not in ("name", "life", "count")]
    typed = drafts.select(*rest, trimmed(F.col("name")).alias("name"), number("life").alias("starting_life"), number("count").alias("player_count"))
    return typed.where((F.col("name") != "") & (F.col("starting_life") > 0) & (F.col("player_count") > 0))


def apply_format(games: DataFrame, presets: DataFrame) -> DataFrame:
    """games (game_id, format_id) with the preset's starting_life, and its player count within 1 to 6 as target_players.
    presets: (id, starting_life, player_count)."""
    own = presets.select(F.col("id").alias("format_id"), "starting_life", F.greatest(F.lit(1), F.least(F.lit(MOST_PLAYERS), F.col("player_count"))).cast("int").alias("target_players"))
    return games.join(own, "format_id")


def seed_defaults(seeded: DataFrame, presets: DataFrame, defaults: DataFrame) -> DataFrame:
    """presets with the defaults appended, in their order, whose ids an owner hasn't been seeded with. seeded: (owner_id, id),
    owners with a null id have been seeded with nothing; a default that was deleted later doesn't come back."""
    owners = seeded.select("owner_id").unionByName(presets.select("owner_id")).distinct()
    missing = owners.crossJoin(F.broadcast(defaults)).join(seeded, ["owner_id", "id"], "left_anti")  # three rows an owner
    size = presets.groupBy("owner_id").agg((F.max("pos") + 1).alias("size"))
    place = F.row_number().over(Window.partitionBy("owner_id").orderBy("pos")) - 1
    new = missing.withColumn("k", place).join(size, "owner_id", "left").withColumn("pos", (F.coalesce("size", F.lit(0)) + F.col("k")).cast("int"))
    return presets.select(*COLUMNS).unionByName(new.select(*COLUMNS))


def newly_seeded(before: DataFrame, defaults: DataFrame, owners: DataFrame) -> DataFrame:
    """The seeded ids afterwards: (owner_id, id)."""
    return before.where(F.col("id").isNotNull()).unionByName(owners.select("owner_id").distinct().crossJoin(F.broadcast(defaults.select("id")))).distinct()


def upsert_presets(presets: DataFrame, changes: DataFrame) -> DataFrame:
    """presets after one batch of changes (owner_id, seq, op, id, name, starting_life, player_count) with at most one change of
    a kind for an id: update replaces the first entry with the id, if any; remove takes all; add appends in order of seq,
    without a look at ids. Positions are numbered anew."""
    kind = lambda op: changes.where(F.col("op") == op)
    first = F.row_number().over(Window.partitionBy("owner_id", "id").orderBy("pos")) == 1
    new = kind("update").select("owner_id", "id", *[F.col(c).alias(f"new_{c}") for c in COLUMNS[3:]], F.lit(True).alias("hit"))
    joined = presets.withColumn("first", first).join(new, ["owner_id", "id"], "left")
    use = F.coalesce(F.col("hit"), F.lit(False)) & F.col("first")
    updated = joined.select("owner_id", F.col("pos").cast("long").alias("at"), "id", *[F.when(use, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in COLUMNS[3:]])
    left = updated.join(kind("remove").select("owner_id", "id"), ["owner_id", "id"], "left_anti").withColumn("part", F.lit(0))
    adds = kind("add").select("owner_id", F.col("seq").alias("at"), "id", *COLUMNS[3:], F.lit(1).alias("part"))
    place = F.row_number().over(Window.partitionBy("owner_id").orderBy("part", "at")) - 1
    return left.unionByName(adds).select("owner_id", place.alias("pos"), *COLUMNS[2:])


def replay_presets(presets: DataFrame, edits: DataFrame) -> DataFrame:
    """presets after any number of edits an owner (owner_id, seq, op, id, name, starting_life, player_count), replayed in
    order of seq: add appends (ids may repeat), update replaces the first entry that has the id at that moment, if any, and
    remove takes all that do. Positions are numbered anew.

    No list is folded. Entries are only appended, so the order of birth is the order of positions, and what happens to an id is
    its own affair: removes cut its history into lives; entries of the last life are what is left; the first born of a life is
    its first entry as long as it lasts, and shows the last update after its birth. An owner's ids are thus separate keys, and
    an owner with very many edits is spread over tasks but for the numbering of what is left. Presets stand before all
    edits. Edits without an owner, id or seq, and other kinds, have no effect. Of edits with one seq, an owner's are taken in
    the order update, remove, add."""
    rank = F.when(F.col("op") == "update", 1).when(F.col("op") == "remove", 2).when(F.col("op") == "add", 3)
    usable = edits.where(F.col("owner_id").isNotNull() & F.col("id").isNotNull() & F.col("seq").isNotNull() & rank.isNotNull())
    at = lambda before, seq, tie: F.struct(before.alias("edit"), seq.cast("long").alias("seq"), tie.cast("int").alias("tie"))
    told = usable.select("owner_id", "id", *COLUMNS[3:], "op", at(F.lit(1), F.col("seq"), rank).alias("at"))
    old = presets.select("owner_id", "id", *COLUMNS[3:], F.lit("add").alias("op"), at(F.lit(0), F.col("pos"), F.lit(0)).alias("at"))
    of_id = Window.partitionBy("owner_id", "id").orderBy("at")
    so_far = of_id.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = old.unionByName(told).withColumn("life", F.count_if(F.col("op") == "remove").over(so_far))
    rows = rows.withColumn("last_life", F.max("life").over(Window.partitionBy("owner_id", "id"))).where((F.col("life") == F.col("last_life")) & (F.col("op") != "remove"))
    born = F.row_number().over(Window.partitionBy("owner_id", "id", "op").orderBy("at"))
    rows = rows.withColumn("first", (F.col("op") == "add") & (born == 1))
    begun = F.min(F.when(F.col("op") == "add", F.col("at"))).over(Window.partitionBy("owner_id", "id"))
    rows = rows.withColumn("begun", begun)
    values = F.struct(*COLUMNS[3:])
    newest = F.max_by(values, F.when((F.col("op") == "update") & (F.col("at") > F.col("begun")), F.col("at"))).over(Window.partitionBy("owner_id", "id"))
    shown = F.when(F.col("first"), F.coalesce("newest", values)).otherwise(values)
    left = rows.withColumn("newest", newest).where(F.col("op") == "add").select("owner_id", "id", "at", shown.alias("v"))
    place = (F.row_number().over(Window.partitionBy("owner_id").orderBy("at")) - 1).cast("int")
    return left.select("owner_id", place.alias("pos"), "id", "v.*")


def replay_lists(presets: DataFrame, edits: DataFrame) -> DataFrame:
    """`replay_presets` with moves as well (from_pos, to_pos; without effect out of range), which change what comes first: a fold
    over an owner's list. For owners whose edits a task can hold."""
    item = "struct<id:string,name:string,starting_life:bigint,player_count:bigint>"
    entry = lambda x: F.struct(x["id"].alias("id"), *[x[c].cast("long" if c != "name" else "string").alias(c) for c in COLUMNS[3:]])
    rank = F.when(F.col("op") == "update", 1).when(F.col("op") == "remove", 2).when(F.col("op") == "add", 3).when(F.col("op") == "move", 4)
    steps = F.struct("seq", rank.alias("rank"), "op", "id", *COLUMNS[3:], "from_pos", "to_pos")
    told = edits.where(F.col("owner_id").isNotNull() & F.col("seq").isNotNull() & rank.isNotNull()).groupBy("owner_id").agg(F.array_sort(F.collect_list(steps)).alias("steps"))
    lists = presets.groupBy("owner_id").agg(F.array_sort(F.collect_list(F.struct("pos", *COLUMNS[2:]))).alias("old"))

    def step(now: Column, e: Column) -> Column:
        n = F.size(now)
        first = F.array_position(F.transform(now, lambda x: x["id"]), e["id"])
        updated = F.transform(now, lambda x, i: F.when(i + 1 == first, entry(e)).otherwise(x))
        removed = F.filter(now, lambda x: ~F.coalesce(x["id"] == e["id"], F.lit(False)))
        rest = F.concat(F.slice(now, 1, e["from_pos"]), F.slice(now, e["from_pos"] + 2, n))
        moved = F.concat(F.slice(rest, 1, e["to_pos"]), F.slice(now, e["from_pos"] + 1, 1), F.slice(rest, e["to_pos"] + 1, n))
        ok = (e["from_pos"] >= 0) & (e["from_pos"] < n) & (e["to_pos"] >= 0) & (e["to_pos"] < n)
        known = e["id"].isNotNull()
        return (
            F.when(known & (e["op"] == "update"), updated).when(known & (e["op"] == "remove"), removed).when(known & (e["op"] == "add"), F.concat(now, F.array(entry(e))))
            .when((e["op"] == "move") & ok, moved).otherwise(now)
        )

    both = lists.join(told, "owner_id", "full")
    start = F.coalesce(F.transform("old", entry), F.array().cast(f"array<{item}>"))
    folded = F.when(F.col("steps").isNull(), start).otherwise(F.aggregate("steps", start, step))
    return both.select("owner_id", F.posexplode(folded).alias("pos", "v")).select("owner_id", "pos", "v.*")


def decode_presets(text: Column) -> Column:
    """A strict list of presets, as array<struct>. Null text, invalid JSON, anything but a list, or any element with a
    missing or wrong field gives an empty list; a missing or null playerCount is 2; unknown keys are ignored. (An object
    that repeats a key isn't valid to the parser here.)"""
    wrapped, keyed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"w":'), text, F.lit("}")))
    one = F.size(wrapped.try_cast("array<variant>")) == 1
    value = F.try_parse_json(text)
    elements = value.try_cast("array<variant>")
    kind = lambda x, path: F.coalesce(F.schema_of_variant(F.try_variant_get(x, path, "variant")), F.lit("VOID"))
    good = lambda x: (
        F.schema_of_variant(x).startswith("OBJECT") & (kind(x, "$.id") == "STRING") & (kind(x, "$.name") == "STRING")
        & (kind(x, "$.startingLife") == "BIGINT") & kind(x, "$.playerCount").isin("BIGINT", "VOID")
    )
    entry = lambda x: F.struct(
        F.try_variant_get(x, "$.id", "string").alias("id"), F.try_variant_get(x, "$.name", "string").alias("name"),
        F.try_variant_get(x, "$.startingLife", "bigint").alias("startingLife"), F.coalesce(F.try_variant_get(x, "$.playerCount", "bigint"), F.lit(2).cast("bigint")).alias("playerCount"),
    )
    ok = wrapped.isNotNull() & keyed.isNotNull() & one & F.schema_of_variant(value).startswith("ARRAY<") & F.forall(elements, good)
    return F.when(F.coalesce(ok, F.lit(False)), F.transform(elements, entry)).otherwise(F.array().cast(PRESET))


def encode_presets(presets: Column) -> Column:
    return F.to_json(presets)


def reorder_presets(presets: DataFrame, moves: DataFrame) -> DataFrame:
    """presets after one move an owner (owner_id, from_pos, to_pos): taken out at from_pos and put in at to_pos of what is
    left. error is true, and nothing moves, where a position is out of range."""
    n = F.count("*").over(Window.partitionBy("owner_id"))
    own = presets.withColumn("n", n).join(moves, "owner_id", "left")
    a, b = F.col("from_pos"), F.col("to_pos")
    wrong = a.isNotNull() & ((a < 0) | (a >= F.col("n")) | (b < 0) | (b >= F.col("n")))
    rest = F.col("pos") - (F.col("pos") > a).cast("int")
    moved = F.when(F.col("pos") == a, b).otherwise(rest + (rest >= b).cast("int"))
    pos = F.when(a.isNull() | wrong, F.col("pos")).otherwise(moved)
    return own.select("owner_id", pos.cast("int").alias("pos"), *COLUMNS[2:], wrong.alias("error"))


def reorder_many(lists: DataFrame, moves: DataFrame) -> DataFrame:
    """lists (owner_id, items array) after several moves an owner (owner_id, seq, from_pos, to_pos), in order; a move out of
    range is left out and counted in errors."""
    own = moves.groupBy("owner_id").agg(F.array_sort(F.collect_list(F.struct("seq", "from_pos", "to_pos"))).alias("moves"))

    def step(s: Column, m: Column) -> Column:
        items, n = s["items"], F.size(s["items"])
        rest = F.concat(F.slice(items, 1, m["from_pos"]), F.slice(items, m["from_pos"] + 2, n))
        done = F.concat(F.slice(rest, 1, m["to_pos"]), F.slice(items, m["from_pos"] + 1, 1), F.slice(rest, m["to_pos"] + 1, n))
        ok = (m["from_pos"] >= 0) & (m["from_pos"] < n) & (m["to_pos"] >= 0) & (m["to_pos"] < n)
        return F.when(ok, F.struct(done.alias("items"), s["errors"].alias("errors"))).otherwise(F.struct(items.alias("items"), (s["errors"] + 1).alias("errors")))

    start = F.struct(F.col("items").alias("items"), F.lit(0).alias("errors"))
    folded = F.aggregate(F.coalesce("moves", F.array().cast("array<struct<seq:bigint,from_pos:int,to_pos:int>>")), start, step)
    return lists.join(own, "owner_id", "left").select("owner_id", folded.alias("s")).select("owner_id", "s.items", "s.errors")
