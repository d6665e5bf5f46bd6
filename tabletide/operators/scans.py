"""Ordered folds of one very large game, in several tasks.

The windows of the other modules replay a game in one task. Here a large game is cut into blocks, ranges of seq, and what a
block does is a small function that can be composed: a count of epochs, a floored sum x -> max(x + a, b), a seat count that
stays within 1 and 6. Blocks make their functions side by side, a short scan over a game's blocks gives what holds before
each, and the blocks' rows go on from there. The results are those of the plain operators.

Rows without a game_id or seq take no part. A game of `most` rows or fewer is one block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tabletide.operators.actions import STARTS
from tabletide.schemas import MOST_PLAYERS

#: Rows of a block, ranges that a large key's order is first counted in, and large keys that are sent to all tasks.
BLOCK, BINS, FEW_KEYS = 1 << 18, 4096, 10_000
CELL = ("game_id", "epoch", "player_id", "source_id")


def large_keys(rows: DataFrame, most: int = BLOCK, key: str = "game_id", order: str = "seq") -> tuple[DataFrame, list[Row]]:
    """Keys of more than `most` rows with the ends of their order (key, lo, hi), and FEW_KEYS + 1 of them at most as rows."""
    sizes = rows.where(F.col(order).isNotNull()).groupBy(key).agg(F.count("*").alias("key_rows"), F.min(order).alias("lo"), F.max(order).alias("hi"))
    large = sizes.where(F.col(key).isNotNull() & (F.col("key_rows") > most)).drop("key_rows")
    return large, large.limit(FEW_KEYS + 1).collect()


def in_blocks(rows: DataFrame, most: int = BLOCK, key: str = "game_id", order: str = "seq", found: tuple[DataFrame, list[Row]] | None = None) -> DataFrame:
    """rows with block (int): keys of more than `most` rows are cut into ranges of order (a whole number) of about that many
    rows, by a histogram of BINS equal ranges; other keys are block 0. One pass counts the keys; only if some are large are
    these counted by range and looked up, in a broadcast while they are FEW_KEYS or fewer. found: of `large_keys`, if it is known."""
    spark, rows = rows.sparkSession, rows.where(F.col(key).isNotNull() & F.col(order).isNotNull())
    large, known = found or large_keys(rows, most, key, order)
    if not known:
        return rows.withColumn("block", F.lit(0))
    few = len(known) <= FEW_KEYS
    large = F.broadcast(spark.createDataFrame(known, large.schema)) if few else large
    share = (F.col(order) - F.col("lo")).cast("double") / (F.col("hi") - F.col("lo") + 1)
    cut = rows.join(large, key, "left").withColumn("bin", F.floor(share * BINS).cast("int")).drop("lo", "hi")
    bins = cut.where("bin is not null").groupBy(key, "bin").agg(F.count("*").alias("bin_rows"))
    before = F.coalesce(F.sum("bin_rows").over(Window.partitionBy(key).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = bins.select(key, "bin", F.floor(before / most).cast("int").alias("block"))
    found = cut.join(F.broadcast(place) if few and len(known) * BINS <= 1_000_000 else place, [key, "bin"], "left")
    return found.withColumn("block", F.coalesce("block", F.lit(0))).select(*rows.columns, "block")


def join_same(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """a with b's further columns; null keys are equal."""
    other = b.select(*[F.col(k).alias(f"{k}_b") for k in keys], *[c for c in b.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_b"))
    return a.join(other, same).drop(*[f"{k}_b" for k in keys])


def upto(*keys: str, order: str = "seq", last: int = 0):  # noqa: ANN201
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, last)


def epochs_in_blocks(log: DataFrame, most: int = BLOCK) -> DataFrame:
    """log with block and epoch, as of `game_epochs`. A task takes blocks, not games."""
    rows = in_blocks(log, most).repartition("game_id", "block")
    starts = F.sum(F.when(F.col("action").isin(*STARTS), 1).otherwise(0))
    sums = rows.groupBy("game_id", "block").agg(starts.alias("starts"))
    before = sums.select("game_id", "block", F.coalesce(F.sum("starts").over(upto("game_id", order="block", last=-1)), F.lit(0)).alias("epochs_before"))
    within = rows.withColumn("epoch", starts.over(upto("game_id", "block")))
    return within.join(before, ["game_id", "block"]).withColumn("epoch", F.col("epoch") + F.col("epochs_before")).drop("epochs_before")


def block_functions(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Damage actions with block and epoch. First: with s and low, the running sum of their cell and block and its least value.
    Second: for each cell and block at (the sum before the block), low_before (the least running sum before it, null for the
    first) and total and low of all up to it. The block is x -> max(x + total - at, ...): both parts compose."""
    keys = ("game_id", "block", *CELL[1:])
    inner = hits.withColumn("s", F.sum("delta").over(upto(*keys)))
    inner = inner.withColumn("low", F.min("s").over(upto(*keys)))
    of_block = inner.groupBy(*keys).agg(F.sum("delta").alias("a"), F.min("s").alias("m"))
    at = of_block.withColumn("at", F.coalesce(F.sum("a").over(upto(*CELL, order="block", last=-1)), F.lit(0)))
    reach = F.col("at") + F.col("m")
    scan = at.withColumns({"low_before": F.min(reach).over(upto(*CELL, order="block", last=-1)), "low_after": F.min(reach).over(upto(*CELL, order="block"))})
    return inner, scan.select(*keys, "at", "low_before", (F.col("at") + F.col("a")).alias("total_after"), "low_after")


def damage_timeline_in_blocks(log: DataFrame, most: int = BLOCK) -> DataFrame:
    """`commander_damage_timeline`, by blocks."""
    keys = ("game_id", "block", *CELL[1:])
    inner, scan = block_functions(epochs_in_blocks(log, most).where(F.col("action") == "cmd_damage"))
    rows = join_same(inner, scan, keys)
    damage = F.col("at") + F.col("s") - F.least(F.lit(0), F.col("low_before"), F.col("at") + F.col("low"))
    came = F.col("at") - F.least(F.lit(0), F.col("low_before"))
    before = F.lag("damage").over(Window.partitionBy(*keys).orderBy("seq"))
    rows = rows.withColumn("damage", damage).withColumn("applied", F.col("damage") - F.coalesce(before, came))
    return rows.select("game_id", "epoch", "seq", "player_id", "source_id", "delta", "applied", "damage")


def last_epochs(rows: DataFrame) -> DataFrame:
    return rows.groupBy("game_id").agg(F.max("epoch").alias("epoch"), F.max_by("starting_life", F.when(F.col("starting_life").isNotNull(), F.col("seq"))).alias("start"))


def final_cells(rows: DataFrame, last: DataFrame) -> DataFrame:
    """game_id, player_id, source_id, damage of the last epoch: the blocks' functions composed, without a pass over rows."""
    hits = rows.where(F.col("action") == "cmd_damage").join(last.select("game_id", "epoch"), ["game_id", "epoch"], "left_semi")
    scan = block_functions(hits)[1]
    end = scan.groupBy(*CELL).agg(F.max_by("total_after", "block").alias("total"), F.min("low_after").alias("low"))
    return end.select("game_id", "player_id", "source_id", (F.col("total") - F.least(F.lit(0), F.col("low"))).alias("damage"))


def damage_matrix_in_blocks(log: DataFrame, roster: DataFrame, most: int = BLOCK) -> DataFrame:
    """`commander_damage_matrix`, floored, by blocks."""
    rows = epochs_in_blocks(log, most)
    cells = final_cells(rows, last_epochs(rows))
    a, b = roster.select("game_id", "player_id"), roster.select("game_id", F.col("player_id").alias("source_id"))
    pairs = a.join(b, "game_id").where(F.col("player_id") != F.col("source_id"))  # at most 30 a game
    return pairs.join(cells, ["game_id", "player_id", "source_id"], "left").select("game_id", "player_id", "source_id", F.coalesce("damage", F.lit(0)).cast("long").alias("damage"))


def life_totals_in_blocks(log: DataFrame, games: DataFrame, roster: DataFrame, most: int = BLOCK) -> DataFrame:
    """`life_totals`, by blocks. A cell that begins at 0 has had applied to it what it holds, so only sums and cells count."""
    rows = epochs_in_blocks(log, most)
    last = last_epochs(rows)
    direct = rows.where(F.col("action") == "life").join(last.select("game_id", "epoch"), ["game_id", "epoch"], "left_semi")
    gains = direct.groupBy("game_id", "player_id").agg(F.sum("delta").alias("change"))
    losses = final_cells(rows, last).groupBy("game_id", "player_id").agg((-F.sum("damage")).alias("change"))
    change = gains.unionByName(losses).groupBy("game_id", "player_id").agg(F.sum("change").alias("change"))
    own = roster.select("game_id", "player_id").join(games.select("game_id", "starting_life"), "game_id")
    joined = own.join(change, ["game_id", "player_id"], "left").join(last.select("game_id", "start"), "game_id", "left")
    return joined.select("game_id", "player_id", (F.coalesce("start", "starting_life") + F.coalesce("change", F.lit(0))).cast("long").alias("life"))


# Seat counts: a stretch of changes is a function of the count before it, kept as the list of its values at 1 to 6.


def after(count: Column, change: Column) -> Column:
    """The count after a change (action, n): an add at six players and a remove at one are refused."""
    kind = change["action"]
    return (
        F.when(kind == "add_player", F.least(count + 1, F.lit(MOST_PLAYERS))).when(kind == "remove_player", F.greatest(count - 1, F.lit(1)))
        .when(kind == "new_game", F.coalesce(change["n"], count)).otherwise(count)
    )


def value_of(function: Column, count: Column) -> Column:
    return F.get(function, (count - 1).cast("int"))


def identity() -> Column:
    return F.array(*[F.lit(i) for i in range(1, MOST_PLAYERS + 1)])


def roster_changes(log: DataFrame, games: DataFrame, most: int = BLOCK, group: int = 256) -> DataFrame:
    """game_id, seq, action, player_id, n_before, n_after, refused: the add_player and remove_player actions of log, with the
    number of players around each, which follows from the log alone. A game begins, and begins anew at new_game, with
    games' n_players (1 if there is none); reset leaves the players. A block's rows are taken in groups; groups, and then
    blocks, are functions of the count, so no list is longer than a block's groups, a game's blocks or a group's rows."""
    n = F.greatest(F.lit(1), F.least(F.lit(MOST_PLAYERS), F.col("n_players"))).cast("int")
    own = log.where(F.col("action").isin("add_player", "remove_player", "new_game")).select("game_id", "seq", "action", "player_id")
    rows = in_blocks(own, most).join(games.select("game_id", n.alias("n")), "game_id", "left")
    at = F.floor((F.row_number().over(Window.partitionBy("game_id", "block").orderBy("seq")) - 1) / group).cast("int")
    grouped = rows.withColumn("part", at).groupBy("game_id", "block", "part")
    groups = grouped.agg(F.array_sort(F.collect_list(F.struct("seq", "action", "player_id", "n"))).alias("ops"))
    groups = groups.withColumn("function", F.aggregate("ops", identity(), lambda f, op: F.transform(f, lambda x: after(x, op))))

    def then(f: Column, g: Column) -> Column:
        return F.transform(f, lambda x: value_of(g, x))

    def scan(parts: Column, start: Column) -> Column:
        """Of parts (place, function): an array of (place, what holds before it), and what holds at the end."""
        begin = F.struct(start.alias("now"), F.array().cast("array<struct<place:int,before:array<int>>>").alias("found"))
        step = lambda s, p: F.struct(
            then(s["now"], p["function"]).alias("now"), F.concat(s["found"], F.array(F.struct(p["place"].alias("place"), s["now"].alias("before")))).alias("found")
        )
        return F.aggregate(parts, begin, step)

    def listed(place: str) -> Column:
        return F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), "function")))

    blocks = groups.groupBy("game_id", "block").agg(listed("part").alias("parts")).withColumn("scan", scan(F.col("parts"), identity()))
    blocks = blocks.select("game_id", "block", F.col("scan.now").alias("function"), F.col("scan.found").alias("found"))
    per_game = blocks.groupBy("game_id").agg(listed("block").alias("parts")).withColumn("scan", scan(F.col("parts"), identity()))
    entries = per_game.select("game_id", F.explode("scan.found").alias("e")).select("game_id", F.col("e.place").alias("block"), F.col("e.before").alias("of_block"))
    begun = entries.join(games.select("game_id", n.alias("n")), "game_id", "left").withColumn("count", value_of(F.col("of_block"), F.coalesce("n", F.lit(1))))
    parts = blocks.select("game_id", "block", F.explode("found").alias("e")).select("game_id", "block", F.col("e.place").alias("part"), F.col("e.before").alias("of_part"))
    parts = parts.join(begun.select("game_id", "block", "count"), ["game_id", "block"]).withColumn("count", value_of(F.col("of_part"), F.col("count")))

    def replay(s: Column, op: Column) -> Column:
        now = after(s["count"], op)
        row = F.struct(op["seq"].alias("seq"), op["action"].alias("action"), op["player_id"].alias("player_id"), s["count"].alias("n_before"), now.alias("n_after"))
        return F.struct(now.alias("count"), F.concat(s["rows"], F.array(row)).alias("rows"))

    none = F.array().cast("array<struct<seq:bigint,action:string,player_id:string,n_before:int,n_after:int>>")
    told = groups.drop("function").join(parts.select("game_id", "block", "part", "count"), ["game_id", "block", "part"])
    told = told.select("game_id", F.inline(F.aggregate("ops", F.struct(F.col("count"), none.alias("rows")), replay)["rows"]))
    changes = told.where(F.col("action") != "new_game")
    return changes.withColumn("refused", F.col("n_before") == F.col("n_after"))
