"""Line dedup by a segment-partition edit join. DataFrame functions only.

Lines are a text's parts between newlines. A line of at least `least` characters is removed if an equal line, or one at edit
distance `distance` or less that is as long, is earlier (smaller doc_id, or the same document and an earlier line). With
`every`, as in the query and the pipeline, a shorter line that isn't blank is removed if an equal line is earlier: its distance
is 0. Else shorter lines are kept, as blank ones always are. Lines are judged on the input, not on what is left.

1. Equal lines are aggregated by a 128-bit hash to their first place and count.
2. A line of length n is cut into distance + 1 even segments; of two lines within the distance one segment of the shorter
   is a substring of the longer, at a place that the length difference bounds, with at most as many edits before it as there are
   segments before it, and the rest behind it. Each line's keys are the hashes of (length, segment number, substring)
   that it indexes or probes (twelve at distance 2). Keys are aggregated, partially before the shuffle, to the least and
   greatest of either half of the line hash: only keys that different lines share go on, and lines come back to those only: a
   broadcast Bloom filter of the shared keys picks a line's keys before the shuffle, which then has each line once with what
   it holds, however many keys there are (a join by key would have each line's text once a key). A key that passes
   wrongly meets nothing but what is compared anyway; with more than MOST_BLOCKS allows, more pass.
3. One earlier near line is enough. Each line is first compared with the earliest line of each of its keys.
4. Lines that this leaves open are compared with the others of a key, those that index it with those that probe it, if at most
   `group` lines index it (twice that after each division, but no more than WIDEST times): so a key makes at most its rows times WIDEST * `group`
   pairs. A larger group is divided, and steps 3 and 4 are repeated for what it falls into: first by where the lines leave the group's
   earliest one, from the start and then from the end; then by a further segment, and so on in turn: of the parts of the lines
   before and behind the segment, each with the edits that it may have, the longest is taken, what all lines of the group have
   at both its ends is taken off, and the core is cut into segments again. So no group is paired whole, however
   many different lines share a segment. Only groups whose every remaining part is shorter than its segments would be
   (at most 2 * distance characters, so a bounded number of different lines) are.
5. Pairs must agree in their letter counts, are fetched once and verified by a banded bit-parallel edit distance on what is
   between their common ends: the band of 2 * distance + 1 rows of the dynamic program's column is a few bits of a long, moved
   along the diagonal, for lines of any length.

Cases: null and empty texts have one empty line, which is kept; rows that repeat a doc_id and its text are one document (the
same places), returned each; rows that repeat a doc_id with different texts are different documents, in the order of their texts' hashes; a null
doc_id is before all others; an empty table gives an empty result; other columns, whatever their names, are
ignored by `repeated_lines` and kept by `drop_repeated_lines`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletide.llm.common import materialize, two_hashes, unused
from tabletide.llm.quality import WORD, let

GROUP = 64
#: Of key_filter(): words of a block, keys that a block is meant for, bits of a key, blocks at most (32 MB of words).
WORDS, BLOCK_KEYS, MARKS, MOST_BLOCKS = 16, 32, 4, 1 << 18
INDEX, PROBE = 1, 2
WIDEST, BLOCK = 8, 32
LETTERS = " aeinorstdhlu.,w"
COUNTS = [f"c{i}" for i in range(len(LETTERS))]
PARTS = "array<struct<s:int,e:int,d:int>>"
DOC = ["doc_id", "t1", "t2"]


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def named(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, text): t1 and t2 tell texts of one doc_id apart."""
    t1, t2 = two_hashes(F.coalesce(F.col("text"), F.lit("")))
    return docs.select("doc_id", t1.alias("t1"), t2.alias("t2"), "text")


def lines_of(docs: DataFrame, least: int, every: bool = False) -> DataFrame:
    """(doc_id, t1, t2, line_no, line, h1, h2) of the lines of `least` characters, or of every line that isn't blank as well."""
    part = (F.length("line") >= least) | F.col("line").rlike(WORD) if every else F.length("line") >= least
    own = named(docs).select(*DOC, F.posexplode(text_lines(F.col("text"))).alias("line_no", "line")).where(part)
    h1, h2 = two_hashes(F.col("line"))
    return own.select("*", h1.alias("h1"), h2.alias("h2"))


def variants(distance: int) -> list[Column]:
    """structs of v_d (the distance), shorter, v_i, shift, side: how much shorter the indexed part is, the segment, by how many
    characters it is shifted in the probing part, and whether such a key is one that a part indexes too."""
    found = []
    for shorter in range(distance + 1):
        for i in range(distance + 1):
            rest = distance - i
            for shift in range(max(-i, shorter - rest), min(i, shorter + rest) + 1):
                side = INDEX + PROBE if not shorter and not shift else PROBE
                found.append(F.struct(*[F.lit(v).alias(k) for k, v in (("v_d", distance), ("shorter", shorter), ("v_i", i), ("shift", shift), ("side", side))]))
    return found


def with_keys(rows: DataFrame, distances: list[int], least: int, seed: list[str]) -> DataFrame:
    """rows (line, s, e, d, and more) with a row for each key of the characters from s to e, which may have d edits: key,
    side, and the segment's number i, begin and end; i is null if the part is too short to be cut, and then its length is
    the key. A part of m characters is cut into d + 1 even segments, of which the last m % (d + 1) are longer by one.
    The variants are exploded, not written out, so that each key is a few expressions over columns. A line of one-byte
    characters is cut as bytes, which need not be counted from the start."""
    columns = [c for c in rows.columns if c != "key"]
    rows = rows.withColumns({"raw": F.col("line").cast("binary"), "plain": F.octet_length("line") == F.length("line")})
    rows = rows.select("*", F.explode(F.array(*[v for d in distances for v in variants(d)])).alias("v")).select(*rows.columns, "v.*")
    m, n = F.col("e") - F.col("s") - F.col("shorter"), F.col("d") + 1
    rows = rows.where((F.col("v_d") == F.col("d")) & (m >= least)).withColumns({"size": F.floor(m / n).cast("int"), "more": (m % n).cast("int")})
    at = F.col("s") + F.col("size") * F.col("v_i") + F.greatest(F.lit(0), F.col("v_i") - n + F.col("more")) + F.col("shift")
    rows = rows.withColumns({"begin": at, "end": at + F.col("size") + (F.col("v_i") >= n - F.col("more")).cast("int")})
    short, size = m < n, F.col("end") - F.col("begin")
    segment = F.when(F.col("plain"), F.substring("raw", F.col("begin") + 1, size)).otherwise(F.substring("line", F.col("begin") + 1, size).cast("binary"))
    inside = F.when(short, F.col("v_i") == 0).otherwise((F.col("begin") >= F.col("s")) & (F.col("end") <= F.col("e")))
    key = F.when(short, F.xxhash64(*seed, m, F.lit(-1))).otherwise(F.xxhash64(*seed, m, "v_i", segment))
    return rows.where(inside).select(*columns, key.alias("key"), "side", F.when(~short, F.col("v_i")).alias("i"), "begin", "end")


def parts_left(others: Column) -> Column:
    """`others` and what is left before and behind the segment of with_keys(), with the edits that each may have."""
    part = lambda s, e, d: F.struct(s.alias("s"), e.alias("e"), d.alias("d"))
    sides = F.array(part(F.col("s"), F.col("begin"), F.col("i")), part(F.col("end"), F.col("e"), F.col("d") - F.col("i")))
    return F.when(F.col("i").isNull(), others).otherwise(F.concat(others, F.filter(sides, lambda x: x["d"] > 0)))


def letter_counts(line: Column) -> dict[str, Column]:
    return {c: F.length(line) - F.length(F.replace(line, F.lit(x), F.lit(""))) for c, x in zip(COUNTS, LETTERS, strict=True)}


def counts_agree(distance: int) -> Column:
    """Whether the counts a.c* and b.c* allow the distance: an edit changes at most two of a line's counts, by one each."""
    gaps = [F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) for c in COUNTS]
    return sum(gaps[1:], gaps[0]) <= 2 * distance


def shared_start(a: Column, b: Column) -> Column:
    """How many characters a and b have in common at their start (or a little less, beyond two million)."""

    def run(t: Column) -> Column:
        same = lambda p, w: F.substring(t["a"], p + 1, w) == F.substring(t["b"], p + 1, w)
        longer = lambda p, w: F.when((p + w <= t["most"]) & same(p, w), p + w).otherwise(p)
        return F.aggregate(F.array(*[F.lit(1 << k) for k in range(20, -1, -1)]), F.lit(0), longer)

    return let(F.struct(a.alias("a"), b.alias("b"), F.least(F.length(a), F.length(b)).alias("most")), run)


def within(a: Column, b: Column, distance: int) -> Column:
    """Whether the edit distance of a and b is at most `distance`; a is the shorter, by at most `distance`.

    Bit k of a word stands for row j - distance + k of column j of the dynamic program (rows are a's characters). up and
    down are the vertical steps of the last column, moved to the rows of this one. The value at the band's lowest row is
    followed along the diagonal until that row is a's last, and then along the row. Neighbours differ by one at most and
    a diagonal never falls, so a value over three times the distance can't come back, and the rest is passed over, by blocks of
    columns."""
    width = 2 * distance + 1
    whole = (1 << width) - 1
    a_chars, b_chars = F.split(a, "", -1), F.split(b, "", -1)

    def run(x: Column) -> Column:
        rows, columns, p, q = x["m"], x["n"], x["p"], x["q"]

        def step(s: Column, j: Column) -> Column:
            row = j - distance
            letter = F.get(q, j - 1)
            match = F.lit(0)
            for k in range(width):
                match = match + F.when((row + k >= 1) & (row + k <= rows) & (F.get(p, row + k - 1) == letter), F.lit(1 << k)).otherwise(F.lit(0))
            moved = let(
                F.struct(match.alias("match"), s["up"].alias("up"), s["down"].alias("down"), s["value"].alias("value"), j.alias("j")),
                lambda t: let(
                    F.struct(
                        ((((t["match"].bitwiseAND(t["up"])) + t["up"]).bitwiseXOR(t["up"])).bitwiseOR(t["match"]).bitwiseOR(t["down"])).bitwiseAND(whole).alias("level"),
                        t.alias("t"),
                    ),
                    after,
                ),
            )
            return moved

        def block(s: Column, first: Column) -> Column:
            own = F.aggregate(F.sequence(first, F.least(first + (BLOCK - 1), columns)), s, step)
            return F.when(s["value"] > 3 * distance, s).otherwise(own)

        def after(y: Column) -> Column:
            level, t = y["level"], y["t"]
            right = t["down"].bitwiseOR(F.lit(whole) - level.bitwiseOR(t["up"]).bitwiseAND(whole))
            left = level.bitwiseAND(t["up"])
            next_level = F.shiftright(level, 1)
            up = left.bitwiseOR(F.lit(whole) - next_level.bitwiseOR(right).bitwiseAND(whole))
            last = rows - (t["j"] - distance)  # the bit of a's last row; from 2 * distance on the diagonal is followed
            bit = lambda w: F.call_function("shiftright", w, F.greatest(last, F.lit(0)).cast("int")).bitwiseAND(1)
            along = bit(right) - bit(left)
            change = F.when(last >= 2 * distance, F.lit(1) - F.shiftright(level, 2 * distance).bitwiseAND(1)).otherwise(along)
            return F.struct(up.alias("up"), next_level.bitwiseAND(right).alias("down"), (t["value"] + change).alias("value"))

        start = F.struct(F.lit(whole - (1 << distance) + 1).alias("up"), F.lit(0).alias("down"), F.least(F.lit(distance), rows).alias("value"))
        return F.when(columns == 0, rows <= distance).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(columns, F.lit(1)), F.lit(BLOCK)), start, block, lambda s: s["value"] <= distance))

    packed = F.struct(F.length(a).alias("m"), F.length(b).alias("n"), a_chars.alias("p"), b_chars.alias("q"))
    return let(packed, run)


def near(a: Column, b: Column, distance: int) -> Column:
    """within() of what is between the common ends of a and b."""
    length = lambda t, x, cut: F.length(t[x]) - cut
    shorter = F.length(a) <= F.length(b)
    ordered = F.struct(F.when(shorter, a).otherwise(b).alias("x"), F.when(shorter, b).otherwise(a).alias("y"))

    def ends(t: Column) -> Column:
        return let(F.struct(t["x"].alias("x"), t["y"].alias("y"), shared_start(t["x"], t["y"]).alias("p")), tail)

    def tail(t: Column) -> Column:
        q = F.least(shared_start(F.reverse(t["x"]), F.reverse(t["y"])), F.length(t["x"]) - t["p"])
        return let(F.struct(t["x"].alias("x"), t["y"].alias("y"), t["p"].alias("p"), (t["p"] + q).alias("cut")), core)

    def core(t: Column) -> Column:
        cores = F.struct(*[F.substring(t[x], t["p"] + 1, length(t, x, t["cut"])).alias(x) for x in ("x", "y")])
        return let(cores, lambda c: F.when(F.length(c["y"]) <= distance, F.lit(True)).otherwise(within(c["x"], c["y"], distance)))

    return let(ordered, ends)


def verified(pairs: DataFrame, texts: DataFrame, distance: int) -> DataFrame:
    """(h1, h2) of the later lines of pairs (aliases a, b) that are within the distance of the earlier ones."""
    turned = F.col("a.first") > F.col("b.first")
    ids = [F.when(turned, F.col(f"{y}.h{i}")).otherwise(F.col(f"{x}.h{i}")).alias(f"{x}{i}") for x, y in ("ab", "ba") for i in (1, 2)]
    line = lambda x: texts.select(F.col("h1").alias(f"{x}1"), F.col("h2").alias(f"{x}2"), F.col("line").alias(f"line_{x}"))
    both = pairs.select(*ids).distinct().join(line("a"), ["a1", "a2"]).join(line("b"), ["b1", "b2"])
    return both.where(near(F.col("line_a"), F.col("line_b"), distance)).select(F.col("b1").alias("h1"), F.col("b2").alias("h2")).distinct()


def still_open(rows: DataFrame, found: DataFrame) -> DataFrame:
    hit = found.select("h1", "h2", F.lit(True).alias("hit"))
    return rows.join(hit, ["h1", "h2"], "left").withColumn("open", F.col("open") & F.col("hit").isNull()).drop("hit")


def refined(rows: DataFrame, texts: DataFrame, distance: int) -> DataFrame:
    """rows of large groups, with keys that share one more segment. The group's common ends come from the least and greatest
    of its parts and of these reversed, which are partial aggregates."""
    own = rows.join(texts, ["h1", "h2"])
    part = lambda j, c: F.get("parts", F.lit(j))[c]
    piece = lambda j: F.substring("line", part(j, "s") + 1, part(j, "e") - part(j, "s"))

    def core(j: int) -> Column:
        def whole(p: Column) -> Column:
            q = F.least(shared_start(F.col(f"r_lo_{j}"), F.col(f"r_hi_{j}")), F.col(f"least_{j}") - p)
            return let(q, lambda x: F.struct((F.col(f"most_{j}") - p - x).alias("core"), F.lit(j).alias("pick"), p.alias("p"), x.alias("q")))

        return let(shared_start(F.col(f"lo_{j}"), F.col(f"hi_{j}")), whole)

    ends = []
    for j in range(distance):
        for x, least, most in ((piece(j), "lo", "hi"), (F.reverse(piece(j)), "r_lo", "r_hi"), (part(j, "e") - part(j, "s"), "least", "most")):
            ends += [F.min(x).alias(f"{least}_{j}"), F.max(x).alias(f"{most}_{j}")]
    cores = [core(j) for j in range(distance)]
    groups = own.groupBy("key").agg(*ends).select("key", F.array_max(F.array(*cores)).alias("g")).select("key", "g.pick", "g.p", "g.q")
    picked, keep = F.get("parts", "pick"), ["h1", "h2", "first", "n", *COUNTS, "open"]
    staged = own.join(groups, "key").select(
        *keep, "key", "line", (picked["s"] + F.col("p")).alias("s"), (picked["e"] - F.col("q")).alias("e"), picked["d"].alias("d"),
        F.filter("parts", lambda x, i: i != F.col("pick")).alias("others"),
    )
    keyed = with_keys(staged.withColumnRenamed("key", "of"), list(range(1, distance + 1)), 0, ["of"])
    return keyed.select("*", parts_left(F.col("others")).alias("parts")).groupBy("key", *keep, "parts").agg(F.bit_or("side").alias("side"))


def by_pivot(rows: DataFrame, texts: DataFrame, distance: int, backward: bool) -> DataFrame:
    """rows of large groups, with keys that share a place of the group's earliest line, the pivot. p is where a line leaves the
    pivot, and reach how far in the pivot a prefix of the line comes with `distance` edits (the furthest-reaching points of
    Ukkonen and Myers). Of a near pair, the line that leaves later is the pivot up to there, so the other's
    reach is not less: they meet at the later p, which the later line indexes and the other one probes. Backward:
    the same from the lines' ends."""
    turn = F.reverse if backward else (lambda x: x)
    pivots = rows.groupBy("key").agg(F.min(F.struct("first", "h1", "h2")).alias("e")).select("key", "e.h1", "e.h2")
    pivots = pivots.join(texts, ["h1", "h2"]).select("key", turn(F.col("line")).alias("r"))
    own = rows.join(texts, ["h1", "h2"]).withColumn("a", turn(F.col("line"))).drop("line").join(pivots, "key")
    after = lambda x, at: F.substring(x, at + 1, F.length(x))

    def held(df: DataFrame, values: dict[str, Column]) -> DataFrame:
        """df with these columns; the explode of one struct keeps their expressions from being written out in the next ones'."""
        one = F.explode_outer(F.array(F.struct(*[x.alias(c) for c, x in values.items()]))).alias("held")
        return df.select("*", one).select(*df.columns, "held.*")

    reached: dict[int, str] = {}  # by diagonal (place in a less place in the pivot): column with the place in the pivot
    for k in range(distance + 1):
        starts, ends = {}, {}
        for g in range(-k, k + 1):
            before = [F.col(reached[g + by]) + step for by, step in ((0, 1), (-1, 0), (1, 1)) if g + by in reached]
            at = F.greatest(*before) if len(before) > 1 else before[0] if before else F.lit(0)
            starts[f"from_{k}_{g + k}"] = F.greatest(F.least(at, F.length("r"), F.length("a") - g), F.lit(max(0, -g)))
            at = F.col(f"from_{k}_{g + k}")
            ends[f"to_{k}_{g + k}"] = at + shared_start(after(F.col("a"), at + g), after(F.col("r"), at))
        own = held(held(own, starts), ends)
        reached = {g: f"to_{k}_{g + k}" for g in range(-k, k + 1)}
    reach = F.greatest(F.col("to_0_0"), *[F.col(c) for c in reached.values()])
    # outer, for which no filter is inferred: it would be pushed down and write all of the above out again
    places = own.withColumn("place", F.explode_outer(F.sequence(F.col("to_0_0"), reach)))
    side = F.when(F.col("place") == F.col("to_0_0"), F.lit(INDEX + PROBE)).otherwise(F.lit(PROBE))
    keep = ["h1", "h2", "first", "n", *COUNTS, "open", "parts"]
    return places.select(*keep, F.xxhash64("key", F.lit(backward), "place").alias("key"), side.alias("side"))


def key_filter(keys: DataFrame, n: int) -> tuple[DataFrame, Column]:
    """A blocked Bloom filter of n keys (hashes): its rows (block, words), and the condition that a column `key` passes. A key's
    block is its rest by an odd number, which tells nothing of the low bits that choose the word and its marks."""
    blocks, key, long = min(n // BLOCK_KEYS, MOST_BLOCKS) | 1, F.col("key"), lambda v: F.lit(v).cast("long")
    word, mask = key.bitwiseAND(long(WORDS - 1)).cast("int"), long(0)
    for k in range(MARKS):
        mask = mask.bitwiseOR(F.call_function("shiftleft", long(1), F.shiftrightunsigned(key, 4 + 6 * k).bitwiseAND(long(63)).cast("int")))
    words = F.array(*[F.coalesce(F.bit_or(F.when(F.col("word") == i, F.col("mask"))), long(0)) for i in range(WORDS)])
    marked = keys.select(F.pmod(key, long(blocks)).alias("block"), word.alias("word"), mask.alias("mask"))
    return marked.groupBy("block").agg(words.alias("words")), (F.pmod(key, long(blocks)) == F.col("block")) & (F.get("words", word).bitwiseAND(mask) == mask)


def near_earlier(docs: DataFrame, firsts: DataFrame, distance: int, least: int, group: int = GROUP) -> DataFrame:
    """(h1, h2) of lines of which another line within the distance has an earlier first place."""
    lines = lines_of(docs, least).select("line", "h1", "h2", F.lit(0).alias("s"), F.length("line").alias("e"), F.lit(distance).alias("d"))
    keyed = with_keys(lines, [distance], least, [])
    ends = [f(h).alias(f"{k}{h}") for h in ("h1", "h2") for k, f in (("lo", F.min), ("hi", F.max))]
    shared = keyed.groupBy("key").agg(*ends, F.bit_or("side").alias("sides"))
    differ = (F.col("loh1") != F.col("hih1")) | (F.col("loh2") != F.col("hih2"))
    shared = materialize(shared.where(differ & (F.col("sides") == INDEX + PROBE)).select("key"), "line-keys")
    blocks, passes = key_filter(shared, shared.count())
    parts = parts_left(F.array().cast(PARTS)).alias("parts")
    each = keyed.join(F.broadcast(blocks), passes, "left_semi").groupBy("h1", "h2", "line").agg(F.collect_set(F.struct("key", "side", parts)).alias("keys"))
    counted = each.withColumns({"n": F.length("line"), "open": F.lit(True)} | letter_counts(F.col("line"))).join(firsts.select("h1", "h2", "first"), ["h1", "h2"])
    candidates = materialize(counted, "line-candidates")
    texts = candidates.select("h1", "h2", "line")
    rows = candidates.select("h1", "h2", "first", "n", *COUNTS, "open", F.explode("keys").alias("k")).select("*", "k.*").drop("k")

    same = (F.col("a.key") == F.col("b.key")) & (F.col("a.first") < F.col("b.first")) & F.col("b.open")
    alike = (F.abs(F.col("a.n") - F.col("b.n")) <= distance) & counts_agree(distance)
    indexes = F.col("side").bitwiseAND(INDEX) > 0
    before, after = F.col("a.first") < F.col("b.first"), F.col("a.first") > F.col("b.first")
    met = (F.col("a.key") == F.col("b.key")) & ((before & F.col("b.open")) | (after & F.col("a.open") & (F.col("b.side") == PROBE)))
    found: list[DataFrame] = []
    while True:
        top = rows.groupBy("key").agg(F.min(F.struct("first", "h1", "h2", "n", *COUNTS)).alias("e")).select("key", "e.*")
        found.append(materialize(verified(top.alias("a").join(rows.alias("b"), same & alike), texts, distance), "line-near"))
        state = still_open(rows, found[-1])
        keys = state.groupBy("key").agg(
            F.count_if(indexes).alias("size"), F.max(F.when(F.col("open"), F.col("first"))).alias("last"), F.min("first").alias("head"), F.bit_or("side").alias("sides")
        )
        useful = keys.where((F.col("last") > F.col("head")) & (F.col("sides") == INDEX + PROBE)).select("key", "size", "last")
        kept = materialize(state.join(useful, "key").where(F.col("first") <= F.col("last")).drop("last"), "line-open")
        large = (F.col("size") > group * min(1 << len(found) // 2, WIDEST)) & (F.size("parts") > 0)
        small = kept.where(~large)
        found.append(materialize(verified(small.where(indexes).alias("a").join(small.alias("b"), met & alike), texts, distance), "line-near"))
        if kept.where(large).isEmpty():
            break
        rest, level = still_open(kept.where(large).drop("size"), found[-1]), len(found) // 2
        divided = refined(rest, texts, distance) if level % 3 == 0 else by_pivot(rest, texts, distance, level % 3 == 2)
        rows = materialize(divided, "line-rows")
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    return every.distinct()


def repeated_lines(docs: DataFrame, distance: int = 2, least: int = 20, every: bool = False, group: int = GROUP) -> DataFrame:
    """(doc_id, t1, t2, line_no) of the lines to remove; t1 and t2 are the two hashes of the text."""
    own = lines_of(docs, least, every).select(*DOC, "line_no", "h1", "h2")
    place = F.struct(*DOC, "line_no")
    firsts = materialize(own.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")), "line-firsts")
    links = materialize(near_earlier(docs, firsts, distance, least, group), "line-links").withColumn("near", F.lit(True))
    gone = firsts.join(links, ["h1", "h2"], "left").where((F.col("n") > 1) | F.col("near")).select("h1", "h2", "first", "near")
    return own.join(gone, ["h1", "h2"]).where(F.coalesce("near", F.lit(False)) | (place > F.col("first"))).select(*DOC, "line_no").distinct()


def with_repeats(docs: DataFrame, repeats: DataFrame, to: str) -> DataFrame:
    """docs with the ascending numbers of their repeated lines in the column `to` (null: none)."""
    x, y, z = unused(docs, "of_doc", "of_t1", "of_t2")
    lists = repeats.groupBy(*[F.col(c).alias(n) for c, n in zip(DOC, (x, y, z), strict=True)]).agg(F.sort_array(F.collect_list("line_no")).alias(to))
    t1, t2 = two_hashes(F.coalesce(F.col("text"), F.lit("")))
    return docs.join(lists, F.col("doc_id").eqNullSafe(F.col(x)) & (t1 == F.col(y)) & (t2 == F.col(z)), "left").drop(x, y, z)


def line_report(docs: DataFrame, distance: int = 2, least: int = 20, every: bool = False, group: int = GROUP) -> DataFrame:
    """One row for each row of docs: doc_id, n_lines, n_removed, removed_lines (ascending, from 0)."""
    joined = with_repeats(docs.select("doc_id", "text"), repeated_lines(docs, distance, least, every, group), "removed")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return joined.select("doc_id", F.size(text_lines(F.col("text"))).alias("n_lines"), F.size(removed).alias("n_removed"), removed.alias("removed_lines"))


def drop_repeated_lines(docs: DataFrame, distance: int = 2, least: int = 20, every: bool = False, group: int = GROUP) -> DataFrame:
    """docs with the lines removed from text, and n_chars, if there, set anew. No document goes, even if it gets empty."""
    of_lines, of_text = unused(docs, "of_lines", "of_text")
    joined = with_repeats(docs, repeated_lines(docs, distance, least, every, group), of_lines)
    stay = F.array_except(F.sequence(F.lit(0), F.size(text_lines(F.col("text"))) - 1), F.col(of_lines))
    kept = let(text_lines(F.col("text")), lambda a: F.array_join(F.transform(stay, lambda i: F.get(a, i)), "\n"))
    text = F.when(F.col(of_lines).isNull(), F.col("text")).otherwise(kept)
    # explode of one value: the new text is evaluated once and is a column of its own for n_chars
    changed = joined.select("*", F.explode(F.array(text)).alias(of_text))
    new = {"text": F.col(of_text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(of_lines).isNull(), F.col("n_chars")).otherwise(F.length(of_text).cast("long"))
    return changed.withColumns(new).select(*docs.columns)
