"""Exact dedup: a tree merge of sorted digest runs.

Every input partition becomes a run: an entry for each digest with the row that stays and the number of rows. In rounds of
a binomial tree of order `fan_in` the partitions exchange runs: a run has a rank, and in round k digit k of the rank (in base
fan_in) becomes digit k of the digest's bucket. Runs that meet at a rank are read in order of their digests and merged at
once, so each level holds one entry a rank and digest, and after the last round one a digest. What a digest's rows have in
common is thus aggregated by partition and then by at most fan_in entries at a time, however many rows share it; the way back
down the same tree hands the result to the run, and a run's rows are joined only there. No task sees all rows of a group.

Entries are ordered by a 64-bit digest and merged only where SHA-256 and length agree as well: this is verified at every
level, and texts whose 64-bit digests collide stay apart. Texts themselves are read once and never shuffled.

Native: DataFrame functions only. Levels are written to the shared folder, so a lost executor costs one level.

Defined results: null text counts as empty, and empty texts are one group. Of equal texts the row with the largest (or
smallest) id stays; a null id is smaller than any (larger with keep="smallest"), and of rows with the same id the last (first)
as numbered when they were read. An empty table gives an empty result. Other columns are neither read nor in the way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletide.llm.common import materialize, unused

#: What an entry is known by: the digest orders it, the other two verify it.
KEY = ("digest", "sha", "n_bytes")
FAN_IN = 16


def next_rank(level: int, fan_in: int) -> Column:
    """The rank that an entry goes to in round `level`: one digit of its rank is replaced by its digest's."""
    unit = fan_in**level
    digit = F.floor(F.pmod(F.col("digest"), F.lit(fan_in ** (level + 1))) / unit)
    own = F.floor(F.pmod(F.col("rank"), F.lit(fan_in ** (level + 1))) / unit)
    return (F.col("rank") + (digit - own) * unit).cast("long")


def chosen(best: Column, keep: str) -> Column:
    return F.max(best) if keep == "largest" else F.min(best)


def null_order(id_: str, keep: str) -> Column:
    """Ahead of an id in a struct: null ids are the last to be chosen."""
    return (F.col(id_).isNotNull() if keep == "largest" else F.col(id_).isNull()).alias("order_of_nulls")


def merged(entries: DataFrame, keep: str) -> DataFrame:
    """Runs that meet at a rank as one: rows of a rank come together, in order of their digests, and equal entries become one."""
    met = entries.repartition("rank").sortWithinPartitions("rank", *KEY)
    return met.groupBy("rank", *KEY).agg(chosen(F.col("best"), keep).alias("best"), F.sum("n").alias("n"))


def copy_groups(
    docs: DataFrame, text: str = "text", id_: str = "doc_id", keep: str = "largest", fan_in: int = FAN_IN, digest: Callable[[Column], Column] = F.xxhash64
) -> DataFrame:
    """A row for each of docs: run, row (its number), id, n_bytes, sha (binary), keep_id (the id of the row that stays),
    group_size, kept. digest: a long of the text that orders the runs; any will do."""
    if keep not in ("largest", "smallest") or fan_in < 2:
        raise ValueError("keep is 'largest' or 'smallest', fan_in at least 2")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    read = docs.select(F.col(id_).alias("id"), body.alias("body"))
    rows = materialize(
        read.select(
            F.spark_partition_id().cast("long").alias("rank"), F.monotonically_increasing_id().alias("row"), "id", digest(F.col("body")).cast("long").alias("digest"),
            F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("sha"), F.octet_length("body").cast("long").alias("n_bytes"),
        ),
        "exact-rows",
    )
    best = F.struct(null_order("id", keep), "id", "row")
    runs = rows.groupBy("rank", *KEY).agg(chosen(best, keep).alias("best"), F.count("*").alias("n"))  # combined before the shuffle
    levels = [materialize(runs.sortWithinPartitions("rank", *KEY), "exact-runs")]
    top = levels[0].agg(F.max("rank")).first()[0] or 0
    while len(levels) == 1 or fan_in ** (len(levels) - 1) <= top:
        k = len(levels) - 1
        levels.append(materialize(merged(levels[-1].withColumn("rank", next_rank(k, fan_in)), keep), f"exact-level{k + 1}"))
    found = levels.pop().where("n > 1")
    while levels:
        k = len(levels) - 1
        below = levels.pop().select(F.col("rank").alias("from"), next_rank(k, fan_in).alias("rank"), *KEY)
        found = below.join(found, ["rank", *KEY]).select(F.col("from").alias("rank"), *KEY, "best", "n")
    joined = rows.join(found, ["rank", *KEY], "left")
    alone = F.col("n").isNull()
    return joined.select(
        F.col("rank").alias("run"), "row", "id", "n_bytes", "sha", F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (alone | (F.col("row") == F.col("best.row"))).alias("kept"),
    )


def drop_copies(docs: DataFrame, text: str = "text", id_: str = "doc_id", keep: str = "largest", fan_in: int = FAN_IN) -> DataFrame:
    """docs, with all their columns, without the rows whose text another row keeps. docs are written once with a number, and
    the rows that stay are found by it."""
    (number,) = unused(docs, "number")
    numbered = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "exact-docs")
    ids = numbered.select(F.col(text).alias("text"), F.struct(null_order(id_, keep), F.col(id_).alias("id"), F.col(number).alias("number")).alias("id"))
    stay = copy_groups(ids, "text", "id", keep, fan_in).where("kept").select(F.col("id.number").alias(number))
    return numbered.join(stay, number, "left_semi").drop(number)


def dedup_report(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 (lower-case hex) of every row: copy_groups of documents."""
    groups = copy_groups(docs, fan_in=fan_in)
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))
