"""Small helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting that removes an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A temporary one only where it is unset and the
    executors are this process (local mode, as in tests); elsewhere that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write df as a Parquet table in the shared folder (in folders by some columns) and read it back: later steps neither
    recompute it nor depend on the executors that made it. Shuffle files of the write go as soon as it is done; else they
    stay until the driver happens to collect its garbage, and the steps' files add up."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def two_hashes(*parts: Column) -> tuple[Column, Column]:
    """128 bits of hash as two longs. The hash of a value is the seed of the next one's, so the literal comes first: behind
    the parts it would make the second long a function of the first."""
    return F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)


def content_key(*columns: str) -> Column:
    """128 bits of hash over these columns, nulls told apart from values: equal for rows that are equal in them."""
    parts = [c for name in columns for c in (F.isnull(name), F.col(name))]
    return F.concat_ws("-", *[F.hex(h) for h in two_hashes(*parts)])


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, with underscores behind those that df has already."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def row_slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about most_bytes of text, so that long texts don't add up in memory."""
    for batch in batches:
        sizes = np.asarray(pc.binary_length(batch.column(text)).fill_null(0))
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // most_bytes, prepend=0)) if len(sizes) else []
        bounds = [0, *[int(c) for c in cuts if c], batch.num_rows]
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, from batches that are sorted by them. A run may cross batches."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
        change = np.zeros(t.num_rows - 1, dtype=bool)
        for k in keys:
            v = np.asarray(t.column(k).combine_chunks())
            change |= v[1:] != v[:-1]
        bounds = [0, *(np.flatnonzero(change) + 1).tolist()]
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            yield t.slice(lo, hi - lo)
        rest = t.slice(bounds[-1])
    if rest is not None and rest.num_rows:
        yield rest


def connected_components(edges: DataFrame, tag: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (u, v), both long: component is the smallest node that can be reached.

    Alternating large-star and small-star rounds, each written to the shared folder; only two numbers a round come to
    the driver. A node with very many neighbours is aggregated before the shuffle, and its rows in the join back are
    split by adaptive execution."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        near = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e.select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
        )
        least = near.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        hit = near.join(least, "u")
        moved = hit.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else hit.select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.*")
        return moved.where(F.col("u") != F.col("v")).distinct()

    e = materialize(edges.select("u", "v").where(F.col("u") != F.col("v")).distinct(), tag)
    mark = None
    for _ in range(most_rounds):
        e = materialize(star(star(e, True), False), tag)
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()
