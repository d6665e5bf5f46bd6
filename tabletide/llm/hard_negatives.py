"""Hard negatives: anchor-clustered shared lists.

Anchors are clustered by direction. For a cluster, every candidate of a chunk has one upper bound of its inner product with
any member: |x| cos(max(0, angle(x, centre) - widest angle of a member)), times the member's length. The chunk is sorted by it
once a cluster, and all members walk that list in steps until termination is certified: a member stops when its next bound
is below the worst of its full top list (an equal one could still win by its id) or below the lowest score that could
count. The scores themselves are exact integers.

There are two searches of all rows: an anchor's positives (best rows of its label), and for each positive the best rows of other
labels in its score band. A task scans candidates in chunks of bounded size and keeps its own top lists; the lists of all
tasks meet by anchor. Anchors are the query set: they come to the tasks in blocks of at most MOST_ANCHORS (a bounded
broadcast), and all rows are scanned once a block. Centres are fitted on at most FIT_ANCHORS anchors, chosen by a hash: they only
order the lists, and results don't depend on them.

Defined results: rows with a null id, label or vector or any null or non-finite component take no part. Vectors of different
lengths are padded with zeros. Rows that repeat an id are rows of their own, ordered among themselves as they were numbered
when read. Zero vectors score 0. No anchors, no rows of the label or none in the band give no rows. Components must
fit a long once scaled; inner products of 2^53 and more are summed as 64-bit integers, below that as doubles, which is exact."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabletide.llm.common import materialize

#: Anchors in one broadcast, anchors that centres are fitted on, candidates in a chunk, list entries in a step.
MOST_ANCHORS, FIT_ANCHORS, CHUNK, STEP = 8192, 2048, 16384, 512
#: Against rounding of angles, and what stands for no score.
SLACK, NONE = 1e-6, -(2**63 - 1)


def prepared(rows: DataFrame, scale: float = 256.0, label: Column | None = None) -> DataFrame:
    """uid, vec_id, label, v (array of long) of the rows that take part; rows has vec_id, embedding and label."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(usable)
    v = F.transform(x, lambda c: F.floor(F.lit(scale) * c).cast("long"))
    chosen = (F.col("label") if label is None else label).cast("int")
    return kept.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), chosen.alias("label"), v.alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of longs as rows of a matrix; shorter ones are padded with zeros."""
    sizes = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten(), dtype=np.int64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def units(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions (zero for zero vectors) and lengths."""
    x = v.astype(np.float64)
    length = np.sqrt((x * x).sum(axis=1))
    return x / np.where(length > 0, length, 1.0)[:, None], length


def fit_centres(v: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Directions of about the square root of len(v) clusters, by Lloyd's steps on the sphere from evenly spaced rows."""
    x, _ = units(v)
    k = max(1, round(len(x) ** 0.5))
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy() if len(x) else np.zeros((1, v.shape[1]))
    for _ in range(rounds if len(x) else 0):
        own = (x @ centres.T).argmax(axis=1)
        for c in range(k):
            if (own == c).any():
                centres[c] = x[own == c].sum(axis=0)
        centres, _ = units(centres)
    return centres


class Clusters:
    """A block of anchors: v, ids and labels, and for each cluster its members, centre and widest angle. bands: for the search
    of negatives, the least and the greatest score that count for each positive of an anchor (NONE where there is none)."""

    def __init__(self, uid: np.ndarray, label: np.ndarray, v: np.ndarray, centres: np.ndarray, bands: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.uid, self.label, self.v, self.bands = uid, label, v, bands
        direction, self.length = units(v)
        near = direction @ centres.T
        own = near.argmax(axis=1)
        angle = np.arccos(np.clip(near[np.arange(len(v)), own], -1, 1))
        self.parts = []
        for c in np.unique(own):
            members = np.flatnonzero(own == c)
            wide = np.pi if not centres[c].any() else float(angle[members].max()) + SLACK
            self.parts.append((members, centres[c], wide))


class Top:
    """The k best (score, vec_id, uid) of each of n lists, best first; higher scores, then smaller ids."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.score = np.full((n, k), NONE)
        self.vec, self.uid = np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -1)

    def offer(self, i: int, score: np.ndarray, vec: np.ndarray, uid: np.ndarray) -> None:
        if not len(score):
            return
        s, v, u = np.concatenate([self.score[i], score]), np.concatenate([self.vec[i], vec]), np.concatenate([self.uid[i], uid])
        best = np.lexsort((u, v, -s))[: self.k]
        self.score[i], self.vec[i], self.uid[i] = s[best], v[best], u[best]

    def worst(self) -> np.ndarray:
        return self.score[:, -1]


def scored(a: np.ndarray, x: np.ndarray, as_doubles: bool) -> np.ndarray:
    """Inner products as integers."""
    return (a.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64) if as_doubles else a @ x.T


def walk(block: Clusters, tops: Top, vec: np.ndarray, uid: np.ndarray, label: np.ndarray, v: np.ndarray) -> None:
    """Take a chunk of candidates through the lists of every cluster. Without bands: tops has one list an anchor, of rows of its
    label. With bands: one list an anchor and positive, of rows of other labels whose score is in the band."""
    direction, length = units(v)
    k = 1 if block.bands is None else block.bands[0].shape[1]
    exact = float(np.abs(v).max(initial=0)) * float(np.abs(block.v).max(initial=0)) * v.shape[1] < 2**53
    for members, centre, wide in block.parts:
        angle = np.arccos(np.clip(direction @ centre, -1, 1))
        bound = length * np.cos(np.maximum(0.0, angle - wide))
        order = np.argsort(-bound, kind="stable")
        active = members
        for lo in range(0, len(order), STEP):
            step = order[lo : lo + STEP]
            # the bound is for a member of length 1
            reach = block.length[active] * bound[step[0]] + SLACK * (1 + block.length[active] * length.max())
            least = tops.worst().reshape(-1, k)[active]
            if block.bands is not None:
                least = np.maximum(least, block.bands[0][active])
            goes_on = (reach[:, None] >= least).any(axis=1)
            active, least = active[goes_on], least[goes_on]
            if not len(active):
                break
            scores = scored(block.v[active], v[step], exact)
            fits = (block.label[active][:, None] == label[step][None, :]) == (block.bands is None)
            fits &= block.uid[active][:, None] != uid[step][None, :]
            fits &= scores >= least.min(axis=1)[:, None]
            if block.bands is not None:
                fits &= scores <= block.bands[1][active].max(axis=1)[:, None]
            for r in np.flatnonzero(fits.any(axis=1)):
                at = np.flatnonzero(fits[r])
                for j in range(k):
                    s = scores[r][at]
                    hit = s >= least[r, j]
                    if block.bands is not None:
                        hit &= s <= block.bands[1][active[r], j]
                    tops.offer(active[r] * k + j, s[hit], vec[step[at[hit]]], uid[step[at[hit]]])


def chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(vec_id, uid, label, v) of about CHUNK candidates at a time."""
    held: list[tuple[np.ndarray, ...]] = []
    for b in batches:
        t = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        held.append((np.asarray(t["vec_id"]), np.asarray(t["uid"]), np.asarray(t["label"]), matrix(t["v"], width)))
        if sum(len(x[0]) for x in held) >= CHUNK:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held = []
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


FOUND = "anchor_uid long, positive int, vec_id long, uid long, score long"


def search(rows: DataFrame, block: Clusters, width: int, k: int) -> DataFrame:
    """anchor_uid, positive (place of the band, 0 without), vec_id, uid, score: the top lists of every task."""
    sent = rows.sparkSession.sparkContext.broadcast(block)
    schema = pa.schema([("anchor_uid", pa.int64()), ("positive", pa.int32()), ("vec_id", pa.int64()), ("uid", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        bands = 1 if own.bands is None else own.bands[0].shape[1]
        tops = Top(len(own.uid) * bands, k)
        for vec, uid, label, v in chunks(batches, width):
            walk(own, tops, vec, uid, label, v)
        at, place = np.nonzero(tops.uid >= 0)
        columns = [own.uid[at // bands], (at % bands).astype(np.int32), tops.vec[at, place], tops.uid[at, place], tops.score[at, place]]
        for lo in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + (1 << 16)], t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return rows.select("vec_id", "uid", "label", "v").mapInArrow(run, FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    """The first k of all tasks' lists, with rank from 1."""
    w = Window.partitionBy("anchor_uid", "positive").orderBy(F.desc("score"), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def blocks_of(anchors: DataFrame, most: int) -> int:
    """In how many blocks anchors come, by a hash of their numbers, so that a block has about `most` or fewer."""
    return max(1, -(-anchors.count() // most))


def as_block(anchors: DataFrame, centres: np.ndarray, width: int) -> Clusters | None:
    """Anchors (uid, label, v, and bands as an array of structs rank, low, high if they are given) in the form that tasks take."""
    got = anchors.toArrow()
    if not got.num_rows:
        return None
    got = got.sort_by("uid").combine_chunks()
    uid, label, v = np.asarray(got["uid"]), np.asarray(got["label"]), matrix(got["v"].chunk(0), width)
    if "bands" not in got.column_names:
        return Clusters(uid, label, v, centres)
    lists = got["bands"].to_pylist()
    most = max(1, *(len(x) for x in lists))
    low, high = np.full((len(uid), most), 2**63 - 1), np.full((len(uid), most), NONE)
    for i, bands in enumerate(lists):
        for x in bands:
            low[i, x["rank"] - 1], high[i, x["rank"] - 1] = x["low"], x["high"]
    return Clusters(uid, label, v, centres, (low, high))


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), label: Column | None = None, most_anchors: int = MOST_ANCHORS
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. rows: vec_id, embedding, label;
    is_anchor is a condition on vec_id and label. share: (80, 100) for negatives from 80 to 100 hundredths of the positive."""
    spark = rows.sparkSession
    own = materialize(prepared(rows, label=label), "negatives-rows")
    width = own.agg(F.max(F.size("v"))).first()[0] or 1
    anchors = own.where(is_anchor)
    sample = anchors.orderBy(F.xxhash64("uid")).limit(FIT_ANCHORS).select("v").toArrow().combine_chunks()
    centres = fit_centres(matrix(sample["v"].chunk(0), width) if sample.num_rows else np.zeros((0, width), np.int64))
    n = blocks_of(anchors, most_anchors)

    def lists(of: DataFrame, k: int) -> DataFrame:
        found = spark.createDataFrame([], FOUND)
        for b in range(n):
            block = as_block(of.where(F.pmod(F.xxhash64("uid"), F.lit(n)) == b), centres, width)
            if block is not None:
                found = found.unionByName(materialize(search(own, block, width, k), "negatives-found"))
        return best(found, k)

    queries = anchors.select("uid", "label", "v")
    near = materialize(lists(queries, positives), "negatives-positives")
    low = -F.floor(-F.col("score").cast("decimal(38,0)") * share[0] / share[1])  # the least integer in the band
    bands = near.groupBy("anchor_uid").agg(F.collect_list(F.struct("rank", low.cast("long").alias("low"), F.col("score").alias("high"))).alias("bands"))
    far = lists(queries.join(bands.withColumnRenamed("anchor_uid", "uid"), "uid"), negatives)
    names = anchors.select(F.col("uid").alias("anchor_uid"), F.col("vec_id").alias("anchor_id"))
    pairs = near.select("anchor_uid", (F.col("rank") - 1).cast("int").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(pairs, ["anchor_uid", "positive"]).join(names, "anchor_uid").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )
