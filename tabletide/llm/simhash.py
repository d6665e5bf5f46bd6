"""SimHash near-duplicates by a Gray-order hierarchical index.

A document's words are the runs of [^\\x20\\x09-\\x0D] in its text with A-Z lower-cased; its shingles are four
consecutive words joined by a space, repeats included (fewer words: the whole sequence; none: fingerprint zero). Bit b
of the fingerprint is 1 if it is set in over half of the shingles' XXH64 (seed 42). Fingerprints link at `distance` or
fewer differing bits.

The index. Distinct fingerprints only take part, so copies cost nothing. 64 bits are cut into distance + 1 bands; two
linked fingerprints agree in one band at least. For each band the fingerprint is rotated until the band leads: the band
is the mask of a top node and its value the node's pattern, and Spark shuffles each fingerprint to its top nodes. Below
a top node, one task sorts the members by Gray rank, so that neighbours share bits, and folds every `FAN` of them into a
node that holds the mask and pattern of the bits that they share; levels are added until one node is left. A query goes
down from the root: each node adds the differences under the part of its mask that its parent hasn't tested, and a
node at which the sum passes the distance is dropped with all that is below.

A top node of more than `block` members is dealt into blocks by a hash; every pair of its blocks is a task, so no task
holds more than two blocks. Links inside a task become a spanning forest (never all pairs); forests are joined by
distributed star rounds.

Cases: null and empty texts have fingerprint zero and link like any other; rows that repeat a doc_id or a text are each
returned; an empty table gives an empty result; other columns are ignored. A null doc_id is returned with a null
doc_id and never names a component unless all of its component are null."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletide.llm.common import as_bytes, connected_components, materialize, row_slices, sorted_groups, unused

SEED, SHINGLE, FAN = 42, 4, 8


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a text's UTF-8 bytes (bytes.lower changes A-Z alone, bytes.split has our words)."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_digest
    counts, n = np.zeros(64, np.int64), len(words) - shingle + 1
    lo, hi = starts[:n].tolist(), ends[shingle - 1 :].tolist()
    for at in range(0, n, 65536):
        hashed = b"".join([digest(joined[s:e], SEED) for s, e in zip(lo[at : at + 65536], hi[at : at + 65536], strict=True)])
        counts += np.unpackbits(np.frombuffer(hashed, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches, "text"):
            fps = np.array([fingerprint(x, shingle) for x in as_bytes(b.column("text"))], np.uint64).view(np.int64)
            yield pa.record_batch([b.column("doc_id").cast(pa.int64()), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code word in the reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """The hierarchical index over an array of codes."""

    def __init__(self, codes: np.ndarray) -> None:
        self.order = np.argsort(gray_rank(codes), kind="stable")
        codes = codes[self.order]
        self.levels = [(np.full(len(codes), ~np.uint64(0)), codes)]  # (mask, pattern), leaves first
        while len(self.levels[-1][0]) > 1:
            mask, pattern = self.levels[-1]
            cuts = np.arange(0, len(mask), FAN)
            ones, anyone = np.bitwise_and.reduceat(pattern, cuts), np.bitwise_or.reduceat(pattern, cuts)
            shared = np.bitwise_and.reduceat(mask, cuts) & ~(ones ^ anyone)
            self.levels.append((shared, ones & shared))

    def search(self, queries: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in queries, place in codes) at distance or less. Work is done for blocks of queries."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for at in range(0, len(queries), 1024):
            q = np.arange(at, min(at + 1024, len(queries)))
            node, gone, above = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.zeros(len(q), np.uint64)
            for depth in range(len(self.levels) - 1, -1, -1):
                mask, pattern = self.levels[depth]
                gone = gone + np.bitwise_count(mask[node] & ~above & (queries[q] ^ pattern[node]))
                near = gone <= distance
                q, node, gone = q[near], node[near], gone[near]
                if depth:
                    first, below = node * FAN, len(self.levels[depth - 1][0])
                    n = np.minimum(below - first, FAN)
                    above = np.repeat(mask[node], n)
                    q, gone = np.repeat(q, n), np.repeat(gone, n)
                    node = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(q))
            found.append((q, self.order[node]))
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the smallest place that the links (a, b) reach: minimum labels with pointer jumping."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
        left = label[a] != label[b]
        a, b = a[left], b[left]
    return label


def link_fingerprints(fps: DataFrame, distance: int = 4, block: int = 4096) -> DataFrame:
    """Edges (u, v) between distinct fingerprints fps (fp long) whose components are those of all links."""
    bands = distance + 1
    widths = [64 // bands + (i < 64 % bands) for i in range(bands)]
    starts = [sum(widths[:i]) for i in range(bands)]
    rows = fps.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(F.shiftleft("fp", starts[i]), 64 - widths[i]).alias("value")) for i in range(bands)])).alias("top"),
    ).select("fp", "top.*")
    sizes = rows.groupBy("band", "value").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    last = F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("int")
    own = F.pmod(F.xxhash64("fp", "band"), F.col("k")).cast("int")
    dealt = (
        rows.join(sizes, ["band", "value"])
        .withColumn("k", last)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        .select("band", "value", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "fp")
    )
    keys = ["band", "value", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, keys):
            fp = np.asarray(t.column("fp").combine_chunks()).view(np.uint64)
            side = np.asarray(t.column("own").combine_chunks()) == t.column("hi")[0].as_py()
            band = t.column("band")[0].as_py()
            turned = (fp << np.uint64(starts[band])) | (fp >> np.uint64((64 - starts[band]) % 64)) if starts[band] else fp
            whole = bool(side.all())
            left, right = (np.arange(len(fp)), np.arange(len(fp))) if whole else (np.flatnonzero(~side), np.flatnonzero(side))
            if not len(left) or not len(right):
                continue
            a, b = GrayIndex(turned[right]).search(turned[left], distance)
            a, b = left[a], right[b]
            label = forest(len(fp), a[a != b], b[a != b])
            moved = np.flatnonzero(label != np.arange(len(fp)))
            if len(moved):
                yield pa.record_batch([pa.array(fp[moved].view(np.int64)), pa.array(fp[label[moved]].view(np.int64))], names=["u", "v"])

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "u long, v long")


def simhash_groups(docs: DataFrame, distance: int = 4, shingle: int = SHINGLE, block: int = 4096) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, fingerprint (16 hex digits), component_id (the smallest
    doc_id that links reach, itself included), class_fingerprints (how many distinct fingerprints its class has)."""
    marked = materialize(fingerprints(docs, shingle), "simhash")
    firsts = marked.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    parts = connected_components(link_fingerprints(firsts.select("fp"), distance, block), "simhash-links")
    placed = firsts.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "first_doc", F.coalesce("component", "fp").alias("component"))
    named = placed.groupBy("component").agg(F.min("first_doc").alias("component_id"), F.count("*").alias("class_fingerprints"))
    classes = placed.select("fp", "component").join(named, "component")
    return marked.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "class_fingerprints"
    )


def keep_first(docs: DataFrame, distance: int = 4) -> DataFrame:
    """One row of each group stays: the one with the smallest doc_id (nulls last), of several with that one the first row
    of a table that is written with row numbers. So repeated rows and groups of null doc_ids leave one row as well."""
    (row,) = unused(docs, "of_row")
    own = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "simhash-rows")
    groups = simhash_groups(own.select(F.col(row).alias("doc_id"), "text"), distance)
    placed = own.select(F.col(row).alias("row"), F.col("doc_id").alias("id")).join(groups.select(F.col("doc_id").alias("row"), "component_id"), "row")
    first = F.min(F.struct(F.isnull("id").alias("none"), "id", "row")).alias("first")
    stay = placed.groupBy("component_id").agg(first).select(F.col("first.row").alias(row))
    return own.join(stay, row, "left_semi").select(*docs.columns)
