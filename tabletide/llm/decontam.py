"""Benchmark decontamination by an FM-index for each shard of the training texts.

Words are the runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after A-Z are lower-cased. A window is 13 consecutive words of an
item (an item of fewer words, but not none, is one window). A word inside any occurrence of a window is hit.

A shard is a slice of documents of about `shard_bytes` of text inside one task. Its symbols are the words that any window
has; all other words, and the ends of documents, are separators. A window occurs only inside a run of symbols, so runs
shorter than the shortest window are left out. Over the rest the task builds a suffix array by prefix doubling, its
Burrows-Wheeler transform, a wavelet matrix for ranks and a sample of suffix positions (every eighth, and the start of
each run); all windows are searched backward together, occurrences are located by walking to the next sample, and their
spans are merged.

Windows reach the tasks in broadcast blocks of items of about `block_bytes`, read one block after the other; with more
than one block each is a pass over the documents, and the spans and items of a document's passes are merged by a shuffle.

Cases: null and empty texts and items have no words (an item without words never occurs); rows that repeat a doc_id are
returned each; rows that repeat an item_id are windows of one item; rows with a null item_id are one item, named None; empty tables give no hits or no rows; other columns
are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletide.llm.common import as_bytes, content_key, row_slices, sorted_groups, unused

WINDOW = 13
WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 32 for b in range(256))
ID_TYPES = {"long": pa.int64(), "string": pa.string()}
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:int,end:int>>"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def words(text: bytes) -> list[bytes]:
    return text.lower().translate(WORD_BYTES).split()


class FmIndex:
    """Over an array of symbols in which 0 separates; each separator is smaller than all else and than those behind it."""

    def __init__(self, text: np.ndarray, sample: int = 8) -> None:
        n = len(text)
        gaps = np.flatnonzero(text == 0)
        rank = text.astype(np.int64) + len(gaps)
        rank[gaps] = np.arange(len(gaps))
        order, span = np.argsort(rank, kind="stable"), 1
        while True:
            ordered = rank[order]
            if span > 1:
                after = np.concatenate([rank, np.full(span // 2, -1)])[order + span // 2]
                new = np.concatenate([[0], np.cumsum((ordered[1:] != ordered[:-1]) | (after[1:] != after[:-1]))])
            else:
                new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = new
            if new[-1] == n - 1:
                break
            order = np.argsort(rank * (n + 1) + np.concatenate([rank[span:], np.full(min(span, n), -1)])[:n] + 1, kind="stable")
            span *= 2
        before = text[order - 1]
        self.size, self.order = n, order
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=int(text.max()) + 1))])
        starts = np.zeros(n, bool)
        starts[0] = True
        starts[gaps[:-1] + 1] = True
        self.sampled = (order % sample == 0) | starts[order]
        self.position = order[self.sampled]
        self.nth = np.cumsum(self.sampled) - 1
        self.last = before
        self.ranks: list[tuple[int, int, np.ndarray]] = []  # (bit, zeros, ones before each place)
        for bit in range(max(1, int(text.max()).bit_length()) - 1, -1, -1):
            one = (before >> bit) & 1
            self.ranks.append((bit, n - int(one.sum()), np.concatenate([[0], np.cumsum(one, dtype=np.int32)])))
            before = np.concatenate([before[one == 0], before[one == 1]])
        self.begin = np.zeros(int(text.max()) + 1, np.int64)
        symbols = np.arange(int(text.max()) + 1)
        self.begin = self.rank_from(symbols, np.zeros(len(symbols), np.int64), np.zeros(len(symbols), np.int64))

    def rank_from(self, symbol: np.ndarray, place: np.ndarray, begin: np.ndarray) -> np.ndarray:
        for bit, zeros, ones in self.ranks:
            up = (symbol >> bit) & 1
            place = np.where(up == 1, zeros + ones[place], place - ones[place])
        return place - begin

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol is in the transform before each place."""
        return self.rank_from(symbol, place, self.begin[symbol])

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of rows of equal length: (rows that occur, first place, place after the last)."""
        rows = np.arange(len(phrases))
        rows = rows[(phrases < len(self.first) - 1).all(axis=1)]
        lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), self.size, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            s = phrases[rows, k]
            lo, hi = self.first[s] + self.rank(s, lo), self.first[s] + self.rank(s, hi)
            some = lo < hi
            rows, lo, hi = rows[some], lo[some], hi[some]
        return rows, lo, hi

    def locate(self, places: np.ndarray) -> np.ndarray:
        """Positions in the text: back along the transform to the next sample, which a run's start always is."""
        at, steps, open_ = places.copy(), np.zeros(len(places), np.int64), np.flatnonzero(~self.sampled[places])
        while len(open_):
            s = self.last[at[open_]]
            at[open_] = self.first[s] + self.rank(s, at[open_])
            steps[open_] += 1
            open_ = open_[~self.sampled[at[open_]]]
        return self.position[self.nth[at]] + steps


class Phrases:
    """The windows of some items: distinct ones, in numbers, by length, and the items that have each."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW) -> None:
        self.symbol: dict[bytes, int] = {}
        self.ids = sorted({str(i) for i, _ in items})
        number = {x: k for k, x in enumerate(self.ids)}
        owners: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            w = [self.symbol.setdefault(x, len(self.symbol) + 1) for x in words(text)]
            for at in range(max(1, len(w) - window + 1)) if w else ():
                owners.setdefault(tuple(w[at : at + window]), set()).add(number[str(item)])
        self.by_length: list[tuple[np.ndarray, list[list[int]]]] = []
        for n in sorted({len(x) for x in owners}):
            own = [x for x in owners if len(x) == n]
            self.by_length.append((np.array(own, np.int64), [sorted(owners[x]) for x in own]))
        self.shortest = min((len(x) for x in owners), default=0)

    def find(self, texts: list[bytes]) -> tuple[list[int], list[np.ndarray], list[set[str]]]:
        """Of each text the number of words, the merged spans of hit words (rows start, end), and the items."""
        symbols, counts, get = [], [], self.symbol.get
        for text in texts:
            w = words(text)
            counts.append(len(w))
            symbols.append(np.fromiter(map(get, w, repeat(0)), np.int32, len(w)))
            symbols.append(np.zeros(1, np.int32))
        ends = np.cumsum(np.array(counts) + 1)
        spans: list[np.ndarray] = [np.zeros((0, 2), np.int64)] * len(texts)
        items: list[set[str]] = [set() for _ in texts]
        whole = np.concatenate(symbols)
        edge = np.flatnonzero(np.diff((whole > 0).astype(np.int8), prepend=0, append=0))
        start, end = edge[::2], edge[1::2]
        keep = end - start >= self.shortest
        start, end = start[keep], end[keep]
        if not len(start) or not self.shortest:
            return counts, spans, items
        n = end - start + 1  # with one separator behind each run
        origin = np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        index = FmIndex(whole[origin])
        hit = []
        for phrases, owners in self.by_length:
            rows, lo, hi = index.search(phrases)
            if not len(rows):
                continue
            times = hi - lo
            places = np.repeat(lo - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
            at = origin[index.locate(places)]
            hit.append(np.stack([at, at + phrases.shape[1]], axis=1))
            for row, doc in set(zip(np.repeat(rows, times).tolist(), np.searchsorted(ends, at, side="right").tolist(), strict=True)):
                items[doc].update(self.ids[i] for i in owners[row])
        if hit:
            merged = merge(np.concatenate(hit))
            doc = np.searchsorted(ends, merged[:, 0], side="right")
            base = ends - np.array(counts) - 1
            for d in np.unique(doc).tolist():
                spans[d] = merged[doc == d] - base[d]
        return counts, spans, items


def merge(spans: np.ndarray) -> np.ndarray:
    """Overlapping and touching spans as one."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.stack([spans[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)]], axis=1)


def result_rows(rows: list[tuple], id_type: str = "long") -> pa.RecordBatch:
    """From (doc_id, n_words, spans, items)."""
    out = []
    for doc, n, spans, items in rows:
        hit = int((spans[:, 1] - spans[:, 0]).sum())
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((doc, n, hit, len(items), digest, hit > 0 and 20 * hit >= n, [{"start": a, "end": b} for a, b in spans.tolist()]))
    types = (ID_TYPES[id_type], pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), SPANS)
    return pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=[x.split()[0] for x in RESULT.split(", ")])


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = 8 << 20, block_bytes: int = 4 << 20, id_type: str = "long") -> DataFrame:
    """One row for each row of docs (doc_id, text): n_words, n_hit, n_items, items_sha256, contaminated, and the spans
    of hit words. benchmark: (item_id, text). id_type: doc_id's type."""
    spark, schema = docs.sparkSession, RESULT.replace("doc_id long", f"doc_id {id_type}")
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    passes = []
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else items
        held = spark.sparkContext.broadcast(Phrases([(r["item_id"], r["text"].encode()) for r in own.collect()], window))  # about block_bytes

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in row_slices(batches, "text", shard_bytes):
                found = held.value.find(as_bytes(b.column("text")))
                rows = list(zip(b.column("doc_id").to_pylist(), *found, strict=True))
                if blocks == 1:
                    yield result_rows(rows, id_type)
                else:
                    keys = b.column("key").to_pylist()
                    cells = ([x for x, _ in zip(keys, rows, strict=True)], [r[0] for r in rows], [r[1] for r in rows], [r[2].ravel().tolist() for r in rows], [sorted(r[3]) for r in rows])
                    types = (pa.string(), ID_TYPES[id_type], pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()))
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(cells, types, strict=True)], names=["key", "doc_id", "n_words", "flat", "items"])

        if blocks == 1:
            return docs.select("doc_id", "text").mapInArrow(run, schema)
        named = docs.select("doc_id", "text", F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.sha1(F.coalesce("text", F.lit("")))).alias("key"))
        passes.append(named.mapInArrow(run, f"key string, doc_id {id_type}, n_words long, flat array<long>, items array<string>").withColumn("pass", F.lit(k)))
    rows = passes[0]
    for p in passes[1:]:
        rows = rows.unionByName(p)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, ["key"]):
            own = t.to_pylist()
            spans = np.array([x for r in own for x in r["flat"]], np.int64).reshape(-1, 2)
            one = (own[0]["doc_id"], own[0]["n_words"], merge(spans) if len(spans) else spans, {x for r in own for x in r["items"]})
            yield result_rows([one] * sum(r["pass"] == 0 for r in own), id_type)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(combine, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that are contaminated; all others unchanged. Each row goes or stays by its own text, whether
    its doc_id is null, repeated or neither."""
    (key,) = unused(docs, "of_key")
    keyed = docs.withColumn(key, content_key("doc_id", "text"))
    found = find_contamination(keyed.select(F.col(key).alias("doc_id"), "text"), benchmark, id_type="string")
    gone = found.where("contaminated").select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(gone, key, "left_anti").select(*docs.columns)
