"""Substring dedup by repeated-phrase automata.

Words are the runs of [^\\x20\\x09-\\x0D]. A window is 20 consecutive words of a document; a word is removed if a window over
it also starts earlier (smaller doc_id, or the same document and an earlier start). Windows are judged on the input.

0. Of documents with equal texts only the first takes part in the following; all windows of the others start earlier in it.
1. Seeds. Of each window the phrase of 5 words with the smallest hash is its seed, so equal windows have equal seeds.
   Phrases whose hash is in the lowest eighth are marks, and most seeds are marks. Seeds and marks are counted (partially
   before the shuffle), and the positions of those found twice or more go back to their documents.
2. Passages. A window of which the seed or a mark inside is found once only cannot repeat. Around each other seed the
   document gives the stretch of words whose windows have this seed, at most 35 words. Stretches are dealt by seed; a
   seed of more than `deal` occurrences is dealt over several tasks (step 4).
3. Automata. A task reads its stretches seed by seed, in the order of documents. For each block of them it counts
   windows, and those found twice or more are confirmed and compiled into an Aho-Corasick automaton over word numbers;
   so every task's seeds are a shard of the phrases. The block's stretches are streamed through the automaton, which finds
   every occurrence exactly; all but the first of each window are removed.
4. The distinct windows of a seed that was dealt over several tasks are compared by their 128-bit hash, aggregated to the
   first occurrence of each.
5. Spans are joined to the documents.

Cases: null and empty texts have no words (the hash of the empty string); fewer than 20 words are never removed; rows
that repeat a doc_id and its text are one document, returned each; rows that repeat a doc_id with different texts are different
documents, in the order of their texts' hashes; a null doc_id is before all others; other columns are ignored; an empty
table gives an empty result."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletide.llm.common import as_bytes, materialize, row_slices, sorted_groups, two_hashes

WINDOW, SEED = 20, 5
SLICE = 2 << 20
FEW_COPIES = 500_000  # ids
FEW_SEEDS = 500_000  # longs and counts
STRETCH = "seed long, deal int, doc_id long, start int, words binary"
FOUND = "doc_id long, start int, end int, hash binary"


def mixed(x: np.ndarray) -> np.ndarray:
    """Stafford's 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
FACTOR = np.uint64(0x9E3779B97F4A7C15)  # odd
MARK = np.uint64((1 << 64) // 8)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(joined: bytes) -> np.ndarray:
    """A hash of each word of a buffer in which every word is followed by a space."""
    buf = np.frombuffer(joined, np.uint8)
    if not len(buf):
        return np.zeros(0, np.uint64)
    total = np.cumsum(BYTE[buf] * powers(int(FACTOR), len(buf)), dtype=np.uint64)
    ends = np.flatnonzero(buf == 32)
    upto = total[ends]
    span = np.diff(upto, prepend=np.uint64(0))
    starts = np.concatenate([[0], ends[:-1] + 1])
    back = powers(pow(int(FACTOR), -1, 1 << 64), len(buf))[starts]
    return mixed(span * back)


def seeds_of(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the words of several documents, one after the other: the hash of the phrase at each place, and for each place
    that starts a window the place of its seed (-1 elsewhere)."""
    n = len(hashes)
    if n < WINDOW:
        return np.zeros(n, np.uint64), np.full(n, -1)
    phrase = np.zeros(n, np.uint64)
    m = n - SEED + 1
    for j in range(SEED):
        phrase[:m] = phrase[:m] * FACTOR + hashes[j : j + m]
    phrase = mixed(phrase)
    width, at, span = WINDOW - SEED + 1, np.arange(n), 1
    while span < width:
        by = min(span, width - span)
        left, right = at[: len(at) - by], at[by:]
        at = np.where(phrase[left] <= phrase[right], left, right)
        span += by
    place = np.full(n, -1)
    doc = np.repeat(np.arange(len(counts)), counts)
    place[: n - WINDOW + 1] = np.where(doc[: n - WINDOW + 1] == doc[WINDOW - 1 :], at[: n - WINDOW + 1], -1)
    return phrase, place


def spaced(words: list[bytes]) -> bytes:
    return b" ".join(words) + b" " if words else b""


def placed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, place): place is a long that orders documents as doc_id does and that only rows equal in both share. It
    is the doc_id itself, unless some are null or stand for several texts: then the distinct pairs are sorted and numbered."""
    h1, h2 = two_hashes(F.coalesce(F.col("text"), F.lit("")))
    own = docs.select("doc_id", h1.alias("h1"), h2.alias("h2"))
    ends = own.groupBy("doc_id").agg(*[f(h).alias(f"{k}{h}") for h in ("h1", "h2") for k, f in (("lo", F.min), ("hi", F.max))])
    if ends.where("doc_id is null or loh1 <> hih1 or loh2 <> hih2").isEmpty():
        return docs.select("doc_id", "text", F.col("doc_id").cast("long").alias("place"))
    numbered = materialize(own.distinct().orderBy("doc_id", "h1", "h2").withColumn("place", F.monotonically_increasing_id()), "repeats-places")
    numbered = numbered.withColumnRenamed("doc_id", "of")
    keyed = docs.select("doc_id", "text", h1.alias("k1"), h2.alias("k2"))
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2"))
    return keyed.join(numbered, same).select("doc_id", "text", "place")


def later_copies(docs: DataFrame) -> DataFrame:
    """(doc_id) of documents whose text a smaller doc_id has."""
    h1, h2 = two_hashes(F.col("text"))
    own = docs.select("doc_id", h1.alias("h1"), h2.alias("h2"), F.octet_length("text").alias("n")).where("n > 0")
    firsts = own.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    return own.join(firsts, ["h1", "h2", "n"]).where("doc_id > first").select("doc_id").distinct()


def seeds(docs: DataFrame) -> DataFrame:
    """(seed, doc_id, pos): the seeds of all windows, and the marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches, "text", SLICE):
            words = [x.split() for x in as_bytes(b.column("text"))]
            counts = np.array([len(w) for w in words])
            phrase, place = seeds_of(word_hashes(b"".join(map(spaced, words))), counts)
            end = np.cumsum(counts)
            wanted = phrase < MARK
            wanted[place[place >= 0]] = True
            at = np.flatnonzero(wanted)
            doc = np.searchsorted(end, at, side="right")
            inside = (at + SEED <= end[doc]) & (counts[doc] >= WINDOW)
            at, doc = at[inside], doc[inside]
            ids = b.column("doc_id").cast(pa.int64()).take(pa.array(doc))
            yield pa.record_batch([pa.array(phrase[at].view(np.int64)), ids, pa.array((at - (end - counts)[doc]).astype(np.int32))], names=["seed", "doc_id", "pos"])

    return docs.select("doc_id", "text").mapInArrow(run, "seed long, doc_id long, pos int")


def candidate_stretches(words: list[bytes], pos: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(index in pos, seed hash, first word, end) for the recurring positions pos (ascending) of a document."""
    phrase, place = seeds_of(word_hashes(spaced(words)), np.array([len(words)]))
    once = phrase < MARK
    once[len(words) - SEED + 1 :] = False
    once[pos[pos < len(words)]] = False
    before = np.concatenate([[0], np.cumsum(once)])
    m = len(words) - WINDOW + 1
    if m < 1:
        return
    place = np.where(before[WINDOW - SEED + 1 : WINDOW - SEED + 1 + m] > before[:m], -1, place[:m])
    start = np.flatnonzero(np.diff(place, prepend=-2))
    end, seed = np.append(start[1:], m), place[start]
    k = np.minimum(np.searchsorted(pos, seed), len(pos) - 1)
    for j in np.flatnonzero((seed >= 0) & (pos[k] == seed)).tolist():
        yield int(k[j]), int(phrase[seed[j]].view(np.int64)), int(start[j]), int(end[j]) - 1 + WINDOW


def stretches(docs: DataFrame, deal: int) -> DataFrame:
    """The stretches of words around seeds that are found twice or more."""
    often = seeds(docs).groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    # a table of its own, so that the join below has no aggregate on a side and its hot seeds can be split
    often = materialize(often.select("seed", F.ceil(F.col("n") / deal).cast("int").alias("deals")), "repeats-seeds")
    found = seeds(docs).join(F.broadcast(often) if often.count() <= FEW_SEEDS else often, "seed")
    by_doc = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "deals"))).alias("found"))
    by_doc = by_doc.select("doc_id", F.col("found.pos").alias("pos"), F.col("found.deals").alias("deals"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches, "text", SLICE):
            out: list[tuple] = []
            for i, text in enumerate(as_bytes(b.column("text"))):
                words, doc = text.split(), b.column("doc_id")[i].as_py()
                pos, deals = (np.asarray(b.column(c)[i].values) for c in ("pos", "deals"))
                for k, seed, lo, hi in candidate_stretches(words, pos):
                    own = xxhash.xxh32_intdigest(str(doc)) % int(deals[k]) if deals[k] > 1 else -1
                    out.append((seed, own, doc, lo, b" ".join(words[lo:hi])))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
            yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["seed", "deal", "doc_id", "start", "words"])

    return docs.select("doc_id", "text").join(by_doc, "doc_id").mapInArrow(run, STRETCH)


def block_windows(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Confirm, compile and locate over a block of stretches: for each occurrence of a window that occurs twice or more
    its stretch, its offset there, and the window's number, in the order of the stretches."""
    number: dict[bytes, int] = {}
    text: list[int] = []
    for w in words:
        text += [number.setdefault(x, len(number) + 1) for x in w]
        text.append(0)
    ids = np.array(text, np.int64)
    lengths = np.array([len(w) + 1 for w in words])
    own = np.repeat(np.arange(len(words)), lengths)
    spread, m = mixed(ids.astype(np.uint64) * FACTOR), len(ids) - WINDOW + 1
    hashed = np.zeros(max(m, 0), np.uint64)
    for j in range(WINDOW):
        hashed = hashed * FACTOR + spread[j : j + len(hashed)]
    inside = np.flatnonzero(own[: len(hashed)] == own[np.minimum(np.arange(len(hashed)) + WINDOW, len(ids) - 1)])
    _, first, times = np.unique(hashed[inside], return_index=True, return_counts=True)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for k, at in enumerate(inside[first[times > 1]].tolist()):
        automaton.add_word(tuple(text[at : at + WINDOW]), k)
    empty = np.zeros(0, np.int64)
    if not len(automaton):
        return empty, empty, empty
    automaton.make_automaton()
    hits = np.array(list(automaton.iter(tuple(text))), np.int64).reshape(-1, 2)
    at = hits[:, 0] - WINDOW + 1
    begin = np.cumsum(lengths) - lengths
    return own[at], at - begin[own[at]], hits[:, 1]


def located(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """From stretches sorted by seed, deal, document and start: spans to remove (hash null), and of seeds that are dealt
    over tasks the distinct windows with their first place here (hash set)."""

    def solve(held: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(held).sort_by([("doc_id", "ascending"), ("start", "ascending")])  # a block may have several deals of a seed
        words = [x.split(b" ") for x in t.column("words").to_pylist()]
        doc = np.array([-1 if x is None else x for x in t.column("doc_id").to_pylist()], np.int64)
        start = np.asarray(t.column("start").combine_chunks())
        of, offset, window = block_windows(words)
        _, first, inverse = np.unique(window, return_index=True, return_inverse=True)
        place = start[of] + offset
        later = (doc[of] != doc[of][first][inverse]) | (place != place[first][inverse])
        d, s = doc[of][later], place[later]
        order = np.lexsort((s, d))
        d, s = d[order], s[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (s[1:] > s[:-1] + WINDOW)
        lasts = np.append(np.flatnonzero(new)[1:] - 1, len(d) - 1) if len(d) else np.zeros(0, np.int64)
        rows = list(zip(d[new].tolist(), s[new].tolist(), (s[lasts] + WINDOW).tolist(), [None] * int(new.sum()), strict=True))
        seen: set[bytes] = set()
        for k in np.flatnonzero(np.asarray(t.column("deal").combine_chunks()) >= 0).tolist():
            for j in range(len(words[k]) - WINDOW + 1):
                h = xxhash.xxh3_128_digest(b" ".join(words[k][j : j + WINDOW]))
                if h not in seen:
                    seen.add(h)
                    rows.append((int(doc[k]), int(start[k]) + j, int(start[k]) + j + WINDOW, h))
        types = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.record_batch([pa.array([r[i] for r in rows], x) for i, x in enumerate(types)], names=["doc_id", "start", "end", "hash"])

    held, n = [], 0
    for t in sorted_groups(batches, ["seed", "deal"]):
        if n and n + t.num_rows > block:
            yield solve(held)
            held, n = [], 0
        held.append(t)
        n += t.num_rows
    if held:
        yield solve(held)


def repeated_spans(docs: DataFrame, deal: int = 20_000, block: int = 8_000) -> DataFrame:
    """(doc_id, start, end, hash): what located() finds."""
    order = ["seed", "deal", "doc_id", "start"]
    return stretches(docs, deal).repartition("seed", "deal").sortWithinPartitions(*order).mapInArrow(lambda x: located(x, block), FOUND)


def final_spans(found: DataFrame) -> DataFrame:
    """found with the windows of dealt seeds resolved: all but the first place of each go."""
    plain = found.where(F.col("hash").isNull()).select("doc_id", "start", "end")
    dealt = found.where(F.col("hash").isNotNull())
    place = F.struct("doc_id", "start")
    firsts = dealt.groupBy("hash").agg(F.min(place).alias("first"), F.count("*").alias("n")).where(F.col("n") > 1)
    later = dealt.join(firsts, "hash").where(place > F.col("first")).select("doc_id", "start", "end")
    return plain.unionByName(later)


def remove_repeats(docs: DataFrame, deal: int = 20_000, block: int = 8_000, with_text: bool = False) -> DataFrame:
    """One row for each row of docs (doc_id, text): n_words, n_removed, kept_sha256 and, if asked for, kept_text (kept
    words joined by one space)."""
    whole = placed(docs)
    named = whole.select(F.col("place").alias("doc_id"), "text")
    copies = materialize(later_copies(named), "repeats-copies")
    rest = named.join(F.broadcast(copies) if copies.count() <= FEW_COPIES else copies, "doc_id", "left_anti")
    spans = final_spans(materialize(repeated_spans(rest, deal, block), "repeats"))
    spans = spans.unionByName(copies.select("doc_id", F.lit(0).alias("start"), F.lit((1 << 31) - 1).alias("end")))
    by_doc = spans.groupBy(F.col("doc_id").alias("place")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches, "text", SLICE):
            rows = []
            for doc, text, own in zip(b.column("doc_id").to_pylist(), as_bytes(b.column("text")), b.column("spans").to_pylist(), strict=True):
                words = text.split()
                gone = np.zeros(len(words) + 1, np.int64)
                for s in own or ():
                    if s["start"] < len(words) >= WINDOW:
                        gone[s["start"]] += 1
                        gone[min(s["end"], len(words))] -= 1
                stay = np.cumsum(gone)[:-1] == 0
                kept = b" ".join(compress(words, stay.tolist()))
                rows.append((doc, len(words), len(words) - int(stay.sum()), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            cells = [pa.array([r[i] for r in rows], x) for i, x in enumerate(types)]
            if with_text:
                cells.append(pa.array([r[4] for r in rows], pa.binary()).cast(pa.string()))
            yield pa.record_batch(cells, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: len(cells)])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return whole.join(by_doc, "place", "left").select("doc_id", "text", "spans").mapInArrow(run, schema)
