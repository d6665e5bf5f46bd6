"""Toxicity by maximum-scoring segments.

Tokens are words (as in decontamination: letters and digits, A-Z lower-cased); a word is looked up whole and by its
prefixes of 4 to 8 characters. From labelled rows that aren't held out, each token gets the log-odds of being in a toxic
and a clean document under a Dirichlet prior in proportion to its pooled frequency, and a z-score. Tokens with a
significant z-score are the lexicon, with the log-odds as score; a word has the score of its most significant token, and
any other word costs `drift`. In each document a linear-time scan (Ruzzo and Tompa) finds all maximal scoring segments:
the toxic passages.

Calibration. Maximal segment scores of clean texts follow an extreme-value (Gumbel) law: with the rate lambda, at which
the mean of exp(lambda * score) over clean words is 1, a text of n words has no segment of score S or more with the
probability exp(-n * K * exp(-lambda * S)). K is the maximum-likelihood estimate from the best scores of the clean training
rows, of which those without a scoring word are censored at 0. This gives each segment a p-value, and its excess over the
score of p-value SIGNIFICANT is its evidence; a document's is the sum over its significant segments (excess over
zero), or the best excess if none is. A logistic curve of the evidence, fitted on training rows, gives the score.

At most `most_rows` labelled rows are used for training, chosen by a hash of doc_id (a documented bound, so the labels may be
broadcast); the lexicon is bounded by them. All documents are scored, whole texts, without labels, lang or source.

Cases: null and empty texts have no words and get the score of no evidence; a null doc_id is not held out and never a
training row; rows that repeat are returned each; repeated labels of a doc_id count once, as toxic if any is; without
training rows of both kinds the score is 0; other columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletide.llm.common import as_bytes, materialize, row_slices
from tabletide.llm.decontam import words

SHORTEST, LONGEST = 4, 8
PHRASE, NEAR, BANDS, WIDE = 5, 0.8, 8, 4
MOST_OF_ONE = 5  # occurrences of a token that count in one document
#: What a Python worker holds at once: scores of words, token lists of words, bytes of text whose tokens are counted.
MOST_KNOWN, MOST_SPLIT, MOST_COUNTED = 50_000, 20_000, 1 << 20
SIGNIFICANT = 0.01
AT_SIGNIFICANT = -math.log(-math.log1p(-SIGNIFICANT))
PASSAGES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("p_value", pa.float64())]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def tokens(word: bytes) -> list[bytes]:
    """A word whole, and its prefixes (in characters), marked by a trailing hyphen."""
    text = word.decode("utf-8", "replace")
    return [word, *[text[:k].encode() + b"-" for k in range(SHORTEST, min(LONGEST, len(text)) + 1)]]


class Known(dict):
    """word -> its score, made when it is first asked for. Bounded."""

    def __init__(self, lexicon: dict[bytes, tuple[float, float]], drift: float) -> None:
        self.lexicon, self.none = lexicon, (0.0, -drift)

    def __missing__(self, word: bytes) -> float:
        if len(self) > MOST_KNOWN:
            self.clear()
        s = self[word] = max((self.lexicon[t] for t in tokens(word) if t in self.lexicon), default=self.none)[1]
        return s


@dataclass
class Model:
    lexicon: dict[bytes, tuple[float, float]]  # token -> (z, log-odds)
    drift: float
    rate: float = 1.0
    location: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def __post_init__(self) -> None:
        self.known = Known(self.lexicon, self.drift)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def scores(self, w: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, w), float, len(w))

    def segments(self, w: list[bytes]) -> list[tuple[int, int, float]]:
        """All maximal scoring segments (start, end, score), in order. Only scoring words are visited one by one."""
        return maximal_segments(self.scores(w))

    def excess(self, s: float, n: int) -> float:
        """By how much a segment's normed score is beyond the one that clean texts of n words exceed with SIGNIFICANT."""
        return self.rate * s - math.log(max(n, 1)) - self.location - AT_SIGNIFICANT

    def p_value(self, s: float, n: int) -> float:
        """The probability that the best segment of a clean text of n words scores s or more."""
        return -math.expm1(-math.exp(min(700.0, math.log(max(n, 1)) + self.location - self.rate * s)))

    def evidence(self, segments: list[tuple[int, int, float]], n: int) -> float:
        each = [self.excess(s, n) for _, _, s in segments] or [self.excess(0.0, n)]
        return sum(x for x in each if x > 0) or max(each)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.slope * evidence + self.offset))))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time: each segment that is held links to the last one
    before it with a smaller total before, so that those in between are never visited again."""
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    held: list[tuple[int, int, float, float, int]] = []  # start, end, total before, total after, link
    places = np.flatnonzero(scores > 0)
    for start, before, after in zip(places.tolist(), sums[places].tolist(), sums[places + 1].tolist(), strict=True):
        end, j = start + 1, len(held) - 1
        while True:
            while j >= 0 and held[j][2] >= before:
                j = held[j][4]
            if j < 0 or held[j][3] >= after:
                held.append((start, end, before, after, j))
                break
            start, _, before, _, link = held[j]
            del held[j:]
            j = link
    return [(a, b, after - before) for a, b, before, after, _ in held]


def log_odds(counts: DataFrame, toxic: int, clean: int, prior: float, least_z: float | None, drift: float) -> Model:
    """counts: (token, t, c, tn, cn): documents of each kind that have the token, and its occurrences in them. The
    documents, in which one text can't speak for many, say whether a token is significant, by
    default if its z-score is beyond the largest to expect of as many standard normal ones; the occurrences give its score. The prior weighs as `prior` times the documents,
    and as a tenth of that times the occurrences."""

    def delta(t: Column, c: Column, all_t: Column, all_c: Column, weight: float) -> tuple[Column, Column]:
        a, mass = weight * (t + c), weight * (all_t + all_c)
        y, x = t + a, c + a
        d = F.log(y / (all_t + mass - y)) - F.log(x / (all_c + mass - x))
        return d, d / F.sqrt(1 / y + 1 / x)

    words_ = counts.where("is_word").agg(F.sum("tn").alias("t"), F.sum("cn").alias("c")).first()
    _, z = delta(F.col("t"), F.col("c"), F.lit(toxic), F.lit(clean), prior)
    d, _ = delta(F.col("tn"), F.col("cn"), F.lit(words_["t"]), F.lit(words_["c"]), prior / 10)
    tested = materialize(counts.where("t >= 3").select("token", d.alias("delta"), z.alias("z")), "toxicity-tokens")
    least_z = math.sqrt(2 * math.log(max(2, tested.count()))) if least_z is None else least_z
    found = tested.where((F.col("z") >= least_z) & (F.col("delta") > 0))
    return Model({bytes(r["token"]): (r["z"], r["delta"]) for r in found.collect()}, drift)  # bounded by the training rows


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method, with a slight pull of the slope to zero."""
    w = np.zeros(2)
    m = np.stack([np.clip(x, -30, 30), np.ones(len(x))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -50, 50)))
        gradient = m.T @ (y - p) - np.array([0.01, 0]) * w
        step = np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + np.diag([0.01, 1e-6]), gradient)
        w = w + step
        if abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def calibrate(model: Model, rows: list[tuple[float, list, int, int]], mean_clean: dict[float, int]) -> Model:
    """rows: (best segment score, all segments' scores, words, label) of training rows; mean_clean: word score -> how
    often in clean ones."""
    s = np.array(list(mean_clean), float)
    n = np.array(list(mean_clean.values()), float)
    n /= n.sum()
    lo, hi = 1e-6, 1.0
    while (n * np.exp(np.minimum(hi * s, 500))).sum() < 1 and hi < 64:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (n * np.exp(np.minimum(mid * s, 500))).sum() < 1 else (lo, mid)
    model.rate = lo
    # maximum likelihood of the location; texts without a scoring word only say that their best score is at most 0
    clean = [(best, max(k, 1)) for best, _, k, label in rows if not label]
    scored = max(1, sum(best > 0 for best, _ in clean))
    model.location = math.log(scored / max(1e-300, sum(k * math.exp(-model.rate * best) for best, k in clean))) if clean else 0.0
    x = np.array([model.evidence([(0, 0, v) for v in each], k) for _, each, k, _ in rows])
    model.slope, model.offset = logistic(x, np.array([r[3] for r in rows], float))
    return model


def one_of_copies(rows: DataFrame) -> DataFrame:
    """rows (row, doc_id, text, toxic) without near copies, whose words would otherwise count once a copy: a row goes if an
    earlier one (by doc_id, then row) of its label stays and at least NEAR of the five-word phrases of both are in both.

    BANDS hashes, each of WIDE min-hashes, only propose pairs: a row and the earliest of its label with the same hash. So
    a few copies may stay, but none goes unverified. Rows, and so pairs, are bounded by the training rows."""

    seeds = np.random.default_rng(5).integers(0, 1 << 63, (2, BANDS * WIDE), np.uint64)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches, "text"):
            bands, phrases = [], []
            for text in as_bytes(b.column("text")):
                w = words(text)
                h = np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(w[i : i + PHRASE])) for i in range(max(1, len(w) - PHRASE + 1))], np.uint64))
                least = np.array([((h ^ a) * (c | np.uint64(1))).min() for a, c in seeds.T], np.uint64).reshape(BANDS, WIDE)
                bands.append([xxhash.xxh64_intdigest(x.tobytes()) >> 1 for x in least])
                phrases.append(h.view(np.int64))
            cells = [pa.array(bands, pa.list_(pa.int64())), pa.array(phrases, pa.list_(pa.int64()))]
            yield pa.record_batch([b.column("row"), b.column("doc_id").cast(pa.int64()), b.column("kind"), *cells], names=["row", "doc_id", "kind", "bands", "phrases"])

    named = rows.select("row", "doc_id", "text", (F.col("toxic") > 0).alias("kind"))
    own = materialize(named.mapInArrow(sketch, "row long, doc_id long, kind boolean, bands array<long>, phrases array<long>"), "toxicity-sketches")
    each = own.select(F.struct("doc_id", "row").alias("place"), "kind", F.posexplode("bands").alias("band", "h"))
    least = each.groupBy("kind", "band", "h").agg(F.min("place").alias("first"))
    pairs = each.join(least, ["kind", "band", "h"]).where(F.col("place") > F.col("first")).select("place", "first").distinct()
    a, b = own.select(F.col("row").alias("a"), F.col("phrases").alias("p")), own.select(F.col("row").alias("b"), F.col("phrases").alias("q"))
    both = pairs.join(a, F.col("first.row") == F.col("a")).join(b, F.col("place.row") == F.col("b")).withColumn("n", F.size(F.array_intersect("p", "q")))
    near = both.where(F.col("n") >= NEAR * (F.size("p") + F.size("q") - F.col("n"))).select("place.*", F.col("first.row").alias("first")).collect()
    gone: set[int] = set()
    for r in sorted(near):  # in order, so that whether the first one stays is known
        if r["first"] not in gone:
            gone.add(r["row"])
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame([(x,) for x in gone], "row long")), "row", "left_anti")


def train(docs: DataFrame, labels: DataFrame, most_rows: int, prior: float, least_z: float | None, drift: float) -> Model | None:
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    spread = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 30))
    chosen = known.where(spread < int((1 << 30) * min(1.0, 0.97 * most_rows / max(n, 1))) + (n <= most_rows) * (1 << 30))
    labelled = materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("row", F.monotonically_increasing_id()), "toxicity-labelled")
    rows = materialize(one_of_copies(labelled), "toxicity-rows")
    kinds = {r["toxic"] > 0: r["n"] for r in rows.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if len(kinds) < 2:
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(MOST_SPLIT)(tokens)
        for b in row_slices(batches, "text", MOST_COUNTED):  # the slices' counts are merged by the aggregation, before its shuffle
            found = [Counter() for _ in range(4)]  # toxic, clean documents; occurrences in them
            for text, label in zip(as_bytes(b.column("text")), b.column("toxic").to_pylist(), strict=True):
                kind, own = int(label <= 0), {}
                for w, n in Counter(words(text)).items():
                    for t in known(w):
                        own[t] = own.get(t, 0) + n
                found[kind].update(own.keys())
                found[kind + 2].update({t: min(n, MOST_OF_ONE) for t, n in own.items()})
            keys = list(found[0].keys() | found[1].keys())
            cells = [pa.array(keys, pa.binary()), pa.array([not k.endswith(b"-") for k in keys])]
            yield pa.record_batch(cells + [pa.array([f[k] for k in keys], pa.int64()) for f in found], names=["token", "is_word", "t", "c", "tn", "cn"])

    schema = "token binary, is_word boolean, t long, c long, tn long, cn long"
    counts = rows.select("text", "toxic").mapInArrow(count, schema).groupBy("token", "is_word").agg(*[F.sum(x).alias(x) for x in ("t", "c", "tn", "cn")])
    model = log_odds(counts, kinds[True], kinds[False], prior, least_z, drift)
    held = spark.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches, "text"):
            out, seen = [], Counter()
            for text, label in zip(as_bytes(b.column("text")), b.column("toxic").to_pylist(), strict=True):
                w = words(text)
                scores = held.value.scores(w)
                each = [s for _, _, s in maximal_segments(scores)]
                out.append((int(label > 0), len(w), each, None, None))
                if label <= 0:
                    seen.update(np.round(scores, 6).tolist())
            out += [(None, None, None, k, v) for k, v in seen.items()]
            types = (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.int64())
            yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["label", "n", "scores", "score", "times"])

    scanned = materialize(rows.select("text", "toxic").mapInArrow(scan, "label int, n long, scores array<double>, score double, times long"), "toxicity-scan")
    words_ = {r["score"]: r["times"] for r in scanned.where("score is not null").groupBy("score").agg(F.sum("times").alias("times")).collect()}
    fit = [(max(r["scores"], default=0.0), r["scores"], r["n"], r["label"]) for r in scanned.where("label is not null").select("label", "n", "scores").collect()]  # most_rows at most
    return calibrate(model, fit, words_)


def score(
    docs: DataFrame, labels: DataFrame, most_rows: int = 40_000, prior: float = 0.1, least_z: float | None = None, drift: float = 0.2, threshold: float = 0.7
) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, held_out, score, predicted, passages (significant segments:
    words start to end, their score and p-value). labels: (doc_id, toxic)."""
    model = train(docs, labels, most_rows, prior, least_z, drift)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches, "text"):
            rows, own = [], held.value
            for text in as_bytes(b.column("text")):
                w = words(text)
                found = own.segments(w) if own else []
                p = own.probability(own.evidence(found, len(w))) if own else 0.0
                rows.append((p, int(p >= threshold), [{"start": s, "end": e, "score": v, "p_value": own.p_value(v, len(w))} for s, e, v in found if own.excess(v, len(w)) > 0]))
            cells = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.float64(), pa.int32(), PASSAGES))]
            yield pa.record_batch([b.column("doc_id").cast(pa.int64()), b.column("held_out"), *cells], names=["doc_id", "held_out", "score", "predicted", "passages"])

    named = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return named.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, passages array<struct<start:int,end:int,score:double,p_value:double>>")
