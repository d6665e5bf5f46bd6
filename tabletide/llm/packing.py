"""Best-fit packing of documents into sequences by a configuration linear program.

A document is its token ids and then id 0; only documents longer than a sequence are cut, into pieces of full length,
of which the first may be shorter. The program has a variable for each configuration (a multiset of lengths that fits
a sequence) and asks for as few sequences as possible that cover the length histogram, which has at most `size`
entries whatever the corpus. It is solved by multiplicative weights on both sides: each length has a weight, which falls as
it is covered, and each known configuration a share, which grows with what its lengths are worth. A knapsack dynamic
program over the capacity prices the lengths: it finds the configurations worth most, which join the known ones, and by the
dearest one the prices give a lower bound. The fractional solution is rounded, and what is left over is packed by best
fit decreasing, on the histogram as well; the result is never worse than best fit alone.

The plan has a row for each configuration and length (bounded by the number of rounds and the capacity, not by the
corpus), says which ranks of a length go to which sequences, and is broadcast. The rank of a piece among those of its
length is made of counts by (length, input partition), so no length is gathered in one task.

Cases: null and empty texts are one piece with id 0 alone; rows that repeat are pieces each; an empty table gives an
empty result; very long texts give many full pieces, which are sequences of their own; other columns are ignored."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabletide.llm.common import materialize, row_slices
from tabletide.llm.tokens import VOCABULARY, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
Config = tuple[tuple[int, int], ...]  # (length, how many), lengths descending


def pieces(docs: DataFrame, size: int = 2048, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).ids
        for b in row_slices(batches, "text"):
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.int32(0)).astype("<u4")
                cuts = [0, *range(len(ids) % size or size, len(ids), size), len(ids)] if len(ids) > size else [0, len(ids)]
                rows += [(doc, k, lo, hi - lo, zlib.crc32(ids[lo:hi])) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))]
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def knapsack(price: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each capacity the worth of the dearest configuration, and the length to take first (0: leave one unit free).
    An unbounded knapsack by dynamic programming; lengths are descending, and ties go to the longest."""
    best, first = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    fits = np.searchsorted(-lengths, -np.arange(size + 1))
    for c in range(int(lengths[-1]), size + 1):
        worth = best[c - lengths[fits[c] :]] + price[fits[c] :]
        k = int(worth.argmax())
        best[c], first[c] = (worth[k], lengths[fits[c] + k]) if worth[k] > best[c - 1] else (best[c - 1], 0)
    return best, first


def traced(first: np.ndarray, start: int, room: int) -> dict[int, int]:
    """The configuration of length `start` and the dearest content of the room that it leaves."""
    found = {start: 1}
    while room > 0:
        if x := int(first[room]):
            found[x] = found.get(x, 0) + 1
        room -= x or 1
    return found


@dataclass
class Program:
    """The linear program's best solution so far: configuration -> how often, which covers every length at least as often as
    the histogram has it; what it costs; and the greatest dual bound found."""

    solution: dict[Config, float]
    cost: float
    bound: float


def dual_functions(lengths: np.ndarray, demand: np.ndarray, size: int) -> float:
    """A lower bound from dual feasible functions: prices that no configuration sums to more than 1."""
    share, found = lengths / size, float(demand @ lengths) / size
    for least in np.unique(lengths[2 * lengths <= size]).tolist():
        found = max(found, float(demand @ np.where(lengths > size - least, 1.0, np.where(lengths >= least, share, 0.0))))
    for k in range(1, 20):
        found = max(found, float(demand @ np.where((k + 1) * lengths % size == 0, share, (k + 1) * lengths // size / k)))
    return found


def near_dearest(price: np.ndarray, lengths: np.ndarray, size: int, tolerance: float) -> tuple[float, list[dict[int, int]]]:
    """Worth of the dearest configuration, and of each length the dearest one with it, if it is worth at most `tolerance`
    (a share) less."""
    best, first = knapsack(price, lengths, size)
    found = [traced(first, x, size - x) for i, x in enumerate(lengths.tolist()) if best[size - x] + price[i] >= (1 - tolerance) * best[size]]
    return float(best[size]), found


def columns(configs: list[Config], place: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Configurations as two arrays: places of their lengths, and how many of each (0 where there are fewer lengths)."""
    at, take = np.zeros((len(configs), max(map(len, configs))), np.int64), np.zeros((len(configs), max(map(len, configs))))
    for i, c in enumerate(configs):
        at[i, : len(c)], take[i, : len(c)] = [place[x] for x, _ in c], [n for _, n in c]
    return at, take


def covered(at: np.ndarray, take: np.ndarray, often: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at.ravel(), weights=(take * often[:, None]).ravel(), minlength=n)


def play(at: np.ndarray, take: np.ndarray, demand: np.ndarray, often: np.ndarray, price: np.ndarray, steps: int, rate: float, most: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """Multiplicative weights on both sides of the covering program over these configurations: a configuration's share grows
    with what its lengths are worth, a length's weight falls with how much of it is covered, each step with the last gain
    once more in place of the one before (optimistic steps, which settle where plain ones circle). Gains are cut at `most`, as
    what is covered often enough needs no more. Returns the averages: shares (sum 1) and prices of a piece."""
    total = often.sum()
    shares, weights = np.log(np.maximum(often / total, 1e-9)), np.log(np.maximum(price * demand, 1e-300))
    sums, before = (np.zeros(len(often)), np.zeros(len(demand))), None
    for _ in range(steps):
        x, w = np.exp(shares - shares.max()), np.exp(weights - weights.max())
        x, w = x / x.sum(), w / w.sum()
        sums[0][:] += x
        sums[1][:] += w
        gain = np.minimum(((w / demand)[at] * take).sum(axis=1) * total, most), np.minimum(covered(at, take, x, len(demand)) * total / demand, most)
        last = before or gain
        shares, weights, before = shares + rate * (2 * gain[0] - last[0]), weights - rate * (2 * gain[1] - last[1]), gain
    return sums[0] / steps, sums[1] / steps / demand


def completed(often: dict[Config, float], histogram: dict[int, int], size: int, fine: int = 1000) -> dict[Config, float]:
    """The configurations and, for what they leave open of a length, best fit of that in `fine`ths of a piece."""
    left = {x: float(n) for x, n in histogram.items()}
    for config, v in often.items():
        for x, n in config:
            left[x] -= n * v
    rest = best_fit({x: math.ceil(v * fine - 1e-6) for x, v in left.items() if v * fine > 1e-6}, size)
    found = dict(often)
    for config, n in rest.items():
        found[config] = found.get(config, 0.0) + n / fine
    return found


def multiplicative_weights(histogram: dict[int, int], size: int, rounds: int, steps: int = 400, tolerance: float = 0.02, goal: float = 0.002) -> Program:
    """Fractional covering by configurations that the knapsack program prices. It begins with those of `consumed`. A round plays
    multiplicative weights over the configurations known so far, takes the average as a solution (at a few scales, the
    rest completed), and prices all lengths by the average of the weights: by the dearest configuration these give a dual
    bound, and of each length the dearest configuration with it, if it is within `tolerance`, joins the known ones, which
    the next round plays. Ends at a gap of `goal`."""
    lengths = np.array(sorted(histogram, reverse=True), np.int64)
    demand = np.array([histogram[x] for x in lengths.tolist()], float)
    place = {int(x): i for i, x in enumerate(lengths)}
    found = Program({}, math.inf, dual_functions(lengths, demand, size))

    def offer(often: dict[Config, float]) -> None:
        solution = completed(often, histogram, size)
        if (cost := sum(solution.values())) < found.cost:
            found.solution, found.cost = solution, cost

    offer(consumed(histogram, size, 60))
    known, price, rate, best_bound = dict(found.solution), lengths / size, 0.5, 0.0
    for _ in range(rounds):
        if found.cost <= (1 + goal) * found.bound:
            break
        configs = list(known)
        at, take = columns(configs, place)
        shares, played = play(at, take, demand, np.array([known[c] for c in configs]), price, steps, rate)
        before = found.cost
        for scale in (0.97, 1.0, 1.03):
            offer({c: v * found.cost * scale for c, v in zip(configs, shares.tolist(), strict=True) if v > 1e-7})
        worth, dearest = near_dearest(played, lengths, size, tolerance)
        bound = float(demand @ played) / worth
        if bound > best_bound:
            best_bound, price = bound, played
        found.bound = max(found.bound, bound)
        rate = rate if found.cost < before else max(0.7 * rate, 0.05)
        value = (played[at] * take).sum(axis=1)
        known = {c: 0.5 * v * found.cost for c, v, y in zip(configs, shares.tolist(), value, strict=True) if v > 1e-7 or y > (1 - tolerance) * worth}
        for c, v in found.solution.items():
            known[c] = known.get(c, 0.0) + 0.5 * v
        new = {tuple(sorted(c.items(), reverse=True)) for c in dearest} - known.keys()
        known |= dict.fromkeys(sorted(new), 0.02 * found.cost / max(1, len(new)))
    return found


def rounded(solution: dict[Config, float], histogram: dict[int, int]) -> dict[Config, int]:
    """Whole numbers of configurations, the most used first; what rounding leaves of one goes to the next, and none covers
    more than what is left of a length."""
    left, found, carry = dict(histogram), {}, 0.0
    for config, often in sorted(solution.items(), key=lambda x: (-x[1], x[0])):
        whole = min(int(often + carry + 1e-9), *(left[x] // n for x, n in config))
        carry = min(1.0, often + carry - whole)
        if whole > 0:
            found[config] = whole
            for x, n in config:
                left[x] -= n * whole
    return found


def consumed(histogram: dict[int, int], size: int, rounds: int, rate: float = 0.01, tolerance: float = 0.001) -> dict[Config, float]:
    """Another solution by the same prices and dynamic program: near-dearest configurations are taken as often as their
    scarcest length is left, in part, so that nothing is covered more often than the histogram has it."""
    lengths = np.array(sorted(histogram, reverse=True), np.int64)
    demand = np.array([histogram[x] for x in lengths.tolist()], float)
    place = {int(x): i for i, x in enumerate(lengths)}
    left, price = demand.copy(), lengths / size
    solution: dict[Config, float] = {}
    for _ in range(rounds):
        open_ = np.flatnonzero(left >= 1)
        if not len(open_):
            break
        covered, used = np.zeros(len(lengths)), False
        for config in near_dearest(price[open_], lengths[open_], size, tolerance)[1]:
            at = np.array([place[x] for x in config])
            take = np.array(list(config.values()), float)
            often = (left[at] / take).min()
            if often < 1:
                continue
            often = often / 2 if often >= 8 else often
            key = tuple(sorted(config.items(), reverse=True))
            solution[key] = solution.get(key, 0.0) + often
            left[at] -= take * often
            covered[at] += take * often / demand[at]
            used = True
        if not used:
            break
        price *= np.exp(-rate * covered)
    return solution


def best_fit(histogram: dict[int, int], size: int) -> dict[Config, int]:
    """Best fit decreasing of a histogram: sequences with the same content are handled together."""
    free: dict[int, dict[Config, int]] = {}
    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        left = histogram[length]
        for room in sorted(r for r in free if r >= length):
            while left and free.get(room):
                config, n = free[room].popitem()
                each = min(room // length, left)
                use = min(n, left // each) if each else 0
                if n > use:
                    free[room][config] = n - use
                to = free.setdefault(room - each * length, {})
                grown = (*config, (length, each))
                to[grown] = to.get(grown, 0) + use
                left -= each * use
            if not left:
                break
        each = size // length
        if left >= each:
            to = free.setdefault(size - each * length, {})
            to[((length, each),)] = to.get(((length, each),), 0) + left // each
        if left % each:
            to = free.setdefault(size - left % each * length, {})
            to[((length, left % each),)] = to.get(((length, left % each),), 0) + 1
    found: dict[Config, int] = {}
    for by in free.values():
        for config, n in by.items():
            found[config] = found.get(config, 0) + n
    return found


def solve_with_bound(histogram: dict[int, int], size: int = 2048, rounds: int = 40) -> tuple[dict[Config, int], float]:
    """How often each configuration is used, and a lower bound of how many are needed; every length is packed exactly as
    often as the histogram has it. The fewest sequences of: the program's solution rounded, the consuming one rounded, each with
    best fit for the rest, and best fit alone; the earlier of equals."""
    full = {((size, 1),): histogram[size]} if histogram.get(size) else {}
    rest = {x: n for x, n in histogram.items() if x < size and n}
    if not rest:
        return full, float(sum(full.values()))
    program = multiplicative_weights(rest, size, rounds)
    choices: list[dict[Config, int]] = []
    for start in (rounded(program.solution, rest), rounded(consumed(rest, size, 60), rest), {}):
        left, found = dict(rest), dict(start)
        for config, n in start.items():
            for x, k in config:
                left[x] -= n * k
        for config, n in best_fit(left, size).items():
            found[config] = found.get(config, 0) + n
        choices.append(found)
    best = min(choices, key=lambda x: sum(x.values()))
    return full | best, program.bound + sum(full.values())


def solve(histogram: dict[int, int], size: int = 2048, rounds: int = 40) -> dict[Config, int]:
    return solve_with_bound(histogram, size, rounds)[0]


def plan_rows(solution: dict[Config, int]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, lo, hi, each, sequence, offset): ranks lo..hi-1 of a length go, `each` to a sequence, to the sequences
    from `sequence` on, from `offset` in each."""
    rows, used, sequence = [], {}, 0
    for config in sorted(solution):
        offset, n = 0, solution[config]
        for length, each in config:
            lo = used.get(length, 0)
            rows.append((length, lo, lo + each * n, each, sequence, offset))
            used[length] = lo + each * n
            offset += length * each
        sequence += n
    return rows


def pack(docs: DataFrame, size: int = 2048, rounds: int = 40, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    own = materialize(pieces(docs, size, vocabulary).withColumn("row", F.monotonically_increasing_id()), "pieces")
    own = own.withColumn("part", F.shiftrightunsigned("row", 33))
    counts = own.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    plan = spark.createDataFrame(plan_rows(solve(histogram, size, rounds)), "l long, lo long, hi long, each long, first long, at long")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("row")) - 1
    ranked = own.withColumn("k", within).join(offsets, ["length", "part"]).withColumn("rank", F.col("before") + F.col("k"))
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("l")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    slot = F.col("rank") - F.col("lo")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.floor(slot / F.col("each"))).alias("sequence_id"),
        (F.col("at") + slot % F.col("each") * F.col("length")).alias("offset"),
    )
