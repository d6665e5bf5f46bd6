"""URL filters by a Bloom filter cascade. DataFrame functions only.

A rule is a host and a path prefix, like `example.org/es/`: it fits its host and all subdomains if the url's path starts
with its path; the longest rule that fits wins. For each url the keys that could be rules are its host's suffixes at
label borders, each with the prefixes of its path that have a listed rule's path length. They are looked up in a
cascade: level 0 is a Bloom filter of the listed keys; level 1 one of the keys of the corpus that pass level 0 without
being listed; level 2 one of the listed keys that pass level 1; and so on until a level passes nothing wrongly. As the
levels are built over every key of the corpus, the answer is exact for all of them, and no key is joined with a list.
Allowing and blocking rules have a cascade each. A url that no rule fits is judged by a third cascade, over hosts with
their whole paths.

Filters are binary values in the plan. A cascade is built for one part of the keys (by hash) at a time, with as many
parts as keep a part's level 0 within `part_bytes`; a bounded number of parts is looked up in a pass, so what tasks are
sent doesn't grow with the list. Should levels not end, as with keys that share all hashes, the listed keys that pass
all MOST_LEVELS of them are kept as they are.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: then up to `?`, `#` or the end.

Cases: a null url or one without `://` has an empty host and path and no keys but the empty host; rows that repeat are
returned each; an empty table or an empty list gives no matches; other columns are ignored."""

from __future__ import annotations

import math
import string
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletide.llm.common import materialize

#: The contract's rules.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
#: First digits of the MD5 of the pages in the query's list.
LISTED_DIGITS = ("0", "1")
BITS = 7  # of a filter's byte that are used, so that it is a character
MOST_LEVELS = 40
#: False positives of the levels behind the first. One half would take the fewest bits (2.9 a key over all levels, against
#: 4.9), but each level is a pass over what is left, and an eighth takes a third of the levels.
LATER_RATE = 0.125


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path)."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def key_column(host: Column, path: Column, lengths: list[int]) -> Column:
    """All keys of a url: suffixes of its host at label borders, each with its path's prefixes of these lengths."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    heads = F.array_distinct(F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda x: x.isNotNull()))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(heads, lambda p: F.concat(s, p))))


def spot(key: Column, number: int, i: int, size: int) -> Column:
    """The i-th bit of a key in the filter of this number. The hash of a value is the seed of the next one's, so the key comes
    last: before the numbers, two keys that share one hash would share the bits of all levels."""
    return F.pmod(F.xxhash64(F.lit(number), F.lit(i), key), F.lit(size))


def mask_of(at: Column) -> Column:
    return F.get(F.array(*[F.lit(1 << b) for b in range(BITS)]), (at % BITS).cast("int"))


@dataclass
class Level:
    """A Bloom filter: bits as a binary value (bit b is bit b % BITS of byte b // BITS)."""

    number: int
    hashes: int
    bits: bytes

    def passes(self, key: Column) -> Column:
        table = F.lit(self.bits)

        def one(i: int) -> Column:
            at = spot(key, self.number, i, BITS * len(self.bits))
            byte = F.ascii(F.substring(table, F.floor(at / BITS).cast("int") + 1, F.lit(1)).cast("string"))
            return mask_of(at).bitwiseAND(byte) != 0

        found = one(0)
        for i in range(1, self.hashes):
            found = found & one(i)
        return found


@dataclass
class Part:
    """Levels for a part of the keys. last: the listed keys among those that pass all levels, if the levels had to end."""

    levels: list[Level] = field(default_factory=list)
    last: list[str] | None = None

    def has(self, key: Column) -> Column:
        """Whether a key of this part is listed; exact for the keys over which the cascade was built."""
        chain = None
        for i, x in enumerate(self.levels):
            missed, answer = ~x.passes(key), F.lit(i % 2 == 1)
            chain = F.when(missed, answer) if chain is None else chain.when(missed, answer)
        if chain is None:
            return F.lit(False)
        return chain.otherwise(F.lit(len(self.levels) % 2 == 1) if self.last is None else key.isin(self.last))


@dataclass
class Cascade:
    parts: list[Part] = field(default_factory=list)

    def part_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit("part"), key), F.lit(len(self.parts)))

    def has(self, numbers: list[int]) -> Callable[[Column], Column]:
        """Whether a key is in one of these parts and listed."""

        def one(key: Column) -> Column:
            chain = F.when(F.lit(False), F.lit(False))
            for k in numbers:
                chain = chain.when(self.part_of(key) == k, self.parts[k].has(key))
            return chain.otherwise(F.lit(False))

        return one


def bloom(keys: DataFrame, n: int, rate: float, number: int) -> Level:
    """A filter of n keys. Its bits are put together by bit_or before they come to the driver, a bounded number."""
    size = BITS * max(8, math.ceil(n * -math.log(rate) / math.log(2) ** 2 / BITS))
    hashes = max(1, round(size / max(n, 1) * math.log(2)))
    spots = keys.select(F.explode(F.array(*[spot(F.col("key"), number, i, size) for i in range(hashes)])).alias("at"))
    bytes_ = spots.groupBy(F.floor(F.col("at") / BITS).cast("int").alias("byte")).agg(F.bit_or(mask_of(F.col("at"))).alias("v"))
    table = bytearray(size // BITS)
    for r in bytes_.collect():  # at most size // BITS rows, which part_bytes bounds
        table[r["byte"]] = r["v"]
    return Level(number, hashes, bytes(table))


def distinct_keys(universe: DataFrame) -> DataFrame:
    """universe: (key and flags), every key of the corpus and of the lists, repeats allowed. Each key once, as a written table."""
    flags = [c for c in universe.columns if c != "key"]
    return materialize(universe.groupBy("key").agg(*[F.max(c).alias(c) for c in flags]), "url-keys")


def build(keys: DataFrame, flag: str, part_bytes: int = 1 << 20, most_levels: int = MOST_LEVELS) -> Cascade:
    """A cascade of the keys with this flag, over distinct_keys. What is left behind a level is written, so that the next
    one reads that alone; it shrinks by LATER_RATE with each."""
    keys = keys.select("key", F.col(flag).alias("listed"))
    total, listed = (int(x or 0) for x in keys.agg(F.count("*"), F.sum(F.col("listed").cast("int"))).first())
    rate = min(0.5, max(1e-9, math.sqrt(0.5) * listed / max(1, total - listed)))
    parts = max(1, math.ceil(listed * -math.log(rate) / math.log(2) ** 2 / BITS / part_bytes))
    found = Cascade([Part() for _ in range(parts)])
    if parts > 1 and listed:  # written once by part, so that a part reads its own keys only
        keys = materialize(keys.withColumn("part", found.part_of(F.col("key")).cast("int")), "url-parts", ("part",))
    for k in range(parts if listed else 0):
        own = keys.where(F.col("part") == k).select("key", "listed") if parts > 1 else keys
        inside, outside = own.where("listed"), own.where(~F.col("listed"))
        part, n = found.parts[k], listed if parts == 1 else inside.count()
        while n:
            level = len(part.levels)
            if level == most_levels:  # what is left shrinks with each level, so this is nothing or a handful
                part.last = [r["key"] for r in own.where("listed").where(reduce(lambda a, b: a & b, [x.passes(F.col("key")) for x in part.levels])).collect()]
                break
            part.levels.append(bloom(inside, n, rate if level == 0 else LATER_RATE, level))
            wrong = materialize(outside.where(part.levels[-1].passes(F.col("key"))), "url-wrong")
            inside, outside = wrong, inside
            n = inside.count()
    return found


def lookup(rows: DataFrame, keys: str, cascade: Cascade, to: str, at_once: int = 32) -> DataFrame:
    """rows with the column `to`: those of the array column `keys` that the cascade has. A pass over the rows has the
    filters of `at_once` parts."""
    rows = rows.withColumn(to, F.array().cast("array<string>"))
    for first in range(0, len(cascade.parts), at_once):
        own = list(range(first, min(first + at_once, len(cascade.parts))))
        rows = rows.withColumn(to, F.concat(F.col(to), F.filter(F.col(keys), cascade.has(own))))
        if own[-1] + 1 < len(cascade.parts):
            rows = materialize(rows, "url-part")
    return rows


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, part_bytes: int = 1 << 20) -> DataFrame:
    """One row for each row of pages (page_id, url): page_id, host, path, rule, verdict.

    rules: (rule, verdict); listed: (key), hosts followed by a path: a url that no rule fits is blocked if its own is listed."""
    host, path = split_url(F.col("url"))
    lengths = [r[0] for r in rules.select(F.length(F.substring("rule", F.expr("greatest(instr(rule, '/'), 1)"), F.length("rule"))).alias("n")).distinct().orderBy("n").collect()]
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = materialize(rows.withColumn("keys", key_column(F.col("host"), F.col("path"), lengths)).withColumn("own", F.array(F.concat("host", "path"))), "url-rows")
    verdicts = ("allow", "block")
    universe = rows.select(F.explode("keys").alias("key"), *[F.lit(False).alias(v) for v in verdicts])
    known = rows.select(F.concat("host", "path").alias("key"), F.lit(False).alias("listed"))
    keys = distinct_keys(universe.unionByName(rules.select(F.col("rule").alias("key"), *[(F.col("verdict") == v).alias(v) for v in verdicts])))
    for verdict in verdicts:
        rows = lookup(rows, "keys", build(keys, verdict, part_bytes), verdict)
    pages_known = distinct_keys(known.unionByName(listed.select("key", F.lit(True).alias("listed"))))
    rows = lookup(rows, "own", build(pages_known, "listed", part_bytes), "listed")
    hit = lambda v: F.transform(F.col(v), lambda k: F.struct(F.length(k).alias("n"), k.alias("rule"), F.lit(v).alias("verdict")))
    best = F.array_max(F.concat(hit("allow"), hit("block")))
    return rows.withColumn("best", best).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.when(F.size("listed") > 0, "block").otherwise("allow")).alias("verdict"),
    )


def listed_pages(pages: DataFrame) -> DataFrame:
    """The query's list of blocked pages, which stands in for one that someone keeps: those of the corpus whose MD5 begins
    with one of LISTED_DIGITS. Nothing in a key shows whether it is listed."""
    host, path = split_url(F.col("url"))
    return pages.select(F.concat(host, path).alias("key")).where(F.substring(F.md5("key"), 1, 1).isin(*LISTED_DIGITS)).distinct()
