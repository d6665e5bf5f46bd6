"""Quality rules: fixed rules, then robust multivariate outliers for each language and source. DataFrame functions only.

Words are the runs of [^\\x20\\x09-\\x0D] of a whole text. Each document has base statistics (`base_statistics`), and
from them a vector of transformed statistics (`FEATURES`), each in the unit of its own sampling noise, so that short and long
documents vary alike: the logarithm of the mean word length, less its group's median, times the root of the words; and of symbols,
capitals, sentence marks and repeated words twice the root of the count less the root of what the group's median rate
lets expect (Anscombe's transform; repeated words come in pairs of windows, which are what is counted). Each (lang, source)
group gets a minimum-covariance-determinant estimate. From three starts (a diagonal one of quartiles, the mean and
covariance of all rows, and the covariance of the signs, that is of directions from the medians) concentration steps keep the
`share` of rows nearest by Mahalanobis distance and estimate centre and covariance from them again, which lowers the
determinant, until it settles; the start with the least determinant is used. Distances are binned on a fine logarithmic
scale and the sums of each bin are aggregated, so a step is one partial aggregation: its result has a bounded number of
rows a group, however large the group is, and no row is sorted or collected. A document whose squared distance from
the final estimate, with the consistency factor of the share, is beyond the `quantile` of the chi-square law is rejected.

Groups of fewer than `least` rows use the estimate of their language, and if that has fewer, the one of all rows; these are made
only if a group needs them. With fewer rows in all there is no estimate: medians and unit covariance, that of sampling noise,
stand for it. A statistic that doesn't vary among a group's nearest rows (no symbols at all: a variance below
CONSTANT) has no covariance to be judged by; it gets the variance 1 that counts of its expectation have, and others are as estimated.

Cases: null and empty texts have no words, so they fail the base rule; null lang or source is a group of its own;
rows that repeat a doc_id count and are returned each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabletide.llm.common import content_key, materialize, unused

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
FEATURES = ["f_length", "f_symbols", "f_capitals", "f_marks", "f_repeats"]
CONSTANT = 0.01  # a variance below this is that of a constant
KEY = ["level", "g_lang", "g_source"]
FEW_GROUPS, SALTS = 50_000, 64
BINS = 16  # to a doubling of the squared distance


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def chained(hashes: Column, by: int) -> Column:
    """Hashes of twice the span: each with the one that starts `by` words later."""
    return let(hashes, lambda a: F.zip_with(a, F.slice(a, by + 1, F.greatest(F.size(a) - by, F.lit(0))), lambda p, q: F.xxhash64(p, q)))


def covered(starts: Column, span: int) -> Column:
    """Words under windows of `span` words at these ascending starts."""
    gaps = F.zip_with(starts, F.slice(starts, 2, F.size(starts)), lambda a, b: F.least(F.lit(span), F.coalesce(b - a, F.lit(span))))
    return F.aggregate(gaps, F.lit(0), lambda s, x: s + x)


def repeat_words(w: Column) -> Column:
    """Words in windows of eight words that the text has twice or more, the first included."""
    spans = F.transform(w, lambda x: F.xxhash64(x))
    for by in (1, 2, 4):
        spans = chained(spans, by)
    n = F.size(w) - (WINDOW - 1)

    def twice(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = let(
            ordered,
            lambda o: F.filter(
                o,
                lambda x, k: ((k > 0) & (F.get(o, k - 1)["h"] == x["h"])) | F.coalesce(F.get(o, k + 1)["h"] == x["h"], F.lit(False)),
            ),
        )
        starts = F.array_sort(F.transform(again, lambda x: x["i"]))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(starts, lambda s: covered(s, WINDOW)))

    return F.when(n < 2, F.lit(0)).otherwise(let(F.slice(spans, 1, F.greatest(n, F.lit(1))), twice))


def base_statistics(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, source, the columns to carry on, the base statistics of the contract, base_failed, and two counts for the vector."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    split = docs.select("doc_id", "lang", "source", *carry, words(F.col("text")).alias("w"), text.alias("text"))
    found = split.select(
        "doc_id",
        "lang",
        "source",
        *carry,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("w")).cast("long").alias("n_repeat_words"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.regexp_count("text", F.lit("[.,;:!?]")).cast("long").alias("n_marks"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return found.withColumn("base_failed", failed)


#: What is counted, and how many words a count stands for.
COUNTS = {"f_symbols": ("n_symbols", 1), "f_capitals": ("n_capitals", 1), "f_marks": ("n_marks", 1), "f_repeats": ("n_repeat_words", 2 * WINDOW)}
RAW = ["n_words", "word_chars", *[c for c, _ in COUNTS.values()]]


def mean_length() -> Column:
    return F.log((F.col("word_chars") + 1) / (F.col("n_words") + 1))


def centres(rows: DataFrame) -> DataFrame:
    """KEY and the medians of a group's mean word length and rates."""
    rates = [(F.col(c) / per / F.greatest(F.col("n_words"), F.lit(1))).alias(f) for f, (c, per) in COUNTS.items()]
    found = rows.select(*KEY, mean_length().alias("f_length"), *rates)
    return found.groupBy(*KEY).agg(*[F.percentile_approx(f, 0.5, 10000).alias(f"r_{f}") for f in FEATURES])


def vectors(rows: DataFrame) -> DataFrame:
    """rows (RAW and centres) with FEATURES."""
    n = F.col("n_words").cast("double")
    count = lambda f, c, per: 2 * (F.sqrt(F.col(c) / per + 0.375) - F.sqrt(n * F.col(f"r_{f}") + 0.375))
    return rows.select(
        "*", (F.sqrt(n) * (mean_length() - F.col("r_f_length"))).alias("f_length"), *[count(f, c, per).alias(f) for f, (c, per) in COUNTS.items()]
    ).drop(*[f"r_{f}" for f in FEATURES])


def chi_square(x: float, k: int) -> float:
    """P(chi-square with k degrees of freedom <= x), by the series of the incomplete gamma function."""
    a, half = k / 2, x / 2
    term = total = 1 / a
    for i in range(1, 400):
        term *= half / (a + i)
        total += term
    return total * math.exp(-half + a * math.log(half) - math.lgamma(a))


def chi_square_quantile(probability: float, k: int) -> float:
    lo, hi = 0.0, 200.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, k) < probability else (lo, mid)
    return lo


def consistency(share: float, p: int) -> float:
    """By how much the covariance of the nearest share of normal rows is too small."""
    return share / chi_square(chi_square_quantile(share, p), p + 2)


def cholesky_columns(params: DataFrame, p: int) -> DataFrame:
    """params with the lower factor as columns l_i_j: one evaluation a group, not one a document. Each row of the factor
    passes through an explode of one struct, so that its expressions aren't written out again in the next row's."""
    for i in range(p):
        row: list[Column] = []
        for j in range(i + 1):
            s = F.col(f"c_{j}_{i}")
            for k in range(j):
                s = s - row[k] * (row[k] if i == j else F.col(f"l_{j}_{k}"))
            row.append(F.sqrt(F.greatest(s, F.lit(1e-12))) if i == j else s / F.col(f"l_{j}_{j}"))
        one = F.explode(F.array(F.struct(*[x.alias(f"l_{i}_{j}") for j, x in enumerate(row)]))).alias("row")
        params = params.select("*", one).select(*params.columns, "row.*")
    return params


def beside(rows: DataFrame, groups: DataFrame, key: list[str], few: bool) -> DataFrame:
    """rows with their group's columns. groups are broadcast if they are few (FEW_GROUPS rows of some 40 numbers); else the
    rows of a group are dealt over SALTS copies of its row."""
    if few:
        return rows.join(F.broadcast(groups), key)
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, [*key, "salt"]).drop("salt")


def with_distance(rows: DataFrame, params: DataFrame, key: list[str], few: bool) -> DataFrame:
    """rows with d2, the squared distance from their group's estimate."""
    p = len(FEATURES)
    joined = beside(rows, cholesky_columns(params, p), key, few)
    for i in range(p):
        s = F.col(FEATURES[i]) - F.col(f"m_{i}")
        for k in range(i):
            s = s - F.col(f"l_{i}_{k}") * F.col(f"z_{k}")
        joined = joined.withColumn(f"z_{i}", s / F.col(f"l_{i}_{i}"))
    return joined.withColumn("d2", sum((F.col(f"z_{i}") ** 2 for i in range(1, p)), F.col("z_0") ** 2))


def varied(variance: Column) -> Column:
    return F.when(variance < CONSTANT, 1.0).otherwise(variance)


def estimate(sums: DataFrame, columns: list[str], n: Column, factor: float, *more: Column) -> DataFrame:
    """From sums s_i and s_i_j over n rows: columns, centre m_i, covariance c_i_j (i <= j) times the factor."""
    p = len(FEATURES)
    mean = lambda i: F.col(f"s_{i}") / n
    moment = lambda i, j: (F.col(f"s_{i}_{j}") / n - mean(i) * mean(j)) * factor
    covariance = [(varied(moment(i, j)) if i == j else moment(i, j)).alias(f"c_{i}_{j}") for i in range(p) for j in range(i, p)]
    return sums.select(*columns, *more, *[mean(i).alias(f"m_{i}") for i in range(p)], *covariance)


def sums_of(values: list[Column]) -> list[Column]:
    pairs = [(i, j) for i in range(len(values)) for j in range(i, len(values))]
    return [F.sum(x).alias(f"s_{i}") for i, x in enumerate(values)] + [F.sum(values[i] * values[j]).alias(f"s_{i}_{j}") for i, j in pairs]


def log_determinant() -> Column:
    return sum((F.log(F.col(f"l_{i}_{i}")) for i in range(1, len(FEATURES))), F.log("l_0_0")) * 2


def starts(rows: DataFrame) -> DataFrame:
    """KEY, start, m_i, c_i_j: three first estimates a group."""
    p, own = len(FEATURES), [F.col(f) for f in FEATURES]
    quartiles = [F.percentile_approx(f, [0.25, 0.5, 0.75], 10000).alias(f"q_{i}") for i, f in enumerate(FEATURES)]
    first = materialize(rows.groupBy(*KEY).agg(F.count("*").alias("n"), *quartiles, *sums_of(own)), "quality-starts")
    median, scale = [F.col(f"q_{i}")[1] for i in range(p)], [F.sqrt(varied(((F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / 1.349) ** 2)) for i in range(p)]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    centre = [m.alias(f"m_{i}") for i, m in enumerate(median)]
    diagonal = first.select(*KEY, F.lit(0).alias("start"), *centre, *[(scale[i] ** 2 if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in pairs])
    whole = estimate(first, KEY, F.col("n"), 1.0, F.lit(1).alias("start"))
    named = first.select(*KEY, *centre, *[x.alias(f"scale_{i}") for i, x in enumerate(scale)])
    turned = rows.join(F.broadcast(named) if named.count() <= FEW_GROUPS else named, KEY).withColumns({f"z_{i}": (own[i] - F.col(f"m_{i}")) / F.col(f"scale_{i}") for i in range(p)})
    norm = sum((F.col(f"z_{i}") ** 2 for i in range(1, p)), F.col("z_0") ** 2) + 1e-12
    # rows at the medians themselves have no direction
    mean = turned.withColumn("norm", norm).groupBy(*KEY).agg(*[F.avg(F.col(f"z_{i}") * F.col(f"z_{j}") / F.col("norm")).alias(f"u_{i}_{j}") for i, j in pairs])
    turn = lambda i, j: F.col(f"u_{i}_{j}") * p * F.col(f"scale_{i}") * F.col(f"scale_{j}")
    sign = [(varied(turn(i, j)) if i == j else turn(i, j)).alias(f"c_{i}_{j}") for i, j in pairs]
    signs = mean.join(named, KEY).select(*KEY, F.lit(2).alias("start"), *[f"m_{i}" for i in range(p)], *sign)
    return diagonal.unionByName(whole).unionByName(signs)


def mcd(rows: DataFrame, share: float, steps: int, few: bool, settled: float = 0.01) -> DataFrame:
    """A row a group: KEY, n, m_i and c_i_j, with the consistency factor. rows: KEY and FEATURES. A start of a group rests once
    its determinant falls by no more than the share `settled` in a step; only the others go on, for `steps` at most."""
    p, factor = len(FEATURES), consistency(share, len(FEATURES))
    whole = Window.partitionBy(*KEY, "start")
    below = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = [f"m_{i}" for i in range(p)] + [f"c_{i}_{j}" for i in range(p) for j in range(i, p)]
    with_size = lambda x: cholesky_columns(x, p).withColumn("size", log_determinant())
    now = materialize(with_size(starts(rows)).select(*KEY, "start", *names, F.lit(None).cast("long").alias("n"), "size", F.lit(None).cast("double").alias("before")), "quality-mcd")
    rests: list[DataFrame] = []
    for step in range(steps):
        bins = with_distance(rows, now.select(*KEY, "start", *names), KEY, few).withColumn("bin", F.floor(F.log2(F.col("d2") + 1e-6) * BINS))
        bins = bins.groupBy(*KEY, "start", "bin").agg(F.count("*").alias("n"), *sums_of([F.col(f) for f in FEATURES]))
        sums = [c for c in bins.columns if c[:2] == "s_" or c == "n"]
        run = bins.select(*KEY, "start", "bin", F.col("n").alias("here"), F.sum("n").over(whole).alias("all"), *[F.sum(c).over(below).alias(c) for c in sums])
        cut = run.where((F.col("n") >= share * F.col("all")) & (F.col("n") - F.col("here") < share * F.col("all")))
        new = with_size(estimate(cut, [*KEY, "start"], F.col("n"), factor, F.col("all").alias("n")))
        new = new.join(now.select(*KEY, "start", F.col("size").alias("before")), [*KEY, "start"])
        now = materialize(new.select(*KEY, "start", *names, "n", "size", "before"), "quality-mcd")
        goes_on = (F.col("before") - F.col("size") > settled) if step else F.lit(True)
        rests.append(now.where(~goes_on) if step + 1 < steps else now)
        now = now.where(goes_on)
        if now.isEmpty():
            break
    found = rests[0]
    for x in rests[1:]:
        found = found.unionByName(x)
    return found.groupBy(*KEY).agg(F.min_by(F.struct("n", *names), F.struct("size", "start")).alias("e")).select(*KEY, "e.*")


def judge(docs: DataFrame, share: float = 0.75, steps: int = 20, quantile: float = 0.9999, least: int = 50, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs (doc_id, text, lang, source): the contract's columns, d2 (squared distance), and the
    columns of docs to carry on."""
    stats = materialize(base_statistics(docs, carry), "quality")
    own = ["o_lang", "o_source"]
    rows = stats.withColumns({"o_lang": F.coalesce("lang", F.lit("\0")), "o_source": F.coalesce("source", F.lit("\0"))})
    fit = rows.where(~F.col("base_failed")).select(*own, *RAW)
    # level 0 is a group of its own, 1 a language, 2 all rows
    counts = fit.groupBy(*own).agg(F.count("*").alias("n"))
    langs = counts.groupBy("o_lang").agg(F.sum("n").alias("lang_n"))
    level = F.when(F.col("n") >= least, 0).when(F.col("lang_n") >= least, 1).otherwise(2)
    groups = counts.join(langs, "o_lang").select(*own, level.alias("level"))
    asked = groups.groupBy("o_lang").agg(F.max((F.col("level") == 1).cast("int")).alias("by_lang"))
    groups = materialize(groups.join(asked, "o_lang"), "quality-groups")
    by_all = not groups.where("level = 2").isEmpty()
    few = 3 * groups.count() <= FEW_GROUPS
    target = lambda k: F.struct(F.lit(k).alias("level"), (F.col("o_lang") if k < 2 else F.lit("")).alias("g_lang"), (F.col("o_source") if k < 1 else F.lit("")).alias("g_source"))
    wanted = F.array_compact(F.array(F.when(F.col("level") == 0, target(0)), F.when(F.col("by_lang") == 1, target(1)), F.when(F.lit(by_all), target(2))))
    near = F.broadcast(groups) if few else groups
    levels = materialize(fit.join(near, own).select(F.explode(wanted).alias("g"), *RAW).select("g.*", *RAW), "quality-levels")
    middle = materialize(centres(levels), "quality-centres")
    chosen = mcd(materialize(vectors(beside(levels, middle, KEY, few)).select(*KEY, *FEATURES), "quality-vectors"), share, steps, few).join(middle, KEY)
    use = groups.select(*own, F.when(F.col("level") == 0, target(0)).when(F.col("level") == 1, target(1)).otherwise(target(2)).alias("g")).select(*own, "g.*")
    p = len(FEATURES)
    unit = {f"m_{i}": F.lit(0.0) for i in range(p)} | {f"c_{i}_{j}": F.lit(float(i == j)) for i in range(p) for j in range(i, p)}
    chosen = chosen.withColumns({name: F.when(F.col("n") < least, x).otherwise(F.col(name)) for name, x in unit.items()})
    used = materialize(use.join(chosen.drop("n"), KEY).drop(*KEY), "quality-estimates")
    judged = vectors(beside(rows.where(~F.col("base_failed")), used.select(*own, *[f"r_{f}" for f in FEATURES]), own, few))
    scored = with_distance(judged, used.drop(*[f"r_{f}" for f in FEATURES]), own, few)
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    cutoff = chi_square_quantile(quantile, len(FEATURES))
    return scored.select(*out, (F.col("d2") <= cutoff).alias("kept"), F.col("d2"), *carry).unionByName(
        rows.where("base_failed").select(*out, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("d2"), *carry)
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """docs without the rows that are rejected. Each row goes or stays by its own lang, source and text, whether its doc_id
    is null, repeated or neither."""
    (key,) = unused(docs, "of_key")
    keyed = docs.withColumn(key, content_key("doc_id", "lang", "source", "text"))
    gone = judge(keyed, carry=(key,)).where(~F.col("kept")).select(key).distinct()
    return keyed.join(gone, key, "left_anti").select(*docs.columns)
