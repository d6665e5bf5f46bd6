"""Parts of the toxicity scores, the token counts and the url cascade against plain versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabletide.llm import token_counts, toxicity, url_filter


def plain_segments(scores):
    """Ruzzo and Tompa's definition: the best segment (shortest, leftmost of equals), then those of what is left and right of it."""
    best = None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 1e-12 and (best is None or total > best[0] + 1e-12 or abs(total - best[0]) <= 1e-12 and j - i < best[2] - best[1]):
                best = (total, i, j)
    if best is None:
        return []
    total, i, j = best
    shifted = [(a + j + 1, b + j + 1, s) for a, b, s in plain_segments(scores[j + 1 :])]
    return [*plain_segments(scores[:i]), (i, j + 1, total), *shifted]


def test_maximal_segments():
    r = random.Random(1)
    for _ in range(400):
        scores = [r.choice([-2.0, -1.0, -0.5, -0.2, 0.7, 1.0, 3.1]) + r.random() / 97 for _ in range(r.randint(0, 14))]
        got = toxicity.maximal_segments(np.array(scores))
        want = plain_segments(scores)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert [x[2] for x in got] == pytest.approx([x[2] for x in want])
    long = np.array([r.choice([-1.0, 1.0]) for _ in range(200_000)])
    assert sum(e - s for s, e, _ in toxicity.maximal_segments(long)) <= len(long)


def test_log_odds(spark):
    """Monroe, Colaresi and Quinn's log-odds ratio with a Dirichlet prior in proportion to the pooled counts."""
    toxic, clean, prior = 200, 1800, 0.1
    rows = [(b"vile", True, 60, 12, 90, 13), (b"vil-", False, 62, 20, 95, 21), (b"tea", True, 20, 180, 30, 300), (b"odd", True, 3, 4, 3, 4), (b"rare", True, 2, 0, 9, 0)]
    counts = spark.createDataFrame([(bytearray(a), *x) for a, *x in rows], "token binary, is_word boolean, t long, c long, tn long, cn long")
    model = toxicity.log_odds(counts, toxic, clean, prior, 1.0, 0.2)
    all_t, all_c = sum(x[4] for x in rows if x[1]), sum(x[5] for x in rows if x[1])

    def delta(y, x, n, m, weight):
        a, mass = weight * (y + x), weight * (n + m)
        odds = lambda k, whole: math.log((k + a) / (whole + mass - k - a))
        d = odds(y, n) - odds(x, m)
        return d, d / math.sqrt(1 / (y + a) + 1 / (x + a))

    want = {}
    for token, _, t, c, tn, cn in rows:
        z, d = delta(t, c, toxic, clean, prior)[1], delta(tn, cn, all_t, all_c, prior / 10)[0]
        if t >= 3 and z >= 1.0 and d > 0:
            want[token] = (pytest.approx(z), pytest.approx(d))
    assert model.lexicon == want and b"vile" in want and b"rare" not in want


def test_extreme_values():
    """The p-value of the best segment of clean texts is near the share of such texts that reach it."""
    r = np.random.default_rng(2)
    scores, share = np.array([-0.2, 1.5]), np.array([0.9, 0.1])
    n, best = 300, []
    for _ in range(3000):
        w = r.choice(scores, n, p=share) - (r.random(n) < 0.6) * 0.4
        best.append(max((s for _, _, s in toxicity.maximal_segments(w)), default=0.0))
    values = {float(x): int(c) for x, c in zip([-0.2, -0.6, 1.5, 1.1], [36, 54, 4, 6], strict=True)}
    rows = [(b, [b] if b > 0 else [], n, 0) for b in best] + [(60.0, [60.0], n, 1)] * 200
    model = toxicity.calibrate(toxicity.Model({}, 0.2), rows, values)
    assert sum(c * math.exp(model.rate * x) for x, c in values.items()) / 100 == pytest.approx(1.0, abs=1e-6)  # the law's rate
    for q in (0.5, 0.9, 0.98):
        s = float(np.quantile(best, q))
        assert model.p_value(s, n) == pytest.approx(np.mean(np.array(best) >= s), rel=0.35)
    assert model.p_value(60.0, n) < 1e-6 and model.probability(model.evidence([(0, 9, 60.0)], n)) > 0.9
    assert model.probability(model.evidence([], n)) < 0.1
    assert model.excess(10.0, n) > 0 or model.p_value(10.0, n) > toxicity.SIGNIFICANT


def plain_attribution(spans, borders, rule):
    counts, crossing = [0.0] * len(borders), [0] * len(borders)
    section = lambda c: next(i for i, b in enumerate(borders) if c < b)
    for first, last in spans:
        parts = [section(c) for c in range(first, last + 1)]
        if parts[0] != parts[-1]:
            crossing[parts[0]] += 1
        if rule in ("first", "last"):
            counts[parts[0 if rule == "first" else -1]] += 1
        elif rule == "share":
            for p in parts:
                counts[p] += 1 / len(parts)
        else:
            counts[max(sorted(set(parts)), key=parts.count)] += 1
    return counts, crossing


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_attribution_by_brute_force(rule):
    r = random.Random(4)
    for _ in range(200):
        spans, at = [], 0
        for _ in range(r.randint(1, 12)):
            width = r.randint(1, 6)
            spans.append((at, at + width - 1))
            at += width if r.random() < 0.9 else max(0, width - 1)  # a character may belong to two tokens
        end = spans[-1][1] + 1
        borders = sorted({*(r.randint(1, end) for _ in range(r.randint(0, 5))), end})
        counts, crossing = token_counts.attribute(np.array([s for s, _ in spans]), np.array([e for _, e in spans]), np.array(borders), rule)
        want = plain_attribution(spans, borders, rule)
        assert counts.tolist() == pytest.approx(want[0]) and crossing.tolist() == want[1]


def test_spans_are_the_tokenizers():
    own = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    r = random.Random(6)
    for k in range(120):
        text = "".join(r.choice(["word ", "Wörter ", "é", "😀", "\n", "  ", "x.", "日本", "1234 ", "don't "]) for _ in range(k))
        encoded = own.encode(text, add_special_tokens=False)
        first, last = token_counts.token_spans(text)
        assert len(first) == len(encoded.ids)
        for (a, b), s, e in zip(encoded.offsets, first.tolist(), last.tolist(), strict=True):
            assert a <= s <= e < max(b, a + 1)


def test_repeated_rows_are_counted_each(spark):
    text = "One sentence. Another one! A third\nline"
    df = spark.createDataFrame([(1, text, 5), (1, text, 6), (None, None, 7)], "doc_id long, text string, section long")
    got = token_counts.section_tokens(df).collect()
    one = [(x.section, x.start, x.end, x.n_tokens) for x in got if x.doc_id == 1]
    assert len(one) == 8 and all(one.count(x) == 2 for x in one)
    assert [(x.section, x.n_tokens) for x in got if x.doc_id is None] == [(0, 0.0)]


def test_keys_that_share_all_hashes(spark, monkeypatch):
    """Levels that can't tell keys apart end at most_levels, and the listed keys that are left decide."""
    monkeypatch.setattr(url_filter, "spot", lambda key, number, i, size: F.pmod(F.lit(3 + i), F.lit(size)))
    keys = spark.createDataFrame([(f"k{i}", i % 3 == 0) for i in range(40)], "key string, listed boolean")
    cascade = url_filter.build(keys, "listed", most_levels=3)
    assert [len(p.levels) for p in cascade.parts] == [3] and sorted(cascade.parts[0].last) == sorted(f"k{i}" for i in range(0, 40, 3))
    got = url_filter.lookup(keys.withColumn("own", F.array("key")), "own", cascade, "hit").collect()
    assert all((r.hit == [r.key]) == r.listed for r in got)


def test_parts_read_their_own_keys(spark):
    keys = spark.createDataFrame([(f"key{i}", i % 2 == 0) for i in range(3000)], "key string, listed boolean")
    cascade = url_filter.build(keys, "listed", part_bytes=64)
    assert len(cascade.parts) == 5
    got = url_filter.lookup(keys.withColumn("own", F.array("key")), "own", cascade, "hit", at_once=4).collect()
    assert len(got) == 3000 and all((r.hit == [r.key]) == r.listed for r in got)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame(list(url_filter.RULES.items()), "rule string, verdict string")
    assert url_filter.judge(none, rules, spark.createDataFrame([], "key string")).count() == 0
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, labels).count() == 0
