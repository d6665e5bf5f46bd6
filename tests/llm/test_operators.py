"""The operators of the training-data package on small tables, against brute force: nulls, empty and long texts, ties and
repeated rows, empty tables, and further columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tabletide.llm import decontam, line_dedup, packing, quality, simhash, substring_dedup, token_counts, toxicity, url_filter, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, seed string, key string"


def some_texts(n: int = 60) -> list[str | None]:
    r = random.Random(7)
    words = ["".join(r.choice("abcdefgé") for _ in range(r.randint(1, 7))) for _ in range(300)]
    text = lambda k: "".join(r.choice(words) + r.choice([" ", " ", " ", ", ", ".\n", "  "]) for _ in range(k))
    base = [text(r.randint(0, 120)) for _ in range(n)]
    passage = text(40)
    base += [base[3], base[3], base[5] + " extra", passage + base[7], base[8] + passage, passage, "", None, " \n ", "x", "LONG " * 9000, "a b c " * 30]
    return base


@pytest.fixture(scope="module")
def rows() -> list[tuple]:
    return [(i, t, "en" if i % 3 else None, "src" if i % 2 else None, len(t or ""), "s", "k") for i, t in enumerate(some_texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def twice(df):
    return df.unionByName(df.where("doc_id < 3"))


def removed_words(texts):
    seen, found = {}, {}
    for k, t in texts:
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - 19):
            if seen.setdefault(tuple(w[i : i + 20]), (k, i)) != (k, i):
                gone.update(range(i, i + 20))
        kept = [x for i, x in enumerate(w) if i not in gone]
        found[k] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return found


@pytest.mark.parametrize("limits", [{}, {"deal": 2, "block": 5}])
def test_substring_dedup(docs, rows, none, limits):
    want = removed_words([(r[0], r[1]) for r in rows])
    got = substring_dedup.remove_repeats(docs, **limits, with_text=True).collect()
    assert {r.doc_id: tuple(r)[1:4] for r in got} == want
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert substring_dedup.remove_repeats(none).count() == 0
    more = substring_dedup.remove_repeats(twice(docs)).collect()
    assert len(more) == len(rows) + 3 and {r.doc_id: tuple(r)[1:4] for r in more} == want


def test_warc(spark):
    big = "é" * 3000
    pages = [(1, "http://a/ b\n", big), (2, None, big), (3, "http://c", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", "z" * 1000), (8, "u", "z" * 1000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = warc.round_trip(df, chunk=1001).collect()
    assert len(got) == len(pages)
    size = {p: len((h or "").encode()) for p, _, h in pages}
    for r in got:
        html = next(h for p, _, h in pages if p == r.page_id) or ""
        assert (r.payload_bytes, r.payload_digest) == (size[r.page_id], hashlib.sha1(html.encode()).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 3) if r.page_id in (1, 2) else ("response", None))
    folder = warc.scratch(spark, "test-warc")
    manifest = warc.write_archives(warc.chunk_table(df, chunk=1001), folder, segment=500)
    rows = warc.read_archives(manifest, folder, 1001).where("page_id = 3").orderBy("chunk_no").collect()
    assert b"".join(r.chunk for r in rows) == big.encode() and len(rows) == 6 and rows[-1].last
    assert [r.sha1_so_far for r in rows][2] == hashlib.sha1(big.encode()[:3003]).hexdigest()
    assert warc.round_trip(df.where("false")).count() == 0


def judged(url, rules, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path, host = re.match(r"[^?#]*", rest[len(host) :])[0], host.translate(LOWER)
    best = None
    for q in rules:
        at = q.index("/")
        if (host == q[:at] or host.endswith("." + q[:at])) and path.startswith(q[at:]) and (best is None or len(q) > len(best)):
            best = q
    return host, path, best, rules[best] if best else "block" if host + path in listed else "allow"


@pytest.mark.parametrize("part_bytes", [1 << 20, 8])
def test_url_filter(spark, part_bytes):
    r = random.Random(1)
    hosts = ["org", "example.org", "a.example.org", "xexample.org", "example.com", "M.Example.COM", "de", "", "fr.com"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x", "/fr/a", "/de/#", "?q=/de/", "/deep/er"]
    urls = [None, "", "no scheme", "http://", "://org/"] + [f"http://{r.choice(hosts)}{r.choice(paths)}" for _ in range(120)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("x"))
    rules = spark.createDataFrame(list(url_filter.RULES.items()), "rule string, verdict string")
    listed = ["de", "example.com/", "a.example.org/deep/er", "m.example.com?", "never.seen"]
    got = url_filter.judge(pages, rules, spark.createDataFrame([(x,) for x in listed], "key string"), part_bytes).collect()
    assert {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in got} == {i: judged(u, url_filter.RULES, listed) for i, u in enumerate(urls)}


def test_toxicity(spark):
    r = random.Random(3)
    plain = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        w = [r.choice(plain) for _ in range(r.randint(20, 80))]
        if toxic:
            for _ in range(4):
                w.insert(10, r.choice(["nasty", "vile"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (None, "nasty vile")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(0))
    out = toxicity.score(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(out) == len(rows) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in out)
    held = [x for x in out if x.held_out]
    assert {x.doc_id for x in held} == {k for k, _ in rows if k is not None and zlib.crc32(str(k).encode()) % 3 == 1}
    assert np.mean([x.predicted == dict(labels).get(x.doc_id, 0) for x in held]) > 0.95
    nobody = toxicity.score(df, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert {x.score for x in nobody} == {0.0}


def test_segments():
    model = toxicity.Model({b"bad": (9.0, 3.0)}, 1.0)
    text = b"bad a bad a a a a a bad bad a".split()
    assert model.segments(text) == [(0, 3, 5.0), (8, 10, 6.0)]


def test_packing(docs, none):
    got = packing.pack(docs, size=64).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= 1.03 * sum(r.length for r in got) / 64 + 2
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.collect()}
    assert packing.pack(none).count() == 0


def test_solve_is_exact():
    h = {5: 100, 11: 40, 3: 7, 16: 9, 9: 33}
    solution, seen = packing.solve(h, 16), {}
    for config, n in solution.items():
        assert sum(a * b for a, b in config) <= 16
        for length, k in config:
            seen[length] = seen.get(length, 0) + n * k
    assert seen == h


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(docs, rule, none):
    got = token_counts.section_tokens(docs, rule=rule).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max("end").alias("end")).collect()
    from tabletide.llm.tokens import encoder

    for r in got:
        text = docs.where(F.col("doc_id") == r.doc_id).first().text or "" if r.doc_id < 4 else None
        if text is not None:
            assert abs(r.n - len(encoder().ids(text))) < 1e-6 and r.end == len(text)
    assert token_counts.section_tokens(none, rule=rule).count() == 0


def test_attribute():
    first, last, borders = np.array([0, 2, 4]), np.array([1, 5, 6]), np.array([3, 7])
    assert token_counts.attribute(first, last, borders, "first")[0].tolist() == [2, 1]
    assert token_counts.attribute(first, last, borders, "last")[0].tolist() == [1, 2]
    assert token_counts.attribute(first, last, borders, "most")[0].tolist() == [1, 2]
    assert token_counts.attribute(first, last, borders, "share")[0].tolist() == [1.25, 1.75]


def test_quality(docs, rows, none):
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for k, t, *_ in rows:
        w = WORD.findall(t or "")
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        many = {x for x in windows if windows.count(x) > 1} if len(windows) < 500 else set(windows)
        covered = {j for i, x in enumerate(windows) if x in many for j in range(i, i + 8)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        g = got[k]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (g.base_failed and g.kept)
    assert quality.judge(none).count() == 0


@pytest.mark.parametrize("block_bytes", [4 << 20, 300])
def test_decontamination(spark, docs, rows, none, block_bytes):
    texts = [r[1] for r in rows]
    items = [(1, " ".join(WORD.findall(texts[2])[:30]).upper()), (2, "x"), (3, None), (4, ""), (10, texts[9]), (11, texts[9])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = split.findall((t or "").translate(LOWER))
        for at in range(max(1, len(w) - 12)) if w else ():
            windows.setdefault(tuple(w[at : at + 13]), set()).add(i)
    got = {r.doc_id: tuple(r)[1:6] for r in decontam.find_contamination(docs, bench, block_bytes=block_bytes).collect()}
    for k, t, *_ in rows:
        w = split.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for at in range(len(w) - n + 1):
                if own := windows.get(tuple(w[at : at + n])):
                    hit.update(range(at, at + n))
                    found |= own
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        assert got[k] == (len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w))
    assert decontam.find_contamination(none, bench).count() == 0
    assert not any(r.n_hit for r in decontam.find_contamination(docs, bench.where("false")).collect())


def edit(a, b):
    p = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        q = [i]
        for j, d in enumerate(b, 1):
            q.append(min(p[j - 1] + (c != d), p[j] + 1, q[-1] + 1))
        p = q
    return p[-1]


@pytest.mark.parametrize("group", [64, 3])
def test_line_dedup(spark, none, group):
    r = random.Random(2)
    base = ["".join(r.choice("abcé ") for _ in range(r.randint(18, 30))) for _ in range(25)]
    lines = base[:]
    for x in base * 3:
        y = list(x)
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(y))
            y[k : k + r.randint(0, 1)] = r.choice(["", "a", "é"])
        lines.append("".join(y))
    r.shuffle(lines)
    texts = ["\n".join(lines[i : i + 5]) for i in range(0, 100, 5)] + [None, "", "\n", "short\nshort", lines[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_chars", F.lit(0).cast("long")).withColumn("line", F.lit(1))
    seen, want = [], {}
    for k, t in enumerate(texts):
        want[k] = []
        for i, x in enumerate((t or "").split("\n")):
            if len(x) >= 20:
                if any(abs(len(x) - len(y)) <= 2 and edit(x, y) <= 2 for y in seen):
                    want[k].append(i)
                seen.append(x)
    assert {x.doc_id: x.removed_lines for x in line_dedup.line_report(df, group=group).collect()} == want
    if group == 3:
        return
    for x in line_dedup.drop_repeated_lines(df.withColumns({c: F.lit(0) for c in ("of_doc", "of_lines", "of_text")})).collect():
        if want[x.doc_id]:
            kept = "\n".join(y for i, y in enumerate(texts[x.doc_id].split("\n")) if i not in want[x.doc_id])
            assert (x.text, x.n_chars) == (kept, len(kept))
        else:
            assert x.text == texts[x.doc_id]
    assert line_dedup.line_report(none).count() == 0


def brute_components(fps, distance=4):
    label = list(range(len(fps)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = sorted((top(i), top(j)))
                label[b] = a
    return [top(i) for i in range(len(fps))]


def test_simhash(docs, rows, none):
    def fingerprint(t):
        w = WORD.findall((t or "").translate(LOWER))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fingerprint(r[1]) for r in rows]
    got = sorted(simhash.simhash_groups(docs).collect(), key=lambda r: r.doc_id)
    assert [r.fingerprint for r in got] == [f"{x:016x}" for x in fps]
    assert [r.component_id for r in got] == brute_components(fps)
    assert simhash.simhash_groups(none).count() == 0
    assert simhash.simhash_groups(twice(docs)).count() == len(rows) + 3


def test_links_in_small_blocks(spark):
    r = random.Random(4)
    fps = [r.getrandbits(64) for _ in range(40)]
    for _ in range(160):
        x = r.choice(fps)
        for b in r.sample(range(64), r.randint(1, 6)):
            x ^= 1 << b
        fps.append(x)
    fps = list(dict.fromkeys(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = brute_components(fps)
    for block in (4096, 4):
        edges = simhash.link_fingerprints(df, block=block).collect()
        label = {x: x for x in signed}

        def top(x, label=label):
            while label[x] != x:
                x = label[x]
            return x

        for e in edges:
            a, b = top(e.u), top(e.v)
            label[b] = a
        names = {}
        assert all(names.setdefault(top(x), w) == w for x, w in zip(signed, want, strict=True)) and len(set(names.values())) == len(names)


def test_large_groups_of_variants(spark):
    """Variants of one line share segments with each other: the group is divided, and no near pair is lost by it."""
    r = random.Random(6)
    base, lines = "".join(r.choice("abcdefgh ") for _ in range(48)), []
    for k in range(60):
        y = list(base)
        for _ in range(1 + k % 6):
            at = r.randrange(len(y))
            y[at : at + r.randint(0, 1)] = r.choice(["", "a", "é", "bc"])
        lines.append("".join(y))
    lines += [f"Page {r.randrange(2000)} of a long text for all" for _ in range(40)]
    r.shuffle(lines)
    want = [k for k, x in enumerate(lines) if any(abs(len(x) - len(y)) <= 2 and edit(x, y) <= 2 for y in lines[:k])]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {x.doc_id for x in line_dedup.line_report(df, group=8).collect() if x.n_removed}
    assert got == set(want) and 10 < len(want) < 90
