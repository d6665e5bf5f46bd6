"""Exact dedup, conversation repair and hard negatives against brute force: nulls, ties, repeated rows, empty tables, long
conversations, colliding digests, clashing column names."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabletide.llm import conversation_repair as repair
from tabletide.llm import exact_dedup, hard_negatives, queries

DOCS = "doc_id long, text string, rank int, digest string, row long"


# exact dedup


def some_docs():
    r = random.Random(3)
    texts = ["", None, "a", "b", "É\n", "x" * 50000, *["".join(r.choice("ab") for _ in range(r.randint(1, 4))) for _ in range(200)], *["copied"] * 150]
    rows = [(i, t, i % 3, None, 5) for i, t in enumerate(texts)]
    return [*rows, (None, "a", 1, "d", 1), (None, "only null id", 1, "d", 1), (None, "only null id", 1, "d", 1), rows[3], rows[3]]


def exact_want(rows, keep):
    groups = {}
    for k, t, *_ in rows:
        groups.setdefault(t or "", []).append(k)
    best = {t: (max if keep == "largest" else min)([x for x in g if x is not None], default=None) for t, g in groups.items()}
    return sorted(((k, best[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for k, t, *_ in rows), key=str)


@pytest.mark.parametrize(("keep", "fan_in", "weak"), [("largest", 2, False), ("largest", 16, True), ("smallest", 3, True)])
def test_exact_groups(spark, keep, fan_in, weak):
    rows = some_docs()
    docs = spark.createDataFrame(rows, DOCS).repartition(13)
    digest = (lambda c: F.length(c) % 3) if weak else F.xxhash64  # a digest that collides must not merge texts
    got = exact_dedup.copy_groups(docs, keep=keep, fan_in=fan_in, digest=digest).collect()
    assert sorted(((r.id, r.keep_id, r.group_size, r.sha.hex()) for r in got), key=str) == exact_want(rows, keep)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({t or "" for _, t, *_ in rows}) == len({r.sha for r in kept})
    assert all(r.id == r.keep_id for r in kept)
    assert len({r.row for r in got}) == len(rows)


def test_exact_drop_and_report(spark):
    rows = some_docs()
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    left = exact_dedup.drop_copies(docs, keep="smallest")
    assert left.columns == docs.columns
    got = [(r.text or "", r.doc_id) for r in left.collect()]
    least = {}
    for k, t, *_ in rows:
        least.setdefault(t or "", []).append(k)
    assert sorted(got, key=str) == sorted(((t, min([x for x in g if x is not None], default=None)) for t, g in least.items()), key=str)
    none = spark.createDataFrame([], DOCS)
    assert exact_dedup.drop_copies(none).count() == 0
    report = exact_dedup.dedup_report(none)
    assert report.count() == 0 and dict(report.dtypes)["group_size"] == "bigint"


def test_no_task_sees_all_copies(spark):
    """A group that is the whole table meets in fan_in entries at a time: each level has one entry a rank."""
    docs = spark.range(0, 4000, numPartitions=40).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    got = exact_dedup.copy_groups(docs, fan_in=4).groupBy("keep_id", "group_size", "kept").count().collect()
    assert {tuple(r) for r in got} == {(3999, 4000, True, 1), (3999, 4000, False, 3999)}


# conversation repair


def brute_repair(rows):
    """(cost, audit, lines) by the plain dynamic program that keeps whole strings. rows: (role, text, required, truncated)."""
    states = {"": (0, "", ())}
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    role = {"u": "user", "a": "assistant"}

    def inserted(now):
        for _ in range(3):
            for s, (c, w, t) in list(now.items()):
                for to in step[s].values():
                    if to != "s":
                        new = (c + 2, w + "I", (*t, f"{role[to]}:"))
                        now[to] = min(now.get(to, new), new)
        return now

    def all_paths(now):
        """Every way up to three inserts, kept apart, as a shorter string may lose later."""
        for s, v in now:
            yield s, v
            yield from more_inserts(s, v, 3)

    def more_inserts(s, v, left):
        if left:
            for to in step[s].values():
                if to != "s":
                    new = (v[0] + 2, v[1] + "I", (*v[2], f"{role[to]}:"))
                    yield to, new
                    yield from more_inserts(to, new, left - 1)

    now = list(states.items())
    for who, text, required, truncated in rows:
        best = {}
        for s, (c, w, t) in all_paths(now):
            options = [(s, (c + 3, w + "D", t))]
            if not required:
                if who[:1] in step[s]:
                    options.append((step[s][who[:1]], (c + truncated, w + "K", (*t, f"{who}:{text}"))))
                options += [(to, (c + 2 + truncated, w + "R", (*t, f"{role[to]}:{text}"))) for to in step[s].values() if to != "s"]
            for to, v in options:
                best[to] = min(best.get(to, v), v)
        now = list(best.items())
    return min(v for s, v in all_paths(now) if s in ("", "a"))


def by_engine(rows):
    r = repair.Repair()
    edits = [e for row in rows for e in r.feed(repair.Row(*row))] + r.end()
    return r.cost, "".join(e.letter for e in edits), tuple(f"{e.role}:{e.text}" for e in edits if e.role is not None)


def test_repair_of_all_short_conversations():
    kinds = [(w, "t", q, t) for w in ("system", "user", "assistant", "tool", "") for q, t in ((False, False), (False, True), (True, False))]
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            assert by_engine(rows) == brute_repair(rows), rows


def test_repair_of_long_conversations():
    r = random.Random(5)
    for k in range(150):
        roles = [["user", "assistant"], ["system", "user", "assistant", "tool"], ["tool"], ["user", "tool"]][k % 4]
        rows = [(r.choice(roles), str(i), r.random() < 0.2, r.random() < 0.2) for i in range(r.randint(20, 60))]
        assert by_engine(rows) == brute_repair(rows)


def test_repair_memory_is_bounded():
    r = random.Random(6)
    now, most = repair.Repair(), 0
    for i in range(20000):
        now.feed(repair.Row(r.choice(["user", "assistant"]), "x", r.random() < 0.1, r.random() < 0.1))
        if i % 50 == 0:
            held, todo = 0, [now.root]
            while todo:
                node = todo.pop()
                held += 1
                todo += node.children
            most = max(most, held)
    assert most < 200


TALK = "conv_id long, turn long, role string, text string, blank string, copy string"


def damaged_rows(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        how = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        role = "user" if how == 4 else role
        text = "" if how == 1 else text.translate(str.maketrans("", "", ".!?")) if how == 2 else text
        out += [(conv, turn, role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    return out


def repair_want(rows):
    left = damaged_rows(rows)
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted([r[1:] for r in left if r[0] == conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults, plain = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, role, text in own:
            core = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            plain.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(plain))
        cost, audit, lines = brute_repair(plain)
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def talk():
    r = random.Random(9)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(r.randint(1, 9)):
            text = r.choice(["Yes.", "No", " \t", "", None, "What?  \n", "long " * 400 + "end", "same.", f"{turn} é!"])
            rows.append((conv, r.choice([turn, turn, turn, turn + 2, None]), r.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), text))
    rows += rows[:20]
    return rows + [(999, t, "user", "gone.") for t in range(200) if zlib.crc32(f"999:{t}".encode()) % 20 == 0]


def test_repair_report(spark):
    rows = talk()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], TALK)
    got = repair.repair_report(repair.damaged(df)).collect()
    want = repair_want(rows)
    assert len(got) == len(want) and want[999] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id], r.conv_id
    none = df.where("false")
    assert repair.repair_report(repair.damaged(none)).count() == 0


def test_repaired_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi.", "", ""), (1, 1, "user", "Hi.", "", ""), (1, 2, "tool", "ok.", "", ""), (1, 3, "user", "And?", "", "")], TALK)
    got = repair.repaired(repair.undamaged(df)).orderBy("place").collect()
    assert [(r.place, r.edit, r.role, r.text) for r in got] == [(0, "K", "user", "Hi."), (1, "R", "assistant", "ok."), (2, "K", "user", "And?"), (3, "I", "assistant", "")]


# hard negatives

ROWS = "vec_id long, embedding array<float>, label int, uid long, v string"


def some_vectors(n=900, width=8):
    r = np.random.default_rng(2)
    rows = []
    for i in range(n):
        v = (r.normal(size=width) + 2 * np.eye(width)[i % 4]) * r.choice([0.02, 0.2, 1.0])
        rows.append([i, [float(x) for x in np.float32(v)], int(r.integers(0, 4)), 7, "v"])
    for i in (30, 200, 330):
        rows[i][1] = rows[(i + 100) % n][1]
    rows[11][1], rows[12][1], rows[13][2], rows[14][1], rows[15][1], rows[300][1], rows[17][1] = None, [None, *rows[12][1][1:]], None, [float("nan")] * width, [float("inf")] * width, [0.0] * width, [1.0] * 3
    return [tuple(r) for r in rows] + [tuple(rows[21]), (None, rows[22][1], 2, 7, "v"), (1000, rows[100][1], rows[100][2], 7, "v"), (1000, rows[100][1], rows[100][2], 7, "v")]


def negatives_want(rows, labels=4):
    usable = []
    for i, (vec, v, label, *_) in enumerate(rows):
        if vec is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        usable.append((vec, (label + 1) % 10 if vec % 7 == 0 else label, [int(np.floor(256 * float(np.float32(x)))) for x in v], i))
    out = []
    for vec, label, v, i in usable:
        if vec % 100:
            continue
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), o, k, j) for o, k, w, j in usable if j != i)
        for s, o, _, _ in [x for x in scores if x[2] == label][:5]:
            fits = [x for x in scores if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(vec, o, rank, x[1], -s, -x[0]) for rank, x in enumerate(fits, 1)]
    return sorted(out)


def test_hard_negatives(spark):
    rows = some_vectors()
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    want = negatives_want(rows)
    assert len(want) > 40
    for most in (8192, 3):  # in one block of anchors, and in several
        got = hard_negatives.mine(df, F.col("vec_id") % 100 == 0, label=shifted, most_anchors=most)
        assert sorted(map(tuple, got.collect())) == want
    assert hard_negatives.mine(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives.mine(df.where("vec_id % 100 <> 0"), F.col("vec_id") % 100 == 0).count() == 0


def test_lists_end_early():
    """Members stop before the end of a list where bounds certify it, and lose nothing by it."""
    r = np.random.default_rng(4)
    v = np.round(np.concatenate([r.normal(size=(4000, 6)) + 4 * np.eye(6)[r.integers(0, 6, 4000)], np.zeros((1, 6))]) * 100).astype(np.int64)
    uid, label = np.arange(len(v)), r.integers(0, 3, len(v))
    anchors = np.arange(0, 4000, 100)
    block = hard_negatives.Clusters(uid[anchors], label[anchors], v[anchors], hard_negatives.fit_centres(v[anchors]))
    tops, taken = hard_negatives.Top(len(anchors), 5), []
    plain = hard_negatives.scored
    hard_negatives.scored = lambda a, x, d: taken.append(len(a) * len(x)) or plain(a, x, d)
    try:
        hard_negatives.walk(block, tops, uid, uid, label, v)
    finally:
        hard_negatives.scored = plain
    assert sum(taken) < 0.7 * len(anchors) * len(v)
    for i, a in enumerate(anchors):
        own = [k for k in np.lexsort((uid, -(v @ v[a]))) if k != a and label[k] == label[a]][:5]
        assert tops.uid[i].tolist() == own


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op13_hard_negatives"])
def test_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    want = c.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())
