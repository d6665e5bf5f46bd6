"""What the queries and the pipeline's stages must not leave out: short lines, null and repeated ids, rows that only share
a passage."""

from __future__ import annotations

import random
import string
import time
from collections import Counter
from functools import partial

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tabletide.llm import common, decontam, line_dedup, queries, substring_dedup, toxicity

LETTERS = string.ascii_letters + string.digits
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(k, t, "en", "web", len(t or "")) for k, t in rows], SCHEMA)


def test_short_equal_lines(spark, tmp_path):
    texts = ["Les.\nunique one\n\n \n", "Les.\nLes!\n\n \nunique two", "x\nx\n" + "a line of over twenty characters", "Les.\na line of over twenty character"]
    df = documents(spark, enumerate(texts))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = {0: [], 1: [0], 2: [1], 3: [0, 1]}  # blank lines stay, and short lines that are only near
    assert {r.doc_id: r.removed_lines for r in queries.op9_line_dedup(spark, str(tmp_path)).collect()} == want
    stage = dict(corpus_pipeline.STAGES)["line_dedup"]
    got = {r.doc_id: (r.text, r.n_chars) for r in stage(spark, df, str(tmp_path)).collect()}
    for k, t in enumerate(texts):
        kept = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want[k])
        assert got[k] == (kept, len(kept))


def test_lines_whose_hashes_agree_in_half(spark):
    a, b = "a line of ƭĦ many characters", "a line of ɛÓ many characters"
    upper = [xxhash.xxh64_intdigest(x.encode(), 42) >> 32 for x in (a, b)]
    assert upper[0] == upper[1]
    got = line_dedup.line_report(documents(spark, [(1, a), (2, b)])).collect()
    assert {r.doc_id: r.removed_lines for r in got} == {1: [], 2: [0]}


def test_lines_of_many_shared_keys_are_shuffled_once(spark, monkeypatch):
    """Lines that share keys with others go through a shuffle once, not once for each of their twelve keys, also where the shared
    keys are more than any that fit in a broadcast of keys."""
    monkeypatch.setattr(line_dedup, "FEW_KEYS", 0, raising=False)
    r = random.Random(8)
    base = ["".join(r.choices(LETTERS, k=70_000)) for _ in range(8)]  # longer than a compressed block, which would take out copies
    lines = [x[:k] + "*" + x[k + 1 :] for x in base for k in r.sample(range(70_000), 2)]
    df = documents(spark, enumerate("\n".join(lines[k : k + 4]) for k in range(0, len(lines), 4)))
    written = lambda: sum(x.totalShuffleWrite() for x in list_of(spark, spark.sparkContext._jsc.sc().statusStore().executorList(True)))
    before = written()
    firsts = line_dedup.lines_of(df, 20).groupBy("h1", "h2").agg(F.min(F.struct(*line_dedup.DOC, "line_no")).alias("first"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for more keys than Spark would broadcast by itself
    try:
        found = line_dedup.near_earlier(df, firsts, 2, 20).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == 8 and written() - before < 6 * sum(map(len, lines))


def list_of(spark, seq):
    return [seq.apply(i) for i in range(seq.size())]


def test_key_filter(spark):
    """No key is lost, few others pass; a filter that is too small for its keys lets more pass and loses none."""
    keys, others = (spark.range(a, a + 20_000).select(F.xxhash64("id").alias("key")) for a in (0, 10**6))
    for n, few in ((20_000, 100), (200, 20_001)):
        blocks, passes = line_dedup.key_filter(keys, n)
        assert keys.join(F.broadcast(blocks), passes, "left_semi").count() == 20_000
        assert others.join(F.broadcast(blocks), passes, "left_semi").count() < few


def test_materialized_steps_leave_no_shuffle_files(spark):
    files = lambda: {x.getName() for x in list_of(spark, spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if x.getName().startswith("shuffle_")}
    before, own = files(), spark.range(5000).groupBy((F.col("id") % 100).alias("k")).agg(F.max("id").alias("most"))
    kept = spark.conf.get(common.CLEANUP, None)
    made = common.materialize(own, "test-steps")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and spark.conf.get(common.CLEANUP, None) == kept
    assert made.count() == own.count() == 100 and made.agg(F.sum("most")).first() == own.agg(F.sum("most")).first()


def words_of(seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n)) + "."


def rows_left(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_quality_stage_judges_rows(spark, tmp_path):
    good = [words_of(i) for i in range(5)]
    rows = [(None, good[0]), (None, "short"), (1, good[1]), (1, "too short"), (2, good[2]), (2, good[2]), (None, None), (3, ""), (None, good[3])]
    got = rows_left(dict(corpus_pipeline.STAGES)["quality"](spark, documents(spark, rows), str(tmp_path)))
    assert got == Counter((k, t) for k, t in rows if t in good)


def test_near_duplicate_stage_leaves_one_row_a_group(spark, tmp_path):
    t = [words_of(i) for i in range(5)]
    rows = [(None, t[0]), (None, t[1]), (None, t[1]), (7, t[2]), (7, t[2]), (5, t[3]), (5, t[4]), (4, t[4]), (None, t[4]), (9, None), (None, "")]
    got = rows_left(dict(corpus_pipeline.STAGES)["simhash"](spark, documents(spark, rows), str(tmp_path)))
    assert got == Counter([(None, t[0]), (None, t[1]), (7, t[2]), (5, t[3]), (4, t[4]), (9, None)])


@pytest.mark.parametrize("block_bytes", [4 << 20, 100])
def test_decontamination_stage_judges_rows(spark, tmp_path, monkeypatch, block_bytes):
    t = [words_of(i) for i in range(5)]
    spark.createDataFrame([(1, t[0]), (2, t[1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(decontam, "find_contamination", partial(decontam.find_contamination, block_bytes=block_bytes))
    rows = [(None, t[0]), (None, t[2]), (1, t[1]), (1, t[3]), (2, t[4]), (2, t[4]), (None, None)]
    got = rows_left(dict(corpus_pipeline.STAGES)["decontamination"](spark, documents(spark, rows), str(tmp_path)))
    assert got == Counter((k, x) for k, x in rows if x not in t[:2])


def test_training_rows_that_share_a_passage_stay(spark):
    passage, long = words_of(0, 30)[:-1], words_of(1, 300)[:-1]
    texts = [f"{passage} {words_of(i, 60)}" for i in range(2, 12)]
    rows = [(i, i, t, i % 2) for i, t in enumerate(texts)]
    rows += [(20, 20, long, 0), (21, 21, long + " extra", 0), (22, 22, long + " extra", 1), (23, 20, long, 0), (24, 24, "", 0), (25, 25, None, 0)]
    got = toxicity.one_of_copies(spark.createDataFrame(rows, "row long, doc_id long, text string, toxic int")).collect()
    assert sorted(r.row for r in got) == [*range(10), 20, 22, 24]


def test_second_hash_is_not_a_function_of_the_first(spark):
    from pyspark.sql import functions as F

    from tabletide.llm.common import two_hashes

    h1, h2 = two_hashes(F.col("x"))
    row = spark.createDataFrame([("some text",)], "x string").select(h1.alias("h1"), h2.alias("h2"), F.xxhash64("x", F.lit(1)).alias("chained")).first()
    assert row.h2 != row.chained


def test_texts_of_one_doc_id_are_told_apart(spark):
    w, v = words_of(1, 25), words_of(2, 25)
    got = substring_dedup.remove_repeats(documents(spark, [(1, w), (2, w), (2, v), (None, v[:-1] + ".")]), with_text=True).collect()
    assert Counter((r.doc_id, r.n_removed, r.kept_text) for r in got) == Counter([(1, 0, w), (2, 25, ""), (2, 25, ""), (None, 0, v)])
