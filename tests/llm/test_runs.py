"""Runs of repeated events against a walk in plain Python, and odd input."""

import random

from loomtrace.llm.runs import agglomerate, collapse_runs, similarity, template

SCHEMA = "seq long, log_id string, thread_id string, kind string, ts timestamp_ntz, function_name string, message string"


def frame(spark, rows):
    from datetime import datetime, timedelta

    t0 = datetime(2026, 1, 1)
    return spark.createDataFrame([(s, lg, th, k, None if ms is None else t0 + timedelta(milliseconds=ms), f, m) for s, lg, th, k, ms, f, m in rows], SCHEMA)


def test_template(spark):
    from pyspark.sql import functions as F

    same = ["value 5 at 0x1F: ok", "VALUE 17.5 at 0xabc ok!", "value  616f-4a99 at 12:30:01 ok"]
    d = spark.createDataFrame([(x,) for x in same], "m string").select(template(F.col("m")).alias("t"))
    assert {r["t"] for r in d.collect()} == {"value # at # ok"}


def test_similarity():
    assert similarity(("f", "a # b"), ("f", "a # b")) == 1.0
    assert similarity(("f", "a # b"), ("g", "a # b")) == 0.0
    assert similarity((None, "a # b"), ("g", "a # b")) == 0.95
    assert 0.3 < similarity(("f", "state change to wa"), ("f", "state change to warming")) < 0.95
    assert similarity(("f", "tick #"), ("f", "ticket lost")) == 0.0
    assert similarity(("f", ""), ("f", "x")) == 0.0 and similarity(("f", ""), ("f", "")) == 1.0


def test_runs(spark):
    rows = [
        (1, "l", "t", "STRUCTURED", 0, "f", "slot 5 took 3 ms"),
        (1, "l", "t", "STRUCTURED", 0, "f", "slot 5 took 3 ms"),  # delivered twice
        (2, "l", "u", "STRUCTURED", 5, "f", "slot 5 took 3 ms"),  # another thread
        (3, "l", "t", "RAW", 7, None, "slot"),
        (4, "l", "t", "TRACE", 250, None, "Slot 7 took 4.5 ms ..."),
        (5, "l", "t", "STRUCTURED", None, "f", "slot 7 to"),
        (6, "l", "t", "STRUCTURED", 900, "g", "slot 7 took 1 ms"),
        (7, "l", None, "STRUCTURED", 900, "g", "a"),
        (8, "l", None, "STRUCTURED", 900, "g", "a"),
        (9, None, None, "STRUCTURED", 900, "g", "a"),
        (10, "l", "t", "STRUCTURED", 1000, "g", None),
        (11, "l", "t", "STRUCTURED", 1001, "g", ""),
        (None, "l", "t", "STRUCTURED", 0, "f", "slot"),
    ]
    got = {(r["first_seq"], r["last_seq"], r["events"], r["duration_ms"]) for r in collapse_runs(frame(spark, rows)).collect()}
    assert got == {(1, 5, 3, 250), (2, 2, 1, 0), (6, 6, 1, 0), (7, 8, 2, 0), (9, 9, 1, 0), (10, 11, 2, 1)}
    two = {(r["first_seq"], r["last_seq"]) for r in collapse_runs(frame(spark, rows), min_count=2).collect()}
    assert two == {(1, 5), (7, 8), (10, 11)}
    near = {(r["first_seq"], r["last_seq"]) for r in collapse_runs(frame(spark, rows), min_count=2, max_gap_ms=100).collect()}
    assert (1, 5) not in near and (7, 8) in near


def test_blocks_and_skew_do_not_matter(spark):
    rnd = random.Random(2)
    texts = ["alpha 1 beta", "alpha 2 be", "gamma", "delta 7 of 9", "delta 1 of"]
    rows, seq, text = [], 0, texts[0]
    for _ in range(600):
        if rnd.random() < 0.4:
            text = rnd.choice(texts)
        seq += rnd.choice([1, 1, 2, 9])
        rows.append((seq, "hot" if rnd.random() < 0.8 else "cold", rnd.choice(["t", None]), "STRUCTURED", seq, rnd.choice(["f", "f", None]), text))
    d = frame(spark, rows)
    key = lambda df: sorted((r["first_seq"], r["last_seq"], r["events"]) for r in df.collect())
    want = key(collapse_runs(d))
    assert sum(n for _, _, n in want) == len(rows)
    for block in (16, 101):
        assert key(collapse_runs(d, block=block, min_count=2)) == key(collapse_runs(d, min_count=2))


def test_most_similar_first():
    run = lambda i, t: [i, i, 1, None, None, "f", t, t, True]
    got = agglomerate([run(1, "state change to"), run(2, "state change to"), run(3, "state change to warming"), run(4, "state change to idle")], 0.3, None)
    assert [(r[0], r[1]) for r in got] == [(1, 3), (4, 4)]


def test_empty_and_clashing_columns(spark):
    d = frame(spark, [(1, "l", "t", "STRUCTURED", 0, "f", "x")])
    assert collapse_runs(d.where("false")).count() == 0
    odd = d.withColumn("block", d.seq).withColumn("template", d.message).withColumn("n", d.seq).withColumn("head", d.seq)
    assert collapse_runs(odd).count() == 1
