"""Problem 1: runs of repeated consecutive events, by adjacent agglomeration.

A sequence (*entity*) is the records of one log and thread in order of ``seq``. Neighbouring runs that report the same
event are merged, most similar pair first, with a linked list and a priority queue, until no pair meets the limits.

How it is spread out: Catalyst drops repeated deliveries, writes each message as a template (numbers, ids, addresses and
times become ``#``, punctuation and case go) and marks which neighbours could ever merge. Records that can merge with
neither side are runs of their own and never reach Python. The others are merged per *block*: an entity is cut at fixed
multiples of ``block`` in ``seq``, so that one log that holds a third of all rows still becomes many tasks' work. The
first and last run of every block then go through the same agglomeration once more, along the entity, which joins the
runs that a block border had cut.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.session import cut

BLOCK = 1 << 16
MIN_SIMILARITY = 0.3
MIN_CUT = 4

RUN_SCHEMA = (
    "log_id string, thread_id string, first_seq long, last_seq long, n long, "
    "first_us long, last_us long, function_name string, template string, message string"
)
_FRAGMENT = RUN_SCHEMA + ", block long, head boolean, tail boolean"


def template(message: Column) -> Column:
    """What a message says without numbers, ids, addresses, times, spacing, case and punctuation.

    Every such variable part becomes one ``#``; words are kept, parted by one blank. Null stays null.
    """
    t = F.lower(message)
    t = F.regexp_replace(t, r"0x[0-9a-f]*|\b[0-9a-f]{4,}(?:-[0-9a-f]{4,})+\b|\b(?=[a-f]*[0-9])[0-9a-f]{6,}\b|[0-9]+", "#")
    t = F.regexp_replace(t, r"[^\p{L}#]+", " ")
    return F.trim(F.regexp_replace(t, r"#(?: ?#)+", "#"))


def similarity(a: tuple[str | None, str], b: tuple[str | None, str]) -> float:
    """How alike two (function, template) pairs are: 1 for the same event, 0 for different ones.

    A missing function fits any and costs 0.05. A template that is the other one cut off at its end (at least
    ``MIN_CUT`` characters are left) scores the share that is left, in 0.3 to 0.9. Two empty templates are alike; an
    empty one is alike to nothing else.
    """
    (f, s), (g, t) = a, b
    if f is not None and g is not None and f != g:
        return 0.0
    known = 1.0 if f == g else 0.95
    if s == t:
        return known
    if len(s) > len(t):
        s, t = t, s
    if len(s) < MIN_CUT:
        return 0.0
    if t.startswith(s):
        return known * (0.3 + 0.6 * len(s) / len(t))
    # an id that was cut in its middle leaves a few hexadecimal letters
    head, _, end = s.rpartition(" ")
    if head and len(end) <= 8 and not end.strip("abcdef") and (t.startswith(head + " #") or t.startswith(head + "#")):
        return known * (0.3 + 0.6 * len(head) / len(t))
    return 0.0


def agglomerate(runs: list[list], min_similarity: float, max_gap_us: int | None) -> list[list]:
    """Merge neighbours of one stretch: a linked list of runs and a heap of (−similarity, position).

    A run is ``[first_seq, last_seq, n, first_us, last_us, function, template, message, joint]``; ``joint`` says whether
    it may be merged with its successor at all. A merged run keeps the function that is known and the longer template,
    so that what it can still be merged with follows all of its records.
    """
    n = len(runs)
    nxt = list(range(1, n + 1))
    prv = list(range(-1, n - 1))
    alive = [True] * n
    version = [0] * n
    heap: list[tuple[float, int, int, int, int]] = []

    def offer(i: int) -> None:
        j = nxt[i]
        if j >= n or not runs[i][8]:
            return
        a, b = runs[i], runs[j]
        if max_gap_us is not None and a[4] is not None and b[3] is not None and abs(b[3] - a[4]) > max_gap_us:
            return
        s = similarity((a[5], a[6]), (b[5], b[6]))
        if s >= min_similarity:
            heapq.heappush(heap, (-s, i, j, version[i], version[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, j, vi, vj = heapq.heappop(heap)
        if not (alive[i] and alive[j] and version[i] == vi and version[j] == vj and nxt[i] == j):
            continue
        a, b = runs[i], runs[j]
        longer = b if len(b[6]) > len(a[6]) else a
        runs[i] = [
            a[0], b[1], a[2] + b[2],
            a[3] if b[3] is None or (a[3] is not None and a[3] <= b[3]) else b[3],
            a[4] if b[4] is None or (a[4] is not None and a[4] >= b[4]) else b[4],
            a[5] if a[5] is not None else b[5], longer[6], longer[7], b[8],
        ]
        alive[j] = False
        version[i] += 1
        k = nxt[i] = nxt[j]
        if k < n:
            prv[k] = i
        offer(i)
        if prv[i] >= 0:
            offer(prv[i])
    return [r for r, live in zip(runs, alive) if live]


def _stretches(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[tuple[tuple, list[list], list[tuple[bool, bool]]]]:
    """Rows sorted by key and place, cut into stretches of rows that are joint to each other, across batches."""
    now: tuple | None = None
    runs: list[list] = []
    ends: list[tuple[bool, bool]] = []
    for pdf in batches:
        pdf = pdf.astype(object).where(pdf.notna(), None)
        keys = list(zip(*(pdf[k] for k in key)))
        cols = ["first_seq", "last_seq", "n", "first_us", "last_us", "function_name", "template", "message", "joint"]
        for k, row, end in zip(keys, zip(*(pdf[c] for c in cols)), zip(pdf["head"], pdf["tail"])):
            if runs and (k != now or not runs[-1][8]):
                yield now, runs, ends
                runs, ends = [], []
            now = k
            runs.append(list(row))
            ends.append(end)
    if runs:
        yield now, runs, ends


def _merge(key: list[str], min_similarity: float, max_gap_us: int | None):
    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for k, runs, ends in _stretches(batches, key):
            first, last, head, tail = runs[0][0], runs[-1][1], ends[0][0], ends[-1][1]
            of = dict(zip(key, k))
            for r in agglomerate(runs, min_similarity, max_gap_us) if len(runs) > 1 else runs:
                out.append((of["log_id"], of["thread_id"], *r[:8], of.get("block"), bool(head and r[0] == first), bool(tail and r[1] == last)))
            if len(out) >= 20_000:
                yield _frame(out)
                out = []
        if out:
            yield _frame(out)

    return over


_COLS = ["log_id", "thread_id", "first_seq", "last_seq", "n", "first_us", "last_us", "function_name", "template", "message", "block", "head", "tail"]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=_COLS)
    return pdf.astype({c: "Int64" for c in ("first_seq", "last_seq", "n", "first_us", "last_us", "block")})


def _compatible(f: Column, g: Column, s: Column, t: Column) -> Column:
    """A condition that all pairs of neighbours meet which could end up in one run."""
    width = F.least(F.length(s), F.length(t), F.greatest(F.lit(MIN_CUT), F.least(F.length(s), F.length(t)) - 9))
    alike = (s == t) | ((F.least(F.length(s), F.length(t)) >= MIN_CUT) & (F.substring(s, 1, MIN_CUT - 1) == F.substring(t, 1, MIN_CUT - 1)) & (F.left(s, width) == F.left(t, width)))
    return F.coalesce(alike & (f.isNull() | g.isNull() | (f == g)), F.lit(False))


def collapse_runs(
    logs: DataFrame, min_similarity: float = MIN_SIMILARITY, max_gap_ms: int | None = None, block: int = BLOCK, min_count: int = 1
) -> DataFrame:
    """Log entries to one row per run: its first and last ``seq``, count and duration.

    Input: columns ``seq, log_id, thread_id, kind, ts, function_name, message``; others are not read, so extra columns
    may be called anything. Only kinds STRUCTURED and TRACE count; repeated deliveries of a ``seq`` count once; rows
    without ``seq`` have no place and are left out. Null ``thread_id`` (or ``log_id``) is a thread (log) of its own. A
    null message equals an empty one. ``duration_ms`` spans the earliest and latest known ``ts`` of the run and is null if
    none is known. An empty table gives an empty result.

    ``max_gap_ms`` also parts neighbours whose ``ts`` are further apart (in either direction); None: no limit.
    """
    max_gap_us = None if max_gap_ms is None else max_gap_ms * 1000
    rows = (
        logs.where(F.col("kind").isin("STRUCTURED", "TRACE") & F.col("seq").isNotNull())
        .select("seq", "log_id", "thread_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "function_name", F.coalesce("message", F.lit("")).alias("message"))
        .withColumn("block", F.floor(F.col("seq") / block).cast("long"))
    )
    key = ["log_id", "thread_id", "block"]
    by_seq = Window.partitionBy(*key).orderBy("seq")
    # a repeated delivery is an exact copy and so a neighbour: no second shuffle to drop it
    rows = rows.withColumn("again", F.lag("seq").over(by_seq) == F.col("seq")).where(F.coalesce(~F.col("again"), F.lit(True)))
    rows = rows.withColumn("template", template(F.col("message")))
    rows = rows.withColumn("later", F.lead(F.struct("function_name", "template")).over(by_seq))
    joint = F.col("later").isNotNull() & _compatible(F.col("function_name"), F.col("later.function_name"), F.col("template"), F.col("later.template"))
    rows = rows.withColumn("joint", joint).withColumn("earlier", F.coalesce(F.lag("joint").over(by_seq), F.lit(False)))
    rows = rows.withColumn("head", F.row_number().over(by_seq) == 1).withColumn("tail", F.col("later").isNull())
    single = [
        "log_id", "thread_id", F.col("seq").alias("first_seq"), F.col("seq").alias("last_seq"), F.lit(1).cast("long").alias("n"),
        F.col("us").alias("first_us"), F.col("us").alias("last_us"), "function_name", "template", "message", "block", "head", "tail", "joint", "earlier",
    ]
    # whatever can merge with neither side and is no border of its block is a run by itself
    alone = ~F.col("joint") & ~F.col("earlier") & ~F.col("head") & ~F.col("tail")
    marked = rows.withColumn("alone", alone)
    if min_count > 1:
        marked = marked.where(~F.col("alone"))
    marked = marked.select(*single, "alone")
    busy = marked.where(~F.col("alone")).drop("alone", "earlier").sortWithinPartitions(*key, "first_seq")
    # read twice below, and much smaller than the input: written once to the shared folder
    fragments = cut(busy.mapInPandas(_merge(key, min_similarity, max_gap_us), _FRAGMENT))
    border = F.col("head") | F.col("tail")
    # borders: a few rows a block; the same merging once more along each entity
    along = Window.partitionBy("log_id", "thread_id").orderBy("first_seq")
    edges = (
        fragments.where(border)
        .withColumn("next_block", F.lead("block").over(along))
        .withColumn("joint", F.col("tail") & F.col("next_block").isNotNull() & (F.col("next_block") != F.col("block")))
        .drop("block", "next_block")
        .sortWithinPartitions("log_id", "thread_id", "first_seq")
        .mapInPandas(_merge(["log_id", "thread_id"], min_similarity, max_gap_us), _FRAGMENT)
    )
    parts = [fragments.where(~border), edges]
    if min_count <= 1:
        parts.append(marked.where(F.col("alone")).drop("alone", "earlier", "joint"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.where(F.col("n") >= min_count).select(
        "log_id", "thread_id", "first_seq", "last_seq", F.col("n").alias("events"), "function_name", "message",
        F.floor((F.col("last_us") - F.col("first_us")) / 1000).cast("long").alias("duration_ms"),
    )
