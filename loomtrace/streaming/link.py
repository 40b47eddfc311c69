"""Linking of records as they arrive: Structured Streaming with the last record of each function as state.

Records of one log must arrive in order of ``seq`` from batch to batch (a late one never links backwards, as in a log
read from its file). The reach of the call graph is joined to the stream as a static table, so that the state function
sees each record with its possible callers and holds nothing but the latest records.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomtrace.operators.graph import SYNC_MS

OUT = "log_id string, seq long, parent_seq long, arrow_kind string, depth int, hops int"


def _fits(earlier: int | None, later: int | None, window: int) -> bool:
    return earlier is None or later is None or 0 <= later - earlier <= window


def _step(sync_ms: int):
    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent: dict[str, list] = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(chunks)).sort_values("seq", kind="stable")
        out = []
        for seq, ts, name, known, callers in zip(rows["seq"], rows["ts_ms"], rows["key"], rows["known"], rows["callers"]):
            ts = None if pd.isna(ts) else int(ts)
            parent = arrow = None
            depth = hops = 0
            best = None
            if known:
                for c in callers if callers is not None else ():
                    last = recent.get(c["caller"])
                    if last is not None and _fits(last[1], ts, c["window_ms"]) and (best is None or (last[0], -c["hops"]) > best[0]):
                        best = ((last[0], -c["hops"]), last, c)
            if best is not None:
                parent, arrow, depth, hops = best[1][0], best[2]["kind"], best[1][2] + 1, best[2]["hops"]
            elif name is not None and name in recent and _fits(recent[name][1], ts, sync_ms):
                depth, parent = recent[name][2], recent[name][3]
            if name is not None:
                recent[name] = [int(seq), ts, depth, parent]
            out.append((key[0], int(seq), parent, arrow, depth, hops))
        state.update((json.dumps(recent),))
        frame = pd.DataFrame(out, columns=["log_id", "seq", "parent_seq", "arrow_kind", "depth", "hops"])
        yield frame.astype({"parent_seq": "Int64"})

    return step


def link_stream(events: DataFrame, reach: DataFrame, sync_ms: int = SYNC_MS) -> DataFrame:
    """Links of a stream of records ``log_id, seq, ts_ms, function_id, file_name, function_name`` as they come.

    Same results as ``operators.link.link`` where records arrive in order. State grows with the functions of a log, not
    with its records. Null ``log_id`` is a log of its own.
    """
    c = F.col
    callers = reach.groupBy(c("callee").alias("r_callee")).agg(F.collect_list(F.struct("caller", "hops", "kind", "window_ms")).alias("callers"))
    key = F.coalesce("function_id", F.when(c("function_name") != "", F.concat(F.lit("?"), F.coalesce("file_name", F.lit("")), F.lit("::"), c("function_name"))))
    e = events.select("log_id", "seq", "ts_ms", key.alias("key"), c("function_id").isNotNull().alias("known"), "function_id")
    e = e.join(callers, c("function_id") == c("r_callee"), "left").select("log_id", "seq", "ts_ms", "key", "known", "callers")
    return e.groupBy("log_id").applyInPandasWithState(_step(sync_ms), OUT, "recent string", "append", GroupStateTimeout.NoTimeout)
