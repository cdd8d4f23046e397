"""HTTP headers by connection, in batch and as a stream.

Events are ``conn, ts, is_orig, event, name, value`` with event one of ``start`` (a request or
reply begins: the vector is emptied), ``header`` and ``done`` (the vector is sent). Header order is
event order. A ``done`` without a start sends nothing. Cookie values are masked.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "unknown"
OUT = "ts timestamp, origin string, useragent string, header_events_json string"


def headers_json(names_values: Column) -> Column:
    """JSON list of one-key objects from an array of name, value structs."""
    return F.coalesce(F.to_json(F.transform(names_values, lambda x: F.create_map(x["name"], F.when(x["name"] == "COOKIE", "-").otherwise(x["value"])))), F.lit("[]"))


def agent(names_values: Column, is_orig: Column) -> Column:
    """Last USER-AGENT of a client, SERVER of a server, else a fixed text."""
    last = lambda name: F.try_element_at(F.filter(names_values, lambda x: x["name"] == name), F.lit(-1))["value"]
    return F.coalesce(F.when(is_orig, last("USER-AGENT")).otherwise(last("SERVER")), F.lit(UNKNOWN))


def batch(events: DataFrame) -> DataFrame:
    """The stream's result over a finished table."""
    w = Window.partitionBy("conn").orderBy("ts", "seq")
    runs = events.withColumn("run", F.sum(F.when(F.col("event") == "start", 1).otherwise(0)).over(w)).where("run > 0")
    sent = runs.groupBy("conn", "run").agg(
        F.max_by("ts", F.when(F.col("event") == "done", F.col("ts"))).alias("ts"), F.min_by("is_orig", F.struct("ts", "seq")).alias("is_orig"), F.max(F.col("event") == "done").alias("done"),
        F.array_sort(F.collect_list(F.when(F.col("event") == "header", F.struct("ts", "seq", F.upper("name").alias("name"), "value")))).alias("h"),
    ).where("done")
    pairs = F.transform("h", lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value")))
    return sent.select("ts", F.when(F.col("is_orig"), "client").otherwise("server").alias("origin"), agent(pairs, F.col("is_orig")).alias("useragent"), headers_json(pairs).alias("header_events_json"))


def _update(key: tuple, pdfs: Iterator[pd.DataFrame], state, idle_ms: int | None) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:  # the connection was left open
        state.remove()
        yield pd.DataFrame(columns=["ts", "origin", "useragent", "header_events_json"])
        return
    started, names, values = state.get if state.exists else (False, [], [])
    names, values, out = list(names), list(values), []
    for pdf in pdfs:
        for e in pdf.sort_values(["ts", "seq"]).itertuples():
            if e.event == "start":
                started, names, values = True, [], []
            elif e.event == "header" and started:
                names.append((e.name or "").upper())
                values.append(e.value or "")
            elif e.event == "done" and started:
                wanted = "USER-AGENT" if e.is_orig else "SERVER"
                found = [v for n, v in zip(names, values) if n == wanted]
                text = json.dumps([{n: "-" if n == "COOKIE" else v} for n, v in zip(names, values)], separators=(",", ":"), ensure_ascii=False)
                out.append((e.ts, "client" if e.is_orig else "server", found[-1] if found else UNKNOWN, text))
                started, names, values = False, [], []
    if started:
        state.update((started, names, values))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
    elif state.exists:
        state.remove()
    yield pd.DataFrame(out, columns=["ts", "origin", "useragent", "header_events_json"])


def stream(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Header vectors of a stream of events, kept by connection between batches.

    A connection's state goes when its vector is sent; with ``idle_ms`` also after that long without
    events (Spark then runs batches without data, too).
    """

    def update(key, pdfs, state):
        yield from _update(key, pdfs, state, idle_ms)

    kept = "started boolean, names array<string>, vals array<string>"
    return events.groupBy("conn").applyInPandasWithState(update, OUT, kept, "append", "NoTimeout" if idle_ms is None else "ProcessingTimeTimeout")
