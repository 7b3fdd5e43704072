"""Stateful guards over event streams, by key and in event time.

Each guard is a pure step over (state, ordered events) that yields one verdict for each event, so it can be tested alone;
`by_key` runs it on a stream with keyed state and `in_batch` on a table. Within a micro-batch a key's events are put in
order of time; rows later than the watermark are dropped by Spark before they come here.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vigilframe.plans.shared import own_folder


def token_bucket(capacity: float = 5.0, rate: float = 1 / 3600, cost: float = 1.0) -> tuple[Callable, str]:
    """ST2: tokens grow with time up to the capacity; an event takes `cost` of them or is denied and told when to retry."""

    def step(state, events):
        tokens, last = state or (capacity, None)
        for at, _ in events:
            tokens = min(capacity, tokens + (max(0.0, at - last) * rate if last is not None else 0.0))
            last = at if last is None else max(last, at)
            ok = tokens >= cost - 1e-9
            tokens -= cost if ok else 0.0
            yield (ok, tokens, 0.0 if ok else (cost - tokens) / rate)
        yield tokens, last

    return step, "allowed boolean, tokens double, retry_after double"


def violation_throttle(window: float = 86400.0, most: int = 3, pause: float = 7200.0, bad: float = 80.0) -> tuple[Callable, str]:
    """ST3: an event of value over `bad` is a violation; `most` of them in the window stop the key for the pause."""

    def step(state, events):
        seen, until = [list(x) if isinstance(x, (list, tuple)) else x for x in state] if state else ([], 0.0)
        for at, value in events:
            seen = [t for t in seen if at - t < window]
            stopped = at < until
            if value > bad:
                seen.append(at)
                if len(seen) >= most:
                    until = max(until, at + pause)
            yield (not stopped, float(len(seen)), max(0.0, until - at))
        yield seen, until

    return step, "allowed boolean, violations double, stopped_for double"


def adaptive_throttle(base: float = 100, window: float = 60.0, levels: tuple[int, ...] = (3, 7, 12), shares: tuple[float, ...] = (1.0, 0.5, 0.25, 0.0), cooldown: float = 120.0, bad: float = 80.0) -> tuple[Callable, str]:
    """ST4: incidents (events of value over `bad`) of the window raise the level (0 normal, 3 blocked); every whole cooldown
    since the last of them lowers it by one. A request passes while the window holds fewer passed ones than the level's
    share of `base`; else it is told when to retry. An event is checked before it counts as an incident."""

    def step(state, events):
        incidents, passed = [list(x) for x in state] if state else ([], [])
        for at, value in events:
            incidents, passed = ([t for t in kept if t >= at - window] for kept in (incidents, passed))
            level = sum(len(incidents) >= n for n in levels)
            if level:
                level = max(0, level - max(0, int((at - max(incidents)) // cooldown)))
            ok = level < len(levels) and len(passed) < base * shares[level]
            wait = 0.0 if ok else cooldown if level == len(levels) else max(0.0, min(passed) + window - at) if passed else 0.0
            if ok:
                passed.append(at)
            if value > bad:
                incidents.append(at)
            yield (ok, float(level), wait)
        yield incidents, passed

    return step, "allowed boolean, level double, retry_after double"


def circuit_breaker(failures: int = 3, rest: float = 43200.0, bad: float = 80.0) -> tuple[Callable, str]:
    """ST5: closed until `failures` bad events in a row, open for `rest` seconds, then half-open for one trial."""

    def step(state, events):
        mode, count, since = state or ("closed", 0, 0.0)
        for at, value in events:
            if mode == "open" and at - since >= rest:
                mode = "half-open"
            ok, failed = mode != "open", value > bad
            if ok and failed:
                count += 1
                if mode == "half-open" or count >= failures:
                    mode, since = "open", at
            elif ok:
                mode, count = "closed", 0
            yield (ok, float(count), float(("closed", "half-open", "open").index(mode)))
        yield mode, count, since

    return step, "allowed boolean, failures double, mode double"


def expiring_cache(ttl: float = 86400.0) -> tuple[Callable, str]:
    """ST6, G4: whether the key was seen within the time to live; a hit does not renew it."""

    def step(state, events):
        (stored,) = state or (None,)
        for at, _ in events:
            hit = stored is not None and at - stored < ttl
            age = at - stored if hit else 0.0
            if not hit:
                stored = at
            yield (hit, age, stored)
        yield (stored,)

    return step, "hit boolean, age double, stored double"


def _run(step: Callable, state, pdf: pd.DataFrame):
    """Rows of the verdicts in event order, and the new state."""
    pdf = pdf.sort_values(["at", "event_id"], kind="stable")
    *verdicts, state = step(state, list(zip(pdf["at"].tolist(), pdf["value"].tolist())))
    out = pd.concat([pdf[["event_id", "key"]].reset_index(drop=True), pd.DataFrame(verdicts)], axis=1)
    return out, state


def _named(step_schema: str) -> str:
    return f"event_id long, key long, {step_schema}"


def prepared(events: DataFrame, key: str = "user_id", ts: str = "ts", value: str = "value") -> DataFrame:
    """event_id, key, at (seconds) and value of an event table or stream."""
    at = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))") / 1e6
    return events.select("event_id", F.col(key).cast("long").alias("key"), at.alias("at"), F.col(value).cast("double").alias("value"))


def by_key(events: DataFrame, guard: tuple[Callable, str]) -> DataFrame:
    """The guard over a stream of prepared events; its state lives in Spark's state store."""
    step, schema = guard
    import json

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState):
        old = json.loads(state.get[0]) if state.exists else None
        out, new = _run(step, old, pd.concat(list(frames)))
        state.update((json.dumps(new),))
        names = ["event_id", "key", *[x.split()[0] for x in schema.split(", ")]]
        yield out.set_axis(names, axis=1)

    return events.groupBy("key").applyInPandasWithState(run, _named(schema), "state string", "append", GroupStateTimeout.NoTimeout)


def in_batch(events: DataFrame, guard: tuple[Callable, str]) -> DataFrame:
    """The guard over a table of prepared events: a recurrence that no window function expresses."""
    step, schema = guard
    names = ["event_id", "key", *[x.split()[0] for x in schema.split(", ")]]

    def run(pdf):
        return _run(step, None, pdf)[0].set_axis(names, axis=1)

    return events.groupBy("key").applyInPandas(run, _named(schema))


def stream_guard(chunks: DataFrame, patterns: tuple[str, ...], look_back: int = 500) -> DataFrame:
    """ST1: chunks(stream_id, seq, chunk) in; for each chunk, whether the stream is blocked and the text it releases.

    The unreleased text is scanned again with every chunk, so a pattern that is cut by chunks is found; a block latches;
    text is held back until look_back characters have followed it."""
    import re

    compiled = [re.compile(p) for p in patterns]

    def run(key, frames, state: GroupState):
        buffer, blocked = state.get if state.exists else ("", False)
        pdf = pd.concat(list(frames)).sort_values("seq")
        rows = []
        for seq, chunk in zip(pdf["seq"].tolist(), pdf["chunk"].tolist()):
            buffer += chunk or ""
            blocked = blocked or any(p.search(buffer) for p in compiled)
            free = "" if blocked else buffer[: max(0, len(buffer) - look_back)]
            buffer = buffer[len(free) :]
            rows.append((key[0], seq, blocked, free))
        state.update((buffer, blocked))
        yield pd.DataFrame(rows, columns=["stream_id", "seq", "blocked", "released"])

    return chunks.groupBy("stream_id").applyInPandasWithState(run, "stream_id long, seq long, blocked boolean, released string", "buffer string, blocked boolean", "append", GroupStateTimeout.NoTimeout)


def window_alerts(events: DataFrame, threshold: float = 60.0, least: int = 2, width: str = "1 hour", slide: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """ST7, ST8: sliding means of each metric above the threshold, with a watermark for late events."""
    means = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return means.filter((F.col("n") >= least) & (F.col("mean") > threshold)).select(F.col("window.start").alias("start"), "event_type", "n", "mean")


def file_stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # As a pattern, so that a table of one file is as good as a folder.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run the stream over what is there now, into Parquet in the shared folder, and read the result."""
    spark = stream.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or own_folder(spark)
    path = os.path.join(base, f"stream-{uuid.uuid4().hex}")
    schema = stream.schema
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/out")
