"""Decisions over tool calls before they run, and suites of cases held against the guard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.functions.text import HIGH
from vigilframe.operators import policy  # noqa: F401  registers the plan
from vigilframe.operators.scanners import guard
from vigilframe.plans.sql import apply

# Tools that are not scanned, tools that write.
READ_ONLY = ("Read", "Glob", "Grep", "WebSearch", "WebFetch", "AskUserQuestion", "TodoRead", "ToolSearch")
WRITERS = ("Write", "Edit", "NotebookEdit")


def decisions(events: DataFrame, threshold: int = HIGH, read_only: tuple[str, ...] = READ_ONLY, writers: tuple[str, ...] = WRITERS, least: int = 10) -> DataFrame:
    """SRC9: session, seq, tool, blocked and reasons (the rules, in order) of events(session, seq, tool, args as JSON).
    A call is blocked where a finding reaches the threshold: of the tool-use rules over its name and all its strings
    (writers aside), or of the guard over top-level strings longer than `least` and over whatever a writer writes.
    Calls without a tool, of read-only tools and with unreadable arguments are allowed, as nothing in them can be scanned."""
    calls = events.select("session", "seq", "tool", "args")
    live = calls.filter(F.col("tool").isNotNull() & ~F.col("tool").isin(*read_only))
    used = apply(events.sparkSession, "sc8_tool_calls", tool_calls=live.filter(~F.col("tool").isin(*writers))).filter(F.col("risk") >= threshold).select("session", "seq", F.col("finding").alias("rule"))
    strings = F.expr("transform(filter(map_entries(from_json(args, 'map<string,variant>')), e -> schema_of_variant(e.value) = 'STRING'), e -> struct(e.key AS key, CAST(e.value AS STRING) AS said))")
    parts = live.select("session", "seq", "tool", F.inline(strings))
    written = F.col("tool").isin(*writers) & F.col("key").isin("content", "new_string")
    said = guard(parts.filter(written | (F.length("said") > least)), "said").select("session", "seq", F.inline("findings"))
    said = said.filter(F.col("risk") >= threshold).select("session", "seq", F.col("name").alias("rule"))
    reasons = used.unionByName(said).groupBy(F.col("session").alias("s"), F.col("seq").alias("q")).agg(F.array_sort(F.collect_set("rule")).alias("reasons"))
    # Null-safe, so that a call without a session or number isn't let through.
    out = calls.join(reasons, F.col("session").eqNullSafe(F.col("s")) & F.col("seq").eqNullSafe(F.col("q")), "left")
    return out.select("session", "seq", "tool", F.col("reasons").isNotNull().alias("blocked"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))


def evaluated(cases: DataFrame) -> DataFrame:
    """SRC7, A12: by suite and category, what the guard finds in cases(suite, text, expected, category): cases, passed, and
    the four counts. A case is detected where there is any finding."""
    seen = guard(cases).select("suite", "category", "expected", (F.col("n_findings") > 0).alias("seen"))
    count = lambda when, name: F.count(F.when(when, 1)).alias(name)
    e, s = F.col("expected"), F.col("seen")
    return seen.groupBy("suite", "category").agg(F.count(F.lit(1)).alias("cases"), count(e == s, "passed"), count(e & s, "true_positives"), count(~e & ~s, "true_negatives"), count(~e & s, "false_positives"), count(e & ~s, "false_negatives"))
