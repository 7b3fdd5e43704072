"""Queries and SQL of the library's own operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilframe.functions import rewriting
from vigilframe.functions import text as T
from vigilframe.operators import code, conversation, detectors, graph, hooks, near_pairs, obfuscation, payloads, policy, privacy, reports, scalars, scanners, schemas, similarity, usage  # noqa: F401  registers plans
from vigilframe.plans import rules
from vigilframe.plans.golden import CASES, OBFUSCATED, VULNERABLE
from vigilframe.plans.scored_sql import scored_sql
from vigilframe.plans.sql import PLANS, frame, oracle, query
from vigilframe.sources import io
from vigilframe.streaming import guards


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def guard_scan(spark, sf_dir):
    """SC1-SC7, SC18, G1-G3: findings of all scanners, risk, decision and redaction for each document."""
    return scanners.guard(_table(spark, sf_dir, "documents")).select("doc_id", "n_findings", "risk", "blocked", "safe", "redacted_text")


#: Rules that mean the same to every engine: no look-around, no check of the match, ASCII text.
PORTABLE = tuple(r for r in rules.PROMPT_INJECTION + rules.PII + rules.HARMFUL + rules.HALLUCINATION + rules.TOXICITY + rules.TOOL_USE + rules.SECRETS if "(?!" not in r.pattern and "\\u" not in r.pattern and r.name not in ("CREDIT_CARD", *scanners.GROUPED))


def sc_rule_counts(spark, sf_dir):
    """SC1-SC7, SC18: matches of every portable rule over documents and the golden texts, as ASCII."""
    golden = spark.createDataFrame([(i, t) for i, t, _ in CASES], "doc_id long, text string")
    both = _table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(golden).withColumn("text", T.ascii_only("text"))
    found = scanners.with_findings(scanners.spread(both), "text", PORTABLE, heuristics=False).select("doc_id", F.inline("findings"))
    return found.groupBy("scanner", F.col("name").alias("rule")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"), F.max("risk").alias("risk"))


def _rule_counts_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    golden = ", ".join(f"({i}, {quote(t)})" for i, t, _ in CASES)
    parts = " UNION ALL ".join(f"SELECT {quote(r.scanner)} AS scanner, {quote(r.name)} AS rule, {r.risk} AS risk, doc_id, len(regexp_extract_all(t, {quote(r.pattern)})) AS k FROM d" for r in PORTABLE)
    return f"""WITH d AS (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g') AS t FROM (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {golden}) AS g(doc_id, text)) a), m AS ({parts})
        SELECT scanner, rule, CAST(sum(k) AS BIGINT) AS n, count(DISTINCT doc_id) AS docs, max(risk) AS risk FROM m WHERE k > 0 GROUP BY scanner, rule"""


def sc_golden(spark, sf_dir):
    """The golden texts scored by category presence."""
    golden = spark.createDataFrame(list(CASES), "doc_id long, text string, expected string")
    found = scanners.with_findings(golden, "text", rules.DEFAULT).select("doc_id", "expected", F.transform("findings", lambda x: x["scanner"]).alias("got"))
    hit = F.when(F.col("expected").isNull(), F.size("got") == 0).otherwise(F.array_contains("got", F.col("expected")))
    return found.groupBy(F.coalesce("expected", F.lit("clean")).alias("category")).agg(F.count(F.lit(1)).alias("cases"), F.count(F.when(hit, 1)).alias("right"))


def g5_scan_metrics(spark, sf_dir):
    """Totals, block rate and distributions by risk."""
    out = scanners.guard(_table(spark, sf_dir, "documents"), rules=rules.PII + rules.TOXICITY)
    return out.groupBy("risk").agg(F.count(F.lit(1)).alias("texts"), F.avg(F.col("blocked").cast("double")).alias("block_rate"), F.sum("n_findings").alias("findings"))


def g4_guard_distinct(spark, sf_dir):
    """Each distinct text scanned once."""
    return scanners.guard_distinct(_table(spark, sf_dir, "documents"), rules=rules.PII).select("doc_id", "risk", "redacted_text")


def sc3_redacted_conversations(spark, sf_dir):
    """Turns with personal data replaced."""
    return scanners.guard(_table(spark, sf_dir, "conversations"), rules=rules.PII).select("conv_id", "turn", "redacted_text")


def sc21_code_scanner(spark, sf_dir):
    """SC21: vulnerable code in the documents and in snippets by hand."""
    snippets = spark.createDataFrame(list(VULNERABLE), "id long, code string")
    return code.scan_code(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("code")).unionByName(snippets))


def f16_normalise(spark, sf_dir):
    """F16: every document normalised, with the characters that each step changed."""
    return _table(spark, sf_dir, "documents").select("doc_id", rewriting.normalised("text").alias("n")).select("doc_id", F.col("n.text").alias("text"), F.to_json("n.changed").alias("changed"), "n.modified")


def f19_mask(spark, sf_dir):
    """every document masked with numbered placeholders, and what they stand for."""
    return _table(spark, sf_dir, "documents").select("doc_id", rewriting.masked("text").alias("m")).select("doc_id", F.col("m.text").alias("text"), F.to_json("m.mapping").alias("mapping"))


def snk3_sarif(spark, sf_dir):
    return io.sarif(scanners.scan(_table(spark, sf_dir, "documents"), rules=rules.SECRETS + rules.PII))


def _edges(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 1500 + 1).alias("dst"))


def j17_reachable(spark, sf_dir):
    start = spark.createDataFrame([(1,)], "node long")
    return graph.reachable(_edges(spark, sf_dir), start).select("node")


def j18_components(spark, sf_dir):
    return graph.labels(_edges(spark, sf_dir))


def j18_cycles(spark, sf_dir):
    return graph.on_cycles(_edges(spark, sf_dir))


def _guarded(make):
    def run(spark, sf_dir):
        return guards.drain(guards.by_key(guards.prepared(guards.file_stream(spark, sf_dir)), make()))

    return run


st2_token_bucket = _guarded(guards.token_bucket)
st3_violation_throttle = _guarded(guards.violation_throttle)
st5_circuit_breaker = _guarded(guards.circuit_breaker)
st6_expiring_cache = _guarded(guards.expiring_cache)


def st2_token_bucket_batch(spark, sf_dir):
    return guards.in_batch(guards.prepared(_table(spark, sf_dir, "events")), guards.token_bucket())


def st1_stream_guard(spark, sf_dir):
    """ST1: the turns of each conversation as the chunks of a stream."""
    turns = guards.file_stream(spark, sf_dir, "conversations").select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), F.col("text").alias("chunk"))
    return guards.drain(guards.stream_guard(turns, tuple(r.pattern for r in rules.PII[:3])))


def st7_window_alerts(spark, sf_dir):
    stream = guards.file_stream(spark, sf_dir)
    return guards.drain(guards.window_alerts(stream.withColumn("ts", F.col("ts").cast("timestamp"))))


def sc9_obfuscation(spark, sf_dir):
    """SC9-SC17 over documents and the golden texts."""
    golden = spark.createDataFrame([(i, t) for i, t, _ in OBFUSCATED], "doc_id long, text string")
    both = _table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(golden)
    return obfuscation.obfuscation(both).select("doc_id", F.inline("hidden"))


def _with_golden(spark, sf_dir):
    golden = spark.createDataFrame([(i, t) for i, t, _ in CASES], "doc_id long, text string")
    return _table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(golden)


def guard_verdicts(spark, sf_dir):
    """Risk and categories of the pattern scanners for every document and golden text, which SQL can express as a
    whole; the guard's redaction, spans and encodings are held against brute force in the tests."""
    found = scanners.with_findings(scanners.spread(_with_golden(spark, sf_dir)), "text")
    return conversation.verdicts(found, "doc_id").drop("text")


def _verdicts_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    golden = ", ".join(f"({i}, {quote(t)})" for i, t, _ in CASES)
    return f"SELECT doc_id, risk, categories, dangerous FROM ({scored_sql(scanners.GROUPED, conversation.DANGEROUS, f'(SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {golden}) AS g(doc_id, text))', 'doc_id, text')}) v"


def a10_private_counts(spark, sf_dir):
    """A10, A11."""
    return privacy.private_counts(_table(spark, sf_dir, "events"), "event_type", 1.0, 7)


def j22_kept_spans(spark, sf_dir):
    """Personal data and secrets of documents, overlapping spans dropped, the earliest staying."""
    return scanners.kept_spans(_table(spark, sf_dir, "documents"), rules=rules.PII + rules.SECRETS)


def t3_priority_queue(spark, sf_dir):
    """SNK8, T3: places over all events."""
    return usage.priority_queue(_table(spark, sf_dir, "events"))


def j4_word_gram_duplicates(spark, sf_dir):
    """Pairs of near duplicates, without a row for each gram."""
    return near_pairs.near_pairs(_table(spark, sf_dir, "documents"))


def snk3_sarif_logs(spark, sf_dir):
    """SNK3: whole logs of the secrets and personal data in documents."""
    return io.sarif_logs(scanners.scan(_table(spark, sf_dir, "documents"), rules=rules.SECRETS + rules.PII))


def snk7_scan_events(spark, sf_dir):
    """SNK7: a log record for each document's scan."""
    return io.scan_events(scanners.guard(_table(spark, sf_dir, "documents"), rules=rules.PII + rules.TOXICITY))


def sc33_tool_schemas(spark, sf_dir):
    """SC33: definitions by hand, and every turn as the description of a tool."""
    turns = _table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("id"), F.to_json(F.struct(F.lit("t").alias("name"), F.col("text").alias("description"))).alias("definition"))
    return schemas.findings(scanners.spread(turns).unionByName(spark.createDataFrame(list(schemas.TOOLS), "id long, definition string")))


def src9_hook_decisions(spark, sf_dir):
    """SRC9: every tool call of the inputs as a hook event, decided."""
    calls = frame(spark, sf_dir, "tool_calls")
    event = F.concat(F.lit('{"tool_name": "'), F.col("tool"), F.lit('", "tool_input": '), F.col("args"), F.lit("}"))
    return hooks.decisions(io.hook_events(calls.withColumn("value", event), keep=("session", "seq"))).withColumn("reasons", F.array_join("reasons", ","))


st4_adaptive_throttle = _guarded(lambda: guards.adaptive_throttle(base=6, window=86400.0, levels=(1, 2, 4), cooldown=21600.0))


_OWN = (sc33_tool_schemas, snk3_sarif_logs, snk7_scan_events, src9_hook_decisions, sc21_code_scanner, f16_normalise, f19_mask, j22_kept_spans, sc9_obfuscation, a10_private_counts, guard_scan, guard_verdicts, sc_rule_counts, sc_golden, g5_scan_metrics, g4_guard_distinct, sc3_redacted_conversations, snk3_sarif, j17_reachable, j18_components, j18_cycles, st1_stream_guard, st2_token_bucket_batch, st7_window_alerts)
QUERIES = {f.__name__: f for f in _OWN} | {name: query(name) for name in PLANS}
QUERIES |= {"st2_token_bucket": st2_token_bucket, "st3_violation_throttle": st3_violation_throttle, "st4_adaptive_throttle": st4_adaptive_throttle, "st5_circuit_breaker": st5_circuit_breaker, "st6_expiring_cache": st6_expiring_cache}
# In place of the plans, whose SQL checks them.
QUERIES |= {"t3_priority_queue": t3_priority_queue, "j4_word_gram_duplicates": j4_word_gram_duplicates}
_EDGES = "(SELECT o_custkey AS src, o_orderkey % 1500 + 1 AS dst FROM orders)"
SQL = {name: oracle(name) for name in PLANS} | {
    "sc_rule_counts": _rule_counts_sql(),
    "guard_verdicts": _verdicts_sql(),
    "j18_cycles": f"WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT src, dst FROM {_EDGES}), r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst) SELECT DISTINCT src AS node FROM r WHERE src = dst",
    "j17_reachable": f"WITH RECURSIVE r(node) AS (SELECT 1::BIGINT UNION SELECT e.dst FROM r JOIN {_EDGES} e ON e.src = r.node) SELECT node FROM r",
    "j18_components": f"WITH RECURSIVE b AS MATERIALIZED (SELECT src, dst FROM {_EDGES} UNION SELECT dst, src FROM {_EDGES}), r(node, component) AS (SELECT src, src FROM b UNION SELECT b.dst, r.component FROM r JOIN b ON b.src = r.node) SELECT node, min(component) AS component FROM r GROUP BY node",
}
