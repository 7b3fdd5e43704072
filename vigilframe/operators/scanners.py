"""Scanners and the guard: text column in, findings out, in one projection without a shuffle.

`with_findings` unrolls a rule table into an array column; `scan` explodes it to one row for each finding; `guard` reduces it in
place to the risk, the block decision and the redacted text, so that texts without findings stay. Texts that occur more
than once can be scanned once with `guard_distinct`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.functions.text import HIGH, LOW, MEDIUM, NONE, col, luhn_valid, pinned, redact, without_overlaps, words
from vigilframe.operators.obfuscation import hidden_terms, suspicious
from vigilframe.plans.rules import AGGRESSIVE, DEFAULT, HEDGING, INJECTION_TOKENS, PLACEHOLDER, SECRETS, Rule

FINDING = "struct<scanner:string,name:string,risk:int,start:int,stop:int,match:string>"
#: Cheap patterns that must be found before the rule's own is tried.
FIRST = {"CREDIT_CARD": "[0-9]{4}", "PHONE_US": "[0-9]{4}", "IP_ADDRESS": r"[0-9]\.[0-9]", "SSN": "[0-9]-[0-9]"}
#: Rules whose first group is the secret that is held against the placeholders.
GROUPED = ("aws_secret_key", "generic_secret", "stripe_key")


def has_needle(low: Column, needles: tuple[str, ...]) -> Column | None:
    out = None
    for n in needles:
        one = F.contains(low, F.lit(n))
        out = one if out is None else out | one
    return out


def _present(text: Column, low: Column, rule: Rule) -> Column:
    when = text.rlike(rule.pattern)
    if rule.name in FIRST:
        when = text.rlike(FIRST[rule.name]) & when
    needle = has_needle(low, rule.needles)
    return when if needle is None else needle & when


def _hit(text: Column, low: Column, rule: Rule) -> Column:
    """The rule with its matches and the pieces between them, or null."""
    row = F.struct(F.lit(rule.scanner).alias("scanner"), F.lit(rule.name).alias("name"), F.lit(rule.risk).alias("risk"), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("m"), F.split(text, rule.pattern, -1).alias("b"))
    return F.when(_present(text, low, rule), row)


def _located(hit: Column) -> Column:
    """A finding for each match: the pieces before it and the matches before it give its place."""
    return F.aggregate(
        F.arrays_zip(hit["m"].alias("m"), F.slice(hit["b"], 1, F.size(hit["m"])).alias("b")),
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{FINDING}>").alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["b"]) + F.length(x["m"])).alias("at"),
            F.concat(a["out"], F.array(F.struct(hit["scanner"], hit["name"], hit["risk"], (a["at"] + F.length(x["b"])).alias("start"), (a["at"] + F.length(x["b"]) + F.length(x["m"])).alias("stop"), x["m"].alias("match")))).alias("out"),
        ),
        lambda a: a["out"],
    )


def _whole(condition: Column, scanner: str, name: str, risk: int) -> Column:
    row = F.struct(F.lit(scanner).alias("scanner"), F.lit(name).alias("name"), F.lit(risk).alias("risk"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("stop"), F.lit(None).cast("string").alias("match"))
    return F.when(condition, row)


def density(text) -> Column:
    """Share of the words that speak of instructions and roles."""
    low = F.lower(col(text))
    ws = words(low)
    hit = F.filter(ws, lambda w: F.regexp_replace(w, r"^[.,!?;:\"'()\[\]{}]+|[.,!?;:\"'()\[\]{}]+$", "").isin(*INJECTION_TOKENS))
    # A text without any of the words, as substrings, is not split at all.
    return F.when(has_needle(low, INJECTION_TOKENS) & (F.size(ws) > 0), F.size(hit) / F.size(ws)).otherwise(0.0)


def _genuine(x: Column, names: set[str]) -> Column:
    """Card numbers must pass the Luhn check; secrets must not be placeholders."""
    out = F.lit(True)
    if "CREDIT_CARD" in names:
        out = out & ((x["name"] != "CREDIT_CARD") | luhn_valid(x["match"]))
    if names & {r.name for r in SECRETS}:
        value = x["match"]
        for r in SECRETS:
            if r.name in GROUPED:
                value = F.when(x["name"] == r.name, F.regexp_extract(x["match"], r.pattern, 1)).otherwise(value)
        out = out & ((x["scanner"] != "secrets") | ~value.rlike(PLACEHOLDER))
    return out


def with_findings(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = DEFAULT, heuristics: bool = True, hidden: bool = False) -> DataFrame:
    """df with findings: all findings of the rules in rule order, those of a text as a whole, and, if hidden, dangerous
    terms that encodings hide. Null texts have none.

    A text meets every pattern once, to see whether any is there. Only texts with one have their matches taken out, which
    runs in expressions that aren't compiled; most texts end there."""
    body, low = F.col("__body"), F.col("__low")
    none = F.array().cast(f"array<{FINDING}>")
    out = df.withColumn("__body", F.coalesce(F.col(text), F.lit(""))).withColumn("__low", pinned(F.lower("__body")))
    some = reduce(lambda a, b: a | b, [_present(body, low, r) for r in rules], F.lit(False))
    out = out.withColumn("__some", pinned(some))
    out = out.withColumn("__hits", pinned(F.when(F.col("__some"), F.filter(F.array(*[_hit(body, low, r) for r in rules]), lambda x: x.isNotNull()))))
    genuine = F.filter(F.flatten(F.transform("__hits", _located)), lambda x: _genuine(x, {r.name for r in rules}))
    out = out.withColumn("findings", pinned(F.when(F.col("__some"), genuine).otherwise(none)))
    scanners, whole = {r.scanner for r in rules} if heuristics else set(), []
    if "hallucination" in scanners:
        whole.append(_whole(has_needle(low, HEDGING.needles) & (F.regexp_count(body, F.lit(HEDGING.pattern)) >= 3), "hallucination", HEDGING.name, HEDGING.risk))
    if "toxicity" in scanners:
        loud = F.when(F.contains(body, F.lit("!!")), F.regexp_count(body, F.lit(AGGRESSIVE[1]))).otherwise(0)
        whole.append(_whole(F.regexp_count(body, F.lit(AGGRESSIVE[0])) + loud >= 2, "toxicity", "aggressive_tone", LOW))
    if "prompt_injection" in scanners:
        clear = ~F.exists("findings", lambda x: x["scanner"] == "prompt_injection")
        whole.append(_whole(clear & (density(body) > 0.7), "prompt_injection", "density", MEDIUM))
    parts = ["findings"] + ([F.filter(F.array(*whole), lambda x: x.isNotNull())] if whole else [])
    if hidden:
        unseen = lambda x: F.struct(F.lit("obfuscation").alias("scanner"), x["kind"].alias("name"), x["risk"].alias("risk"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("stop"), x["decoded"].alias("match"))
        parts.append(F.when(suspicious(body, low), F.transform(hidden_terms(body, low), unseen)).otherwise(none))
    if len(parts) > 1:
        out = out.withColumn("findings", pinned(F.concat(*parts)))
    return out.drop("__body", "__low", "__some", "__hits")


def scan(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = DEFAULT, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each finding: keep, scanner, name, risk, start, stop, match."""
    return with_findings(df.select(*keep, text), text, rules).select(*keep, F.inline("findings"))


def blocked_at(risk, threshold: int = HIGH) -> Column:
    return col(risk) >= threshold


def redacted(text, found) -> Column:
    """PII spans replaced by [TYPE]; of overlapping ones the earliest stays."""
    is_pii = lambda x: x["scanner"] == "pii"
    pii = F.array_sort(F.filter(col(found), is_pii), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["stop"] - a["stop"]))
    clean = redact(text, without_overlaps(pii), lambda x: F.concat(F.lit("["), x["name"], F.lit("]")))
    return F.when(F.exists(col(found), is_pii), clean).otherwise(col(text))


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, where it has fewer (a table of few row groups): scanning a text takes
    far longer than moving it. A table of more partitions stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def guard(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = DEFAULT, threshold: int = HIGH, hidden: bool | None = None) -> DataFrame:
    """df with findings, n_findings, risk, blocked, safe and redacted_text. hidden: look for what encodings hide as well;
    the default guard does."""
    out = with_findings(spread(df), text, rules, hidden=rules is DEFAULT if hidden is None else hidden)
    out = out.withColumn("n_findings", F.size("findings")).withColumn("risk", F.coalesce(F.array_max(F.transform("findings", lambda x: x["risk"])), F.lit(NONE)))
    out = out.withColumn("blocked", blocked_at("risk", threshold))
    return out.withColumn("safe", ~F.col("blocked") & (F.col("risk") <= LOW)).withColumn("redacted_text", redacted(text, "findings"))


def guard_distinct(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = DEFAULT, threshold: int = HIGH) -> DataFrame:
    """guard, each distinct text scanned once: the cache of a stream of requests, as a join."""
    key = F.sha2(F.col(text), 256)
    once = guard(df.select(text).distinct(), text, rules, threshold).withColumn("__key", key).drop(text)
    return df.withColumn("__key", key).join(once, "__key", "left").drop("__key")


def blocked_terms(df: DataFrame, terms: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """term and how often each text has it, case ignored. terms(term): the caller's; empty and null ones are left out.

    Texts and terms meet by a term's first three characters (all of a shorter one's), so a list of any length is an
    equi-join; what meets is held against the whole term."""
    p = "__term_"
    words = terms.select(F.lower("term").alias("term")).filter("term <> ''").distinct().withColumn(p + "first", F.substring("term", 1, 3))
    low = df.select(*keep, F.lower(F.col(text)).alias(p + "low")).withColumn(p + "row", F.monotonically_increasing_id())

    def grams_of(n):
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(p + "low") - n + 1, F.lit(1))), lambda i: F.substr(F.col(p + "low"), i, F.lit(n)))

    grams = F.array_distinct(F.flatten(F.array(*map(grams_of, (1, 2, 3)))))
    hit = low.withColumn(p + "first", F.explode(grams)).join(words, p + "first").filter(F.contains(p + "low", "term"))
    n = (F.length(p + "low") - F.length(F.replace(F.col(p + "low"), F.col("term"), F.lit("")))) / F.length("term")
    return hit.select(*keep, "term", n.cast("long").alias("n"))


def kept_spans(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = DEFAULT, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The located findings of each text without those that start before the last one kept ends; of those that start
    together the first in rule order stays. One row for each: keep, scanner, name, risk, start, stop, match."""
    found = with_findings(df.select(*keep, text), text, rules, heuristics=False)
    # By start, then by the place in rule order.
    placed = F.array_sort(F.transform("findings", lambda x, i: F.struct(x["start"].alias("start"), i.alias("i"), x["stop"].alias("stop"), x.alias("x"))))
    return found.withColumn("findings", pinned(F.transform(without_overlaps(placed), lambda s: s["x"]))).select(*keep, F.inline("findings"))
