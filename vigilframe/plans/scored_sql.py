"""The scan of conversation turns as SQL for the independent engine: which rules of the table each turn meets."""

from __future__ import annotations

import re

from vigilframe.functions.text import LOW, MEDIUM
from vigilframe.plans.rules import AGGRESSIVE, DEFAULT, HEDGING, INJECTION_TOKENS, PLACEHOLDER


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _alternatives(body: str) -> list[str]:
    """The parts between the bars of a pattern's outermost group."""
    parts, depth, i = [""], 0, 0
    while i < len(body):
        step = 2 if body[i] == "\\" else 1
        depth += {"(": 1, ")": -1}.get(body[i], 0)
        if body[i] == "|" and depth == 0:
            parts.append("")
        else:
            parts[-1] += body[i : i + step]
        i += step
    return parts


def _present(rule, grouped) -> str:
    # RE2 has no flag u: it folds case over all letters as it is.
    pattern = rule.pattern.replace("(?iu)", "(?i)")
    every = f"regexp_extract_all(t, {_q(pattern)})"
    if rule.name == "CREDIT_CARD":
        digits = "regexp_replace(m, '[^0-9]', '', 'g')"
        doubled = f"CAST({digits}[i] AS INT) * (1 + i % 2)"
        return f"len(list_filter({every}, lambda m: list_sum(list_transform(range(1, 17), lambda i: {doubled} - CASE WHEN {doubled} > 9 THEN 9 ELSE 0 END)) % 10 = 0)) > 0"
    if rule.scanner == "secrets":
        value = f"regexp_extract(m, {_q(pattern)}, 1)" if rule.name in grouped else "m"
        return f"len(list_filter({every}, lambda m: NOT regexp_matches({value}, {_q(PLACEHOLDER)}))) > 0"
    if "(?!" not in pattern:
        return f"regexp_matches(t, {_q(pattern)})"
    # RE2 has no look-ahead: addresses that are let through are taken out before.
    body = pattern.removeprefix("(?i)")
    parts = _alternatives(body)
    if len(parts) == 1 and body.endswith("))"):
        parts = _alternatives(body[1:-1])
    out = []
    for x in parts:
        ahead = re.search(r"https\?://\(\?!(.*)\)$", x)
        text = "t" if ahead is None else f"regexp_replace(t, {_q(f'(?i)https?://(?:{ahead[1]})')}, ' ; ', 'g')"
        out.append(f"regexp_matches({text}, {_q('(?i)' + (x if ahead is None else x[: ahead.start()] + 'https?://'))})")
    return f"({' OR '.join(out)})"


def scored_sql(grouped: tuple[str, ...], dangerous: tuple[str, ...], source: str = "conversations", keys: str = "conv_id, turn, role, text") -> str:
    hits = [(r.scanner, r.risk, _present(r, grouped)) for r in DEFAULT]
    hits.append(("hallucination", HEDGING.risk, f"len(regexp_extract_all(t, {_q(HEDGING.pattern)})) >= 3"))
    hits.append(("toxicity", LOW, " + ".join(f"len(regexp_extract_all(t, {_q(p)}))" for p in AGGRESSIVE) + " >= 2"))
    rows = ", ".join(f"CASE WHEN {x} THEN {{'c': '{c}', 'r': {r}}} END" for c, r, x in hits)
    words = "regexp_extract_all(lower(t), '[^ \\t\\n\\r\\f\\v]+')"
    tokens = ", ".join(_q(x) for x in INJECTION_TOKENS)
    bare = "regexp_replace(regexp_replace(w, '^[.,!?;:\"''()\\[\\]{}]+', ''), '[.,!?;:\"''()\\[\\]{}]+$', '')"
    dense = f"len(list_filter({words}, lambda w: {bare} IN ({tokens}))) > 0.7 * len({words})"
    found = f"SELECT {keys}, t, list_filter([{rows}], lambda x: x IS NOT NULL) AS f FROM (SELECT *, coalesce(text, '') AS t FROM {source} s) a"
    dense = f"CASE WHEN NOT list_contains(list_transform(f, lambda x: x.c), 'prompt_injection') AND {dense} THEN list_append(f, {{'c': 'prompt_injection', 'r': {MEDIUM}}}) ELSE f END"
    names = "list_sort(list_distinct(list_transform(g, lambda x: x.c)))"
    some = ", ".join(_q(x) for x in dangerous)
    return f"""SELECT {keys}, CAST(coalesce(list_max(list_transform(g, lambda x: x.r)), 0) AS BIGINT) AS risk, {names} AS categories, list_has_any({names}, [{some}]) AS dangerous
        FROM (SELECT {keys}, {dense} AS g FROM ({found}) b) c"""
