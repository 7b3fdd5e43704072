"""Sources and sinks: texts, manifests, request bodies, policies and audit logs in; JSON lines, SARIF and metrics out."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


# Levels by risk; colours of a badge from a score on.
LEVELS = ("note", "note", "warning", "error", "error")
RISKS = ("none", "low", "medium", "high", "critical")
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
SHADES = ((90, "#4c1"), (80, "#97ca00"), (70, "#a4a61d"), (60, "#dfb317"), (50, "#fe7d37"))
WORST = "#e05d44"


def texts(spark: SparkSession, values) -> DataFrame:
    """SRC1: an in-memory list as doc_id, text."""
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")


def files(spark: SparkSession, path: str, pattern: str = "*", most: int | None = None) -> DataFrame:
    """SRC3: path and whole text of each file; `most` only where a caller wants a sample."""
    out = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", F.decode("content", "UTF-8").alias("text"))
    return out.limit(most) if most else out


def requirements(manifests: DataFrame) -> DataFrame:
    """SC23, SRC4: filename, line, package, pin and version of each requirement in manifests(filename, content)."""
    lines = manifests.select("filename", F.posexplode(F.split("content", "\n")).alias("n", "raw")).withColumn("raw", F.trim(F.regexp_replace("raw", "#.*", "")))
    name, pin = F.regexp_extract("raw", r"^([A-Za-z0-9._-]+)", 1), F.regexp_extract("raw", r"(==|>=|<=|~=|!=|>|<|\*)", 1)
    return lines.filter("raw <> ''").select("filename", (F.col("n") + 1).alias("line"), F.lower(name).alias("package"), pin.alias("pin"), F.regexp_extract("raw", r"[=<>~!]=?\s*([0-9][^,; ]*)", 1).alias("version"))


def requirement_findings(reqs: DataFrame, malicious: DataFrame) -> DataFrame:
    """SC23: known-malicious (4), wildcard (2), unpinned and lower bound only (1), one of each kind for a line."""
    bad = reqs.join(malicious.select(F.lower("package").alias("package")).distinct(), "package", "left_semi").select("filename", "line", F.lit("malicious").alias("kind"), F.lit(4).alias("risk"))
    loose = F.when(F.col("pin") == "*", F.struct(F.lit("wildcard").alias("kind"), F.lit(2).alias("risk"))).when(F.col("pin") == "", F.struct(F.lit("unpinned").alias("kind"), F.lit(1).alias("risk"))).when(F.col("pin").isin(">=", ">"), F.struct(F.lit("lower bound only").alias("kind"), F.lit(1).alias("risk")))
    return bad.unionByName(reqs.withColumn("f", loose).filter("f IS NOT NULL").select("filename", "line", "f.kind", "f.risk")).distinct()


def request_text(body: str | Column) -> Column:
    """SRC10: system prompt and user messages of a chat request body (JSON), joined by blanks."""
    parsed = F.from_json(F.col(body) if isinstance(body, str) else body, "system string, messages array<struct<role:string,content:string>>")
    users = F.transform(F.filter(parsed["messages"], lambda m: m["role"] == "user"), lambda m: m["content"])
    return F.concat_ws(" ", parsed["system"], F.array_join(F.coalesce(users, F.array().cast("array<string>")), " "))


def policy(spark: SparkSession, text: str) -> DataFrame:
    """SRC5: a JSON policy (or YAML where a parser is installed) as a table of rules."""
    try:
        data = json.loads(text)
    except ValueError:
        import yaml

        data = yaml.safe_load(text)
    rows = [(r.get("name"), r.get("condition"), r.get("pattern"), r.get("action", "warn"), int(r.get("priority", 0)), bool(r.get("enabled", True))) for r in data.get("rules", [])]
    return spark.createDataFrame(rows, "name string, condition string, pattern string, action string, priority int, enabled boolean")


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    """SRC6: an exported audit log, whichever spelling its keys have."""
    raw = spark.read.option("multiLine", True).json(path)
    names = set(raw.columns)
    pick = lambda a, b: F.coalesce(*[F.col(c) for c in (a, b) if c in names]) if names & {a, b} else F.lit(None)
    return raw.select(pick("entry_id", "entryId").cast("string").alias("entry_id"), pick("event_type", "eventType").cast("string").alias("event_type"), pick("tool_name", "toolName").cast("string").alias("tool_name"), pick("risk", "riskLevel").cast("string").alias("risk"))


def sarif(findings: DataFrame, levels=LEVELS) -> DataFrame:
    """SNK3: SARIF 2.1.0 results of each scanner, one row for each result: a run is the rows of one scanner, in parts."""
    level = F.get(F.array(*map(F.lit, levels)), F.col("risk"))
    region = F.struct(F.col("start").alias("charOffset"), (F.col("stop") - F.col("start")).alias("charLength"))
    place = F.array(F.struct(F.struct(F.struct(F.col("doc_id").cast("string").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    return findings.select("scanner", F.to_json(F.struct(F.col("name").alias("ruleId"), level.alias("level"), F.struct(F.col("name").alias("text")).alias("message"), place.alias("locations"))).alias("result"))


def sarif_logs(findings: DataFrame, version: str = "1", tool: str = "vigilframe") -> DataFrame:
    """SNK3: whole SARIF 2.1.0 logs (schema, version, one run with the tool, its rules and the results), one in each row;
    write it as text, a file for each row's worth. A log holds one Arrow batch of findings (spark.sql.execution.arrow.
    maxRecordsPerBatch), so that none grows with the input; rules are those of its results, in order of appearance."""
    rows = findings.select("scanner", "name", F.col("doc_id").cast("string").alias("uri"), F.get(F.array(*map(F.lit, LEVELS)), F.col("risk")).alias("level"), "start", "stop")

    def run(frames: Iterator):
        import pandas as pd

        for pdf in frames:
            places: dict[str, int] = {}
            rules, results = [], []
            for scanner, name, uri, level, start, stop in pdf.itertuples(index=False, name=None):
                rule = f"{scanner}/{name}"
                if rule not in places:
                    places[rule] = len(rules)
                    rules.append({"id": rule, "name": name, "shortDescription": {"text": name.replace("_", " ")}, "defaultConfiguration": {"level": level}})
                place = {"artifactLocation": {"uri": uri}}
                if start == start and start is not None:
                    place["region"] = {"charOffset": int(start), "charLength": int(stop) - int(start)}
                results.append({"ruleId": rule, "ruleIndex": places[rule], "level": level, "message": {"text": name}, "locations": [{"physicalLocation": place}]})
            if results:
                driver = {"name": tool, "version": version, "rules": rules}
                yield pd.DataFrame({"results": [len(results)], "log": [json.dumps({"$schema": SARIF_SCHEMA, "version": "2.1.0", "runs": [{"tool": {"driver": driver}, "results": results}]})]})

    return rows.mapInPandas(run, "results long, log string")


def markdown(report: DataFrame, title: str, order: str | None = None) -> DataFrame:
    """SNK4: a report as Markdown lines: place and line. Write the lines by place. Bars and line ends in cells are escaped."""
    cells = [F.regexp_replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\R", " ") for c in report.columns]
    body = report.select(F.concat(F.lit("| "), F.array_join(F.array(*cells), " | "), F.lit(" |")).alias("line"), *([F.col(order).cast("string").alias("by")] if order else [F.lit("").alias("by")]))
    head = [f"# {title}", "", "| " + " | ".join(report.columns) + " |", "|" + "---|" * len(report.columns)]
    top = report.sparkSession.createDataFrame([(i, "", x) for i, x in enumerate(head)], "part int, by string, line string")
    return top.unionByName(body.withColumn("part", F.lit(len(head)))).select("part", "by", "line").orderBy("part", "by", "line").select("line")


def badge(score: Column, label: str = "security") -> Column:
    """SNK4: a flat SVG badge of a score from 0 to 100."""
    shade = F.coalesce(*[F.when(score >= least, F.lit(x)) for least, x in SHADES], F.lit(WORST))
    left, right = 13 * len(label) // 2 + 20, 60
    before = f'<svg xmlns="http://www.w3.org/2000/svg" width="{left + right}" height="20" role="img"><rect width="{left}" height="20" fill="#555"/><rect x="{left}" width="{right}" height="20" fill="'
    text = f'"/><g fill="#fff" font-family="Verdana,sans-serif" font-size="11" text-anchor="middle"><text x="{left / 2}" y="14">{label}</text><text x="{left + right / 2}" y="14">'
    return F.concat(F.lit(before), shade, F.lit(text), score.cast("int").cast("string"), F.lit("/100</text></g></svg>"))


def scan_events(guarded: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """SNK7: one structured log record for each scan of scanners.guard, as JSON: its attributes, no text."""
    kinds = F.array_sort(F.array_distinct(F.transform("findings", lambda x: x["scanner"])))
    facts = F.struct("safe", "blocked", F.get(F.array(*map(F.lit, RISKS)), F.col("risk")).alias("risk"), F.col("n_findings").alias("findings_count"), kinds.alias("categories"))
    return guarded.select(*keep, F.to_json(F.struct(F.lit("scan").alias("name"), facts.alias("attributes"))).alias("event"))


def observed(guarded: DataFrame, name: str = "scans") -> tuple[DataFrame, Observation]:
    """SNK7: the frame, and totals that fill while whatever is done with it runs (no second pass): scans, blocked, safe,
    findings, and scans by risk. On a stream use DataFrame.observe with a listener."""
    count = lambda when: F.count(F.when(when, 1))
    watch = Observation(name)
    by_risk = [count(F.col("risk") == i).alias(f"risk_{r}") for i, r in enumerate(RISKS)]
    return guarded.observe(watch, F.count(F.lit(1)).alias("scans"), count(F.col("blocked")).alias("blocked"), count(F.col("safe")).alias("safe"), F.coalesce(F.sum("n_findings"), F.lit(0)).alias("findings"), *by_risk), watch


def suite(spark: SparkSession, text: str) -> DataFrame:
    """SRC7: a suite of cases in JSON (or YAML where a parser is installed) as suite, case_id, text, expected, category and
    description. A case without input, expected_risk or category is an error that names it."""
    try:
        data = json.loads(text)
    except ValueError:
        import yaml

        data = yaml.safe_load(text)
    rows = []
    for i, case in enumerate(data["cases"]):
        if lacks := [k for k in ("input", "expected_risk", "category") if k not in case]:
            raise ValueError(f"case {i} lacks {', '.join(lacks)}")
        rows.append((data.get("name", "custom"), i, case["input"], bool(case["expected_risk"]), case["category"], case.get("description", "")))
    return spark.createDataFrame(rows, "suite string, case_id long, text string, expected boolean, category string, description string")


def hook_events(raw: DataFrame, body: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """SRC9: keep, tool and args (JSON) of hook events, a JSON object in each row of a table or stream. Blank and malformed
    events, and those without a tool, stay with a null tool; absent arguments are an empty object."""
    event = F.from_json(F.col(body), "tool_name string, tool_input string")
    tool = F.nullif(event["tool_name"], F.lit(""))
    return raw.select(*keep, tool.alias("tool"), F.when(tool.isNotNull(), F.coalesce(event["tool_input"], F.lit("{}"))).alias("args"))


def json_lines(df: DataFrame, path: str) -> None:
    """SNK1, SNK2."""
    df.write.json(path)


def prometheus(metrics: DataFrame) -> DataFrame:
    """SNK6: metrics(name, labels map, value) as text lines, labels in order."""
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')))
    return metrics.select(F.concat("name", F.lit("{"), F.array_join(pairs, ","), F.lit("} "), F.col("value").cast("string")).alias("line"))


def alerts(findings: DataFrame, trigger_on: int) -> DataFrame:
    """SNK5: what a webhook sink would send; use with foreachBatch."""
    return findings.filter(F.col("risk") >= trigger_on).select(F.to_json(F.struct("*")).alias("payload"))
