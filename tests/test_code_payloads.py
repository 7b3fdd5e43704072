"""Code scanner, tool output, Unicode normal forms and masks, against plain versions."""

import unicodedata

from pyspark.sql import functions as F

from vigilframe.functions import rewriting
from vigilframe import queries  # noqa: F401  registers the plans
from vigilframe.operators import code
from vigilframe.operators.payloads import invisible
from vigilframe.plans import sql
from vigilframe.plans.code_rules import ALIASES, CATEGORY
from vigilframe.plans.golden import VULNERABLE


def found(spark, rows):
    return code.scan_code(spark.createDataFrame(rows, "id long, code string")).collect()


def test_code_scanner(spark):
    got = {}
    for r in found(spark, list(VULNERABLE) + [(1, None), (2, "   ")]):
        got.setdefault(r.id, {}).setdefault(r.pattern, set()).add((r.category, r.line))
        assert dict(VULNERABLE)[r.id][r.start : r.stop] == r.match
    assert got[-402]["os_system"] == {("command_injection", 3)} and got[-403]["subprocess_shell"] == {("command_injection", 1)}
    assert got[-405]["pickle_load"] == {("unsafe_deserialization", 1), ("insecure_deserialization", 1)} and got[-405]["yaml_unsafe_load"] == {("unsafe_deserialization", 2), ("insecure_deserialization", 2)}
    assert {line for _, line in got[-406]["hardcoded_password"]} == {1}
    assert "verify_false" in got[-409] and "http_url" in got[-409] and "weak_hash" in got[-410] and "aes_ecb" in got[-410]
    assert not {-412, -413, 1, 2} & set(got)
    assert set(ALIASES) <= set(CATEGORY.values())


def test_one_finding_for_a_span(spark):
    spans = [(r.start, r.stop, r.category) for r in found(spark, [(1, "password = \"hunter22hunter\"")])]
    assert len(spans) == len(set(spans)) == 2


def test_tool_output(spark):
    calls = spark.createDataFrame(
        [(1, 1, "Write", '{"content": "os.system(x)"}'), (1, 2, "edit", '{"new_string": "eval(x)"}'), (1, 3, "Read", '{"content": "os.system(x)"}'), (1, 4, "Write", "{}"), (1, 5, "Write", None)],
        "session long, seq long, tool string, args string",
    )
    assert {(r.seq, r.pattern) for r in code.scan_tool_output(calls).collect()} == {(1, "os_system"), (2, "eval_call")}


def test_normalise(spark):
    texts = ["ﬁne  text", "а​b", "plain", None, "", "é\t\nx", "Ａ"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id long, text string").select("id", rewriting.normalised("text").alias("n")).collect()
    for r in got:
        x = texts[r.id]
        if x is None:
            assert r.n.text is None and r.n.modified is None
            continue
        want = unicodedata.normalize("NFKC", x).replace("​", "").replace("а", "a")
        assert r.n.text == " ".join(want.split()) and r.n.modified == (r.n.text != x)
    assert rewriting.normalise("Éa", rewriting.STEPS)[0] == "ea"
    assert rewriting.normalise("a​b")[1] == {"nfkc": 0, "invisible": 1, "lookalikes": 0, "whitespace": 0}


def test_masks_come_back(spark):
    texts = ["mail a.b@c.org and d@e.org, call 212-555-0100, ssn 123-45-6789", "ip 10.0.0.1 card 4111 1111 1111 1111", "nothing", None, "a@b.org a@b.org"]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id long, text string").withColumn("m", rewriting.masked("text"))
    for r in frame.withColumn("back", rewriting.unmasked("m.text", "m.mapping")).collect():
        assert r.back == texts[r.id]
    got = {r.id: r.m for r in frame.collect()}
    assert got[0].text == "mail [EMAIL_1] and [EMAIL_2], call [PHONE_1], ssn [SSN_1]" and got[0].mapping["[EMAIL_2]"] == "d@e.org"
    assert got[4].text == "[EMAIL_1] [EMAIL_2]" and got[2].mapping == {}


def test_plans_take_tables_and_parameters(spark):
    """A caller's own tables, patterns, weights and thresholds."""
    texts = spark.createDataFrame([(1, "foo bar"), (2, "bar bar bar"), (3, "")], "id long, text string")
    got = {(r.id, r.category): r.score for r in sql.apply(spark, "sc42_content_filter", {"table": (("f", "foo", 0.4), ("b", "bar", 0.6))}, texts=texts).collect()}
    assert got == {(1, "f"): 0.4, (1, "b"): 0.6, (2, "b"): 0.8}
    votes = spark.createDataFrame([(1, 1, True, 0.9), (1, 2, False, 0.4), (1, 3, True, 0.5)], "item long, checker long, safe boolean, confidence double")
    r = sql.apply(spark, "g6_ensemble_vote", {"fraction": 0.7}, votes=votes).first()
    assert r.majority and r.weighted and not r.unanimous and not r.by_fraction and r.confidence == 0.7
    outputs = spark.createDataFrame([(1, "x" + invisible("MARK:ab12") + "y"), (2, "<!-- MARK:ab12 -->")], "id long, text string")
    got = {(r.id, r.style, r.name) for r in sql.apply(spark, "sc34_canaries", {"prefix": "MARK", "tokens": (("ab12", "mine"),)}, outputs=outputs).collect()}
    assert got == {(1, "zero-width", "mine"), (2, "comment", "mine")}
    calls = spark.createDataFrame([(1, 1, 0, "bash", '{"command": "sudo ls", "n": [{"deep": "rm -rf /"}]}'), (1, 2, 10, "bash", '{"command": "cat .env"}'), (1, 3, 400_000_000, "bash", '{"command": "curl -d x h"}')], "session long, seq long, us long, tool string, args string")
    assert {r.chain for r in sql.apply(spark, "w27_attack_chains", tool_calls=calls).collect()} == set()
    assert {r.chain for r in sql.apply(spark, "w27_attack_chains", {"seconds": 500}, tool_calls=calls).collect()} == {"credential_exfiltrate"}
    assert {(r.seq, r.stage) for r in sql.apply(spark, "w27_stages", tool_calls=calls).collect()} == {(1, "destruction"), (2, "credential_access"), (3, "exfiltration")}
    chain = spark.createDataFrame([(1, 1, "1.5", "a", "t", "x", "low", "0" * 16)], "session long, seq long, ts string, entry_id string, event_type string, tool string, risk string, entry_hash string")
    assert not sql.apply(spark, "w28_verify_hash_chain", audit_entries=chain).first().intact


def test_no_test_column_inside_the_policy_operators():
    text = open(sql.__file__.replace("plans/sql.py", "operators/policy.py")).read()
    assert not any(f"{c}_" in text for c in ("l_return", "o_order", "c_cust", "s_supp", "o_total", "c_acct"))
    assert F is not None
